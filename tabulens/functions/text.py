"""Text scalars as Spark columns. All of them are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide what a cell is.
NULL_WORDS = ("", "na", "n/a", "nan", "null", "none", "missing")
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
PLAIN_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"
GROUPED_NUMBER = r"^[+-]?(?:(?:\d{1,3}(?:,\d{3})+)|(?:\d{1,3}(?:,\d{2})*,\d{3}))(?:\.\d+)?$"
PERCENTAGE = r"^[+-]?\d+(\.\d+)?\s*%$"
CURRENCY = r"^\s*[$€£₹]\s*[+-]?\d[\d,]*(\.\d+)?\s*$"
ISO_DATE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"
NUMERIC_DATE = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNIT = r"[A-Za-z%²$€£₹]+"
MEASURE = r"\d|[%$€£₹²]"
#: The signature of a number without a unit.
NO_UNIT = "unit:none"

#: What generic numeric coercion takes: also exponents and infinities.
GENERIC_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"

#: All white space that Python's str.strip takes off.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Only the ends of a cell are looked at; a regular expression would try every place of it."""
    return F.btrim(c, F.lit(SPACE))


def token(c: Column) -> Column:
    """A cell for comparison with word lists."""
    return F.lower(strip(c))


def is_null_word(c: Column) -> Column:
    return token(c).isin(*NULL_WORDS)


def null_words_out(c: Column) -> Column:
    return F.when(is_null_word(c), F.lit(None)).otherwise(c)


def blanks_out(c: Column) -> Column:
    return F.when(strip(c) == "", F.lit(None)).otherwise(c)


def to_number(c: Column) -> Column:
    """Plain numbers, and numbers grouped by thousands or the Indian way; anything else is null."""
    return number_in(strip(c))


def number_in(s: Column) -> Column:
    """to_number of a stripped cell."""
    return F.when(s.rlike(PLAIN_NUMBER) | s.rlike(GROUPED_NUMBER), F.regexp_replace(s, ",", "").try_cast("double"))


def to_number_generic(c: Column) -> Column:
    """What generic coercion reads as a number: exponents and infinities, but no grouped digits."""
    s = strip(c)
    word = F.lower(s)
    return F.when(s.rlike(GENERIC_NUMBER), s.try_cast("double")).when(word.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(word.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))


def to_boolean(c: Column) -> Column:
    return boolean_in(token(c))


def boolean_in(t: Column) -> Column:
    """to_boolean of a cell's token."""
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


#: Date patterns that are read whatever the policy, besides ISO with an optional time and zone.
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "MMM d yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMMM d, yyyy")
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy")
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def to_timestamp(c: Column, day_first: bool | None = None) -> Column:
    """Dates in a closed list of forms; day_first settles numeric dates, the other order serves where it alone fits.

    Free-form words such as `now`, bare times and bare years are no dates: they would depend on the clock.
    """
    return timestamp_in(strip(c), day_first)


def timestamp_in(s: Column, day_first: bool | None = None) -> Column:
    """to_timestamp of a stripped cell. Every form has a year of four digits and a sign or blank beside it, so other cells try none."""
    numeric = (DAY_FIRST + MONTH_FIRST) if day_first else (MONTH_FIRST + DAY_FIRST)
    named = F.initcap(s)
    tries = [F.when(s.rlike(ISO_TIME), F.regexp_replace(s, r"\s+(Z|[+-]\d{2}:?\d{2})$", "$1").try_cast("timestamp"))]
    tries += [F.when(s.rlike(ISO_DATE), F.try_to_timestamp(s, F.lit(p))) for p in DATE_PATTERNS[:3]]
    tries += [F.when(s.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"), F.try_to_timestamp(s, F.lit(p))) for p in numeric]
    tries += [F.when(s.rlike("[A-Za-z]{3}"), F.try_to_timestamp(named, F.lit(p))) for p in DATE_PATTERNS[3:]]
    return F.when(s.rlike(r"\d{4}") & s.rlike(r"[-/. ]"), F.coalesce(*tries))


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def title(c: Column) -> Column:
    """Each run of letters with a capital first: `they're a-b` becomes `They'Re A-B`."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


CASES = {"lower": lower, "upper": upper, "title": title}


def is_percentage(c: Column) -> Column:
    return strip(c).rlike(PERCENTAGE)


def is_currency(c: Column) -> Column:
    return c.rlike(CURRENCY)


def date_signature(c: Column) -> Column:
    return date_in(strip(c))


def date_in(s: Column) -> Column:
    """date_signature of a stripped cell."""
    named = s.rlike("[A-Za-z]{3,9}") & F.lower(s).rlike("|".join(MONTHS))
    return F.when(s.rlike(ISO_DATE), "iso_date").when(s.rlike(NUMERIC_DATE), "numeric_date").when(named, "named_date")


def has_unit(s: Column) -> Column:
    """Whether a stripped cell is a measure with units."""
    return s.rlike(MEASURE) & s.rlike(UNIT)


def units_in(s: Column) -> Column:
    """The signature of a stripped cell that has units."""
    return F.concat(F.lit("unit:"), F.array_join(F.array_sort(F.transform(F.regexp_extract_all(s, F.lit(UNIT), F.lit(0)), F.lower)), " "))


def unit_signature(c: Column) -> Column:
    s = strip(c)
    return F.when(has_unit(s), units_in(s)).when(s.rlike(MEASURE) & number_in(s).isNotNull(), F.lit(NO_UNIT))


def is_strict_float(c: Column) -> Column:
    """Whether a number is left after a percent sign, or a currency sign and commas, is taken off."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), r"%$", ""), r"^[$€£₹]", ""), ",", "")
    return to_number_generic(s).isNotNull()


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def percentage(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def log_transform(c: Column) -> Column:
    """The natural logarithm of positive values; others stay."""
    return F.when(c > 0, F.log(c)).otherwise(c)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
