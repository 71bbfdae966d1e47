"""The older profile: its own shares, flags and vocabulary, kept beside the raw profile for those who use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions import stats, text
from tabulens.operators import classify, mixed
from tabulens.operators.columns import aggregate, col, distinct_measures, duplicate_rows, kinds, outlier_bounds, outside, present, quantiles, share


def measures(c: Column, physical: str) -> dict[str, Column]:
    is_text = physical == "string"
    none = F.lit(0).cast("long")
    s = c.cast("string") if is_text else F.lit(None).cast("string")
    real = F.when(c.isNotNull() & ~F.coalesce(text.is_null_word(s), F.lit(False)), c)
    r = real.cast("string") if is_text else F.lit(None).cast("string")
    number = text.to_number_generic(r)
    out = {
        "missing_count": F.count_if(c.isNull()),
        "non_null_count": F.count(c),
        "string_count": F.count(s) if is_text else none,
        "whitespace_count": F.count_if(s != text.strip(s)) if is_text else none,
        "empty_string_count": F.count_if(text.strip(s) == "") if is_text else none,
        "null_like_text_count": F.count_if(text.is_null_word(s)) if is_text else none,
        "semantic_count": F.count(real),
        "percentage": F.count_if(text.is_percentage(r)) if is_text else none,
        "currency": F.count_if(text.is_currency(r)) if is_text else none,
        "boolean": F.count_if(text.token(r).isin("true", "false", "yes", "no", "y", "n")) if is_text else F.count(c) if physical == "boolean" else none,
        "numeric": F.count_if(number.isNotNull()) if is_text else F.count(c) if physical == "numeric" else none,
        "datetime": F.count_if(text.to_timestamp(r).isNotNull()) if is_text else F.count(c) if physical == "datetime" else none,
        "whole": F.count_if(number % 1 == 0) if is_text else none,
        "strict": F.count_if(text.is_strict_float(r)) if is_text else none,
        "average_length": F.avg(F.char_length(s)) if is_text else F.lit(None).cast("double"),
    }
    return out


def profile(df: DataFrame, approximate: int = 0) -> dict:
    """Per column: missing and null-like counts, parse shares among values that are no null words, flags, inferred type."""
    types = mixed.type_counts(df) if mixed.names(df) else {}
    df = mixed.as_text(df)
    shapes = [(n, k) for n, k in kinds(df) if k != "nested"]
    found = aggregate(df, {("", "rows"): F.count("*")} | {(n, m): e for n, k in shapes for m, e in measures(present(df, n), k).items()})
    rows = int(found["", "rows"])
    distinct = distinct_measures(df, [n for n, _ in shapes], blanks=True)
    numeric = {n: stats.clean(col(n)) for n, k in shapes if k == "numeric"}
    quarts = quantiles(df, numeric, (0.25, 0.75), rows, approximate)
    fences = {n: b for n, (a, z) in quarts.items() if a is not None and a != z and (b := outlier_bounds(a, z))}
    late = aggregate(df, {(n, "o"): F.count_if(outside(numeric[n], b)) for n, b in fences.items()})
    columns = []
    for n, k in shapes:
        f = {m: found[n, m] for m in measures(present(df, n), k)}
        unique = distinct[n]["unique"] if n in distinct else 0
        semantic = f["semantic_count"]
        p = {"name": n, "physical_type": k, "dtype": df.schema[n].dataType.simpleString(), "non_null_count": f["non_null_count"], "missing_count": f["missing_count"], "missing_percentage": share(f["missing_count"], rows)}
        p |= {"unique_count": unique, "unique_percentage": share(unique, f["non_null_count"]), "has_duplicates": unique < f["non_null_count"], "is_constant": unique == 1}
        p |= {m: f[m] for m in ("whitespace_count", "empty_string_count", "null_like_text_count", "average_length")}
        p |= {"whitespace_percentage": share(f["whitespace_count"], f["string_count"]), "empty_string_percentage": share(f["empty_string_count"], f["string_count"])}
        p["null_like_count"] = f["null_like_text_count"] + f["missing_count"]
        p |= {f"{m}_parse_percentage": share(f[m], semantic) for m in ("percentage", "currency", "boolean", "numeric", "datetime")}
        p["all_integral"] = f["numeric"] == f["whole"]
        p["integral"] = p["dtype"] in ("tinyint", "smallint", "int", "bigint")
        p["has_case_variations"] = k == "string" and n in distinct and distinct[n]["folded"] < unique
        p["has_mixed_types"] = len(types.get(n, ())) > 1
        p["is_potential_id"] = classify.legacy_potential_id(n, unique)
        p["outlier_count"] = int(late[n, "o"]) if n in fences else 0
        p["outlier_percentage"] = share(p["outlier_count"], f["non_null_count"])
        p["inferred_type"] = kind = classify.legacy_type(p)
        valid = {"integer": "numeric", "float": "numeric", "percentage": "strict", "currency": "strict", "boolean": "boolean", "datetime": "datetime"}.get(kind)
        p["invalid_parse_count"] = int(semantic - f[valid]) if valid and k == "string" else 0
        p["preprocessing_flags"] = flags(p)
        columns.append(p)
    _, extra = duplicate_rows(df)
    return {"row_count": rows, "column_count": len(columns), "columns": columns, "duplicate_row_count": extra, "duplicate_row_percentage": share(extra, rows), "quality_summary": quality(columns, extra)}


#: Flags of a column, in order, and the measure that raises each.
FLAGS = (
    ("missing_values_present", "missing_count"),
    ("null_like_values_present", "null_like_count"),
    ("leading_or_trailing_whitespace", "whitespace_count"),
    ("empty_strings_present", "empty_string_count"),
    ("case_variations_present", "has_case_variations"),
    ("mixed_types_present", "has_mixed_types"),
    ("invalid_values_present", "invalid_parse_count"),
    ("constant_column", "is_constant"),
    ("potential_id_column", "is_potential_id"),
    ("statistical_outliers_present", "outlier_count"),
)


def flags(p: dict) -> list[str]:
    return [name for name, measure in FLAGS if p[measure]]


def quality(columns: list[dict], duplicate_row_count: int) -> dict:
    counted = {"missing": "missing_count", "null_like_values": "null_like_count", "whitespace": "whitespace_count", "empty_strings": "empty_string_count", "mixed_types": "has_mixed_types", "case_variations": "has_case_variations", "invalid_values": "invalid_parse_count", "outliers": "outlier_count"}
    out = {f"columns_with_{name}": sum(bool(p[m]) for p in columns) for name, m in counted.items()}
    return out | {"constant_columns": sum(p["is_constant"] for p in columns), "potential_id_columns": sum(p["is_potential_id"] for p in columns), "duplicate_rows": duplicate_row_count}
