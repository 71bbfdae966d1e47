"""What the bytes of a whole text file are: UTF-8 or which 8-bit character set, and whether quoted cells hold line breaks.

The file is scanned by lines in parallel. A line end is never part of a longer UTF-8 character, so lines are valid or not
independently of each other. Lines that are not are read byte by byte (Latin-1) and scored under each character
set: its table turns bytes into classes of characters, and the pairs and runs of classes tell how likely the text is.
All counts are sums over lines, so one aggregate decides, and only its one row comes to the driver.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character sets, the script of each, and letters that are frequent in the languages written with it.
CHARSETS = (
    ("windows-1252", "latin", "éèàêçâîôûùëïäöüßáíóúñãõåøæ"),
    ("windows-1250", "latin", "ąćęłńóśźżčřšžýáíéůěőűăâîşţđ"),
    ("windows-1251", "own", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїє"),
    ("koi8-r", "own", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"),
    ("iso-8859-5", "own", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїє"),
    ("windows-1253", "own", "αοιετσνηυρπκμλωςγδάίέόήύώ"),
    ("iso-8859-7", "own", "αοιετσνηυρπκμλωςγδάίέόήύώ"),
)
#: Sets that Spark's readers know; others are read as Latin-1 and translated.
LATIN_1 = "iso-8859-1"
HIGH = "".join(map(chr, range(0x80, 0x100)))

#: Weights of what is counted: frequent letters, further ones, and what texts hardly hold.
FREQUENT, LETTER, ODD_PAIR, SYMBOL, UNDEFINED = 2, 1, -3, -2, -6


def table_of(charset: str) -> str:
    """The characters of bytes 0x80 to 0xFF; U+FFFD where there is none."""
    return "".join(bytes([b]).decode(charset, "replace")[:1] for b in range(0x80, 0x100))


def class_of(char: str, frequent: str) -> str:
    """c and C are frequent letters, l and L further ones, x is undefined, s the rest."""
    if char == "�" or 0x80 <= ord(char) < 0xA0:
        return "x"
    if not char.isalpha():
        return "s"
    kind = "c" if char.lower() in frequent else "l"
    return kind.upper() if char.isupper() else kind


def scored(latin: Column, charset: str, script: str, frequent: str) -> Column:
    """How well a text of Latin-1 characters, which stand for bytes, reads under a character set."""
    classes = "".join(class_of(c, frequent) for c in table_of(charset))
    letters = "abcdefghijklmnopqrstuvwxyz"
    seen = F.translate(latin, HIGH + letters + letters.upper(), classes + "a" * 26 + "A" * 26)
    count = lambda pattern: F.regexp_count(seen, F.lit(pattern))
    # Letters of scripts of their own stand together; accented Latin ones stand among plain ones.
    mixed = count("[aA](?=[clCL])") + count("[clCL](?=[aA])") if script == "own" else count("[clCL](?=[clCL][clCL])")
    odd = mixed + count("[cla](?=[CL])") + count("[cl](?=A)")
    return FREQUENT * count("[cC]") + LETTER * count("[lL]") + ODD_PAIR * odd + SYMBOL * count("(?<=[clCLaA])s(?=[clCLa])") + UNDEFINED * count("x")


@dataclass
class Bytes:
    """The character set, how sure it is (0 to 1), lines that it doesn't fit, and whether quotes span lines."""

    charset: str
    confidence: float
    misfits: int = 0
    quoted_breaks: bool = True
    warnings: list[str] = field(default_factory=list)


def by_mark(data: bytes) -> str | None:
    if data.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    return "utf-16" if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) else None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file as they are, in splits; the text source doesn't decode."""
    return spark.read.text(path, lineSep="\n")


def examine(spark: SparkSession, path: str, data: bytes) -> Bytes:
    """data is the head of the file, of which the mark is taken; all else is decided by every line."""
    mark = by_mark(data)
    if mark == "utf-16":
        return Bytes(mark, 1.0)
    line = F.col("value")
    valid, latin = F.is_valid_utf8(line), F.decode(line.cast("binary"), "ISO-8859-1")
    bad = F.when(~valid, latin)
    wide = F.octet_length(line) > F.char_length(line)
    sums = {c: F.coalesce(F.sum(scored(bad, c, script, frequent)), F.lit(0)) for c, script, frequent in CHARSETS}
    row = lines(spark, path).agg(
        F.count_if(~valid).alias("bad"),
        F.count_if(valid & wide).alias("wide"),
        F.count_if(F.regexp_count(latin, F.lit('"')) % 2 == 1).alias("odd_quotes"),
        F.coalesce(F.sum(F.regexp_count(bad, F.lit(r"[\x{80}-\x{FF}]"))), F.lit(0)).alias("high"),
        F.coalesce(F.sum(F.regexp_count(bad, F.lit(r"[\x{80}-\x{9F}]"))), F.lit(0)).alias("low"),
        *(s.alias(c) for c, s in sums.items()),
    ).first()
    breaks = row["odd_quotes"] > 0
    if mark or not row["bad"] or row["wide"] > row["bad"]:
        found = Bytes(mark or "utf-8", 1.0 if not row["bad"] else round(row["wide"] / (row["wide"] + row["bad"]), 4), row["bad"], breaks)
        if row["bad"]:
            found.warnings.append(f"{row['bad']} lines hold bytes that are no UTF-8; these were replaced.")
        return found
    best = max(sums, key=lambda c: row[c])  # of equal scores the first
    confidence = round(max(0.0, min(1.0, row[best] / (FREQUENT * row["high"]))), 4)
    # Windows' Western set is Latin-1 where none of the bytes that only Windows uses occurs.
    found = Bytes(LATIN_1 if best == "windows-1252" and not row["low"] else best, confidence, 0, breaks)
    if row["wide"]:
        found.warnings.append(f"{row['wide']} lines are valid UTF-8 of more than ASCII, {row['bad']} are not; read as {found.charset}.")
    elif confidence < 0.5:
        found.warnings.append(f"The encoding is uncertain; read as {found.charset}.")
    return found


def reader_charset(charset: str) -> str:
    """What Spark's readers are told."""
    return charset.replace("-sig", "") if charset.startswith("utf") else LATIN_1


def decoded(c: Column, charset: str) -> Column:
    """A cell read under reader_charset() in its true characters."""
    return c if charset.startswith("utf") or charset == LATIN_1 else F.translate(c, HIGH, table_of(charset))
