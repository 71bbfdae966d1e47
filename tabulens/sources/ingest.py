"""Reading a file: what it is, how it is encoded and delimited, and its columns typed by all of their cells.

Only the head of a file comes to the driver; the scan itself is Spark's, all columns as text, and one aggregate over
it decides each column's type. Errors are reported, not raised.
"""

from __future__ import annotations

import csv
import io
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import text
from tabulens.operators import mixed, raw_profile, structure
from tabulens.operators.columns import aggregate, col
from tabulens.plans.planner import Plan, plan_cleaning
from tabulens.sources import encodings, workbook

EXTENSIONS = ("csv", "tsv", "xlsx", "xls", "xlsm", "json", "parquet")
DELIMITERS = (",", ";", "\t", "|")
HEAD_BYTES = 1 << 20
BAD = "__bad_line"


@dataclass
class Ingested:
    frame: DataFrame | None = None
    report: dict = field(default_factory=lambda: {"errors": [], "warnings": []})
    profile: dict | None = None
    structure: dict | None = None
    plan: Plan | None = None


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def file_facts(spark: SparkSession, path: str) -> dict:
    """Name, bytes and time of a file, without its content."""
    row = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").first()
    return {"name": os.path.basename(path), "extension": extension(path), "size": None if row is None else row["length"], "modified": None if row is None else str(row["modificationTime"])}


def head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path on any file system that Spark reads is a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(where) and system.getFileStatus(where).isDirectory())


def kind_by_magic(data: bytes) -> str:
    if data.startswith(b"PK"):
        return "xlsx"
    return "xls" if data.startswith(bytes.fromhex("D0CF11E0")) else "parquet" if data.startswith(b"PAR1") else "csv"


def delimiter(sample: str) -> tuple[str, bool]:
    """The delimiter under which most rows are as wide as a first row of several cells; whether any gave several."""
    best, chosen = (False, 0), ","
    for d in DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO(sample), delimiter=d) if r]
        if rows and (score := (len(rows[0]) > 1, sum(len(r) == len(rows[0]) for r in rows))) > best:
            best, chosen = score, d
    return chosen, best[0]


def has_header(sample: str) -> bool:
    try:
        return csv.Sniffer().has_header(sample)
    except csv.Error:
        return True


def scan_text(spark: SparkSession, path: str, sep: str, header: list[str], with_header: bool, charset: str, quoted_breaks: bool = True) -> tuple[DataFrame, int]:
    """All columns as text under positional names, and the number of rows that are too long. Without quoted line breaks the file is read in splits."""
    names = [f"c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD]])
    sentinel = "\u0001null\u0001"
    df = spark.read.csv(path, schema=schema, sep=sep, header=with_header, encoding=encodings.reader_charset(charset), mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, nullValue=sentinel, emptyValue="", multiLine=quoted_breaks, quote='"', escape='"', enforceSchema=True)
    # Both short and long rows are marked; only long ones are errors, short ones have empty cells at the end.
    width = F.size(F.split(F.regexp_replace(F.col(BAD), r'"[^"]*"', ""), "\\" + sep if sep == "|" else sep))
    # The scan refuses to be asked for the marks alone, so the cells are counted beside them.
    too_long = df.agg(F.count_if(F.col(BAD).isNotNull() & (width > len(names))), *map(F.count, names)).first()[0]
    return df.select(*(encodings.decoded(F.coalesce(F.col(n), F.lit("")), charset).alias(n) for n in names)), int(too_long)


def typed(df: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where every cell reads as such; one blank cell keeps a column text."""
    wanted = {}
    for n in df.columns:
        c = col(n)
        wanted |= {(n, "all"): F.count(c), (n, "long"): F.count_if(c.rlike(r"^\s*[+-]?\d{1,19}\s*$") & text.strip(c).try_cast("long").isNotNull()), (n, "double"): F.count_if(text.to_number_generic(c).isNotNull()), (n, "boolean"): F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false"))}
    found = aggregate(df, wanted)

    def cast(n: str):
        size = found[n, "all"]
        if size and found[n, "long"] == size:
            return text.strip(col(n)).try_cast("long")
        if size and found[n, "double"] == size:
            return text.to_number_generic(col(n))
        return F.lower(col(n)) == "true" if size and found[n, "boolean"] == size else col(n)

    return df.select(*(cast(n).alias(n) for n in df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is no value here."""
    return df.select(*(F.nanvl(col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name) for f in df.schema))


def read(spark: SparkSession, path: str, report: dict) -> tuple[DataFrame | None, list[str]]:
    """The table under positional or own names, and its header as it stands in the file."""
    ext = extension(path)
    if ext and ext not in EXTENSIONS:
        report["errors"].append(f"Files of type .{ext} are not supported.")
        return None, []
    if ext == "parquet" or is_folder(spark, path):
        df = spark.read.parquet(path)
        return nan_to_null(df), df.columns
    data = head(spark, path)
    if not data:
        report["errors"].append("The file is empty.")
        return None, []
    if not ext:
        ext = kind_by_magic(data)
        report["warnings"].append(f"The file has no extension; read as {ext}.")
    report["file_type"] = ext
    if ext == "parquet":
        df = spark.read.parquet(path)
        return nan_to_null(df), df.columns
    if ext == "json":
        df = mixed.read_json(spark, path, data.lstrip()[:1] == b"[")
        return nan_to_null(df), df.columns
    if ext == "xls" and not data.startswith(b"PK"):
        report["errors"].append("Workbooks of the binary kind (.xls) are not read; save them as .xlsx.")
        return None, []
    if ext in ("xlsx", "xls", "xlsm"):
        return read_excel(spark, path, report)
    facts = encodings.examine(spark, path, data)
    charset = facts.charset
    report["warnings"] += facts.warnings
    sample = data.decode(charset, "replace")
    if len(data) == HEAD_BYTES:
        sample = sample[: sample.rfind("\n") + 1] or sample
    if not sample.strip():
        report["errors"].append("The file holds no text.")
        return None, []
    sep, several = ("\t", True) if ext == "tsv" else delimiter(sample)
    with_header = has_header(sample) if several else True
    first = next(r for r in csv.reader(io.StringIO(sample), delimiter=sep) if r)
    header = first if with_header else [str(i) for i in range(len(first))]
    report |= {"encoding": charset, "encoding_confidence": facts.confidence, "delimiter": sep, "has_header": with_header}
    if len(first) == 1:
        report["warnings"].append("Only one column was found.")
    df, too_long = scan_text(spark, path, sep, header, with_header, charset, facts.quoted_breaks)
    if too_long:
        report["errors"].append(f"{too_long} rows have more cells than the header.")
        return None, header
    return typed(df), header


def read_excel(spark: SparkSession, path: str, report: dict) -> tuple[DataFrame | None, list[str]]:
    """The first sheet under the header of its first row; a cell without a value is null."""
    names = workbook.sheet_names(spark, path)
    report["skipped_sheets"] = names[1:]
    if report["skipped_sheets"]:
        report["warnings"].append("Only the first sheet was read.")
    rows = workbook.rows(spark, path)
    first = rows.where("place = 0").first()
    if first is None:
        report["errors"].append("The sheet is empty.")
        return None, []
    # Cells beside the header's are dropped by no one: the widest row names the columns.
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    header = [x if x is not None else f"Unnamed: {i}" for i, x in enumerate(list(first["cells"]) + [None] * (width - len(first["cells"])))]
    return typed(rows.where("place > 0").select(*(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)))), header


def ingest(spark: SparkSession, path: str, date_dayfirst: bool | None = None, approximate: int = 0) -> Ingested:
    """Read, check, profile and plan. Errors end up in the report with their type."""
    out = Ingested()
    try:
        df, header = read(spark, path, out.report)
        if df is None:
            return out
        named, out.structure = structure.check(df, header)
        if out.structure["errors"]:
            out.report["errors"] += out.structure["errors"]
            return out
        out.report["warnings"] += out.structure["warnings"]
        out.profile = raw_profile.profile(named, "raw", header, approximate, out.structure)
        out.plan = plan_cleaning(out.profile, named.columns, date_dayfirst)
        out.report |= {"row_count": out.profile["row_count"], "column_count": out.profile["column_count"]}
        out.frame = mixed.as_text(named)
    except Exception as e:  # the report is the interface for faults of the input
        out.report["errors"].append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    return out
