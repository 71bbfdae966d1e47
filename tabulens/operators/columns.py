"""What the operators share about a table's columns: physical kinds, value counts and exact quantiles."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import stats, text
from tabulens.operators.row_order import placed

#: Columns whose aggregates go into one plan; wider tables take several.
BATCH = 25
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: Rows up to which quantiles are exact in one aggregate, which holds a count of every value; beyond, all columns' brackets are narrowed together.
PERCENTILE_ROWS = 5_000_000

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(data_type: T.DataType) -> str:
    """boolean, numeric, datetime, timedelta, string, or nested, which has no values to measure."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, DATETIME):
        return "datetime"
    if isinstance(data_type, T.DayTimeIntervalType):
        return "timedelta"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "nested"


def kinds(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, kind(f.dataType)) for f in df.schema]


def present(df: DataFrame, name: str) -> Column:
    """The column, with NaN as null."""
    return F.nanvl(col(name), F.lit(None)) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else col(name)


@contextlib.contextmanager
def short_methods(df: DataFrame) -> Iterator[None]:
    """Jobs under Spark's limit for the JVM's compiler: it leaves methods over 8 000 bytes interpreted, as which a plan of many expressions runs ten times longer than split up."""
    conf = df.sparkSession.conf
    before = conf.get(METHOD_LIMIT)
    conf.set(METHOD_LIMIT, str(min(int(before), 8_000)))
    try:
        yield
    finally:
        conf.set(METHOD_LIMIT, before)


def aggregate(df: DataFrame, wanted: dict[tuple[str, str], Column]) -> dict[tuple[str, str], object]:
    """One row of aggregates by (column, metric), in batches of columns."""
    names = list(dict.fromkeys(c for c, _ in wanted))
    found: dict[tuple[str, str], object] = {}
    for a in range(0, len(names), BATCH):
        keys = [k for k in wanted if k[0] in set(names[a : a + BATCH])]
        row = df.agg(*(wanted[k].alias(f"m{i}") for i, k in enumerate(keys))).first()
        found |= {k: row[i] for i, k in enumerate(keys)}
    return found


@contextlib.contextmanager
def spread(df: DataFrame) -> Iterator[DataFrame]:
    """df for several passes: over all cores, held for them, where its files make fewer tasks than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.is_cached or not placed(df)[1] or df.rdd.getNumPartitions() >= cores:
        yield df
        return
    held = df.repartition(cores).persist()
    try:
        yield held
    finally:
        held.unpersist()


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) of the non-null values of each column, as text; one shuffle of pre-aggregated counts."""
    cells = [F.struct(F.lit(n).alias("column"), present(df, n).cast("string").alias("value")) for n in names]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    return df.select(F.explode(F.array(*cells)).alias("cell")).where("cell.value is not null").groupBy("cell.column", "cell.value").agg(F.count("*").alias("n"))


def cells_of(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) of every non-null cell as text, n = 1; what is grouped by column alone shuffles no text."""
    cells = [F.struct(F.lit(n).alias("column"), present(df, n).cast("string").alias("value"), F.lit(1).cast("long").alias("n")) for n in names]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("value is not null")


def cell_marks(df: DataFrame, names: list[str], blanks: bool = False) -> DataFrame:
    """(column, mark1, mark2, stripped, folded) of each distinct non-null value: 128 bits of hashes stand for the value, and for texts 64 each for it stripped and in lower case.

    Texts are hashed where they are read, so a row in the shuffle has the same small size for any column. Blank texts
    have no stripped form unless blanks is set.
    """
    none = F.lit(None).cast("long")
    cells = []
    own = [(n, k) for n, k in kinds(df) if n in names]
    # Under names of their own, so that a text is stripped once.
    rows = df.select(*(present(df, n).alias(f"c{i}") for i, (n, _) in enumerate(own)), *(text.strip(col(n)).alias(f"s{i}") for i, (n, k) in enumerate(own) if k == "string"))
    for i, (n, k) in enumerate(own):
        c = F.col(f"c{i}")
        shown = F.col(f"s{i}") if k == "string" else None
        shown = shown if shown is None or blanks else F.when(shown != "", shown)
        hashed = lambda x: F.when(x.isNotNull(), F.xxhash64(x))
        forms = (none, none) if shown is None else (hashed(shown), hashed(F.lower(shown)))
        cells.append(F.struct(F.lit(n).alias("column"), F.when(c.isNotNull(), F.xxhash64(c)).alias("mark1"), F.xxhash64(F.lit(1), c).alias("mark2"), forms[0].alias("stripped"), forms[1].alias("folded")))
    long = rows.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("mark1 is not null")
    return long.groupBy("column", "mark1", "mark2").agg(F.max("stripped").alias("stripped"), F.max("folded").alias("folded"))


def distinct_measures(df: DataFrame, names: list[str], blanks: bool = False) -> dict[str, dict]:
    """unique, and distinct stripped values with (stripped) and without (folded) case, of each column."""
    if not names:
        return {}
    marks = cell_marks(df, names, blanks)
    texts = [F.countDistinct("stripped").alias("stripped"), F.countDistinct("folded").alias("folded")]
    shapes = dict(kinds(df))
    if not any(shapes[n] == "string" for n in names):
        texts = [F.lit(0).cast("long").alias(c) for c in ("stripped", "folded")]
    rows = marks.groupBy("column").agg(F.count("*").alias("unique"), *texts)
    return {r["column"]: r.asDict() for r in rows.collect()}


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of each column with their rank; ties by value. The limit holds within tasks before the shuffle."""
    from pyspark.sql import Window

    by = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def quantiles(df: DataFrame, columns: dict[str, Column], q: tuple[float, ...], rows: int, approximate: int = 0) -> dict[str, list[float | None]]:
    """Linear quantiles of numeric expressions, exact unless approximate gives an accuracy."""
    if not columns:
        return {}
    if approximate or rows <= PERCENTILE_ROWS:
        found = aggregate(df, {(n, "q"): stats.quantiles(c, *q, approximate=approximate) for n, c in columns.items()})
        return {n: found[n, "q"] or [None] * len(q) for n in columns}
    from tabulens.operators.selection import joint_quantiles

    return joint_quantiles(df, columns, q)


def outlier_bounds(q1: float | None, q3: float | None) -> tuple[float, float] | None:
    """Tukey's fences."""
    return None if q1 is None or q3 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))


def outside(c: Column, bounds: tuple[float, float]) -> Column:
    return (c < bounds[0]) | (c > bounds[1])


def rounded(x, digits: int = 4):
    """Python's rounding, as reports show it."""
    return None if x is None else round(float(x), digits)


def share(part: int, whole: int, digits: int | None = 4) -> float:
    x = part / whole * 100 if whole else 0.0
    return x if digits is None else round(x, digits)


def strings(df: DataFrame, name: str) -> Column:
    return col(name) if kind(df.schema[name].dataType) == "string" else F.lit(None).cast("string")


def identical_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of columns of one type with equal values in every row, null equal to null.

    Combined hashes pick the candidates, so that the exact comparison, one pass for all, meets few pairs.
    """
    fields = [f for f in df.schema if kind(f.dataType) != "nested"]
    # Equal values cancel out in one sum and not in the other; the row's place plays no part in either.
    sums = aggregate(df, {(f.name, m): e for f in fields for m, e in (("xor", F.bit_xor(F.xxhash64(col(f.name)))), ("sum", F.sum(F.xxhash64(col(f.name)).cast("decimal(38,0)"))))})
    mark = lambda f: (f.dataType.simpleString(), sums[f.name, "xor"], sums[f.name, "sum"])
    pairs = [(a.name, b.name) for i, a in enumerate(fields) for b in fields[i + 1 :] if mark(a) == mark(b)]
    if not pairs:
        return []
    same = df.agg(*(F.bool_and(col(a).eqNullSafe(col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    return [p for i, p in enumerate(pairs) if same[i] or same[i] is None]


def _groupable(c: Column, data_type: T.DataType) -> Column:
    """A column that can be grouped by; maps and variants can't, so maps go as sorted entries and what holds them deeper, or variants, as JSON."""
    if isinstance(data_type, T.MapType) and not re.search(r"map<|variant", data_type.simpleString()[4:]):
        return F.array_sort(F.map_entries(c))
    return F.to_json(F.struct(c)) if re.search(r"map<|variant", data_type.simpleString()) else c


def duplicate_rows(df: DataFrame) -> tuple[int, int]:
    """Rows that have an equal (every member counts), and rows beyond the first of each kind."""
    keys = [_groupable(col(f.name), f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema)]
    row = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("any"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra")).first()
    return int(row["any"]), int(row["extra"])


