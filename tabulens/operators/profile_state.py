"""Profiles as states that are stored and merge: the profile of a union follows from the states of its parts, without their rows.

A state is a row a group and column. It holds counts, extremes, the central moments, an HLL sketch of the values and a
KLL sketch of the numbers, some kilobytes whatever the rows. States of partitions, days or files can be written as a
table, united, and merged to any coarser grouping; so a new day costs a scan of that day alone.

Counts, extremes and moments are exact (moments up to rounding); distinct counts have a relative standard error of
DISTINCT_ERROR and quantiles a rank error of about RANK_ERROR. Numbers are the values of numeric columns, seconds since
1970 of dates and times, 0 and 1 of booleans, and the lengths of texts; NaN is null, and infinite values are values but no
numbers. Nested columns have counts alone. A table without rows has one state a column without groups, and none with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.operators.columns import BATCH, col, kinds, present, share

#: Log2 of the registers of a distinct sketch, and entries of a quantile sketch.
REGISTERS, ENTRIES = 13, 400
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (REGISTERS / 2), 0.01
INFINITE = float("inf")
FIELDS = {"position", "column", "dtype", "rows", "nulls", "n", "mean", "m2", "m3", "low", "high", "distinct", "ranks"}


def _number(c: Column, physical: str) -> Column:
    none = F.lit(None).cast("double")
    v = {
        "numeric": lambda: c.cast("double"),
        "boolean": lambda: c.cast("double"),
        "datetime": lambda: c.cast("timestamp").cast("double"),
        "timedelta": lambda: none,
        "string": lambda: F.char_length(c).cast("double"),
    }.get(physical, lambda: none)()
    return F.when(F.abs(v) < INFINITE, v)


def _state(df: DataFrame, name: str, place: int, physical: str) -> Column:
    c = present(df, name)
    v = _number(c, physical)
    n = F.count(v).cast("double")
    m2 = F.var_pop(v) * n
    return F.struct(
        F.lit(place).alias("position"),
        F.lit(name).alias("column"),
        F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
        F.count("*").alias("rows"),
        F.count_if(c.isNull()).alias("nulls"),
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        m2.alias("m2"),
        F.when(m2 > 0, F.skewness(v) * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).when(n > 0, 0.0).alias("m3"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.hll_sketch_agg(F.when(c.isNotNull(), F.lit(0).cast("long") if physical == "nested" else F.xxhash64(c)), F.lit(REGISTERS)).alias("distinct"),
        F.kll_sketch_agg_double(v, F.lit(ENTRIES)).alias("ranks"),
    )


def states(df: DataFrame, by: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """(by, position, column, dtype, rows, nulls, n, mean, m2, m3, low, high, distinct, ranks), a row a group of by and column; one shuffle of partial states."""
    if taken := set(by) & FIELDS:
        raise ValueError(f"states cannot be grouped by columns with names of their own: {sorted(taken)}")
    keys = [col(b) for b in by]
    shapes = [(i, n, k) for i, (n, k) in enumerate(kinds(df)) if n not in by and (columns is None or n in columns)]
    parts = []
    for a in range(0, len(shapes), BATCH):
        made = df.groupBy(*keys).agg(F.array(*(_state(df, n, i, k) for i, n, k in shapes[a : a + BATCH])).alias("made"))
        parts.append(made.select(*keys, F.inline("made")))
    if not parts:
        raise ValueError("no columns to profile")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """The states of the unions of the rows behind equal by (some or none of the columns that the states are grouped by).

    The mean of each union comes first; moments about it are then sums over the parts, without the
    cancellation that sums of powers have. A column's type is the least of its types by name, as a part may have read it differently.
    """
    keys = [*by, "column"]
    total = F.sum("n")
    centre = F.sum(F.col("n") * F.col("mean")) / F.when(total > 0, total)
    whole = parts.groupBy(*map(col, keys)).agg(
        F.min("position").alias("position"),
        F.min("dtype").alias("dtype"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        total.alias("n"),
        centre.alias("mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
    )
    slim = parts.groupBy(*map(col, keys)).agg(centre.alias("centre")).select(*(col(k).alias(f"key{i}") for i, k in enumerate(keys)), "centre")

    def same(d: DataFrame) -> Column:
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & d[f"key{i}"].eqNullSafe(col(k))
        return on

    off = F.col("mean") - F.col("centre")
    moments = parts.join(slim, same(slim)).groupBy(*(f"key{i}" for i in range(len(keys)))).agg(
        F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
        F.sum(F.col("m3") + 3 * off * F.col("m2") + F.col("n") * off * off * off).alias("m3"),
    )
    return whole.join(moments, same(moments)).select(*map(col, by), "position", "column", "dtype", "rows", "nulls", "n", "mean", "m2", "m3", "low", "high", "distinct", "ranks")


def measures(merged: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What states say, a row a state: counts, null_percentage, unique_count (an estimate), mean, std, skewness (both adjusted for bias), low, high, and quantiles, an array."""
    n = F.col("n").cast("double")
    spread = F.sqrt(F.col("m2") / n)
    skew = F.when(n < 3, F.lit(None)).when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(F.col("m3") / n / F.pow(spread, F.lit(3)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    parts = [c for c in merged.columns if c not in ("m2", "m3", "distinct", "ranks")]
    ranks = F.when(F.col("n") > 0, F.array(*(F.kll_sketch_get_quantile_double("ranks", F.lit(q)) for q in quantiles)))
    return merged.select(
        *map(col, parts),
        F.when(F.col("rows") > 0, F.round(100 * F.col("nulls") / F.col("rows"), 4)).otherwise(0.0).alias("null_percentage"),
        F.hll_sketch_estimate("distinct").alias("unique_count"),
        F.sqrt(F.col("m2") / F.when(n > 1, n - 1)).alias("std"),
        skew.alias("skewness"),
        ranks.alias("quantiles"),
    )


def as_profile(merged: DataFrame, kind: str = "raw") -> dict:
    """One table's states (no groups) as what `summary.compare` reads of a profile, so that two days are compared without their rows."""
    rows = sorted((r.asDict() for r in measures(merged).collect()), key=lambda r: (r["position"], r["column"]))
    columns = [r | {"name": r["column"], "null_count": r["nulls"], "non_null_count": r["rows"] - r["nulls"], "null_percentage": share(r["nulls"], r["rows"])} for r in rows]
    return {"profile_type": kind, "row_count": max((r["rows"] for r in rows), default=0), "column_count": len(columns), "columns": columns}
