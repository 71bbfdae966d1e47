"""The numbers behind charts, for all columns and pairs at once: bins, cross-tables, category means, missingness patterns.

Each function is one pass over the table (and one aggregate for ranges where bins need them), whatever the number of
columns or pairs, and returns rows: as many as bins, cells or patterns, never as many as the table's.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions import stats
from tabulens.operators.columns import aggregate, col, present

#: Bins of a measure, and cardinalities within which categories are crossed: the first of a pair, and the second.
BINS, FIRST, SECOND = 20, (2, 20), (2, 10)
#: Bits of a pattern in one number.
WORD_BITS = 62


def ranges(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """The finite range of each column that has one."""
    finite = {n: F.when(F.abs(v) < float("inf"), v) for n in names for v in [stats.clean(col(n))]}
    found = aggregate(df, {(n, m): f(v) for n, v in finite.items() for m, f in (("low", F.min), ("high", F.max))})
    return {n: (found[n, "low"], found[n, "high"]) for n in names if found[n, "low"] is not None}


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """The bin of equal width that holds a value, the last one with its upper end; null outside of the range."""
    place = (v - low) / (high - low) * bins if high > low else F.lit(0.0)
    return F.when(v.between(low, high), F.least(F.floor(place), F.lit(bins - 1)).cast("int"))


def histograms(df: DataFrame, names: list[str], bins: int = BINS) -> DataFrame:
    """(column, bin, low, high, n): the filled bins of each numeric column."""
    found = ranges(df, names)
    cells = [F.struct(F.lit(n).alias("column"), bin_of(stats.clean(col(n)), a, z, bins).alias("bin"), F.lit(a).alias("from"), F.lit((z - a) / bins).alias("width")) for n, (a, z) in found.items()]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n long")
    counts = df.select(F.explode(F.array(*cells)).alias("c")).where("c.bin is not null").groupBy("c.column", "c.bin", "c.from", "c.width").agg(F.count("*").alias("n"))
    return counts.select("column", "bin", (F.col("from") + F.col("width") * F.col("bin")).alias("low"), (F.col("from") + F.col("width") * (F.col("bin") + 1)).alias("high"), "n")


def pair_bins(df: DataFrame, names: list[str], bins: int = BINS) -> DataFrame:
    """(a, b, bin_a, bin_b, n): the filled cells of a grid over each pair of numeric columns, for scatter and pair plots."""
    found = ranges(df, names)
    own = {n: bin_of(stats.clean(col(n)), a, z, bins) for n, (a, z) in found.items()}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), own[a].alias("bin_a"), own[b].alias("bin_b")) for a, b in combinations(own, 2)]
    if not cells:
        return df.sparkSession.createDataFrame([], "a string, b string, bin_a int, bin_b int, n long")
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bin_a is not null and bin_b is not null")
    return long.groupBy("a", "b", "bin_a", "bin_b").agg(F.count("*").alias("n"))


def crossed(cardinality: dict[str, int]) -> list[tuple[str, str]]:
    """The pairs of categories that charts cross, in the order of the columns."""
    fits = lambda n, limits: limits[0] <= cardinality[n] <= limits[1]
    return [(a, b) for a, b in combinations(cardinality, 2) if fits(a, FIRST) and fits(b, SECOND)]


def cross_tables(df: DataFrame, cardinality: dict[str, int], measures: list[str] = ()) -> DataFrame:
    """Counts of all crossed pairs of categories, and counts and means of measures by each category, in one pass of grouping sets.

    Rows (first, second, first_value, second_value, n, share, means): second is null for a category alone, share is that
    within the first value, means maps measures to their means. Rows where a category is null are in no cell of it.
    """
    names = list(cardinality)
    sets = [list(p) for p in crossed(cardinality)] + [[n] for n in names if FIRST[0] <= cardinality[n] <= FIRST[1]]
    empty = "first string, second string, first_value string, second_value string, n long, share double, means map<string,double>"
    if not sets:
        return df.sparkSession.createDataFrame([], empty)
    # Positions name the keys, so that no name in the table clashes with what is added.
    keys = {n: f"k{i}" for i, n in enumerate(names)}
    plain = df.select(*(col(n).cast("string").alias(k) for n, k in keys.items()), *(stats.clean(col(m)).alias(f"m{i}") for i, m in enumerate(measures)))
    means = [F.avg(f"m{i}").alias(f"mean{i}") for i in range(len(measures))]
    found = plain.groupingSets([[F.col(keys[n]) for n in s] for s in sets], *map(F.col, keys.values())).agg(F.grouping_id().alias("which"), F.count("*").alias("n"), *means)
    number = {tuple(s): sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s) for s in sets}
    text = lambda x: F.lit(x).cast("string")
    label = F.coalesce(*(F.when(F.col("which") == k, F.struct(text(s[0]).alias("first"), text(s[1] if len(s) > 1 else None).alias("second"), F.col(keys[s[0]]).alias("first_value"), (F.col(keys[s[1]]) if len(s) > 1 else text(None)).alias("second_value"))) for s, k in number.items()))
    of = F.create_map(*(x for i, m in enumerate(measures) for x in (F.lit(m), F.col(f"mean{i}")))) if measures else F.lit(None).cast("map<string,double>")
    rows = found.select(label.alias("l"), "n", of.alias("means")).select("l.*", "n", "means").where("first_value is not null and (second is null or second_value is not null)")
    # One window a pair and value: at most SECOND[1] rows, or the FIRST[1] values of a category alone.
    within = Window.partitionBy("first", "second", F.when(F.col("second").isNotNull(), F.col("first_value")))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(within)).select("first", "second", "first_value", "second_value", "n", "share", "means")


def missing_patterns(df: DataFrame) -> DataFrame:
    """(missing, n): each set of columns (names in order) that rows lack together, and how many rows do; a bit a column is what is grouped."""
    names = df.columns
    words = []
    for at in range(0, len(names), WORD_BITS):
        bits = [F.when(present(df, n).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(names[at : at + WORD_BITS])]
        words.append(sum(bits[1:], bits[0]).alias(f"w{at}"))
    counts = df.select(*words).groupBy(*(f"w{at}" for at in range(0, len(names), WORD_BITS))).agg(F.count("*").alias("n"))
    lacking = [F.when(F.col(f"w{i - i % WORD_BITS}").bitwiseAND(F.lit(1 << (i % WORD_BITS))) != 0, F.lit(n)) for i, n in enumerate(names)]
    return counts.select(F.filter(F.array(*lacking), lambda x: x.isNotNull()).alias("missing"), "n")


def missing_together(df: DataFrame) -> DataFrame:
    """(a, b, n): how many rows lack both columns (a = b: lack it), the cells of a missingness heatmap, from the patterns alone."""
    patterns = missing_patterns(df).where(F.size("missing") > 0)
    pairs = patterns.select(F.explode("missing").alias("a"), "missing", "n").select("a", F.explode("missing").alias("b"), "n")
    place = F.array(*map(F.lit, df.columns))
    return pairs.where(F.array_position(place, F.col("a")) <= F.array_position(place, F.col("b"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
