"""Pearson correlations of many columns in one pass, by sums of products of blocks of columns.

With X the values less their means in a batch of rows (0 where absent) and M the presence marks, M'M, X'M, (X*X)'M and
X'X hold, for every pair of columns, the moments about their means over the rows where both are present. Tasks merge
these over their batches and hand out one row a pair; Spark merges those about the means of all tasks. The state of a
task is a few matrices, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.operators.columns import col, short_methods

#: Columns of a block; wider tables take a pass for each pair of blocks.
BLOCK = 512
PARTS = ("n", "mean_i", "mean_j", "squares_i", "squares_j", "products", "low_i", "high_i", "low_j", "high_j")


def partial_moments(df: DataFrame, names: list[str]) -> DataFrame:
    """A row a task and pair i < j, over rows with both: the count, both means, squares and products about them, and for each a range that is empty only if it has one value."""
    k = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, squares, products = np.zeros((4, k, k))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            there = ~np.isnan(x)
            mark = there.astype(float)
            shift = np.where(there, x, 0.0).sum(axis=0) / np.maximum(mark.sum(axis=0), 1.0)
            z = np.where(there, x - shift, 0.0)
            count, total = mark.T @ mark, z.T @ mark
            own = np.maximum(count, 1.0)
            both = np.maximum(n + count, 1.0)
            step = shift[:, None] + total / own - mean
            step[count == 0] = 0.0
            squares += (z * z).T @ mark - total * total / own + step * step * n * count / both
            products += z.T @ z - total * total.T / own + step * step.T * n * count / both
            mean += step * count / both
            n += count
            # Ranges tell constants from the rest: where a pair's is not empty, more rows change nothing.
            for j in np.flatnonzero((~(low < high)).any(axis=0) & there.any(axis=0)):
                rows = there[:, j]
                low[:, j] = np.minimum(low[:, j], np.where(there, x, np.inf)[rows].min(axis=0))
                high[:, j] = np.maximum(high[:, j], np.where(there, x, -np.inf)[rows].max(axis=0))
        i, j = np.nonzero(np.triu(n, 1))
        columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], mean[i, j], mean[j, i], squares[i, j], squares[j, i], products[i, j], low[i, j], high[i, j], low[j, i], high[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", *PARTS])

    rows = df.select(*(col(n).cast("double").alias(f"x{at}") for at, n in enumerate(names)))
    return rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in PARTS))


def merged(parts: DataFrame) -> DataFrame:
    """(i, j, n, a, b, p, varied): the squares and products of each pair about the means of all its rows."""
    pair = Window.partitionBy("i", "j")
    off = {c: F.col(c) - F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair) for c in ("mean_i", "mean_j")}
    about = parts.select("*", off["mean_i"].alias("off_i"), off["mean_j"].alias("off_j"))
    n, a, b = F.col("n"), F.col("off_i"), F.col("off_j")
    return about.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("squares_i") + n * a * a).alias("a"),
        F.sum(F.col("squares_j") + n * b * b).alias("b"),
        F.sum(F.col("products") + n * a * b).alias("p"),
        ((F.min("low_i") < F.max("high_i")) & (F.min("low_j") < F.max("high_j"))).alias("varied"),
    )


def correlations(df: DataFrame, names: list[str], block: int = BLOCK) -> dict[tuple[str, str], float | None]:
    """Pearson r of each pair, upper triangle, over rows where both are present; None where one is constant there."""
    found: dict[tuple[str, str], float | None] = {(a, b): None for i, a in enumerate(names) for b in names[i + 1 :]}
    parts = [names[a : a + block] for a in range(0, len(names), block)]
    for at, left in enumerate(parts):
        for right in parts[at:]:
            some = left if left is right else left + right
            with short_methods(df):
                rows = merged(partial_moments(df, some)).where("varied").collect()  # at most a row a pair of columns in two blocks
            for r in rows:
                spread = math.sqrt(r["a"]) * math.sqrt(r["b"]) if r["a"] > 0 and r["b"] > 0 else float("nan")
                x = r["p"] / spread if spread > 0 else float("nan")
                found[some[r["i"]], some[r["j"]]] = max(-1.0, min(1.0, x)) if x == x else x
    return found
