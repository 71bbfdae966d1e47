"""Exact quantiles of many columns together: every pass narrows the brackets of all columns and ranks at once.

1. One pass takes each column's count, range and a sketch, whose quantiles bracket the wanted ranks.
2. One pass counts the values below and in each bracket; a bracket that missed its rank is widened and counted again.
   A bracket of one value that holds its rank is the answer, however many rows it has.
3. Each further pass cuts every open bracket into BINS bins of equal width and counts them, with their least and greatest
   values. The bin of a rank is its next bracket; it is the answer once its values are equal.

Only values in brackets are shuffled, as counts by bin; the driver gets a row a bin. A bracket of the sketch holds about
4e-4 of the rows, so 10**9 rows take a fourth pass and smaller tables three.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.operators.columns import aggregate

#: Bins of a bracket, the sketch's accuracy, and how far around a quantile its bracket reaches.
BINS, ACCURACY, ROOM = 1_024, 20_000, 2e-4

Bracket = tuple[str, float, float]


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value, from 0; null outside of the bracket. Equal values share a bin, and low and high don't, so bins shrink."""
    half = 0.5 if math.isinf(high - low) else 1.0
    place = (v * half - low * half) / (high * half - low * half) * bins if high > low else F.lit(0.0)
    return F.when(v.between(low, high), F.least(F.floor(place), F.lit(bins - 1)).cast("int"))


def counted(df: DataFrame, columns: dict[str, Column], brackets: list[Bracket]) -> dict[Bracket, tuple[int, int]]:
    """For each bracket the number of values below it and in it."""
    wanted = {}
    for at, (n, low, high) in enumerate(brackets):
        wanted |= {(n, f"less{at}"): F.count_if(columns[n] < low), (n, f"held{at}"): F.count_if(columns[n].between(low, high))}
    found = aggregate(df, wanted)
    return {b: (found[b[0], f"less{at}"], found[b[0], f"held{at}"]) for at, b in enumerate(brackets)}


def histograms(df: DataFrame, columns: dict[str, Column], brackets: list[Bracket], bins: int) -> list[list]:
    """For each bracket its filled bins in order: rows (bin, n, low, high)."""
    cells = [F.struct(F.lit(at).alias("bracket"), columns[n].alias("v"), bin_of(columns[n], low, high, bins).alias("bin")) for at, (n, low, high) in enumerate(brackets)]
    # Brackets hold few rows, so most are dropped before any cell is made.
    near = functools.reduce(operator.or_, (columns[n].between(low, high) for n, low, high in brackets))
    inside = df.where(near).select(F.explode(F.filter(F.array(*cells), lambda c: c["bin"].isNotNull())).alias("c")).select("c.*")
    rows = inside.groupBy("bracket", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # at most a row a bin
    out: list[list] = [[] for _ in brackets]
    for r in sorted(rows, key=lambda r: (r["bracket"], r["bin"])):
        out[r["bracket"]].append(r)
    return out


def joint_quantiles(df: DataFrame, columns: dict[str, Column], q: tuple[float, ...], bins: int = BINS) -> dict[str, list[float | None]]:
    """Linear quantiles of numeric expressions without NaN, in one sequence of passes for all of them; None for a column without values."""
    columns = {n: c.cast("double") for n, c in columns.items()}
    shares = sorted({min(1.0, max(0.0, x + d)) for x in q for d in (-ROOM, ROOM)})
    wanted: dict[tuple[str, str], Column] = {}
    for n, v in columns.items():
        own = F.when(F.abs(v) < float("inf"), v)
        wanted |= {(n, "n"): F.count(v), (n, "down"): F.count_if(v == float("-inf")), (n, "up"): F.count_if(v == float("inf")), (n, "low"): F.min(own), (n, "high"): F.max(own)}
        wanted[n, "sketch"] = F.percentile_approx(own, F.array(*map(F.lit, shares)), F.lit(ACCURACY))
    facts = aggregate(df, wanted)

    known: dict[tuple[str, int], float] = {}
    open_ranks: dict[tuple[str, int], tuple[float, float]] = {}
    for n in columns:
        size, down, up = facts[n, "n"], facts[n, "down"], facts[n, "up"]
        for x in q if size else ():
            for rank in {math.floor(x * (size - 1)), math.ceil(x * (size - 1))}:
                if rank < down or rank >= size - up:
                    known[n, rank] = float("-inf") if rank < down else float("inf")
                else:
                    ends = (facts[n, "sketch"][shares.index(min(1.0, max(0.0, x + d)))] for d in (-ROOM, ROOM))
                    open_ranks[n, rank] = tuple(ends)

    below: dict[tuple[str, int], int] = {}
    missed = dict(open_ranks)
    while missed:
        found = counted(df, columns, sorted({(n, *ends) for (n, _), ends in missed.items()}))
        again = {}
        for (n, rank), (low, high) in missed.items():
            less, held = found[n, low, high]
            if rank < less:
                again[n, rank] = (facts[n, "low"], low)
            elif rank >= less + held:
                again[n, rank] = (high, facts[n, "high"])
            elif low == high:
                known[n, rank] = low
                del open_ranks[n, rank]
            else:
                open_ranks[n, rank], below[n, rank] = (low, high), less
        missed = again

    while open_ranks:
        brackets = sorted({(n, *ends) for (n, _), ends in open_ranks.items()})
        filled = dict(zip(brackets, histograms(df, columns, brackets, bins), strict=True))
        narrower = {}
        for (n, rank), ends in open_ranks.items():
            at = below[n, rank]
            for r in filled[n, *ends]:
                if rank < at + r["n"]:
                    if r["low"] == r["high"]:
                        known[n, rank] = r["low"]
                    else:
                        narrower[n, rank], below[n, rank] = (r["low"], r["high"]), at
                    break
                at += r["n"]
        open_ranks = narrower

    def value(n: str, x: float) -> float:
        place = x * (facts[n, "n"] - 1)
        a, b = known[n, math.floor(place)], known[n, math.ceil(place)]
        return a if a == b else a + (b - a) * (place - math.floor(place))

    return {n: [value(n, x) if facts[n, "n"] else None for x in q] for n in columns}
