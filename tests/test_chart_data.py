"""Chart data against plain counting."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tabulens.operators import chart_data


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    maybe = lambda x, p: None if rnd.random() < p else x
    return [(maybe(rnd.choice("abc"), 0.1), maybe(rnd.choice(["x", "y"]), 0.2), rnd.choice("pqrstuvwxyzabcd"), maybe(rnd.uniform(-5, 5), 0.1), maybe(float(rnd.randint(0, 9)), 0.1)) for _ in range(500)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k0 string, which string, n string, m0 double, v double")


def test_histograms_and_pairs(df, rows):
    got = {(r["column"], r["bin"]): r for r in chart_data.histograms(df, ["m0", "v"], 7).collect()}
    want = collections.Counter()
    grid = collections.Counter()
    spans = {c: (min(v), max(v)) for c, i in (("m0", 3), ("v", 4)) for v in [[r[i] for r in rows if r[i] is not None]]}
    place = lambda c, x: min(6, int((x - spans[c][0]) / (spans[c][1] - spans[c][0]) * 7))
    for r in rows:
        own = {c: place(c, r[i]) for c, i in (("m0", 3), ("v", 4)) if r[i] is not None}
        want.update(own.items())
        if len(own) == 2:
            grid[own["m0"], own["v"]] += 1
    assert {k: r["n"] for k, r in got.items()} == want
    assert got["v", 6]["high"] == pytest.approx(9) and got["v", 0]["low"] == 0
    assert {(r["bin_a"], r["bin_b"]): r["n"] for r in chart_data.pair_bins(df, ["m0", "v"], 7).collect()} == grid


def test_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("inf")), (1.0, None, 2.0), (1.0, None, float("nan"))], "a double, b double, c double")
    assert sorted(tuple(r) for r in chart_data.histograms(df, ["a", "b", "c"], 4).collect()) == [("a", 0, 1.0, 1.0, 3), ("c", 0, 2.0, 2.0, 1)]
    assert chart_data.histograms(df, ["b"]).count() == chart_data.pair_bins(df, ["a"]).count() == chart_data.cross_tables(df, {}).count() == 0
    none = df.where("a > 1")
    assert chart_data.histograms(none, ["a"]).count() == chart_data.missing_patterns(none).count() == 0


def test_cross_tables(df, rows):
    """Pairs within the limits only; rows with a null category are in no cell of it."""
    cardinality = {"k0": 3, "which": 2, "n": 15}
    assert chart_data.crossed(cardinality) == [("k0", "which")]
    got = chart_data.cross_tables(df, cardinality, ["v"]).collect()
    pairs = collections.Counter((r[0], r[1]) for r in rows if r[0] and r[1])
    totals = collections.Counter(r[0] for r in rows if r[0] and r[1])
    assert {(r.first_value, r.second_value): (r.n, round(r.share, 9)) for r in got if r.second} == {k: (n, round(n / totals[k[0]], 9)) for k, n in pairs.items()}
    for name, i in (("k0", 0), ("which", 1), ("n", 2)):
        own = [r for r in got if r.second is None and r["first"] == name]
        assert {r.first_value: r.n for r in own} == collections.Counter(r[i] for r in rows if r[i])
        assert sum(r.share for r in own) == pytest.approx(1)
        for r in own:
            values = [x[4] for x in rows if x[i] == r.first_value and x[4] is not None]
            assert r.means["v"] == pytest.approx(sum(values) / len(values))


def test_missing_patterns(spark, df, rows):
    names = df.columns
    want = collections.Counter(tuple(n for n, x in zip(names, r, strict=True) if x is None) for r in rows)
    assert {tuple(r.missing): r.n for r in chart_data.missing_patterns(df).collect()} == want
    together = {(r.a, r.b): r.n for r in chart_data.missing_together(df).collect()}
    assert together == {(a, b): n for i, a in enumerate(names) for b in names[i:] if (n := sum(c for m, c in want.items() if a in m and b in m))}
    wide = spark.range(4).select(*(F.when(F.col("id") % (i + 2) == 0, F.col("id")).alias(f"c{i}") for i in range(130)))
    found = {(r.a, r.b): r.n for r in chart_data.missing_together(wide).collect()}
    assert found["c0", "c129"] == 2 and found["c128", "c129"] == 3
