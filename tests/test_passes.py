"""How often a table is read, and what is shared between the passes."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.functions import text
from tabulens.operators import columns, gram, raw_profile, selection, statistics, summary


def counting(df):
    """df, and the number of its rows that were read so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_correlations_read_the_rows_once(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)).cumsum(axis=0) * [1, 1, 1, 1, 1e-3, 1] + [0, 0, 0, 0, 1e9, 7]
    x[rng.random(x.shape) < 0.1] = np.nan
    df, seen = counting(spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef"))).repartition(3))
    got = gram.correlations(df, list("abcdef"))
    assert seen.value == 400
    want = pd.DataFrame(x - np.nanmean(x, axis=0), columns=list("abcdef")).corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9 if "e" not in (a, b) else 1e-6)


def test_profile_parses_numbers_once(spark, monkeypatch):
    monkeypatch.setattr(columns, "PERCENTILE_ROWS", 0)  # as for large tables
    rows = [(i, f" {i * 37 % 101}.5" if i % 7 else "3 kg") for i in range(500)]
    df, seen = counting(spark.createDataFrame(rows, "k int, v string").repartition(3))
    p = raw_profile.profile(df)["columns"]
    assert seen.value <= 6 * 500  # counts, distinct values, texts, units, numbers, equal columns
    assert [(c["column"], c["semantic_type"], c["outlier_count"], c["format_signatures"]) for c in p] == [("k", "numeric", 0, []), ("v", "numeric", 0, ["unit:kg", "unit:none"])]


def test_texts_are_grouped_by_hash(spark, monkeypatch):
    """No sort of all cells: only those with units meet aggregates that need one."""
    plans = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    df = spark.createDataFrame([(str(i),) for i in range(50)], "v string")
    found = raw_profile.text_measures(columns.cells_of(df, ["v"]))["v"]
    assert (found["first_unit"], found["last_unit"], found["numeric_like"]) == ("unit:none", "unit:none", 50)
    assert plans and not any("SortAggregate" in p for p in plans)


def test_strip_of_every_white_space(spark):
    space = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    cells = [f"{c}{d}x{c} y{d}" for c in space for d in (" ", c)] + ["".join(space), "", "​x", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(text.strip(F.col("v"))).collect()] == [c and c.strip() for c in cells]


def test_few_splits_are_spread_over_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1000).select("id", F.concat(F.lit("g"), F.col("id") % 3).alias("g")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    with columns.spread(df) as held:
        assert held.is_cached and held.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        raw = raw_profile.profile(held)
    assert not held.is_cached and raw == raw_profile.profile(df)
    found = [statistics.statistical_profile(df, summary.summarise(raw, df, [], unchanged=u)) for u in (False, True)]
    assert found[0] == found[1] and found[0]["categorical"]["g"]["count"] == 1000


def test_brackets_of_one_value_take_no_histogram(spark, monkeypatch):
    cut = []
    plain = selection.histograms
    monkeypatch.setattr(selection, "histograms", lambda df, c, brackets, bins: cut.extend(brackets) or plain(df, c, brackets, bins))
    df = spark.range(4000).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    got = selection.joint_quantiles(df, {n: F.col(n) for n in df.columns}, (0.25, 0.5, 0.75))
    assert got == {"few": [0.0, 1.0, 2.0], "many": [999.75, 1999.5, 2999.25]}
    assert all(n == "many" for n, _, _ in cut)
