"""Profile states: what merges equals what is profiled at once."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.operators import profile_state, summary

EXACT = ("position", "column", "dtype", "rows", "nulls", "n", "low", "high")


def days(spark):
    rng = np.random.default_rng(7)
    n = 6000
    rows = pd.DataFrame({"day": rng.integers(0, 9, n), "v": 1e9 + rng.exponential(3, n), "w": rng.integers(0, 1500, n).astype(float), "t": [f"x{i % 701}" * (i % 4) for i in range(n)]})
    df = spark.createDataFrame(rows).withColumn("day", F.when(F.col("day") < 8, F.col("day")))  # one day is null
    return df.withColumn("w", F.when(F.col("w") > 1400, float("nan")).when(F.col("w") < 100, None).otherwise(F.col("w"))), rows


def by_column(df):
    return {r["column"]: r for r in profile_state.measures(df).collect()}


def test_merged_states_equal_the_profile_of_the_union(spark, tmp_path):
    df, rows = days(spark)
    profile_state.states(df, ["day"]).write.parquet(f"{tmp_path}/states")
    stored = spark.read.parquet(f"{tmp_path}/states")
    assert stored.count() == 9 * 3
    merged, at_once = by_column(profile_state.merge(stored)), by_column(profile_state.states(df.drop("day")))
    for c in ("v", "w", "t"):
        for m in EXACT[3:]:
            assert merged[c][m] == at_once[c][m], (c, m)
        for m in ("mean", "std", "skewness"):
            assert merged[c][m] == pytest.approx(at_once[c][m], rel=1e-6), (c, m)
    assert merged["v"]["mean"] == pytest.approx(rows["v"].mean(), rel=1e-12)
    assert merged["v"]["std"] == pytest.approx(rows["v"].std(), rel=1e-6)  # a large offset loses no digits
    assert merged["v"]["skewness"] == pytest.approx((rows["v"] - 1e9).skew(), rel=1e-4)


def test_sketches_keep_their_errors(spark):
    df, rows = days(spark)
    found = by_column(profile_state.merge(profile_state.states(df, ["day"])))
    w = rows["w"][(rows["w"] >= 100) & (rows["w"] <= 1400)]
    for c, values in (("v", rows["v"]), ("w", w), ("t", rows["t"])):
        exact = values.nunique()
        assert abs(found[c]["unique_count"] - exact) <= 4 * profile_state.DISTINCT_ERROR * exact, c
    for c, values in (("v", np.sort(rows["v"])), ("w", np.sort(w))):
        for q, got in zip((0.25, 0.5, 0.75), found[c]["quantiles"], strict=True):
            low, high = np.searchsorted(values, got, "left") / len(values), np.searchsorted(values, got, "right") / len(values)
            assert low - 2 * profile_state.RANK_ERROR <= q <= high + 2 * profile_state.RANK_ERROR, (c, q)


def test_merging_in_steps_is_merging_at_once(spark):
    df, _ = days(spark)
    parts = profile_state.states(df.withColumn("half", F.col("day") % 2), ["day", "half"])
    halves = profile_state.merge(parts, ["half"])
    assert halves.select("half").distinct().count() == 3
    twice, once = by_column(profile_state.merge(halves)), by_column(profile_state.merge(parts))
    for c in once:
        assert [twice[c][m] for m in EXACT] == [once[c][m] for m in EXACT]
        assert twice[c]["std"] == pytest.approx(once[c]["std"]) and twice[c]["skewness"] == pytest.approx(once[c]["skewness"], rel=1e-5, abs=1e-9)


def test_a_new_day_costs_its_own_rows(spark, tmp_path):
    df, _ = days(spark)
    old, new = df.where("day < 5"), df.where("day = 5")
    profile_state.states(old, ["day"]).write.parquet(f"{tmp_path}/s")
    profile_state.states(new, ["day"]).write.mode("append").parquet(f"{tmp_path}/s")
    all_days = spark.read.parquet(f"{tmp_path}/s")
    before = profile_state.as_profile(profile_state.merge(all_days.where("day < 5")))
    after = profile_state.as_profile(profile_state.merge(all_days), "cleaned")
    assert (before["row_count"], after["row_count"]) == (old.count(), old.count() + new.count())
    changes = summary.compare(before, after, [])
    assert [c["column_after"] for c in changes] == ["v", "w", "t"]
    assert changes[0]["changes"]["unique_count"]["changed"] and not changes[0]["changes"]["dtype"]["changed"]


def test_edges(spark):
    df = spark.createDataFrame([(float("inf"), True, None, [1]), (2.0, None, None, None)], "a double, b boolean, s string, l array<int>").withColumn("column", F.lit("clash")).withColumn("rows", F.current_date())
    found = by_column(profile_state.states(df))
    assert (found["a"]["n"], found["a"]["high"], found["a"]["unique_count"]) == (1, 2.0, 2)
    assert (found["b"]["mean"], found["b"]["std"], found["b"]["skewness"]) == (1.0, None, None)
    assert (found["s"]["nulls"], found["s"]["mean"], found["s"]["quantiles"]) == (2, None, None)
    assert (found["l"]["nulls"], found["l"]["n"], found["l"]["unique_count"]) == (1, 0, 1)
    assert found["column"]["quantiles"] == [5.0, 5.0, 5.0] and found["rows"]["rows"] == 2
    empty = by_column(profile_state.merge(profile_state.states(df.limit(0))))
    assert empty["a"]["rows"] == 0 and empty["a"]["mean"] is None and empty["a"]["null_percentage"] == 0.0
    assert profile_state.states(df.limit(0), ["s"]).count() == 0
    wide = spark.range(3).select(*(F.col("id").alias(f"c{i}") for i in range(60)))
    assert by_column(profile_state.states(wide)).keys() == {f"c{i}" for i in range(60)}
    with pytest.raises(ValueError):
        profile_state.states(df.select("s"), ["s"])
    with pytest.raises(ValueError):
        profile_state.states(df, ["column"])
    assert math.isclose(profile_state.DISTINCT_ERROR, 0.0115, abs_tol=1e-4)
