import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulens.functions import stats
from tabulens.operators import columns, gram, raw_profile, selection, statistics, transforms


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=30))
def test_numeric_statistics_agree_with_pandas(spark, values):
    got = statistics.numeric_statistics(frame(spark, values), ["v"])["v"]
    s = pd.Series([v for v in values if v is not None], dtype=float)
    assert got["count"] == len(s)
    for key, want in {"mean": s.mean(), "std": s.std(), "median": s.median(), "q1": s.quantile(0.25), "skewness": s.skew(), "kurtosis": s.kurt()}.items():
        assert (got[key] is None and np.isnan(want)) or got[key] == pytest.approx(want, abs=1e-6), key


def test_constant_columns_do_not_throw(spark):
    df = spark.createDataFrame([(1.0, 0.1, float(i)) for i in range(5)], "a double, b double, c double")
    assert raw_profile.correlations(df, ["a", "b", "c"]) == {("a", "b"): None, ("a", "c"): None, ("b", "c"): None}
    assert statistics.correlation_matrix(df, ["a", "b", "c"]) == {"a": {}, "b": {}, "c": {"c": 1.0}}
    assert statistics.numeric_statistics(df, ["a"])["a"]["skewness"] == 0.0


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 1.0), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    want = pd.DataFrame(rows, columns=["a", "b"]).corr().loc["a", "b"]
    assert df.agg(stats.correlation(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_quartiles_equal_means_no_raw_outliers_but_statistical_ones(spark):
    df = frame(spark, [5, 5, 5, 5, 5, 9])
    assert raw_profile.profile(df)["columns"][0]["outlier_count"] == 0
    assert statistics.numeric_statistics(df, ["v"])["v"]["outlier_count"] == 1


def counting(monkeypatch):
    """How often tables are scanned for quantiles."""
    scans = []
    for name in ("aggregate", "histograms"):
        real = getattr(selection, name)
        monkeypatch.setattr(selection, name, lambda *a, real=real, name=name: (scans.append(name), real(*a))[1])
    return scans


def test_joint_quantiles_of_many_columns(spark, monkeypatch):
    """25 columns, three quantiles each, in four scans: exact, whatever the shape of the values."""
    monkeypatch.setattr(columns, "PERCENTILE_ROWS", 0)
    scans = counting(monkeypatch)
    rng = np.random.default_rng(1)
    shapes = [rng.normal, rng.standard_cauchy, lambda size: rng.integers(0, 5, size).astype(float), lambda size: np.exp(rng.normal(0, 30, size)), lambda size: np.concatenate([np.full(size - 3, 7.0), [1e300, -1e300, 5e-324]])]
    data = {f"c{i}": shapes[i % 5](size=3000) for i in range(25)}
    df = spark.createDataFrame(pd.DataFrame(data))
    got = columns.quantiles(df, {n: F.col(n) for n in data}, (0.25, 0.5, 0.75), 3000)
    assert len(scans) <= 4
    for n, v in data.items():
        assert got[n] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist(), rel=1e-12), n


def test_joint_quantiles_at_the_edges(spark, monkeypatch):
    rows = [(1.0, None, float("inf"), 1), (None, None, float("-inf"), 2), (2.0, None, 5.0, 2**60), (2.0, None, float("inf"), -4)]
    df = spark.createDataFrame(rows, "a double, none double, ends double, whole long")
    got = selection.joint_quantiles(df, {n: F.col(n) for n in df.columns}, (0.0, 0.5, 1.0))
    assert got == {"a": [1.0, 2.0, 2.0], "none": [None] * 3, "ends": [float("-inf"), float("inf"), float("inf")], "whole": [-4.0, 1.5, float(2**60)]}
    # Sketches that miss: brackets are widened until they hold the ranks; few bins take more passes and give the same.
    monkeypatch.setattr(selection, "ACCURACY", 2)
    values = np.random.default_rng(3).normal(size=5000)
    got = selection.joint_quantiles(frame(spark, values), {"v": F.col("v")}, (0.1, 0.9, 0.999), bins=3)
    assert got["v"] == pytest.approx(np.quantile(values, [0.1, 0.9, 0.999]).tolist(), rel=1e-12)


def test_correlations_of_200_columns(spark):
    """Pairwise complete, by blocks of any size, equal to pandas; constants have none."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 8))
    x = base @ rng.normal(size=(8, 200)) + rng.normal(size=(600, 200)) * 0.5 + 1e6 * rng.normal(size=200)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 9] = 3.0, np.nan
    x[5:, 11] = np.nan
    names = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(5)
    centred = x - np.nan_to_num(pd.DataFrame(x).mean().to_numpy())  # pandas itself is off by 1e-8 beside large means
    want = pd.DataFrame(centred, columns=names).corr(min_periods=2)
    for some, block in ((names, gram.BLOCK), (names[:30], 7)):
        got = gram.correlations(df, some, block)
        assert list(got) == [(a, b) for i, a in enumerate(some) for b in some[i + 1 :]]
        for (a, b), r in got.items():
            w = want.loc[a, b]
            assert (r is None) == bool(np.isnan(w)), (a, b, r, w)
            assert r is None or r == pytest.approx(w, abs=1e-9)
    assert raw_profile.correlations(df, names[:20])["c0", "c1"] == pytest.approx(want.loc["c0", "c1"], abs=1e-9)
    assert set(gram.correlations(df.where("c0 is null and c0 is not null"), names[:3]).values()) == {None}


def test_identical_columns_of_even_counts(spark):
    """Values that come in even numbers cancel out in one checksum; the other tells the columns apart."""
    df = spark.createDataFrame([(i % 2, i // 2 % 2, i % 2, i % 2 + 2) for i in range(8)], "a int, b int, c int, d int")
    assert columns.identical_pairs(df) == [("a", "c")]
    assert columns.identical_pairs(df.where("a > 9")) == columns.identical_pairs(df.where("a > 9"))


def test_duplicates_of_rows_with_maps_and_variants(spark):
    df = spark.sql("select 1 as v, map('a', i % 2, 'b', 1) as m from range(4) t(i)")
    assert columns.duplicate_rows(df) == (4, 2)
    assert columns.duplicate_rows(spark.sql("select map('a', 1, 'b', 2) as m union all select map('b', 2, 'a', 1)")) == (2, 1)
    assert columns.duplicate_rows(spark.sql("select parse_json(if(i < 3, '1', '\"1\"')) as v from range(4) t(i)")) == (3, 2)


def test_topk_ties_go_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", "b", "c", None]], "v string")
    s = statistics.categorical_statistics(df, ["v"])["v"]
    assert (s["count"], s["unique_count"], s["top"], s["top_frequency"]) == (5, 3, "a", 2)
    assert [x["value"] for x in s["top_values"]] == ["a", "b", "c"]


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (None,)], "v int")
    assert columns.duplicate_rows(df) == (5, 3)


def test_transforms(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0), ("a", 100.0), ("a", 2.0), ("a", 2.5)], "k string, v double")
    hot = transforms.one_hot(df, "k")
    assert hot.columns == ["v", "k_a", "k_b"] and hot.where("v = 3").first()[1:] == (False, False)
    assert transforms.mean_impute(df, "v").where("k = 'b'").first()["v"] == pytest.approx(21.7)
    assert sorted(r["v"] for r in transforms.drop_outliers(df, "v").collect()) == [1.0, 2.0, 2.5, 3.0]


def test_empty_frames(spark):
    df = spark.createDataFrame([], "v double, s string")
    assert statistics.numeric_statistics(df, ["v"])["v"]["count"] == 0
    assert raw_profile.profile(df)["row_count"] == 0
