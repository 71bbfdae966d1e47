import pytest

from tabulens import pipeline
from tabulens.operators import executor, legacy, raw_profile, structure, summary
from tabulens.plans.planner import Action, Plan, plan_cleaning, plan_legacy


def one(spark, values, name="v", kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


def column(spark, values, name="v", kind="string"):
    return raw_profile.profile(one(spark, values, name, kind))["columns"][0]


def actions(spark, values, name="v", **options):
    df = one(spark, values, name)
    return [a.action for a in plan_cleaning(raw_profile.profile(df), df.columns, **options).actions]


def test_null_roll_up(spark):
    df = spark.createDataFrame([("", None), ("  ", "missing"), ("NA", "n/a"), ("ok", "fine")], "notes string, other string")
    s = raw_profile.profile(df)["null_summary"]
    assert (s["total_null_count"], s["total_null_like_count"], s["total_missing_count"]) == (1, 5, 6)
    assert (s["empty_string_count"], s["whitespace_only_count"]) == (2, 1)


@pytest.mark.parametrize(
    ("values", "name", "kind"),
    [
        (["a", "b"] * 10, "category", "categorical"),
        ([f"id{i:03d}" for i in range(10)], "customer_id", "identifier"),
        ([f"text {'x' * i}" for i in range(10)], "description", "free_text"),
        ([f"k{i}" for i in range(10)], "misc", "unresolved"),
        (["1", "2", "x", "4", "5"], "amount", "numeric"),
        (["yes", "no", "y"], "active", "boolean"),
        (["2024-01-01", "2024-01-02"], "day", "datetime"),
        (["0", "1"], "flag", "numeric"),
        (["YES", "YES"], "c", "boolean"),
        (["same", "same"], "c", "unresolved"),
        ([None, None], "c", "unresolved"),
    ],
)
def test_semantic_types(spark, values, name, kind):
    assert column(spark, values, name)["semantic_type"] == kind


def test_outliers_and_skewness(spark):
    p = column(spark, [1, 2, 3, 100], kind="int")
    assert p["outlier_count"] == 1 and p["skewness"] > 1
    assert raw_profile.outlier_values(one(spark, [1, 2, 3, 100], kind="int"), "v") == [100.0]
    assert column(spark, [1, 100, 2], kind="int")["skewness"] is None


def test_dates_have_no_epoch_outliers(spark):
    df = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,cast(id*id*id as int)) as t from range(8)")
    p = raw_profile.profile(df)["columns"][0]
    assert p["semantic_type"] == "datetime" and p["outlier_count"] == 0 and p["skewness"] is None


def test_nested_columns_are_unresolved(spark):
    p = raw_profile.profile(spark.sql("select array(1, 2) as v, named_struct('a', 1) as s"))["columns"]
    assert [x["semantic_type"] for x in p] == ["unresolved", "unresolved"]


def test_mixed_formats(spark):
    p = column(spark, ["3 kg", "4 lbs", "5 kg"])
    assert p["mixed_format_warning"] and p["format_signatures"] == ["unit:kg", "unit:lbs"]


def test_plan(spark):
    assert actions(spark, [" 1", "2", "3", "4"]) == ["strip_whitespace", "convert_to_numeric"]
    assert "preserve_identifier" in actions(spark, [str(i) for i in range(5)], "customer_id")
    assert "convert_to_numeric" not in actions(spark, [str(i) for i in range(5)], "customer_id")
    assert "review_ambiguous_date_format" in actions(spark, ["01/02/2024", "03/02/2024"])
    assert "convert_to_datetime" in actions(spark, ["01/02/2024", "03/02/2024"], date_dayfirst=True)
    assert actions(spark, ["A", "a"] * 10)[-1:] == ["normalize_case"]
    with pytest.raises(ValueError):
        plan_cleaning({"profile_type": "cleaned"}, [])


def run(spark, values, action, confidence=1.0, kind="string", **options):
    df, log = executor.execute(one(spark, values, kind=kind), Plan([Action(["v"], action, confidence)], "test"), **options)
    return df, next(e for e in log if e["action"] == action)


def test_conversion_outcomes(spark):
    assert run(spark, ["1", "2", "x"], "convert_to_numeric")[1]["status"] == "rejected"
    df, e = run(spark, ["1,000", "2", "3", "x"], "convert_to_numeric")
    assert e["status"] == "executed" and e["invalid_count"] == 1 and [r[0] for r in df.collect()] == [1000.0, 2.0, 3.0, None]
    assert run(spark, ["1"], "convert_to_numeric", 0.5)[1]["status"] == "skipped"
    assert run(spark, [None], "convert_to_numeric")[1]["status"] == "skipped"
    assert run(spark, ["yes", "no", "maybe"], "convert_to_boolean")[1] | {} == run(spark, ["yes", "no", "maybe"], "convert_to_boolean")[1]
    assert run(spark, ["yes", "no", "maybe"], "convert_to_boolean")[1]["status"] == "rejected"
    df, e = run(spark, ["2024-01-01", "2024-02-01"], "convert_to_datetime")
    assert e["timezone_policy"] == "utc" and df.schema["v"].dataType.simpleString() == "timestamp"
    df, _ = run(spark, ["01/02/2024", "02/03/2024"], "convert_to_datetime", date_dayfirst=True)
    assert [str(r[0])[:10] for r in df.collect()] == ["2024-02-01", "2024-03-02"]


def test_unknown_and_review_actions(spark):
    assert run(spark, [1], "fly", kind="int")[1]["status"] == "unsupported"
    assert run(spark, [1], "review_x", kind="int")[1]["status"] == "needs_review"
    assert run(spark, [1], "preserve_x", kind="int")[1]["status"] == "skipped"


def test_strip_comes_first_and_values_nulled_are_told_apart(spark):
    df, log = executor.execute(one(spark, [" a ", "NA", "n/a", "b"]), Plan([Action(["v"], "replace_null_like")], "t"))
    assert log[0]["values_nulled"] == 2 and log[0]["values_changed"] == 0
    assert [r[0] for r in df.collect()] == ["a", None, None, "b"]
    _, log = executor.execute(one(spark, [" a ", "NA"]), Plan([], "t"))
    assert log[0]["action"] == "strip_whitespace" and log[0]["values_changed"] == 1


def test_duplicates_are_reported_only(spark):
    df, log = executor.execute(one(spark, [1, 1, 2], kind="int"), Plan([], "t"))
    assert next(e for e in log if e["action"] == "report_duplicate_rows")["duplicate_row_count"] == 2 and df.count() == 3


def test_validation_and_fingerprint(spark):
    df = one(spark, ["a", "b"])
    assert executor.validate(df, df) == [] and executor.validate(df, df.limit(1)) == ["row counts differ"]
    assert executor.fingerprint(df) == executor.fingerprint(one(spark, ["b", "a"])) != executor.fingerprint(one(spark, ["b", "c"]))


def test_summary(spark):
    df = spark.createDataFrame([("c1", "1", "X"), ("c2", "2", "y"), ("c3", "3", "x")], "customer_id string, amount string, label string")
    raw = raw_profile.profile(df)
    cleaned, log, out = summary.run_stage(df, raw, plan_cleaning(raw, df.columns))
    assert out["columns"][1]["changes"]["dtype"] == {"before": "string", "after": "double", "changed": True}
    assert [e["column"] for e in out["excluded_columns"]][0] == "customer_id"
    assert out["downstream"]["sampling"]["applied"] is False and "amount" in out["downstream"]["eligible_columns"]


def test_structure(spark):
    assert structure.normalised_names(["value", "value", "city"]) == ["value", "value_2", "city"]
    assert structure.normalised_names(["", "Ünnamed", "unnamed: 3"]) == ["column_1", "nnamed", "column_3"]
    df, report = structure.check(spark.createDataFrame([(0, 5), (1, 5)], "a int, b int"), ["", "b"])
    assert report["index_like_columns"] == ["column_1"] and len(report["warnings"]) == 2
    assert structure.check(spark.createDataFrame([], "a int"))[1]["errors"]
    _, report = structure.check(spark.createDataFrame([(1, 1), (None, None)], "a int, b int"))
    assert report["duplicate_value_columns"] == [["a", "b"]]


def test_legacy(spark):
    rows = [("5%", "$1,200", "yes", "NA", "1"), ("6%", "$3", "no", "b", "2"), ("7%", "€4", "y", " b", "3"), ("x", None, "n", "B", "4")]
    p = {c["name"]: c for c in legacy.profile(spark.createDataFrame(rows, "rate string, price string, ok string, word string, paid string"))["columns"]}
    assert [p[n]["inferred_type"] for n in p] == ["percentage", "currency", "boolean", "categorical", "integer"]
    assert p["rate"]["invalid_parse_count"] == 1 and p["price"]["null_like_count"] == 1
    assert p["paid"]["is_potential_id"] and p["word"]["has_case_variations"]
    plan = plan_legacy({"columns": list(p.values())})
    assert ("word", "replace_null_like") in [(a.columns[0], a.action) for a in plan.actions]
    df = executor.execute_legacy(spark.createDataFrame(rows, "rate string, price string, ok string, word string, paid string"), plan)
    assert df.where("word is null").count() == 1


def test_cleaning_scans_once_and_groups_once(spark, monkeypatch):
    """All steps are audited by one aggregate; duplicates take one grouping; the log is that of the steps taken one after the other."""
    rows = [(" 1,200 ", "Yes", "A", "x"), ("NA", "no", " a", None), ("3", " TRUE", "b", ""), ("4.5", "f", "B ", "y")]
    df = spark.createDataFrame(rows, "num string, flag string, name string, rest string")
    scans = []
    for name in ("aggregate", "duplicate_rows"):
        monkeypatch.setattr(executor, name, lambda *a, real=getattr(executor, name), name=name: (scans.append(name), real(*a))[1])
    plan = Plan([Action(["num"], "replace_null_like", 1.0), Action(["num"], "convert_to_numeric", 0.9), Action(["flag"], "convert_to_boolean", 0.9), Action(["name"], "normalize_case", 1.0), Action(["flag"], "normalize_case", 1.0)], "raw_profile")
    cleaned, log = executor.execute(df, plan, 0.3)
    assert sorted(scans) == ["aggregate", "duplicate_rows"]
    told = {(e["action"], *e["columns"]): e for e in log}
    assert told["replace_null_like", "num"]["values_nulled"] == 1 and told["strip_whitespace", "name"]["values_changed"] == 2
    assert (told["convert_to_numeric", "num"]["status"], told["convert_to_numeric", "num"]["invalid_count"]) == ("executed", 0)
    assert told["convert_to_boolean", "flag"]["status"] == "rejected"
    assert told["normalize_case", "name"]["values_changed"] == 2 and told["normalize_case", "flag"]["values_changed"] == 2
    assert [tuple(r) for r in cleaned.collect()] == [(1200.0, "yes", "a", "x"), (None, "no", "a", None), (3.0, "true", "b", ""), (4.5, "f", "b", "y")]
    clash = df.withColumnRenamed("rest", "stripped 0")
    assert executor.execute(clash, plan)[0].columns == clash.columns


def test_the_pass_that_cleans_sees_the_raw_rows(spark):
    out = pipeline.run(spark, spark.createDataFrame([(f" {i % 7}", i) for i in range(40)], "a string, b int"))
    assert out["pipeline_error"] is None and out["raw_snapshot_unchanged"] is True and out["cleaned_frame"].count() == 40
