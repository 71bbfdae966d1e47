"""The query catalogue, each query with the DuckDB SQL of its result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens import pipeline
from tabulens.functions import text
from tabulens.operators import chart_data, executor, gram, legacy, mixed, profile_state, raw_profile, row_order, selection, statistics, structure, summary, transforms
from tabulens.operators.columns import cells_of, distinct_measures, duplicate_rows, identical_pairs, rounded, share, spread, value_counts
from tabulens.plans import charts, evidence
from tabulens.plans.planner import Action, Plan, plan_cleaning

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tables with faults, derived by SQL that Spark and DuckDB read alike: (source table, select).
DIRTY = {
    "dirty_orders": (
        "orders",
        "select o_orderkey, case when o_orderkey%11=0 then 'NA' when o_orderkey%13=0 then '' when o_orderkey%17=0 then null when o_orderkey%5=0 then lower(o_orderpriority) "
        "when o_orderkey%7=0 then concat('  ',o_orderpriority,' ') else o_orderpriority end as v from orders",
    ),
    "text_numbers": (
        "lineitem",
        "select l_orderkey, l_linenumber, case when l_orderkey%19=0 then 'n/a' when l_orderkey%7=0 then concat('1,', cast(100 + l_orderkey%900 as varchar(20)), '.50') when l_orderkey%5=0 then concat(' ', cast(l_orderkey as varchar(20))) "
        "when l_orderkey%3=0 then concat('89,17,', cast(100 + l_orderkey%900 as varchar(20))) when l_orderkey%23=0 then '1e3' else cast(l_linenumber as varchar(20)) end as v from lineitem",
    ),
    "text_dates": (
        "orders",
        "select o_orderkey, case when o_orderkey%29=0 then 'soon' when o_orderkey%31=0 then null when o_orderkey%3=0 then concat(cast(1 + o_orderkey%28 as varchar(2)), '/', cast(1 + o_orderkey%12 as varchar(2)), '/2024') "
        "else concat('2024-', cast(10 + o_orderkey%3 as varchar(2)), '-', cast(10 + o_orderkey%18 as varchar(2))) end as v from orders",
    ),
    "text_booleans": (
        "orders",
        "select o_orderkey, case when o_orderkey%37=0 then 'maybe' when o_orderkey%41=0 then null when o_orderkey%4=0 then 'Yes' when o_orderkey%4=1 then ' no' when o_orderkey%4=2 then 'TRUE' else 'f' || 'alse' end as v from orders",
    ),
    "text_percent": ("orders", "select o_orderkey, case when o_orderkey%9=0 then 'x' when o_orderkey%5=0 then '' else concat(cast(o_orderkey%100 as varchar(3)), case when o_orderkey%2=0 then '%' else '.5 %' end) end as v from orders"),
    "text_currency": ("orders", "select o_orderkey, case when o_orderkey%9=0 then '12' when o_orderkey%5=0 then null else concat(case when o_orderkey%2=0 then '$' else '€ ' end, cast(o_orderkey%1000 as varchar(4)), ',000.25') end as v from orders"),
    "dup_rows": ("nation", "select n_name, n_regionkey from nation union all select n_name, n_regionkey from nation where n_nationkey < 7 union all select n_name, n_regionkey from nation where n_nationkey < 3"),
    "twin_columns": ("customer", "select c_custkey, c_custkey as c_copy, c_name, c_acctbal, c_acctbal + 0.0 as c_balance, c_custkey - 1 as c_row from customer"),
    "one_value": ("supplier", "select s_suppkey, 'same' as v, s_acctbal from supplier"),
    "gaps": ("events", "select event_id, case when event_id%6=0 then null else value end as value, event_type from events"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = DIRTY[name]
    table(spark, sf_dir, source).createOrReplaceTempView(source)
    found = spark.sql(sql)
    spark.catalog.dropTempView(source)
    return found


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cte(name: str) -> str:
    return f"with t as ({DIRTY[name][1]}) "


# --- statistics ---------------------------------------------------------------------------------------------------

NUMBERS = (("lineitem", ("l_quantity", "l_extendedprice", "l_tax")),)


def numeric_sql(source: str, c: str) -> str:
    return f"""select '{c}' as column_name, cast(count({c}) as bigint) as n, round(avg({c}), 6) as mean, round(any_value(q.med), 6) as median, round(stddev_samp({c}), 6) as std,
    min({c}) as min_value, max({c}) as max_value, round(any_value(q.q1), 6) as q1, round(any_value(q.q3), 6) as q3, round(case when min({c}) = max({c}) then 0 else skewness({c}) end, 6) as skewness,
    round(case when min({c}) = max({c}) then 0 else kurtosis({c}) end, 6) as kurtosis,
    cast(sum(case when {c} < q.q1 - 1.5 * (q.q3 - q.q1) or {c} > q.q3 + 1.5 * (q.q3 - q.q1) then 1 else 0 end) as bigint) as outlier_count
    from {source}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from {source}) q"""


def numeric_rows(spark: SparkSession, found: dict) -> DataFrame:
    r6 = lambda x: None if x is None else round(float(x), 6)
    rows = [(n, int(s["count"]), *(r6(s[k]) for k in ("mean", "median", "std")), float(s["min"]), float(s["max"]), *(r6(s[k]) for k in ("q1", "q3", "skewness", "kurtosis")), int(s["outlier_count"])) for n, s in found.items()]
    return spark.createDataFrame(rows, "column_name string, n long, mean double, median double, std double, min_value double, max_value double, q1 double, q3 double, skewness double, kurtosis double, outlier_count long")


@query(" union all ".join(numeric_sql("lineitem", c) for c in NUMBERS[0][1]))
def numeric_statistics(spark, sf_dir):
    return numeric_rows(spark, statistics.numeric_statistics(table(spark, sf_dir, "lineitem"), list(NUMBERS[0][1])))


@query(numeric_sql("events", "value"))
def numeric_statistics_events(spark, sf_dir):
    return numeric_rows(spark, statistics.numeric_statistics(table(spark, sf_dir, "events"), ["value"]))


TOP_SQL = " union all ".join(
    f"select * from (select '{c}' as column_name, {c} as value, cast(count(*) as bigint) as n, cast(row_number() over (order by count(*) desc, {c}) as bigint) as place from {t} group by {c}) where place <= 10"
    for t, c in (("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("part", "p_brand"))
)


@query(TOP_SQL)
def categorical_topk(spark, sf_dir):
    rows = []
    for t, names in (("orders", ["o_orderpriority", "o_orderstatus"]), ("part", ["p_brand"])):
        for n, s in statistics.categorical_statistics(table(spark, sf_dir, t), names).items():
            rows += [(n, v["value"], int(v["count"]), i) for i, v in enumerate(s["top_values"], 1)]
    return spark.createDataFrame(rows, "column_name string, value string, n long, place long")


@query(
    " union all ".join(
        f"select '{c}' as column_name, cast(count({c}) as bigint) as n, strftime(min({c}), '%Y-%m-%dT%H:%M:%SZ') as first_moment, strftime(max({c}), '%Y-%m-%dT%H:%M:%SZ') as last_moment, cast(count(distinct {c}) as bigint) as unique_count, "
        f"round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0, 6) as duration_days from {t}"
        for t, c in (("orders", "o_orderdate"), ("events", "ts"))
    )
)
def datetime_statistics(spark, sf_dir):
    rows = []
    for t, c in (("orders", "o_orderdate"), ("events", "ts")):
        s = statistics.datetime_statistics(table(spark, sf_dir, t), [c])[c]
        rows.append((c, int(s["count"]), s["min"], s["max"], int(s["unique_count"]), round(s["duration_days"], 6)))
    return spark.createDataFrame(rows, "column_name string, n long, first_moment string, last_moment string, unique_count long, duration_days double")


@query(cte("text_booleans") + "select cast(count(b) as bigint) as n, cast(sum(case when b then 1 else 0 end) as bigint) as true_count, cast(sum(case when not b then 1 else 0 end) as bigint) as false_count, round(100.0 * sum(case when b then 1 else 0 end) / count(b), 4) as true_percentage from (select case when lower(trim(v)) in ('true','yes','y','1') then true when lower(trim(v)) in ('false','no','n','0') then false end as b from t)")
def boolean_statistics(spark, sf_dir):
    s = statistics.boolean_statistics(dirty(spark, sf_dir, "text_booleans"), ["v"])["v"]
    return spark.createDataFrame([(s["count"], s["true_count"], s["false_count"], round(s["true_percentage"], 4))], "n long, true_count long, false_count long, true_percentage double")


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as column_x, '{b}' as column_y, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]))
def correlation_long(spark, sf_dir):
    found = raw_profile.correlations(table(spark, sf_dir, "lineitem"), CORRELATED)
    return spark.createDataFrame([(a, b, round(r, 6)) for (a, b), r in found.items()], "column_x string, column_y string, r double")


@query("with p as (" + " union all ".join(f"select '{a}' as x, '{b}' as y, corr({a}, {b}) as r from (select c_custkey, c_acctbal, c_custkey * 2.0 as c_twice from customer)" for a, b in (("c_custkey", "c_acctbal"), ("c_custkey", "c_twice"), ("c_acctbal", "c_twice"))) + ") select x as column_x, y as column_y, round(r, 4) as r from p where abs(r) >= 0.95")
def correlation_warnings(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") * 2.0).alias("c_twice"))
    return spark.createDataFrame([(*w["columns"], w["correlation"]) for w in raw_profile.correlation_warnings(df, df.columns)], "column_x string, column_y string, r double")


@query("select 'general' as family, 'o_orderpriority' as column_name, cast(count(o_orderpriority) as bigint) as n, cast(count(*) - count(o_orderpriority) as bigint) as missing_count, cast(count(distinct o_orderpriority) as bigint) as unique_count, round(100.0 * count(distinct o_orderpriority) / count(o_orderpriority), 4) as unique_percentage from orders")
def general_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority")
    raw = raw_profile.profile(df)
    c = statistics.statistical_profile(df, summary.summarise(raw, df, []))["columns"]["o_orderpriority"]
    return spark.createDataFrame([("general", "o_orderpriority", c["count"], c["missing_count"], c["unique_count"], round(c["unique_percentage"], 4))], "family string, column_name string, n long, missing_count long, unique_count long, unique_percentage double")


# --- raw profile --------------------------------------------------------------------------------------------------


@query(cte("dirty_orders") + "select cast(count(*) as bigint) as row_count, cast(sum(case when v is null then 1 else 0 end) as bigint) as null_count, round(100.0 * sum(case when v is null then 1 else 0 end) / count(*), 4) as null_percentage, cast(sum(case when lower(trim(v)) in ('','na','n/a','nan','null','none','missing') then 1 else 0 end) as bigint) as null_like_count, cast(sum(case when v <> trim(v) then 1 else 0 end) as bigint) as whitespace_count, cast(sum(case when trim(v) = '' then 1 else 0 end) as bigint) as empty_string_count, cast(sum(case when trim(v) = '' and v <> '' then 1 else 0 end) as bigint) as whitespace_only_count, round(avg(length(v)), 4) as average_length from t")
def null_profile(spark, sf_dir):
    found = raw_profile.profile(dirty(spark, sf_dir, "dirty_orders").select("v"))
    p = found["columns"][0]
    return spark.createDataFrame(
        [(found["row_count"], p["null_count"], p["null_percentage"], p["null_like_count"], p["whitespace_count"], p["empty_string_count"], p["whitespace_only_count"], p["average_string_length"])],
        "row_count long, null_count long, null_percentage double, null_like_count long, whitespace_count long, empty_string_count long, whitespace_only_count long, average_length double",
    )


@query(cte("dirty_orders") + "select lower(trim(v)) as marker, cast(count(*) as bigint) as n from t where lower(trim(v)) in ('','na','n/a','nan','null','none','missing') group by 1")
def null_like_breakdown(spark, sf_dir):
    p = raw_profile.profile(dirty(spark, sf_dir, "dirty_orders").select("v"))["columns"][0]
    return spark.createDataFrame(list(p["null_like_breakdown"].items()), "marker string, n long")


@query(cte("dirty_orders") + "select cast(sum(case when v is null then 1 else 0 end) as bigint) as total_null_count, cast(sum(case when lower(trim(v)) in ('','na','n/a','nan','null','none','missing') then 1 else 0 end) as bigint) as total_null_like_count, cast(sum(case when v is null or lower(trim(v)) in ('','na','n/a','nan','null','none','missing') then 1 else 0 end) as bigint) as total_missing_count, round(100.0 * sum(case when v is null or lower(trim(v)) in ('','na','n/a','nan','null','none','missing') then 1 else 0 end) / (2 * count(*)), 4) as total_missing_percentage from t")
def null_summary(spark, sf_dir):
    s = raw_profile.profile(dirty(spark, sf_dir, "dirty_orders"))["null_summary"]
    return spark.createDataFrame([(s["total_null_count"], s["total_null_like_count"], s["total_missing_count"], s["total_missing_percentage"])], "total_null_count long, total_null_like_count long, total_missing_count long, total_missing_percentage double")


UNIQUE = (("customer", ("c_custkey", "c_name", "c_mktsegment")), ("part", ("p_brand", "p_type", "p_size")))


@query(" union all ".join(f"select '{c}' as column_name, cast(count(distinct {c}) as bigint) as unique_count, round(1.0 * count(distinct {c}) / count(*), 4) as uniqueness_ratio from {t}" for t, cs in UNIQUE for c in cs))
def uniqueness(spark, sf_dir):
    """Distinct values by their hashes: no text is shuffled."""
    rows = []
    for t, cs in UNIQUE:
        df = table(spark, sf_dir, t).select(*cs)
        found, n = distinct_measures(df, list(cs)), df.count()
        rows += [(c, found[c]["unique"], rounded(found[c]["unique"] / n)) for c in cs]
    return spark.createDataFrame(rows, "column_name string, unique_count long, uniqueness_ratio double")


@query(cte("dirty_orders") + "select count(distinct case when trim(v) <> '' then lower(trim(v)) end) < count(distinct case when trim(v) <> '' then trim(v) end) as has_case_variations, min(length(v)) <> max(length(v)) as variable_length from t")
def case_variations(spark, sf_dir):
    p = raw_profile.profile(dirty(spark, sf_dir, "dirty_orders").select("v"))["columns"][0]
    return spark.createDataFrame([(p["has_case_variations"], p["variable_length"])], "has_case_variations boolean, variable_length boolean")


NUMBER_SQL = "(" + " or ".join(f"regexp_full_match(trim(v), '{p.strip('^$')}')" for p in (text.PLAIN_NUMBER, text.GROUPED_NUMBER)) + ")"


@query(cte("text_numbers") + f"select round(100.0 * sum(case when {NUMBER_SQL} then 1 else 0 end) / count(v), 4) as numeric_like, cast(sum(case when {NUMBER_SQL} then 1 else 0 end) as bigint) as parsed, round(sum(case when {NUMBER_SQL} then try_cast(replace(trim(v), ',', '') as double) end), 2) as total from t")
def numeric_parse_rate(spark, sf_dir):
    df = dirty(spark, sf_dir, "text_numbers")
    found = raw_profile.text_measures(cells_of(df, ["v"]), ("string_count", "numeric_like"))["v"]
    c = text.to_number(F.col("v"))
    return df.agg(F.lit(share(found["numeric_like"], found["string_count"])).alias("numeric_like"), F.count(c).alias("parsed"), F.round(F.sum(c), 2).alias("total"))


@query(cte("text_dates") + "select round(100.0 * count(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%d/%m/%Y'))) / count(v), 4) as datetime_like from t")
def datetime_parse_rate(spark, sf_dir):
    found = raw_profile.text_measures(value_counts(dirty(spark, sf_dir, "text_dates"), ["v"]), ("string_count", "datetime_like"))["v"]
    return spark.createDataFrame([(share(found["datetime_like"], found["string_count"]),)], "datetime_like double")


@query(cte("text_booleans") + "select round(100.0 * sum(case when lower(trim(v)) in ('true','yes','y','1','false','no','n','0') then 1 else 0 end) / count(v), 4) as boolean_like from t")
def boolean_parse_rate(spark, sf_dir):
    p = raw_profile.profile(dirty(spark, sf_dir, "text_booleans").select("v"))["columns"][0]
    return spark.createDataFrame([(p["boolean_like_percentage"],)], "boolean_like double")


@query(cte("text_dates") + r"select s as signature, cast(count(*) as bigint) as n from (select case when regexp_full_match(trim(v), '\d{4}[-/.]\d{1,2}[-/.]\d{1,2}') then 'iso_date' when regexp_full_match(trim(v), '\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}') then 'numeric_date' end as s from t) where s is not null group by s")
def format_signatures(spark, sf_dir):
    return dirty(spark, sf_dir, "text_dates").select(text.date_signature(F.col("v")).alias("signature")).where("signature is not null").groupBy("signature").agg(F.count("*").alias("n"))


@query("with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events) select cast(sum(case when b <> a and (value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) then 1 else 0 end) as bigint) as outlier_count, round(skewness(value), 4) as skewness, abs(skewness(value)) >= 1 as skewed from events, q")
def iqr_outliers_raw(spark, sf_dir):
    p = raw_profile.profile(table(spark, sf_dir, "events").select("value"))["columns"][0]
    return spark.createDataFrame([(p["outlier_count"], round(p["skewness"], 4), abs(p["skewness"]) >= 1)], "outlier_count long, skewness double, skewed boolean")


TYPES = {
    "customer": {"c_custkey": "numeric", "c_name": "unresolved", "c_mktsegment": "categorical"},
    "part": {"p_brand": "categorical", "p_retailprice": "numeric"},
}


@query(
    " union all ".join(
        f"""select '{c}' as column_name, case when typeof(any_value({c})) in ('BIGINT', 'INTEGER', 'DOUBLE') then 'numeric' when 1.0 * count(distinct {c}) / count(*) <= 0.2 and count(distinct {c}) > 1 then 'categorical'
        when 1.0 * count(distinct {c}) / count(*) >= 0.9 and min(length(cast({c} as varchar))) <> max(length(cast({c} as varchar))) then 'free_text' else 'unresolved' end as semantic_type from {t}"""
        for t, cs in TYPES.items()
        for c in cs
    )
)
def semantic_types(spark, sf_dir):
    rows = [(p["name"], p["semantic_type"]) for t, cs in TYPES.items() for p in raw_profile.profile(table(spark, sf_dir, t).select(*cs))["columns"]]
    return spark.createDataFrame(rows, "column_name string, semantic_type string")


# --- structure ----------------------------------------------------------------------------------------------------


@query(cte("dup_rows") + "select cast(sum(k) as bigint) as any_count, cast(sum(k - 1) as bigint) as extra_count from (select n_name, n_regionkey, count(*) as k from t group by all having count(*) > 1)")
def duplicate_rows_any_extra(spark, sf_dir):
    return spark.createDataFrame([duplicate_rows(dirty(spark, sf_dir, "dup_rows"))], "any_count long, extra_count long")


@query(cte("twin_columns") + "select * from (select 'c_custkey' as a, 'c_copy' as b, bool_and(c_custkey is not distinct from c_copy) as same from t union all select 'c_acctbal', 'c_balance', bool_and(c_acctbal is not distinct from c_balance) from t) where same")
def identical_columns(spark, sf_dir):
    return spark.createDataFrame([(a, b, True) for a, b in identical_pairs(dirty(spark, sf_dir, "twin_columns"))], "a string, b string, same boolean")


@query("select min(c_row) = 0 and bool_and(c_row = place) as index_like from (select c_custkey - 1 as c_row, row_number() over () - 1 as place from customer)")
def index_like(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("c_row"))
    return spark.createDataFrame([(raw_profile.index_like(df, "Unnamed: 0", "c_row", "numeric", df.count()),)], "index_like boolean")


@query("select o_orderkey, row_number() over () - 1 as row_idx from orders")
def row_numbers(spark, sf_dir):
    return row_order.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "row_idx")


@query(
    "with t as (select row_number() over () as place, case when event_id % 6 = 0 then null else value end as value, event_type from events), "
    "n as (select 'value' as column_name, cast(value as varchar) as shown, value as number, place from t where value is not null union all select 'event_type', event_type, null, place from t where event_type is not null), "
    "r as (select *, row_number() over (partition by column_name order by place) as p from n) select column_name, cast(p as int) as place, case when number is null then shown end as shown, number from r where p <= 5"
)
def first_values(spark, sf_dir):
    """Samples of columns in file order, nulls left out."""
    df = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"), "event_type")
    found = row_order.first_values(df, {n: F.col(n) for n in df.columns}, raw_profile.SAMPLES)
    number = F.when(F.col("column") == "value", F.try_variant_get("value", "$", "double"))
    return found.select(F.col("column").alias("column_name"), "place", F.when(number.isNull(), F.try_variant_get("value", "$", "string")).alias("shown"), number.alias("number"))


@query(
    "with h as (select n_nationkey, lower(trim(regexp_replace(concat(' ', r_name, ' (', n_nationkey % 3, ') '), '[^0-9a-zA-Z]+', '_', 'g'), '_')) as base from nation join region on r_regionkey = n_regionkey), "
    "k as (select *, row_number() over (partition by base order by n_nationkey) as k from h) select case when k = 1 then base else base || '_' || k end as name, cast(n_nationkey as int) as place from k"
)
def header_normalisation(spark, sf_dir):
    """A header made of the table's own values, with repeated names, blanks and signs."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    header = [r[0] for r in named.orderBy("n_nationkey").select(F.concat(F.lit(" "), "r_name", F.lit(" ("), (F.col("n_nationkey") % 3).cast("string"), F.lit(") "))).collect()]
    return spark.createDataFrame([(n, i) for i, n in enumerate(structure.normalised_names(header))], "name string, place int")


# --- cleaning -----------------------------------------------------------------------------------------------------


def scalar(name: str, view: str, sql: str, build: Callable) -> None:
    def run(spark, sf_dir):
        df = dirty(spark, sf_dir, view)
        keys = [c for c in df.columns if c != "v"]
        return df.select(*keys, build(F.col("v")).alias("v"))

    QUERIES[name] = run
    source = DIRTY[view][1]
    keys = "l_orderkey, l_linenumber" if "lineitem" in source else "o_orderkey"
    ORACLE_SQL[name] = cte(view) + f"select {keys}, {sql} as v from t"


scalar("strip_text", "dirty_orders", "trim(v)", text.strip)
scalar("null_out", "dirty_orders", "case when lower(trim(v)) in ('','na','n/a','nan','null','none','missing') then null else v end", text.null_words_out)
scalar("blank_out", "dirty_orders", "case when trim(v) = '' then null else v end", text.blanks_out)
scalar("to_number", "text_numbers", f"case when {NUMBER_SQL} then try_cast(replace(trim(v), ',', '') as double) end", text.to_number)
scalar("to_boolean", "text_booleans", "case when lower(trim(v)) in ('true','yes','y','1') then true when lower(trim(v)) in ('false','no','n','0') then false end", text.to_boolean)
scalar("to_date_month_first", "text_dates", "strftime(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%d/%m/%Y')), '%Y-%m-%d')", lambda c: F.date_format(text.to_timestamp(c), "yyyy-MM-dd"))
scalar("to_date_day_first", "text_dates", "strftime(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y')), '%Y-%m-%d')", lambda c: F.date_format(text.to_timestamp(c, True), "yyyy-MM-dd"))
scalar("case_lower", "dirty_orders", "lower(v)", text.lower)
scalar("case_upper", "dirty_orders", "upper(v)", text.upper)
scalar("percentage_cells", "text_percent", r"regexp_full_match(trim(v), '[+-]?\d+(\.\d+)?\s*%')", text.is_percentage)
scalar("currency_cells", "text_currency", r"regexp_full_match(v, '\s*[$€£₹]\s*[+-]?\d[\d,]*(\.\d+)?\s*')", text.is_currency)


@query(cte("dirty_orders") + r"select o_orderkey, case when v is not null then coalesce(list_aggregate(list_transform(regexp_extract_all(v, '\p{L}+|[^\p{L}]+'), lambda w: concat(upper(w[1:1]), lower(w[2:]))), 'string_agg', ''), '') end as v from t")
def case_title(spark, sf_dir):
    return dirty(spark, sf_dir, "dirty_orders").select("o_orderkey", text.title(F.col("v")).alias("v"))


def convert(view: str, action: str, spark, sf_dir, confidence: float = 0.95) -> DataFrame:
    df = dirty(spark, sf_dir, view).select("v")
    _, log = executor.execute(df, Plan([Action(["v"], action, confidence)], "query"))
    e = next(x for x in log if x["action"] == action)
    return spark.createDataFrame([(e["status"], e["invalid_count"], e["data_loss_ratio"])], "status string, invalid_count long, data_loss_ratio double")


@query(cte("text_numbers") + f"select case when loss > 0.3 then 'rejected' else 'executed' end as status, cast(bad as bigint) as invalid_count, round(loss, 4) as data_loss_ratio from (select sum(case when not {NUMBER_SQL} then 1 else 0 end) as bad, 1.0 * sum(case when not {NUMBER_SQL} then 1 else 0 end) / count(v) as loss from t)")
def conversion_audit_numeric(spark, sf_dir):
    return convert("text_numbers", "convert_to_numeric", spark, sf_dir)


@query(cte("text_booleans") + "select case when bad > 0 then 'rejected' else 'executed' end as status, cast(bad as bigint) as invalid_count, round(1.0 * bad / n, 4) as data_loss_ratio from (select sum(case when lower(trim(v)) not in ('true','yes','y','1','false','no','n','0') then 1 else 0 end) as bad, count(v) as n from t)")
def conversion_audit_boolean(spark, sf_dir):
    return convert("text_booleans", "convert_to_boolean", spark, sf_dir)


@query(cte("dirty_orders") + "select cast(sum(case when coalesce(v <> trim(v), false) then 1 else 0 end) as bigint) as values_changed from t")
def strip_log(spark, sf_dir):
    _, log = executor.execute(dirty(spark, sf_dir, "dirty_orders").select("v"), Plan([], "query"))
    return spark.createDataFrame([(log[0]["values_changed"],)], "values_changed long")


@query(cte("dirty_orders") + "select 'v' as column_name, cast(count(distinct v) as bigint) as unique_before, cast(count(distinct trim(v)) as bigint) as unique_after, round(100.0 * sum(case when v is null then 1 else 0 end) / count(*), 4) as null_percentage from t")
def before_after_diff(spark, sf_dir):
    df = dirty(spark, sf_dir, "dirty_orders").select("v")
    raw = raw_profile.profile(df)
    cleaned, log = executor.execute(df, Plan([], "query"))
    c = summary.summarise(raw, cleaned, log)["columns"][0]["changes"]
    return spark.createDataFrame([("v", c["unique_count"]["before"], c["unique_count"]["after"], c["null_percentage"]["after"])], "column_name string, unique_before long, unique_after long, null_percentage double")


# --- mergeable profiles -------------------------------------------------------------------------------------------

STATED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
#: A state's number of a text is its length; its skewness is 0 where all numbers are equal.
STATE_SQL = (
    "'@c' as column_name, cast(count(*) as bigint) as n_rows, cast(count(*) - count(@c) as bigint) as null_count, round(avg(@v), 4) as mean, round(stddev_samp(@v), 4) as std, "
    "case when count(@v) < 3 then null when min(@v) = max(@v) then 0.0 else round(skewness(@v), 4) end as skewness, cast(min(@v) as double) as low, cast(max(@v) as double) as high from lineitem"
)


def state_sql(c: str, by: str = "") -> str:
    return f"select {by and by + ', '}" + STATE_SQL.replace("@v", "length(@c)" if c == "l_returnflag" else "cast(@c as double)").replace("@c", c) + (" group by all" if by else "")


def monthly_states(spark, sf_dir):
    """Profile states of line items by month of shipment."""
    df = table(spark, sf_dir, "lineitem").select(*STATED, F.year("l_shipdate").alias("ship_year"), F.month("l_shipdate").alias("ship_month"))
    return profile_state.states(df, ["ship_year", "ship_month"])


def stated(merged: DataFrame, *by: str) -> DataFrame:
    found = profile_state.measures(merged)
    return found.select(*by, F.col("column").alias("column_name"), F.col("rows").alias("n_rows"), F.col("nulls").alias("null_count"), *(F.round(c, 4).alias(c) for c in ("mean", "std", "skewness")), "low", "high")


@query(" union all ".join(state_sql(c) for c in STATED))
def merged_profile(spark, sf_dir):
    """The profile of a table from the states of its months."""
    return stated(profile_state.merge(monthly_states(spark, sf_dir)))


@query(" union all ".join(state_sql(c, "cast(year(l_shipdate) as int) as ship_year") for c in STATED))
def yearly_profiles(spark, sf_dir):
    """The profile of every year from the states of its months."""
    return stated(profile_state.merge(monthly_states(spark, sf_dir), ["ship_year"]), "ship_year")


# --- chart data ---------------------------------------------------------------------------------------------------

MEASURED = ("l_quantity", "l_extendedprice", "l_discount")
BIN_SQL = "cast(least(floor(({c} - {c}_a) / ({c}_z - {c}_a) * 20), 19) as int)"
RANGE_SQL = "with r as (select " + ", ".join(f"cast(min({c}) as double) as {c}_a, cast(max({c}) as double) as {c}_z" for c in MEASURED) + " from lineitem), t as (select * from lineitem, r) "


@query(RANGE_SQL + " union all ".join(f"select '{c}' as column_name, {BIN_SQL.format(c=c)} as bin, cast(count(*) as bigint) as n from t where {c} is not null group by all" for c in MEASURED))
def numeric_histograms(spark, sf_dir):
    return chart_data.histograms(table(spark, sf_dir, "lineitem"), list(MEASURED)).select(F.col("column").alias("column_name"), "bin", "n")


@query(RANGE_SQL + " union all ".join(f"select '{a}' as a, '{b}' as b, {BIN_SQL.format(c=a)} as bin_a, {BIN_SQL.format(c=b)} as bin_b, cast(count(*) as bigint) as n from t where {a} is not null and {b} is not null group by all" for i, a in enumerate(MEASURED) for b in MEASURED[i + 1 :]))
def scatter_bins(spark, sf_dir):
    return chart_data.pair_bins(table(spark, sf_dir, "lineitem"), list(MEASURED))


CROSSED = "select o_orderpriority, o_orderstatus, case when o_orderkey % 9 <> 0 then cast(o_custkey % 4 as varchar(4)) end as desk, o_totalprice from orders"
CROSS_KEYS = ("o_orderpriority", "o_orderstatus", "desk")


@query(
    f"with t as ({CROSSED}) "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, {a} as value_a, {b} as value_b, cast(count(*) as bigint) as n, round(count(*) / sum(count(*)) over (partition by {a}), 6) as share, cast(null as double) as mean from t where {a} is not null and {b} is not null group by {a}, {b}"
        for i, a in enumerate(CROSS_KEYS)
        for b in CROSS_KEYS[i + 1 :]
    )
    + " union all "
    + " union all ".join(f"select '{a}', null, {a}, null, cast(count(*) as bigint), round(count(*) / sum(count(*)) over (), 6), round(avg(o_totalprice), 2) from t where {a} is not null group by {a}" for a in CROSS_KEYS)
)
def cross_tables(spark, sf_dir):
    """All crossed categories and category means by one pass of grouping sets."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    df = spark.sql(CROSSED)
    cardinality = {n: f["unique"] for n, f in distinct_measures(df, list(CROSS_KEYS)).items()}
    found = chart_data.cross_tables(df, {n: cardinality[n] for n in CROSS_KEYS}, ["o_totalprice"])
    mean = F.when(F.col("second").isNull(), F.round(F.col("means")["o_totalprice"], 2))
    return found.select(F.col("first").alias("a"), F.col("second").alias("b"), F.col("first_value").alias("value_a"), F.col("second_value").alias("value_b"), "n", F.round("share", 6).alias("share"), mean.alias("mean"))


LACKING = "select case when event_id % 6 <> 0 then value end as value, case when event_id % 4 <> 0 then event_type end as event_type, case when event_id % 10 <> 0 then event_id end as event_id from events"
LACKING_KEYS = ("value", "event_type", "event_id")


@query(f"with t as ({LACKING}) " + " union all ".join(f"select '{a}' as a, '{b}' as b, cast(count(*) as bigint) as n from t where {a} is null and {b} is null having count(*) > 0" for i, a in enumerate(LACKING_KEYS) for b in LACKING_KEYS[i:]))
def missing_together(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return chart_data.missing_together(spark.sql(LACKING))


# --- profiles and what follows from them, as SQL over aggregates -----------------------------------------------------

WORDS = ", ".join(f"'{w}'" for w in text.NULL_WORDS)
YES_NO = ", ".join(f"'{w}'" for w in (*text.TRUE_WORDS, *text.FALSE_WORDS))
GENERIC_SQL = rf"try_cast(case when regexp_full_match(trim(@c), '{text.GENERIC_NUMBER.strip('^$')}') then trim(@c) end as double)"
DATE_SQL = "coalesce(try_strptime(@c, '%Y-%m-%d'), try_strptime(@c, '%m/%d/%Y'), try_strptime(@c, '%d/%m/%Y'))"
UNIT_SQL = rf"case when regexp_matches(trim(@c), '{text.MEASURE}') then case when len(regexp_extract_all(trim(@c), '{text.UNIT}')) > 0 then 'unit:' || array_to_string(list_sort(list_transform(regexp_extract_all(trim(@c), '{text.UNIT}'), lambda x: lower(x))), ' ') when @number then 'unit:none' end end"
SIGNATURE_SQL = rf"case when regexp_matches(trim(@c), '{text.ISO_DATE}') then 'iso_date' when regexp_matches(trim(@c), '{text.NUMERIC_DATE}') then 'numeric_date' end"


def column_sql(at: int, name: str, kind: str, relation: str) -> str:
    """One row of a column's measures: kind is text, numeric or datetime."""
    number = f"case when {name} is not null then cast({name} as double) end" if kind == "numeric" else GENERIC_SQL.replace("@c", name) if kind == "text" else "cast(null as double)"
    parsed = NUMBER_SQL.replace("trim(v)", f"trim({name})")
    like = f"sum(case when {{}} then 1 else 0 end) / nullif(count({name}), 0)"
    shares = {
        "text": (like.format(parsed), f"count({DATE_SQL.replace('@c', f'trim({name})')}) / nullif(count({name}), 0)", like.format(f"lower(trim({name})) in ({YES_NO})")),
        "numeric": ("1", "0", like.format(f"{name} in (0, 1)")),
        "datetime": ("0", "1", "0"),
    }[kind]
    of_text = lambda sql, other: sql.replace("@number", parsed).replace("@c", name) if kind == "text" else other
    return f"""select {at} as position, '{name}' as name, '{kind}' as kind, any_value(lower(typeof({name}))) as type, count(*) as n_rows, count(*) - count({name}) as null_count, count({name}) as n_values, count(distinct {name}) as unique_count,
      round(count(distinct {name}) / count(*), 4) as ratio, {of_text("sum(case when lower(trim(@c)) in (" + WORDS + ") then 1 else 0 end)", "0")} as null_like_count, {of_text("sum(case when @c <> trim(@c) then 1 else 0 end)", "0")} as whitespace_count,
      round(100.0 * {shares[0]}, 4) as numeric_like, round(100.0 * {shares[1]}, 4) as datetime_like, round(100.0 * {shares[2]}, 4) as boolean_like,
      {of_text("min(length(@c)) <> max(length(@c))", "false")} as varies, {of_text("count(distinct case when trim(@c) <> '' then lower(trim(@c)) end) < count(distinct case when trim(@c) <> '' then trim(@c) end)", "false")} as case_variations,
      {of_text("count(distinct " + SIGNATURE_SQL + ") + count(distinct " + UNIT_SQL + ")", "0")} as signatures,
      case when count(x) >= 4 and max(q3) <> max(q1) then sum(case when x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) then 1 else 0 end) else 0 end as outlier_count, case when count(x) >= 4 then skewness(x) end as skewness
      from (select *, {number} as x, quantile_cont({number}, 0.25) over () as q1, quantile_cont({number}, 0.75) over () as q3 from {relation})"""


def profile_sql(relation: str, columns: tuple[tuple[str, str], ...]) -> str:
    """CTEs facts and typed: the measures of a relation's columns and their semantic types."""
    return f"""facts as ({" union all ".join(column_sql(i, n, k, relation) for i, (n, k) in enumerate(columns))}), typed as (
      select *, case when kind = 'numeric' then 'numeric' when kind = 'datetime' then 'datetime' when numeric_like >= 80 then 'numeric' when datetime_like >= 80 then 'datetime' when boolean_like >= 80 then 'boolean'
        when unique_count / n_rows <= 0.2 and unique_count > 1 then 'categorical' when unique_count / n_rows >= 0.9 and varies then 'free_text' else 'unresolved' end as semantic_type from facts)"""


ORDER_KINDS = (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "text"))
PART_KINDS = (("p_partkey", "numeric"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "numeric"), ("p_retailprice", "numeric"))

PROFILE_SQL = f"""with {profile_sql("orders", ORDER_KINDS)} select cast(position as int) as position, name, case type when 'varchar' then 'string' when 'double' then 'double' when 'timestamp' then 'timestamp_ntz' else type end as dtype, semantic_type,
  round(case when semantic_type = 'categorical' then 1 - unique_count / n_rows when semantic_type = 'free_text' then unique_count / n_rows when semantic_type = 'unresolved' then 0 else 1.0 end, 4) as confidence, cast(null_count as bigint) as null_count, cast(unique_count as bigint) as unique_count, ratio as uniqueness_ratio,
  cast(null_like_count as bigint) as null_like_count, cast(whitespace_count as bigint) as whitespace_count, numeric_like as numeric_like_percentage, datetime_like as datetime_like_percentage, boolean_like as boolean_like_percentage, cast(outlier_count as bigint) as outlier_count, round(skewness, 4) as skewness from typed"""

#: The planner's rules in the order of their ids, each a condition and a confidence in percent.
PLAN_RULES = (
    ("strip_whitespace", "whitespace_count > 0", "100.0 * whitespace_count / n_rows"),
    ("convert_to_numeric", "kind = 'text' and numeric_like >= 80 and semantic_type = 'numeric'", "numeric_like"),
    ("convert_to_datetime", "kind = 'text' and datetime_like >= 80 and semantic_type = 'datetime' and signatures <= 1", "datetime_like"),
    ("convert_to_boolean", "kind = 'text' and boolean_like >= 80 and semantic_type = 'boolean'", "boolean_like"),
    ("classify_as_categorical", "unique_count / n_rows <= 0.2 and unique_count > 1 and semantic_type in ('categorical', 'free_text')", "100 - 100.0 * unique_count / n_rows"),
    ("preserve_free_text", "semantic_type = 'free_text'", "100.0 * unique_count / n_rows"),
    ("normalize_case", "case_variations and unique_count / n_rows <= 0.2 and unique_count > 1", "100"),
    ("review_outliers", "outlier_count > 0", "100"),
    ("review_skewness", "abs(skewness) >= 1", "100"),
    ("review_mixed_format", "signatures > 1", "100"),
    ("review_semantic_type", "semantic_type = 'unresolved'", "0"),
)
PLAN_KINDS = (("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("v", "text"), ("priority", "text"))
PLAN_SQL = (
    f"with a as ({DIRTY['text_numbers'][1]}), b as ({DIRTY['dirty_orders'][1]}), t as (select a.l_orderkey, l_linenumber, a.v, b.v as priority from a join b on o_orderkey = l_orderkey), {profile_sql('t', PLAN_KINDS)} "
    + " union all ".join(f"select name as column_name, '{action}' as action, round(least(1.0, greatest(0.0, cast({percent} as double) / 100)), 4) as confidence from typed where {when}" for action, when, percent in PLAN_RULES)
)

#: The chart rules over typed columns: how many columns each takes, from what, and on which condition.
PAIR = "from c a join c b on a.semantic_type = '{}' and b.semantic_type = '{}'"
CHART_SQL = (
    ("NUMERIC_HISTOGRAM", "histogram", "name from c where semantic_type = 'numeric'", 0.95, "high"),
    ("NUMERIC_BOX_PLOT", "box_plot", "name from c where semantic_type = 'numeric'", 0.95, "medium"),
    ("CATEGORICAL_BAR", "bar_chart", "name from c where semantic_type = 'categorical'", 0.95, "high"),
    ("LOW_CARDINALITY_PIE", "pie_donut_chart", "name from c where semantic_type = 'categorical' and unique_count between 2 and 6", 0.85, "medium"),
    ("NUMERIC_NUMERIC_SCATTER", "scatter_plot", "a.name || ',' || b.name " + PAIR.format("numeric", "numeric") + " and a.position < b.position", 0.90, "high"),
    ("DATETIME_NUMERIC_LINE", "line_chart", "a.name || ',' || b.name " + PAIR.format("datetime", "numeric"), 0.95, "high"),
    ("CATEGORICAL_NUMERIC_GROUPED_BAR", "grouped_bar_chart", "a.name || ',' || b.name " + PAIR.format("categorical", "numeric") + " and a.unique_count between 2 and 20", 0.85, "medium"),
    *((r, k, "a.name || ',' || b.name " + PAIR.format("categorical", "categorical") + " and a.position < b.position and a.unique_count between 2 and 20 and b.unique_count between 2 and 10", 0.85, "medium") for r, k in (("CATEGORICAL_CATEGORICAL_STACKED_BAR", "stacked_bar_chart"), ("CATEGORICAL_CATEGORICAL_100_PERCENT", "100_percent_stacked_bar_chart"))),
    ("MULTIPLE_NUMERIC_CORRELATION", "correlation_heatmap", "string_agg(name, ',' order by position) from c where semantic_type = 'numeric' having count(*) >= 2", 0.95, "high"),
    ("MISSINGNESS_BAR", "missingness_bar_chart", "string_agg(name, ',' order by position) from c where null_count > 0 having count(*) >= 1", 0.95, "high"),
    ("MULTIPLE_COLUMN_MISSINGNESS", "missingness_heatmap", "string_agg(name, ',' order by position) from c where null_count > 0 having count(*) >= 2", 0.90, "medium"),
    ("NUMERIC_VIOLIN", "violin_plot", "name from c where semantic_type = 'numeric' and n_rows >= 20", 0.85, "medium"),
    ("NUMERIC_QQ", "qq_plot", "name from c where semantic_type = 'numeric' and n_rows >= 20", 0.80, "low"),
    ("MULTIPLE_NUMERIC_PAIR_PLOT", "pair_plot", "string_agg(name, ',' order by position) from c where semantic_type = 'numeric' having count(*) between 2 and 8", 0.85, "medium"),
)


def charts_sql(relation: str, columns: tuple[tuple[str, str], ...]) -> str:
    rules = " union all ".join(f"select '{rule}' as rule_id, '{chart}' as chart_type, columns, cast({conf} as double) as confidence, '{priority}' as priority from (select {what.replace(' from ', ' as columns from ', 1)})" for rule, chart, what, conf, priority in CHART_SQL)
    return f"with {profile_sql(relation, columns)}, c as (select * from typed where semantic_type not in ('identifier', 'free_text', 'unresolved')), charts as ({rules})"


# --- all columns together -----------------------------------------------------------------------------------------

WIDE = {f"x{i}": f"case when (l_orderkey + {i}) % 11 <> 0 then l_quantity * {i % 5} + l_extendedprice * {i % 3} / 1000 + l_linenumber * {i % 7} + l_discount * {i} end" for i in range(1, 25)}


@query(
    f"with t as (select {', '.join(f'{e} as {n}' for n, e in WIDE.items())} from lineitem) "
    + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as correlation from t" for i, a in enumerate(WIDE) for b in list(WIDE)[i + 1 :])
)
def wide_correlations(spark, sf_dir):
    """Pairwise complete correlations of 24 columns by one pass of block sums."""
    df = table(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(n) for n, e in WIDE.items()))
    rows = [(a, b, round(r, 6)) for (a, b), r in gram.correlations(df, list(WIDE)).items()]
    return spark.createDataFrame(rows, "a string, b string, correlation double")


RANKED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey")


@query(" union all ".join(f"select '{n}' as column_name, cast({q} as double) as q, round(cast(quantile_cont({n}, {q}) as double), 6) as value from lineitem" for n in RANKED for q in (0.1, 0.25, 0.5, 0.75, 0.9)))
def joint_quantiles(spark, sf_dir):
    """Quantiles of all columns by narrowing their brackets together, as tables beyond PERCENTILE_ROWS get them."""
    found = selection.joint_quantiles(table(spark, sf_dir, "lineitem"), {n: F.col(n) for n in RANKED}, (0.1, 0.25, 0.5, 0.75, 0.9))
    return spark.createDataFrame([(n, q, round(v, 6)) for n, values in found.items() for q, v in zip((0.1, 0.25, 0.5, 0.75, 0.9), values, strict=True)], "column_name string, q double, value double")


MIXED = """select o_orderkey, case when o_orderkey % 7 = 0 then concat('"', o_orderpriority, '"') when o_orderkey % 5 = 0 then 'true' when o_orderkey % 11 = 0 then 'null'
  when o_orderkey % 3 = 0 then cast(o_orderkey as varchar(20)) when o_orderkey % 13 = 0 then '" na"' else '12.5' end as cell from orders"""


@query(
    f"with t as (select *, json_type(cell) as kind from ({MIXED})) select cast(count(distinct kind) filter (kind <> 'NULL') as bigint) as mixed_type_count, count(distinct kind) filter (kind <> 'NULL') > 1 as has_mixed_types, "
    "cast(count(*) filter (kind = 'NULL') as bigint) as null_count, cast(count(*) filter (kind = 'VARCHAR') as bigint) as string_count, cast(count(*) filter (kind = 'BOOLEAN') as bigint) as n_bool, "
    "cast(count(*) filter (kind = 'DOUBLE') as bigint) as n_float, cast(count(*) filter (kind in ('UBIGINT', 'BIGINT')) as bigint) as n_int, cast(count(*) filter (cell = '\" na\"') as bigint) as null_like_count from t"
)
def mixed_types(spark, sf_dir):
    """What the profile says of a column of JSON cells of several types."""
    with spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")) as orders:
        orders.createOrReplaceTempView("orders")
        df = spark.sql(MIXED).select(F.parse_json("cell").alias("cell"))
        p, counts = raw_profile.profile(df)["columns"][0], mixed.type_counts(df)["cell"]
    row = (p["mixed_type_count"], p["has_mixed_types"], p["null_count"], p["string_count"], counts["bool"], counts["float"], counts["int"], p["null_like_count"])
    return spark.createDataFrame([row], "mixed_type_count long, has_mixed_types boolean, null_count long, string_count long, n_bool long, n_float long, n_int long, null_like_count long")


# --- transforms ---------------------------------------------------------------------------------------------------



@query("select o_orderkey, o_orderstatus = 'F' as \"o_orderstatus_F\", o_orderstatus = 'O' as \"o_orderstatus_O\", o_orderstatus = 'P' as \"o_orderstatus_P\" from orders")
def one_hot_status(spark, sf_dir):
    return transforms.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(cte("gaps") + "select event_id, event_type, round(coalesce(value, avg(value) over ()), 6) as value from t")
def mean_impute(spark, sf_dir):
    return transforms.mean_impute(dirty(spark, sf_dir, "gaps"), "value").withColumn("value", F.round("value", 6))


@query(cte("gaps") + ", q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from t) select event_id, event_type, value from t, q where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)")
def iqr_filter(spark, sf_dir):
    return transforms.drop_outliers(dirty(spark, sf_dir, "gaps"), "value")


@query(cte("gaps") + "select event_id, event_type, round(case when value > 0 then ln(value) else value end, 6) as value from t")
def log_transform(spark, sf_dir):
    return transforms.log_column(dirty(spark, sf_dir, "gaps"), "value").withColumn("value", F.round("value", 6))


# --- plans, charts, legacy, pipeline ------------------------------------------------------------------------------


@query(PLAN_SQL)
def plan_actions(spark, sf_dir):
    df = dirty(spark, sf_dir, "text_numbers").join(dirty(spark, sf_dir, "dirty_orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("v").alias("priority")), "l_orderkey").persist()  # joined once for all passes
    plan = plan_cleaning(raw_profile.profile(df), df.columns)
    df.unpersist()
    return spark.createDataFrame([(a.columns[0], a.action, float(a.confidence)) for a in plan.actions], "column_name string, action string, confidence double")


@query(PROFILE_SQL)
def raw_profile_table(spark, sf_dir):
    return raw_profile.profile_table(spark, raw_profile.profile(table(spark, sf_dir, "orders"))).withColumn("skewness", F.round("skewness", 4))


ORDERS = (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False))
MEASURES_SQL = " union all ".join(
    f"select '{c}' as name, cast(sum(case when {c} is null then 1 else 0 end) as bigint) as null_count, cast(count(distinct {c}) as bigint) as unique_count, round(1.0 * count(distinct {c}) / count(*), 4) as uniqueness_ratio, "
    + (f"cast(sum(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 else 0 end) as bigint)" if number else "cast(0 as bigint)")
    + " as outlier_count, "
    + (f"round(skewness({c}), 4)" if number else "cast(null as double)")
    + " as skewness from orders"
    + (f", (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from orders)" if number else "")
    for c, number in ORDERS
)


@query(MEASURES_SQL)
def profile_measures(spark, sf_dir):
    """The measures of raw_profile_table that SQL expresses."""
    found = raw_profile.profile(table(spark, sf_dir, "orders").select(*(c for c, _ in ORDERS)))
    rows = raw_profile.profile_table(spark, found)
    return rows.select("name", "null_count", "unique_count", "uniqueness_ratio", "outlier_count", F.round("skewness", 4).alias("skewness"))


@query(charts_sql("orders", ORDER_KINDS) + " select * from charts")
def chart_candidates(spark, sf_dir):
    with spread(table(spark, sf_dir, "orders")) as df:
        found = statistics.statistical_profile(df, summary.summarise(raw_profile.profile(df), df, [], unchanged=True))
    return spark.createDataFrame([(c.rule_id, c.chart_type, ",".join(c.columns), c.confidence, c.priority) for c in charts.candidates(found)], "rule_id string, chart_type string, columns string, confidence double, priority string")


@query(cte("text_percent") + r"select 'percentage' as inferred_type, cast(sum(case when trim(v) = '' then 1 else 0 end) as bigint) as empty_string_count, round(100.0 * sum(case when regexp_full_match(trim(v), '[+-]?\d+(\.\d+)?\s*%') then 1 else 0 end) / sum(case when trim(v) <> '' then 1 else 0 end), 4) as percentage_parse from t")
def legacy_percentage(spark, sf_dir):
    p = legacy.profile(dirty(spark, sf_dir, "text_percent").select("v"))["columns"][0]
    return spark.createDataFrame([(p["inferred_type"], p["empty_string_count"], p["percentage_parse_percentage"])], "inferred_type string, empty_string_count long, percentage_parse double")


@query(cte("text_currency") + r"select 'currency' as inferred_type, cast(sum(case when v is null then 1 else 0 end) as bigint) as null_like_count, round(100.0 * sum(case when regexp_full_match(v, '\s*[$€£₹]\s*[+-]?\d[\d,]*(\.\d+)?\s*') then 1 else 0 end) / count(v), 4) as currency_parse from t")
def legacy_currency(spark, sf_dir):
    p = legacy.profile(dirty(spark, sf_dir, "text_currency").select("v"))["columns"][0]
    return spark.createDataFrame([(p["inferred_type"], p["null_like_count"], p["currency_parse_percentage"])], "inferred_type string, null_like_count long, currency_parse double")


@query(cte("one_value") + "select count(distinct v) = 1 as is_constant, cast(count(v) as bigint) as n from t")
def constant_column(spark, sf_dir):
    p = legacy.profile(dirty(spark, sf_dir, "one_value"))["columns"][1]
    return spark.createDataFrame([(p["is_constant"], p["non_null_count"])], "is_constant boolean, n long")


@query(charts_sql("part", PART_KINDS) + " select rule_id, cast(count(*) as bigint) as n from charts group by rule_id")
def evidence_groups(spark, sf_dir):
    with spread(table(spark, sf_dir, "part")) as df:
        found = statistics.statistical_profile(df, summary.summarise(raw_profile.profile(df), df, [], unchanged=True))
    groups = evidence.grouped(evidence.chart_evidence(found, charts.candidates(found)))
    return spark.createDataFrame([(k, len(v)) for k, v in groups.items()], "rule_id string, n long")


def legacy_sql(name: str, kind: str) -> str:
    """The older profile's measures of one column of t: whole numbers, or text."""
    is_text = kind == "text"
    on = lambda sql, other="0": sql.replace("@c", name) if is_text else other
    number = GENERIC_SQL.replace("@c", "r")
    share_of = lambda which: f"coalesce(round(100.0 * sum(case when {which} then 1 else 0 end) / nullif(count(r), 0), 4), 0.0)"
    return f"""select '{name}' as name, '{"string" if is_text else "numeric"}' as physical_type, count({name}) as non_null_count, count(*) - count({name}) as missing_count, count(distinct {name}) as unique_count, count(distinct {name}) < count({name}) as has_duplicates,
      count(distinct {name}) = 1 as is_constant, {on("sum(case when @c <> trim(@c) then 1 else 0 end)")} as whitespace_count, {on("sum(case when trim(@c) = '' then 1 else 0 end)")} as empty_string_count, {on(f"sum(case when lower(trim(@c)) in ({WORDS}) then 1 else 0 end)")} as null_like_text_count,
      {share_of(f"{number} is not null") if is_text else "100.0"} as numeric_parse, {share_of("lower(trim(r)) in ('true','false','yes','no','y','n')") if is_text else "0.0"} as boolean_parse, {on("count(distinct lower(trim(@c))) < count(distinct @c)", "false")} as has_case_variations,
      {"0" if is_text else f"case when max(q3) <> max(q1) then sum(case when {name} < q1 - 1.5 * (q3 - q1) or {name} > q3 + 1.5 * (q3 - q1) then 1 else 0 end) else 0 end"} as outlier_count,
      {f"case when count(r) > 0 and 100.0 * sum(case when {number} is not null then 1 else 0 end) / count(r) >= 70 then case when sum(case when {number} % 1 = 0 then 1 else 0 end) = count({number}) then 'integer' else 'float' end when 100.0 * count(distinct {name}) / count({name}) >= 70 and avg(length({name})) >= 30 then 'text' else 'categorical' end" if is_text else "'integer'"} as inferred_type
      from (select *, {f"case when lower(trim({name})) in ({WORDS}) then null else {name} end" if is_text else name} as r, {"0" if is_text else f"quantile_cont({name}, 0.25) over ()"} as q1, {"0" if is_text else f"quantile_cont({name}, 0.75) over ()"} as q3 from t)"""


LEGACY_FIELDS = ("name", "physical_type", "non_null_count", "missing_count", "unique_count", "has_duplicates", "is_constant", "whitespace_count", "empty_string_count", "null_like_text_count", "numeric_parse_percentage", "boolean_parse_percentage", "has_case_variations", "outlier_count", "inferred_type")
LEGACY_TYPES = ("string", "string", "long", "long", "long", "boolean", "boolean", "long", "long", "long", "double", "double", "boolean", "long", "string")


def legacy_table(name: str, view: str, columns: tuple[tuple[str, str], ...]) -> None:
    """A query of the older profile of a table with faults."""

    def run(spark, sf_dir):
        found = legacy.profile(dirty(spark, sf_dir, view).select(*(c for c, _ in columns)))["columns"]
        as_type = {"string": str, "long": int, "double": float, "boolean": bool}
        rows = [tuple(as_type[t](p[f]) for f, t in zip(LEGACY_FIELDS, LEGACY_TYPES, strict=True)) for p in found]
        return spark.createDataFrame(rows, ", ".join(f"{f.removesuffix('_percentage')} {t}" for f, t in zip(LEGACY_FIELDS, LEGACY_TYPES, strict=True)))

    QUERIES[name] = run
    casts = ", ".join(f"cast({f.removesuffix('_percentage')} as {'bigint' if t == 'long' else 'varchar' if t == 'string' else t}) as {f.removesuffix('_percentage')}" for f, t in zip(LEGACY_FIELDS, LEGACY_TYPES, strict=True))
    ORACLE_SQL[name] = cte(view) + f"select {casts} from (" + " union all ".join(legacy_sql(c, k) for c, k in columns) + ")"


legacy_table("legacy_profile_numbers", "text_numbers", (("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("v", "text")))
legacy_table("legacy_profile_categories", "dirty_orders", (("o_orderkey", "numeric"), ("v", "text")))

#: Actions of a plan over text_booleans, what becomes of each, and why.
TRIED = (
    ("v", "convert_to_numeric", 0.95),
    ("v", "convert_to_boolean", 0.99),
    ("v", "convert_to_datetime", 0.10),
    ("o_orderkey", "convert_to_numeric", 0.95),
    ("absent", "convert_to_boolean", 0.95),
    ("v", "classify_as_categorical", 0.99),
    ("o_orderkey", "classify_as_categorical", 0.10),
    ("v", "review_skewness", 1.0),
    ("o_orderkey", "preserve_identifier", 1.0),
)


@query(
    cte("text_booleans")
    + f"""select 'v' as column_name, 'convert_to_numeric' as action, case when sum(case when regexp_full_match(trim(v), '[+-]?[0-9]+([.][0-9]*)?') then 0 else 1 end) > 0.3 * count(v) then 'rejected' else 'executed' end as status, cast(sum(case when regexp_full_match(trim(v), '[+-]?[0-9]+([.][0-9]*)?') then 0 else 1 end) as bigint) as invalid_count from t where v is not null
    union all select 'v', 'convert_to_boolean', case when sum(case when lower(trim(v)) in ({YES_NO}) then 0 else 1 end) > 0 then 'rejected' else 'executed' end, cast(sum(case when lower(trim(v)) in ({YES_NO}) then 0 else 1 end) as bigint) from t where v is not null
    union all select * from (values ('v', 'convert_to_datetime', 'skipped', cast(null as bigint)), ('o_orderkey', 'convert_to_numeric', 'skipped', null), ('absent', 'convert_to_boolean', 'skipped', null), ('v', 'classify_as_categorical', 'executed', null), ('o_orderkey', 'classify_as_categorical', 'needs_review', null), ('v', 'review_skewness', 'needs_review', null), ('o_orderkey', 'preserve_identifier', 'skipped', null))
    union all select '', 'report_duplicate_columns', 'executed', null
    union all select '', 'report_duplicate_rows', case when count(*) > 0 then 'needs_review' else 'executed' end, null from (select 1 from t group by o_orderkey, trim(v) having count(*) > 1)"""
)
def execution_statuses(spark, sf_dir):
    """Every status that an action can end with: executed, rejected for its losses, skipped, or left for review."""
    plan = Plan([Action([c], a, conf) for c, a, conf in TRIED], "raw_profile")
    _, log = executor.execute(dirty(spark, sf_dir, "text_booleans"), plan)
    rows = [(",".join(e["columns"]), e["action"], e["status"], e.get("invalid_count")) for e in log if e["action"] != "strip_whitespace"]
    return spark.createDataFrame(rows, "column_name string, action string, status string, invalid_count long")


LOG_SQL = (
    f"with t as ({DIRTY['text_numbers'][1]}), {profile_sql('t', PLAN_KINDS[:3])}, actions as ("
    + " union all ".join(f"select name as columns, '{action}' as action, numeric_like from typed where {when}" for action, when, _ in PLAN_RULES)
    + "), twice as (select count(*) as n from (select l_orderkey, l_linenumber, trim(v) from t group by all having count(*) > 1)) "
    "select columns, action, case when action like 'review_%' then 'needs_review' when action like 'preserve_%' then 'skipped' when action = 'convert_to_numeric' and 1 - numeric_like / 100 > 0.3 then 'rejected' else 'executed' end as status from actions "
    "union all select '', 'report_duplicate_columns', 'executed' union all select '', 'report_duplicate_rows', case when n > 0 then 'needs_review' else 'executed' end from twice"
)


@query(LOG_SQL)
def pipeline_log(spark, sf_dir):
    out = pipeline.run(spark, dirty(spark, sf_dir, "text_numbers"))
    if out["pipeline_error"]:
        raise RuntimeError(str(out["pipeline_error"]))
    return spark.createDataFrame([(",".join(e["columns"]), e["action"], e["status"]) for e in out["execution_log"]], "columns string, action string, status string")
