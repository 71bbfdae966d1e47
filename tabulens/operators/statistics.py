"""Typed statistics of the eligible columns: general, numeric, categorical, datetime, boolean, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions import stats, text
from tabulens.operators.columns import aggregate, col, distinct_measures, kinds, outlier_bounds, outside, quantiles, share, top_values, value_counts
from tabulens.operators.raw_profile import correlations

TOP = 10


def numeric_aggregates(c: Column) -> dict[str, Column]:
    return {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "skewness": stats.adjusted_skewness(c), "kurtosis": stats.adjusted_kurtosis(c)}


def as_number(df: DataFrame, name: str, kind: str) -> Column:
    c = stats.clean(col(name)) if kind == "numeric" else stats.clean(text.to_number_generic(col(name)))
    return F.when(F.abs(c) < float("inf"), c)


def numeric_statistics(df: DataFrame, names: list[str], rows: int | None = None, approximate: int = 0) -> dict[str, dict]:
    """Count, mean, quartiles, spread, adjusted skewness and kurtosis, fences, and the values outside them.

    Where the quartiles are equal, every other value is outside; the raw profile reports none then.
    """
    if not names:
        return {}
    shapes = dict(kinds(df))
    values = {n: as_number(df, n, shapes[n]) for n in names}
    rows = df.count() if rows is None else rows
    # Parsed once and held for the passes over them.
    df = df.select(*(v.alias(n) for n, v in values.items())).persist()
    values = {n: col(n) for n in names}
    found = aggregate(df, {(n, m): e for n, v in values.items() for m, e in numeric_aggregates(v).items()})
    quarts = quantiles(df, values, (0.25, 0.5, 0.75), rows, approximate)
    fences = {n: b for n, q in quarts.items() if (b := outlier_bounds(q[0], q[2]))}
    out = aggregate(df, {(n, "o"): F.count_if(outside(values[n], b)) for n, b in fences.items()})
    df.unpersist()
    result = {}
    for n in names:
        q1, median, q3 = quarts[n]
        low, high = fences.get(n, (None, None))
        count, outliers = found[n, "count"], out.get((n, "o"), 0)
        moments = {m: found[n, m] for m in ("count", "mean", "std", "min", "max", "skewness", "kurtosis")}
        result[n] = moments | {"median": median, "q1": q1, "q3": q3, "iqr": None if q1 is None else q3 - q1, "lower_bound": low, "upper_bound": high, "outlier_count": outliers, "outlier_percentage": share(outliers, count, None)}
    return result


def categorical_statistics(df: DataFrame, names: list[str], limit: int = TOP) -> dict[str, dict]:
    """Count, distinct values, the most frequent one and the first ten, off one table of value counts; ties by value."""
    if not names:
        return {}
    counts = value_counts(df, names).persist()
    totals = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique")).collect()}
    first: dict[str, list] = {n: [] for n in names}
    for r in top_values(counts, limit).orderBy("column", "rank").collect():
        first[r["column"]].append((r["value"], r["n"]))
    counts.unpersist()
    out = {}
    for n in names:
        count = totals[n]["count"] if n in totals else 0
        top, freq = first[n][0] if first[n] else (None, 0)
        values = [{"value": v, "count": k, "percentage": share(k, count, None)} for v, k in first[n]]
        out[n] = {"count": count, "unique_count": totals[n]["unique"] if n in totals else 0, "top": top, "top_frequency": freq, "top_percentage": share(freq, count, None), "top_values": values}
    return out


def datetime_statistics(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Count, first and last moment (ISO, UTC), distinct moments, and the days between, with their fraction."""
    if not names:
        return {}
    wanted = {}
    for n in names:
        c = col(n).cast("timestamp")
        wanted |= {(n, "count"): F.count(c), (n, "min"): text.iso(F.min(c)), (n, "max"): text.iso(F.max(c)), (n, "unique_count"): F.countDistinct(c), (n, "duration_days"): (F.unix_micros(F.max(c)) - F.unix_micros(F.min(c))) / 86_400_000_000.0}
    found = aggregate(df, wanted)
    return {n: {m: found[n, m] for m in ("count", "min", "max", "unique_count", "duration_days")} for n in names}


def boolean_statistics(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Counts and shares of true and false; words for yes and no count as such."""
    if not names:
        return {}
    shapes = dict(kinds(df))
    wanted = {}
    for n in names:
        b = col(n) if shapes[n] == "boolean" else text.to_boolean(col(n).cast("string"))
        wanted |= {(n, "count"): F.count(b), (n, "true_count"): F.count_if(b), (n, "false_count"): F.count_if(~b)}
    found = aggregate(df, wanted)
    out = {}
    for n in names:
        count, true, false = (int(found[n, m]) for m in ("count", "true_count", "false_count"))
        out[n] = {"count": count, "true_count": true, "false_count": false, "true_percentage": share(true, count, None), "false_percentage": share(false, count, None)}
    return out


def correlation_matrix(df: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    """Pearson r over rows where both are present, both ways and with the diagonal; entries that don't exist are left out."""
    if len(names) < 2:
        return {}
    out: dict[str, dict[str, float]] = {n: {} for n in names}
    spread = aggregate(df, {(n, "s"): F.min(stats.clean(col(n))) < F.max(stats.clean(col(n))) for n in names})
    for n in names:
        if spread[n, "s"]:
            out[n][n] = 1.0
    for (a, b), r in correlations(df, names).items():
        if r is not None and r == r and abs(r) != float("inf"):
            out[a][b] = out[b][a] = r
    return out


def statistical_profile(df: DataFrame, summary: dict, approximate: int = 0) -> dict:
    """Statistics of the columns that a summary lets through, by their semantic type."""
    eligible = [n for n in summary["downstream"]["eligible_columns"] if n in df.columns]
    types = {p["column"]: p for p in summary["cleaned_profile"]["columns"]}
    of = lambda kind: [n for n in eligible if types[n]["semantic_type"] == kind]
    rows = summary["cleaned_profile"]["row_count"]
    numeric = of("numeric")
    distinct = distinct_measures(df, eligible)
    columns = {}
    for n in eligible:
        p, unique = types[n], distinct.get(n, {"unique": 0})["unique"]
        columns[n] = {"semantic_type": p["semantic_type"], "count": p["non_null_count"], "missing_count": p["null_count"], "missing_percentage": share(p["null_count"], rows, None), "unique_count": unique, "unique_percentage": share(unique, p["non_null_count"], None)}
    native = [n for n in numeric if types[n]["physical_type"] == "numeric"]
    dated = [n for n in of("datetime") if types[n]["physical_type"] == "datetime"]
    return {
        "n_rows": rows,
        "n_columns": len(eligible),
        "columns": columns,
        "numeric": numeric_statistics(df, numeric, rows, approximate),
        "categorical": categorical_statistics(df, of("categorical")),
        "datetime": datetime_statistics(df, dated),
        "boolean": boolean_statistics(df, of("boolean")),
        "correlation_matrix": correlation_matrix(df, native),
    }


def numeric_table(spark, found: dict[str, dict]) -> DataFrame:
    fields = ("count", "mean", "median", "std", "min", "max", "q1", "q3", "iqr", "lower_bound", "upper_bound", "skewness", "kurtosis", "outlier_count", "outlier_percentage")
    whole = ("count", "outlier_count")
    rows = [(n, *(int(s[f]) if f in whole else None if s[f] is None else float(s[f]) for f in fields)) for n, s in found.items()]
    return spark.createDataFrame(rows, "column string, " + ", ".join(f"`{f}` {'long' if f in whole else 'double'}" for f in fields))
