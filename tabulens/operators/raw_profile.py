"""The raw profile: every measure of every column, and what they add up to for the table.

Jobs per table, whatever its width: one aggregate for the counts (in batches of columns), one shuffle of hashes for
distinct values, one aggregate over texts, quartiles, and one aggregate for what depends on them. Texts of columns with
few values are counted first, so that each is parsed once; the others are parsed where they are read, so that no more
than FEW_VALUES of a text column's cells (or SMALL of them) are shuffled as such. Decisions are plain Python over these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions import stats, text
from tabulens.operators import classify, gram, mixed, row_order
from tabulens.operators.columns import aggregate, cells_of, col, distinct_measures, identical_pairs, kinds, outlier_bounds, outside, present, quantiles, rounded, share, spread, value_counts

SAMPLES, OUTLIER_LIST = 5, 1_000
HIGH_MISSING, HIGH_SKEW, HIGH_CORRELATION = 50.0, 1.0, 0.95
MIN_OUTLIER_ROWS = 4
#: Distinct values of a text column, as a share of its rows or a number, up to which they are counted before they are parsed.
FEW_VALUES, SMALL = 0.2, 100_000
#: Pairs whose correlations go into one aggregate.
FEW_PAIRS = 100
INDEX_NAMES = ("", "unnamed: 0", "index")


#: What a column without text has in place of text_measures.
NO_TEXT = dict.fromkeys(("string_count", "whitespace_count", "empty_string_count", "whitespace_only_count", "total_length", "shortest", "longest", *(f"null_like:{w}" for w in text.NULL_WORDS)), 0)
SIGNATURES = ("iso_date", "numeric_date", "named_date")


def measures(c: Column, physical: str) -> dict[str, Column]:
    """Counts over one column; null is no value."""
    none = F.lit(0).cast("long")
    return {
        "null_count": F.count_if(c.isNull()),
        "non_null_count": F.count(c),
        "numeric_like": F.count(c) if physical == "numeric" else none,
        "datetime_like": F.count(c) if physical == "datetime" else none,
        "boolean_like": F.count(c) if physical == "boolean" else F.count_if(c.isin(0, 1)) if physical == "numeric" else none,
    }


def text_cells(df: DataFrame, about: dict[str, int], rows: int) -> DataFrame:
    """(column, value, n) of text columns, of which about[n] says how many values they have: counted where these are few, else a row a cell."""
    few = [n for n, values in about.items() if values <= max(FEW_VALUES * rows, SMALL)]
    many = [n for n in about if n not in few]
    return cells_of(df, many).unionByName(value_counts(df, few)) if few and many else value_counts(df, few) if few else cells_of(df, many)


def text_measures(counts: DataFrame, only: tuple[str, ...] = ()) -> dict[str, dict]:
    """What the cells of each text column look like (or some of it), from rows (column, value, n); the state of a column is bounded."""
    cells = counts.select("column", "value", "n", text.strip(F.col("value")).alias("stripped"))
    value, stripped, token, size = F.col("value"), F.col("stripped"), F.col("token"), F.char_length("value")
    # A plain number is no date and has no unit, so it meets one pattern alone.
    cells = cells.select("*", F.lower("stripped").alias("token"), stripped.rlike(text.PLAIN_NUMBER).alias("plain"))
    plain = F.col("plain")
    cells = cells.select("*", F.when(~plain, text.date_in(stripped)).alias("date"), (plain | stripped.rlike(text.GROUPED_NUMBER)).alias("number"), (~plain & text.has_unit(stripped)).alias("unit"))

    def cases(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    wanted = {
        "string_count": F.sum("n"),
        "whitespace_count": cases(value != stripped),
        "empty_string_count": cases(stripped == ""),
        "whitespace_only_count": cases((stripped == "") & (value != "")),
        "total_length": F.sum(F.col("n") * size),
        "shortest": F.min(size),
        "longest": F.max(size),
        **{f"null_like:{word}": cases(token == word) for word in text.NULL_WORDS},
        "numeric_like": cases(F.col("number")),
        "datetime_like": cases(~plain & text.timestamp_in(stripped).isNotNull()),
        "boolean_like": cases(text.boolean_in(token).isNotNull()),
        **{f"signature:{x}": cases(F.col("date") == x) for x in SIGNATURES},
        "units": cases(F.col("unit")),
        "no_unit": cases(~F.col("unit") & F.col("number") & stripped.rlike(text.MEASURE)),
    }
    rows = cells.groupBy("column").agg(*(e.alias(m) for m, e in wanted.items() if not only or m in only)).collect()
    found = {r["column"]: r.asDict() for r in rows}
    if any(f.get("units") for f in found.values()):
        # Apart, for the least and the greatest text of a group take a sort: that of the cells with units, not of all.
        named = counts.select("column", text.strip(F.col("value")).alias("stripped")).where(text.has_unit(stripped)).select("column", text.units_in(stripped).alias("unit"))
        for r in named.groupBy("column").agg(F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit")).collect():
            found[r["column"]] |= {"first_unit": r["first_unit"], "last_unit": r["last_unit"]}
    for f in found.values():
        if f.get("no_unit"):
            f["first_unit"], f["last_unit"] = min(f.get("first_unit", text.NO_UNIT), text.NO_UNIT), max(f.get("last_unit", text.NO_UNIT), text.NO_UNIT)
    return found


def numeric_view(c: Column, physical: str) -> Column | None:
    """The values that outliers and skewness are taken over: generic coercion, and no epochs of dates."""
    if physical == "numeric":
        return stats.clean(c)
    return stats.clean(text.to_number_generic(c)) if physical == "string" else None


def index_like(df: DataFrame, original: str, name: str, physical: str, rows: int) -> bool:
    """Whether a column named like an index holds 0 to n - 1, in the order of the rows where the table's source has one."""
    if original.strip().lower() not in INDEX_NAMES or physical != "numeric" or not rows:
        return False
    c = col(name)
    r = df.agg(F.min(c), F.max(c), F.countDistinct(c), F.count(c)).first()
    return (r[0], r[1], r[2], r[3]) == (0, rows - 1, rows, rows) and row_order.in_order(df, c) is not False


def profile(df: DataFrame, kind: str = "raw", original_names: list[str] | None = None, approximate: int = 0, checked: dict | None = None) -> dict:
    """The profile of df as a dict: row_count, columns in order, null_summary, pairs and warnings.

    original_names are the header names where df's were normalised. approximate > 0 takes sketched quartiles. checked is
    what structure.check reported of df, whose equal and index columns needn't be looked for again.
    """
    with spread(df) as held:
        return _profile(held, df, kind, original_names, approximate, checked)


def _profile(df: DataFrame, source: DataFrame, kind: str, original_names: list[str] | None, approximate: int, checked: dict | None) -> dict:
    """profile() of df; source is the same table in the order of its files."""
    names = original_names or df.columns
    types = mixed.type_counts(df) if mixed.names(df) else {}
    own_strings, dtypes = mixed.strings_only(df) if types else df, {f.name: f.dataType.simpleString() for f in df.schema}
    df = mixed.as_text(df)
    shapes = kinds(df)
    flat = [(n, k) for n, k in shapes if k != "nested"]
    wanted = {("", "rows"): F.count("*")} | {(n, m): e for n, k in flat for m, e in measures(present(df, n), k).items()}
    wanted |= {(n, "about"): F.approx_count_distinct(col(n)) for n, k in flat if k == "string"}
    found = aggregate(df, wanted)
    rows = int(found["", "rows"])
    distinct = distinct_measures(df, [n for n, _ in flat])
    about = {n: found[n, "about"] for n, k in flat if k == "string"}
    cells = text_measures(text_cells(df, about, rows)) if about else {}
    if types:
        # Of a column of several types, only the strings count as text; what parses is taken over all cells.
        parsed = ("numeric_like", "datetime_like", "boolean_like")
        texts = text_measures(value_counts(own_strings, list(types)))
        cells |= {n: NO_TEXT | texts.get(n, {}) | {m: cells[n][m] for m in parsed if n in cells} for n in types}
    views = {n: v for n, k in flat if (v := numeric_view(col(n), k)) is not None}
    # Numbers are parsed once and held for the passes over them.
    numbers = df.select(*(v.alias(n) for n, v in views.items())).persist() if views else df
    views = {n: F.when(~F.isnan(col(n)), col(n)) for n in views}
    first = aggregate(numbers, {(n, m): e for n, v in views.items() for m, e in (("n", F.count(v)), ("skew", stats.adjusted_skewness(v)))})
    measured = {n: v for n, v in views.items() if first[n, "n"] >= MIN_OUTLIER_ROWS}
    quarts = quantiles(numbers, measured, (0.25, 0.75), rows, approximate)
    fences = {n: b for n, (a, z) in quarts.items() if a is not None and z != a and (b := outlier_bounds(a, z))}
    late = aggregate(numbers, {(n, "out"): F.count_if(outside(measured[n], b)) for n, b in fences.items()})
    correlated = correlation_warnings(numbers, [n for n, k in flat if k == "numeric"])
    if views:
        numbers.unpersist()
    checked = None if types else checked  # texts of variants are compared here alone
    same = [tuple(p) for p in checked["duplicate_value_columns"]] if checked else identical_pairs(df)
    twins = {n for pair in same for n in pair}

    columns = []
    for (n, k), original in zip(shapes, names, strict=True):
        if k == "nested":
            columns.append(_nested(df, n, original, rows))
            continue
        own = NO_TEXT | {m: found[n, m] for m in measures(col(n), k)} | cells.get(n, {})
        get = own.__getitem__
        d = distinct.get(n, {"unique": 0, "stripped": 0, "folded": 0})
        values = get("non_null_count")
        ratio = d["unique"] / rows if rows else 0.0
        breakdown = {w: int(get(f"null_like:{w}")) for w in text.NULL_WORDS}
        skew = first[n, "skew"] if n in views and first[n, "n"] >= MIN_OUTLIER_ROWS else None
        units = {own.get("first_unit"), own.get("last_unit")} - {None}
        signatures = sorted({x for x in SIGNATURES if own.get(f"signature:{x}")} | units)
        p = {
            "name": original,
            "column": n,
            "dtype": dtypes[n],
            "physical_type": k,
            "null_count": int(get("null_count")),
            "null_percentage": share(get("null_count"), rows),
            "non_null_count": int(values),
            "unique_count": int(d["unique"]),
            "uniqueness_ratio": rounded(ratio),
            "string_count": int(get("string_count")),
            "null_like_count": sum(breakdown.values()),
            "null_like_breakdown": {w: c for w, c in breakdown.items() if c},
            "whitespace_count": int(get("whitespace_count")),
            "empty_string_count": int(get("empty_string_count")),
            "whitespace_only_count": int(get("whitespace_only_count")),
            "average_string_length": rounded(get("total_length") / get("string_count")) if get("string_count") else 0.0,
            "mixed_type_count": len(types[n]) if n in types else int(values > 0),
            "has_mixed_types": len(types.get(n, ())) > 1,
            "has_case_variations": d["folded"] < d["stripped"] if k == "string" else False,
            "numeric_like_percentage": share(get("numeric_like"), values),
            "datetime_like_percentage": share(get("datetime_like"), values),
            "boolean_like_percentage": share(get("boolean_like"), values),
            "variable_length": bool(get("shortest") != get("longest")),
            "id_name_signal": classify.named_like_id(original),
            "is_categorical": rows > 0 and ratio <= classify.LOW_CARDINALITY and d["unique"] > 1,
            "is_index_like": n in checked["index_like_columns"] if checked else index_like(source, original, n, k, rows),
            "format_signatures": signatures,
            "mixed_format_warning": len(signatures) > 1,
            "ambiguous_date_warning": "numeric_date" in signatures and not {"iso_date", "named_date"} & set(signatures),
            "outlier_count": int(late[n, "out"]) if n in fences else 0,
            "skewness": rounded(skew, 6),
            "duplicate_value_column": n in twins,
        }
        exact = p | {"uniqueness_ratio": ratio}
        p["is_likely_id"] = rows > 1 and ratio >= classify.HIGH_CARDINALITY and p["id_name_signal"]
        p["is_free_text"] = bool(p["string_count"]) and ratio >= classify.HIGH_CARDINALITY and p["variable_length"]
        p["semantic_type"], p["classification_confidence"] = classify.semantic_type(exact)
        p["warnings"] = column_warnings(exact)
        columns.append(p)

    return {
        "profile_type": kind,
        "row_count": rows,
        "column_count": len(columns),
        "columns": columns,
        "duplicate_value_columns": [list(p) for p in same],
        "null_summary": null_summary(columns, rows),
        "correlation_warnings": correlated,
        "warnings": [{"type": "column", "column": p["name"], "message": w} for p in columns for w in p["warnings"]]
        + [{"type": "duplicate_value_columns", "columns": list(p), "message": "Columns hold equal values."} for p in same]
        + [{"type": "correlation", "columns": w["columns"], "message": f"Columns correlate with r = {w['correlation']}."} for w in correlated],
    }


def _nested(df: DataFrame, n: str, original: str, rows: int) -> dict:
    nulls = df.agg(F.count_if(col(n).isNull())).first()[0]
    zero = ("unique_count", "string_count", "null_like_count", "whitespace_count", "empty_string_count", "whitespace_only_count", "mixed_type_count", "outlier_count")
    zeros = ("uniqueness_ratio", "average_string_length", "numeric_like_percentage", "datetime_like_percentage", "boolean_like_percentage", "classification_confidence")
    false = ("has_mixed_types", "has_case_variations", "variable_length", "is_categorical", "is_index_like", "mixed_format_warning", "ambiguous_date_warning", "duplicate_value_column", "is_likely_id", "is_free_text")
    return (
        {"name": original, "column": n, "dtype": df.schema[n].dataType.simpleString(), "physical_type": "nested", "null_count": nulls, "null_percentage": share(nulls, rows), "non_null_count": rows - nulls}
        | dict.fromkeys(zero, 0)
        | dict.fromkeys(zeros, 0.0)
        | dict.fromkeys(false, False)
        | {"null_like_breakdown": {}, "format_signatures": [], "skewness": None, "id_name_signal": classify.named_like_id(original), "semantic_type": "unresolved", "warnings": ["Nested values are not measured."]}
    )


def column_warnings(p: dict) -> list[str]:
    out = []
    if p["null_percentage"] >= HIGH_MISSING:
        out.append("Half of the values or more are null.")
    if p["uniqueness_ratio"] >= classify.HIGH_CARDINALITY and p["unique_count"] > 1:
        out.append("Nearly every row has a value of its own.")
    if p["unique_count"] <= 1:
        out.append("The column is constant or all null.")
    if p["skewness"] is not None and abs(p["skewness"]) >= HIGH_SKEW:
        out.append("The values are strongly skewed.")
    return out


def null_summary(columns: list[dict], rows: int) -> dict:
    cells = rows * len(columns)
    nulls, like = sum(p["null_count"] for p in columns), sum(p["null_like_count"] for p in columns)
    markers: dict[str, int] = {}
    for p in columns:
        for w, c in p["null_like_breakdown"].items():
            markers[w] = markers.get(w, 0) + c
    return {
        "total_null_count": nulls,
        "total_null_percentage": share(nulls, cells),
        "total_null_like_count": like,
        "null_like_breakdown": markers,
        "total_missing_count": nulls + like,
        "total_missing_percentage": share(nulls + like, cells),
        "empty_string_count": sum(p["empty_string_count"] for p in columns),
        "whitespace_only_count": sum(p["whitespace_only_count"] for p in columns),
        "columns_with_nulls": [p["name"] for p in columns if p["null_count"]],
        "columns_with_null_like": [p["name"] for p in columns if p["null_like_count"]],
    }


def correlations(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson r of each pair, upper triangle: in one aggregate for few pairs, by sums of products for many."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if len(pairs) > FEW_PAIRS:
        return gram.correlations(df, names)
    row = df.agg(*(stats.correlation(stats.clean(col(a)), stats.clean(col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else ()
    return {p: row[i] for i, p in enumerate(pairs)}


def correlation_warnings(df: DataFrame, names: list[str]) -> list[dict]:
    found = correlations(df, names) if len(names) > 1 else {}
    return [{"columns": list(p), "correlation": rounded(r)} for p, r in found.items() if r is not None and r == r and abs(r) >= HIGH_CORRELATION]


def samples(df: DataFrame, limit: int = SAMPLES) -> dict[str, list]:
    """The first non-null values of each column, in the order of the rows in the files (or by its row number); one pass for all columns."""
    shapes = [(n, k) for n, k in kinds(df) if n != row_order.ROW]
    out: dict[str, list] = {n: [] for n, _ in shapes}
    cells = {n: present(df, n) for n, k in shapes if k not in ("nested", "timedelta")}
    for r in row_order.first_values(df, cells, limit).orderBy("column", "place").collect() if cells else ():
        out[r["column"]].append(r["value"].toPython())
    return out


def outlier_values(df: DataFrame, name: str, limit: int = OUTLIER_LIST, approximate: int = 0) -> list[float]:
    """Values outside the fences, in ascending order; limit is the length of the listing, the count is in the profile."""
    physical = dict(kinds(df))[name]
    v = numeric_view(col(name), physical)
    if v is None:
        return []
    (a, z) = quantiles(df, {name: v}, (0.25, 0.75), df.count(), approximate)[name]
    bounds = outlier_bounds(a, z)
    return [] if not bounds or a == z else [r[0] for r in df.select(v.alias("v")).where(outside(F.col("v"), bounds)).orderBy("v").limit(limit).collect()]


def profile_table(spark, found: dict) -> DataFrame:
    """The columns of a profile as rows."""
    rows = [(i, p["name"], p["dtype"], p["semantic_type"], float(p["classification_confidence"]), p["null_count"], p["unique_count"], float(p["uniqueness_ratio"]), p["null_like_count"], p["whitespace_count"], float(p["numeric_like_percentage"]), float(p["datetime_like_percentage"]), float(p["boolean_like_percentage"]), p["outlier_count"], p["skewness"]) for i, p in enumerate(found["columns"])]
    return spark.createDataFrame(
        rows,
        "position int, name string, dtype string, semantic_type string, confidence double, null_count long, unique_count long, uniqueness_ratio double, null_like_count long, whitespace_count long, "
        "numeric_like_percentage double, datetime_like_percentage double, boolean_like_percentage double, outlier_count long, skewness double",
    )
