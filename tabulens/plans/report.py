"""Reports as Markdown, off the evidence alone."""

from __future__ import annotations

# How chart types are shown.
CHART_NAMES = {
    "histogram": "Histogram",
    "box_plot": "Box plot",
    "bar_chart": "Bar chart",
    "pie_chart": "Pie chart",
    "scatter_plot": "Scatter plot",
    "line_chart": "Line chart",
    "grouped_bar_chart": "Grouped bar chart",
    "stacked_bar_chart": "Stacked bar chart",
    "100_percent_stacked_bar_chart": "100% stacked bar chart",
    "heatmap": "Correlation heatmap",
    "missingness_bar_chart": "Missing values bar chart",
    "missingness_heatmap": "Missing values heatmap",
    "violin_plot": "Violin plot",
    "qq_plot": "Q-Q plot",
    "pair_plot": "Pair plot",
}


def label(columns: list[str]) -> str:
    return f"{columns[0]} vs {columns[1]}" if len(columns) == 2 else ", ".join(columns)


def charts_by_type(decisions: list[dict]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for d in decisions:
        if d["decision"] == "accepted":
            out.setdefault(CHART_NAMES.get(d["chart_type"], d["chart_type"]), []).append(label(d["columns"]))
    return out


def shown(x) -> str:
    return "-" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def table(rows: list[dict], keys: list[str]) -> str:
    cell = lambda x: shown(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(k.replace("_", " ") for k in keys) + " |", "| " + " | ".join("---" for _ in keys) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(k)) for k in keys) + " |" for r in rows])


def family(stats: dict[str, dict], keys: list[str]) -> str:
    return table([{"column": n} | s for n, s in stats.items()], ["column", *keys]) if stats else "None."


def markdown(result: dict) -> str:
    """Eight parts: table, raw columns, plan, log, comparison, exclusions, statistics, charts."""
    raw, summary, stats = result["raw_profile"], result["summary"], result["statistics"]
    nulls = raw["null_summary"]
    parts = [
        ("Dataset", f"{raw['row_count']} rows, {raw['column_count']} columns; {nulls['total_missing_count']} cells missing, {nulls['total_null_like_count']} of them as words."),
        ("Columns as found", table(raw["columns"], ["name", "dtype", "semantic_type", "classification_confidence", "null_percentage", "unique_count"])),
        ("Plan", table([{"column": ", ".join(a.columns)} | a.as_dict() for a in result["plan"].actions], ["column", "action", "confidence", "reason"])),
        ("What was done", table([{"column": ", ".join(e["columns"])} | e for e in result["execution_log"]], ["column", "action", "status", "values_changed", "invalid_count", "data_loss_ratio"])),
        ("Before and after", table([{"column": c["column_after"] or c["column_before"]} | {f"{f}_{w}": x[w] for f, x in c["changes"].items() for w in ("before", "after")} for c in summary["columns"]], ["column", "dtype_before", "dtype_after", "null_percentage_before", "null_percentage_after", "unique_count_before", "unique_count_after"])),
        ("Left out of statistics", table([{"column": e["column"], "reasons": "; ".join(e["reasons"])} for e in summary["excluded_columns"]], ["column", "reasons"])),
        (
            "Statistics",
            "\n\n".join(
                [
                    "### Numeric\n\n" + family(stats["numeric"], ["count", "mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis", "outlier_count"]),
                    "### Categorical\n\n" + family(stats["categorical"], ["count", "unique_count", "top", "top_frequency", "top_percentage"]),
                    "### Dates\n\n" + family(stats["datetime"], ["count", "min", "max", "unique_count", "duration_days"]),
                    "### Boolean\n\n" + family(stats["boolean"], ["count", "true_count", "false_count", "true_percentage", "false_percentage"]),
                    "### Correlation\n\n" + family(stats["correlation_matrix"], list(stats["correlation_matrix"])),
                ]
            ),
        ),
        ("Charts", "\n".join(f"- {kind}: {'; '.join(of)}" for kind, of in charts_by_type(result["chart_decisions"]).items()) or "None."),
    ]
    return "# Data report\n\n" + "\n\n".join(f"## {i}. {name}\n\n{body}" for i, (name, body) in enumerate(parts, 1)) + "\n"


def narrative_sections(result: dict) -> dict:
    """The five fixed sections of a narrative, as far as they follow from the evidence."""
    e = result["report_evidence"]
    return {
        "dataset_overview": e["dataset"],
        "data_quality": {"null_summary": e["dataset"]["null_summary"], "conversions": e["preprocessing"]["conversions"]},
        "preprocessing": e["preprocessing"]["steps"],
        "statistics": {k: sorted(e["statistics"][k]) for k in ("numeric", "categorical", "datetime", "boolean")},
        "visualisations": charts_by_type(result["chart_decisions"]),
    }
