"""Evidence for charts and reports: aggregates only, never values of single rows."""

from __future__ import annotations

PRIVATE = frozenset(("sample_values", "outlier_values", "html", "frame", "cleaned_dataframe", "raw_dataframe", "dataframe"))


def scrub(x):
    """Without keys that could hold values of rows, at any depth."""
    if isinstance(x, dict):
        return {k: scrub(v) for k, v in x.items() if k not in PRIVATE}
    return [scrub(v) for v in x] if isinstance(x, (list, tuple)) else x


def chart_evidence(profile: dict, found: list) -> list[dict]:
    """Each candidate with the statistics of its columns."""
    families = ("numeric", "categorical", "datetime", "boolean")
    stats = {n: c | {f: profile[f][n] for f in families if n in profile[f]} for n, c in profile["columns"].items()}
    return [scrub(c.as_dict() | {"row_count": profile["n_rows"], "column_statistics": {n: stats[n] for n in c.columns if n in stats}}) for c in found]


def grouped(evidence: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for e in evidence:
        out.setdefault(e["rule_id"], []).append(e)
    return out


def preprocessing_steps(log: list[dict]) -> list[str]:
    return [f"{e['action']} on {', '.join(e['columns']) or 'the table'}: {e['status']}" for e in log]


def conversions(log: list[dict]) -> list[dict]:
    """Missing before and invalid on conversion are kept apart."""
    keys = ("null_percentage_before", "null_percentage_after", "invalid_count", "data_loss_ratio")
    return [{"column": e["columns"][0], "action": e["action"], "status": e["status"]} | {k: e[k] for k in keys if k in e} for e in log if e["action"].startswith("convert_to_")]


def report_evidence(result: dict) -> dict:
    """Dataset, preprocessing, statistics, and charts by decision."""
    decisions = result["chart_decisions"]
    raw, summary = result["raw_profile"], result["summary"]
    return scrub(
        {
            "dataset": {"rows": raw["row_count"], "columns": raw["column_count"], "null_summary": raw["null_summary"], "types": {p["name"]: p["semantic_type"] for p in raw["columns"]}},
            "preprocessing": {"steps": preprocessing_steps(result["execution_log"]), "conversions": conversions(result["execution_log"]), "summary": summary["summary"], "excluded": summary["excluded_columns"]},
            "statistics": result["statistics"],
            "visualisation": {d: [x for x in decisions if x["decision"] == d] for d in ("accepted", "modified", "rejected")},
        }
    )
