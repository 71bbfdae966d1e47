"""Before and after: the positional comparison of the raw and the cleaned profile, and the hand-off to statistics."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from tabulens.operators import executor, raw_profile
from tabulens.plans.planner import Plan

COMPARED = ("dtype", "null_percentage", "unique_count")
LEFT_OUT = ("identifier", "free_text", "unresolved")
#: Rows that an analysis may be told to look at; reported, never applied.
ANALYSIS_ROWS = 100_000


def compare(raw: dict, cleaned: dict, log: list[dict]) -> list[dict]:
    before, after = raw["columns"], cleaned["columns"]
    out = []
    for i in range(max(len(before), len(after))):
        a = before[i] if i < len(before) else None
        b = after[i] if i < len(after) else None
        names = {p["name"] for p in (a, b) if p} | {p["column"] for p in (a, b) if p}
        changes = {f: {"before": a and a[f], "after": b and b[f], "changed": (a and a[f]) != (b and b[f])} for f in COMPARED}
        out.append({"position": i, "column_before": a and a["name"], "column_after": b and b["name"], "changes": changes, "actions": [e for e in log if names & set(e["columns"])], "before": a, "after": b})
    return out


def summarise(raw: dict, cleaned_frame: DataFrame, log: list[dict], approximate: int = 0, unchanged: bool = False) -> dict:
    """The report on a cleaning: diffs, changed and excluded columns, statuses, and what statistics may use.

    unchanged says that the cleaned frame is the raw one, whose profile then holds for both.
    """
    if raw.get("profile_type") != "raw":
        raise ValueError("a raw profile is needed")
    cleaned = raw | {"profile_type": "cleaned"} if unchanged else raw_profile.profile(cleaned_frame, "cleaned", approximate=approximate)
    columns = compare(raw, cleaned, log)
    name = lambda c: c["column_after"] or c["column_before"]
    excluded = [{"column": name(c), "reasons": [f"semantic type is {c['after']['semantic_type']}"]} for c in columns if c["after"] and c["after"]["semantic_type"] in LEFT_OUT]
    out_names = {e["column"] for e in excluded}
    rows = cleaned["row_count"]
    return {
        "summary": {
            "rows_before": raw["row_count"],
            "rows_after": rows,
            "columns_before": raw["column_count"],
            "columns_after": cleaned["column_count"],
            "changed_columns": [name(c) for c in columns if c["actions"] or any(x["changed"] for x in c["changes"].values())],
            "action_status_counts": dict(Counter(e["status"] for e in log)),
            "unresolved_columns": [name(c) for c in columns if c["after"] and c["after"]["semantic_type"] == "unresolved"],
            "needs_review_columns": sorted({n for e in log if e["status"] == "needs_review" for n in e["columns"]}),
        },
        "columns": columns,
        "excluded_columns": excluded,
        "cleaned_profile": cleaned,
        "downstream": {
            "eligible_columns": [p["name"] for p in cleaned["columns"] if p["name"] not in out_names],
            "excluded_columns": excluded,
            "sampling": {"applied": False, "over_limit": rows > ANALYSIS_ROWS, "original_row_count": rows, "analysis_row_count": rows, "max_rows": ANALYSIS_ROWS, "cleaned_dataset_changed": False},
        },
    }


def run_stage(df: DataFrame, raw: dict, plan: Plan, data_loss_threshold: float = 0.30, case_strategy: str = "lower", date_dayfirst: bool | None = None, approximate: int = 0) -> tuple[DataFrame, list[dict], dict]:
    """Execute a plan and summarise it."""
    cleaned, log = executor.execute(df, plan, data_loss_threshold, case_strategy, date_dayfirst, [p["name"] for p in raw["columns"]])
    return cleaned, log, summarise(raw, cleaned, log, approximate)
