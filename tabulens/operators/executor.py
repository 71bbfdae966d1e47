"""Applying a plan: only safe actions change values, each with its audit.

One aggregate holds the audit of every step: what null words, stripping, every candidate conversion and case would
change. The accepted steps then go into one projection: rolling back is not selecting. Beside that, duplicates are one
grouping of the stripped rows. The input frame is never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions import text
from tabulens.operators.columns import aggregate, col, duplicate_rows, kinds, share
from tabulens.plans.planner import Action, Plan

CONVERSIONS = ("convert_to_numeric", "convert_to_datetime", "convert_to_boolean")
LEAST_CONFIDENCE = 0.80


def converted(c: Column, action: str, day_first: bool | None) -> Column:
    if action == "convert_to_numeric":
        return text.to_number(c)
    return text.to_timestamp(c, day_first) if action == "convert_to_datetime" else text.to_boolean(c)


def _entry(action: str, columns: list[str], status: str, **effects) -> dict:
    return {"action": action, "columns": columns, "status": status} | effects


def execute(df: DataFrame, plan: Plan, data_loss_threshold: float = 0.30, case_strategy: str = "lower", date_dayfirst: bool | None = None, original_names: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """The cleaned frame and the log. Steps come in a fixed order: null words and blanks if planned, stripping of all
    text, reports on duplicates, conversions in plan order, categories, case, and what is left for review."""
    steps, log = audit(df, plan, data_loss_threshold, case_strategy, date_dayfirst, original_names)
    return apply(df, steps), log


def apply(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    """df after each step, {column: what it becomes}; for the frame that was audited, or the same one observed."""
    for step in steps:
        df = df.select(*(step.get(n, col(n)).alias(n) for n in df.columns))
    return df


def audit(df: DataFrame, plan: Plan, data_loss_threshold: float = 0.30, case_strategy: str = "lower", date_dayfirst: bool | None = None, original_names: list[str] | None = None) -> tuple[list[dict[str, Column]], list[dict]]:
    """The steps of the cleaning that apply() takes, and its log, from one scan and one grouping of the rows."""
    if not 0 <= data_loss_threshold <= 1:
        raise ValueError("data_loss_threshold must be between 0 and 1")
    if case_strategy not in text.CASES:
        raise ValueError("case_strategy must be lower, upper or title")
    if date_dayfirst not in (None, True, False):
        raise ValueError("date_dayfirst must be True, False or None")
    log: list[dict] = []
    names = df.columns
    strings = [n for n, k in kinds(df) if k == "string"]
    by = {a: [x.columns[0] for x in plan.actions if x.action == a and x.columns[0] in names] for a in {x.action for x in plan.actions}}
    done: set[tuple[str, str]] = set()

    now = {n: col(n) for n in strings}
    wanted: dict[tuple[str, str], Column] = {("", "rows"): F.count("*")}
    for step, change in (("replace_null_like", text.null_words_out), ("replace_empty_strings", text.blanks_out)):
        for n in dict.fromkeys(by.get(step, [])):
            if n in strings:
                wanted[n, step] = F.count_if(now[n].isNotNull() & change(now[n]).isNull())
                now[n] = change(now[n])
    for n in strings:
        stripped = text.strip(now[n])
        wanted[n, "values"] = F.count(now[n])
        wanted[n, "changed"] = F.count_if(F.coalesce(now[n] != stripped, F.lit(False)))
        now[n] = stripped
    # What later steps read is computed once a row, under names of its own.
    shown = {n: f"stripped {i}" for i, n in enumerate(strings)}
    while set(shown.values()) & set(names):
        shown = {n: f"{x} " for n, x in shown.items()}
    todo: list[Action] = []
    for a in plan.actions:
        if a.action in CONVERSIONS and (a.action, a.columns[0]) not in {(x.action, x.columns[0]) for x in todo}:
            todo.append(a)
    trial: dict[int, Column] = {}
    for i, a in enumerate(todo):
        n = a.columns[0]
        if n in strings and a.confidence >= LEAST_CONFIDENCE:
            day_first = date_dayfirst if date_dayfirst is not None else a.parameters.get("dayfirst")
            trial[i] = converted(col(n), a.action, day_first)
            tried = converted(col(shown[n]), a.action, day_first)
            wanted[n, f"{i}v"] = F.count(col(shown[n]))
            wanted[n, f"{i}b"] = F.count_if(col(shown[n]).isNotNull() & tried.isNull())
            wanted[n, f"{i}n"] = F.count_if(tried.isNull())
    cased = [n for n in dict.fromkeys(by.get("normalize_case", [])) if n in strings]
    for n in cased:
        wanted[n, "case"] = F.count_if(F.coalesce(col(shown[n]) != text.CASES[case_strategy](col(shown[n])), F.lit(False)))
    facts = aggregate(df.select("*", *(now[n].alias(shown[n]) for n in strings)), wanted)
    for step in ("replace_null_like", "replace_empty_strings"):
        for n in dict.fromkeys(by.get(step, [])):
            # A value that turned null is no changed value in the log's first sense; values_nulled counts it.
            log.append(_entry(step, [n], "executed" if n in strings else "skipped", values_changed=0, values_nulled=int(facts.get((n, step), 0))))
            done.add((step, n))
    for n in strings:
        empty = not facts[n, "values"]
        log.append(_entry("strip_whitespace", [n], "skipped" if empty else "executed", values_changed=int(facts[n, "changed"])))
        done.add(("strip_whitespace", n))
    steps = [now]

    given = original_names or names
    repeated = list(dict.fromkeys(n for n in given if given.count(n) > 1))
    log.append(_entry("report_duplicate_columns", repeated, "needs_review" if repeated else "executed", duplicate_column_count=len(repeated)))
    members, _ = duplicate_rows(apply(df, steps))
    log.append(_entry("report_duplicate_rows", [], "needs_review" if members else "executed", duplicate_row_count=members))

    # Conversions: the safe ones are committed.
    rows = int(facts["", "rows"])
    accepted: dict[str, Column] = {}
    for i, a in enumerate(todo):
        n = a.columns[0]
        done.add((a.action, n))
        if i not in trial:
            why = "column is missing" if n not in names else "column is not text" if n not in strings else "confidence is below the limit"
            log.append(_entry(a.action, [n], "skipped", reason=why, confidence=a.confidence))
            continue
        values, bad, null_after = int(facts[n, f"{i}v"]), int(facts[n, f"{i}b"]), int(facts[n, f"{i}n"])
        if not values:
            log.append(_entry(a.action, [n], "skipped", reason="column has no values", confidence=a.confidence))
            continue
        loss = bad / values
        effects = {"null_percentage_before": share(rows - values, rows), "null_percentage_after": share(null_after, rows), "invalid_count": bad, "data_loss_ratio": round(loss, 4), "confidence": a.confidence}
        if a.action == "convert_to_datetime":
            effects["timezone_policy"] = "utc"
        refused = loss > data_loss_threshold or (a.action == "convert_to_boolean" and bad) or n in accepted
        log.append(_entry(a.action, [n], "rejected" if refused else "executed", **effects))
        if not refused:
            accepted[n] = trial[i]
    steps.append(accepted)

    for a in (x for x in plan.actions if x.action == "classify_as_categorical"):
        log.append(_entry(a.action, a.columns, "executed" if a.confidence >= LEAST_CONFIDENCE else "needs_review", confidence=a.confidence))
        done.add((a.action, a.columns[0]))
    still = [n for n in cased if n not in accepted]
    steps.append({n: text.CASES[case_strategy](col(n)) for n in still})
    log += [_entry("normalize_case", [n], "executed", strategy=case_strategy, values_changed=int(facts[n, "case"])) for n in still]
    done |= {("normalize_case", n) for n in still}
    for a in plan.actions:
        if (a.action, a.columns[0]) not in done:
            status = "skipped" if a.action.startswith("preserve_") else "needs_review" if a.action.startswith("review_") else "skipped" if a.action == "normalize_case" else "unsupported"
            log.append(_entry(a.action, a.columns, status, reason=a.reason))
    return steps, log


def apply_action(df: DataFrame, action: Action, date_dayfirst: bool | None = None) -> DataFrame:
    """One action of the older kind, without an audit; review and preserve actions change nothing."""
    n = action.columns[0]
    if action.action.startswith(("review_", "preserve_")):
        return df
    case = action.parameters.get("case", "lower")
    changes = {
        "replace_null_like": text.null_words_out,
        "strip_whitespace": text.strip,
        "replace_empty_strings": text.blanks_out,
        "convert_to_numeric": text.to_number_generic,
        "convert_to_datetime": lambda c: text.to_timestamp(c, date_dayfirst),
        "convert_to_boolean": text.to_boolean,
        "normalize_case": text.CASES[case],
    }
    if action.action not in changes:
        raise ValueError(f"unsupported action {action.action}")
    if n not in df.columns:
        raise ValueError(f"no column {n}")
    return df.select(*(changes[action.action](col(c)).alias(c) if c == n else col(c) for c in df.columns))


def execute_legacy(df: DataFrame, plan: Plan, date_dayfirst: bool | None = None) -> DataFrame:
    for a in plan.actions:
        df = apply_action(df, a, date_dayfirst)
    return df


def validate(before: DataFrame, after: DataFrame, rows: tuple[int, int] | None = None) -> list[str]:
    """What is wrong with a cleaned frame: rows, names and order must be those of the input. rows are the counts, where they are known."""
    out = []
    if before.columns != after.columns:
        out.append("columns differ")
    first, last = rows or (before.count(), after.count())
    if first != last:
        out.append("row counts differ")
    if not last:
        out.append("no rows")
    return out


def row_marks(df: DataFrame) -> list[Column]:
    """Row count and two order-free combinations of row hashes, as aggregates; also for DataFrame.observe."""
    h = F.xxhash64(*map(col, df.columns))
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 20))), F.lit(0)).alias("sum")]


def fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """The row marks of df; equal before and after, a snapshot is unchanged."""
    row = df.agg(*row_marks(df)).first()
    return int(row[0]), int(row[1]), int(row[2])
