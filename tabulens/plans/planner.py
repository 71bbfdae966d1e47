"""Cleaning plans: which actions a profile asks for, with what confidence and why."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

CONVERT_AT = 80.0


@dataclass
class Action:
    columns: list[str]
    action: str
    confidence: float = 0.0
    reason: str = ""
    parameters: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Plan:
    actions: list[Action]
    source: str
    reasoning: str = ""


@dataclass
class Rule:
    """An action, when a column profile asks for it, and its confidence in percent."""

    action: str
    when: Callable[[dict, dict], bool]
    percent: Callable[[dict], float]
    reason: Callable[[dict], str]
    parameters: Callable[[dict, dict], dict] = lambda p, o: {}


def _text(p: dict) -> bool:
    return p["physical_type"] == "string"


def _certain(p: dict) -> float:
    return 100.0


def _ratio(p: dict) -> float:
    return p["unique_count"] / p["rows"] * 100 if p["rows"] else 0.0


def _dated(p: dict, o: dict) -> bool:
    sure = not p["ambiguous_date_warning"] or o["date_dayfirst"] is not None
    return p["datetime_like_percentage"] >= CONVERT_AT and _text(p) and p["semantic_type"] == "datetime" and not p["mixed_format_warning"] and sure


#: In the order in which a column's actions are listed. Their ids and limits are fixed values.
RULES = (
    Rule("strip_whitespace", lambda p, o: p["whitespace_count"] > 0, lambda p: p["whitespace_count"] / max(1, p["rows"]) * 100, lambda p: f"{p['whitespace_count']} values have outer white space."),
    Rule("review_index_column", lambda p, o: p["is_index_like"], _certain, lambda p: "The column repeats the row number."),
    Rule("review_duplicate_column", lambda p, o: p["duplicate_value_column"], _certain, lambda p: "Another column holds the same values."),
    Rule("preserve_identifier", lambda p, o: p["is_likely_id"], _ratio, lambda p: f"{p['unique_count']} different values in {p['rows']} rows, under an identifier's name."),
    Rule(
        "convert_to_numeric",
        lambda p, o: not p["is_likely_id"] and p["numeric_like_percentage"] >= CONVERT_AT and _text(p) and p["semantic_type"] == "numeric",
        lambda p: p["numeric_like_percentage"],
        lambda p: f"{p['numeric_like_percentage']:.1f}% of the text values read as numbers.",
        lambda p, o: {"numeric_like_percentage": p["numeric_like_percentage"]},
    ),
    Rule("convert_to_datetime", _dated, lambda p: p["datetime_like_percentage"], lambda p: f"{p['datetime_like_percentage']:.1f}% of the text values read as dates.", lambda p, o: {"datetime_like_percentage": p["datetime_like_percentage"], "dayfirst": o["date_dayfirst"]}),
    Rule("review_ambiguous_date_format", lambda p, o: p["ambiguous_date_warning"] and o["date_dayfirst"] is None, _certain, lambda p: "Numeric dates need a day-first or month-first policy."),
    Rule(
        "convert_to_boolean",
        lambda p, o: p["boolean_like_percentage"] >= CONVERT_AT and _text(p) and p["semantic_type"] == "boolean",
        lambda p: p["boolean_like_percentage"],
        lambda p: f"{p['boolean_like_percentage']:.1f}% of the text values read as yes or no.",
        lambda p, o: {"boolean_like_percentage": p["boolean_like_percentage"]},
    ),
    Rule("classify_as_categorical", lambda p, o: p["is_categorical"] and p["semantic_type"] in ("categorical", "free_text"), lambda p: 100 - _ratio(p), lambda p: f"Only {p['unique_count']} different values in {p['rows']} rows."),
    Rule("preserve_free_text", lambda p, o: p["is_free_text"] and p["semantic_type"] == "free_text", _ratio, lambda p: "Nearly all values differ, in varying lengths."),
    Rule("normalize_case", lambda p, o: p["has_case_variations"] and p["is_categorical"], _certain, lambda p: "Categories differ in case only.", lambda p, o: {"strategy": "lower"}),
    Rule("review_outliers", lambda p, o: p["outlier_count"] > 0, _certain, lambda p: f"{p['outlier_count']} values lie outside the fences; they stay.", lambda p, o: {"outlier_count": p["outlier_count"]}),
    Rule("review_skewness", lambda p, o: p["skewness"] is not None and abs(p["skewness"]) >= 1, _certain, lambda p: f"Skewness is {p['skewness']:.3f}.", lambda p, o: {"skewness": p["skewness"]}),
    Rule("review_mixed_format", lambda p, o: p["mixed_format_warning"], _certain, lambda p: "The values come in several formats."),
    Rule("review_semantic_type", lambda p, o: p["semantic_type"] == "unresolved", lambda p: 0.0, lambda p: "No type fits well enough."),
)


def confidence(percent: float) -> float:
    return round(min(1.0, max(0.0, percent / 100)), 4)


def plan_cleaning(profile: dict, names: list[str], date_dayfirst: bool | None = None) -> Plan:
    """The plan for a raw profile; names are the table's columns, matched by position."""
    if profile.get("profile_type") != "raw":
        raise ValueError("a raw profile is needed")
    if date_dayfirst not in (None, True, False):
        raise ValueError("date_dayfirst must be True, False or None")
    if len(profile["columns"]) != len(names):
        raise ValueError("profile and table differ in their columns")
    options = {"date_dayfirst": date_dayfirst}

    def actions() -> Iterator[Action]:
        for name, own in zip(names, profile["columns"], strict=True):
            p = own | {"rows": profile["row_count"]}
            for r in RULES:
                if r.when(p, options):
                    yield Action([name], r.action, confidence(r.percent(p)), r.reason(p), r.parameters(p, options))

    return Plan(list(actions()), "raw_profile", "Derived from the raw profile; no data was changed.")


def plan_legacy(profile: dict) -> Plan:
    """The older plan, from a legacy profile; confidences are not part of it."""

    def actions() -> Iterator[Action]:
        for p in profile["columns"]:
            n, kind, constant = p["name"], p["inferred_type"], p["is_constant"]
            if p["null_like_text_count"]:
                yield Action([n], "replace_null_like", reason=f"{p['null_like_text_count']} null words.")
            if p["whitespace_count"]:
                yield Action([n], "strip_whitespace", reason=f"{p['whitespace_count']} values have outer white space.")
            if p["empty_string_count"]:
                yield Action([n], "replace_empty_strings", reason=f"{p['empty_string_count']} blank values.")
            if p["numeric_parse_percentage"] >= CONVERT_AT and p["physical_type"] == "string" and not constant:
                if p["is_potential_id"]:
                    yield Action([n], "preserve_identifier", reason="Numeric text under an identifier's name.")
                elif p["has_mixed_types"]:
                    yield Action([n], "review_mixed_types", reason="Cells of several types.")
                elif kind in ("integer", "float"):
                    yield Action([n], "convert_to_numeric", reason=f"{p['numeric_parse_percentage']:.1f}% numbers.")
                else:
                    yield Action([n], "review_numeric_conversion", reason=f"Numbers under the type {kind}.")
            if p["datetime_parse_percentage"] >= CONVERT_AT and p["physical_type"] == "string" and kind == "datetime":
                yield Action([n], "convert_to_datetime", reason=f"{p['datetime_parse_percentage']:.1f}% dates.")
            if p["boolean_parse_percentage"] >= CONVERT_AT and p["physical_type"] == "string" and kind == "boolean":
                yield Action([n], "convert_to_boolean", reason=f"{p['boolean_parse_percentage']:.1f}% yes or no.")
            if p["has_case_variations"] and kind == "categorical":
                yield Action([n], "normalize_case", reason="Categories differ in case only.", parameters={"case": "lower"})
            if constant:
                yield Action([n], "review_constant_column", reason="One value throughout.")
            if p["is_potential_id"] and kind not in ("integer", "float"):
                yield Action([n], "preserve_identifier", reason="An identifier's name.")
            if p["outlier_count"]:
                yield Action([n], "review_outliers", reason=f"{p['outlier_count']} values outside the fences.")

    return Plan(list(actions()), "legacy_profile")
