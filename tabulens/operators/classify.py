"""Semantic types as decisions over a column's measures; plain Python, first match wins."""

from __future__ import annotations

import re

ACCEPT = 0.80
HIGH_CARDINALITY, LOW_CARDINALITY = 0.90, 0.20
LEGACY_ACCEPT = 70.0

# Names that say a column identifies rows, here and in the older profile.
ID_NAME = re.compile(r"(^|[_\s-])(id|uuid|guid|identifier|code|account_number|reference_number)($|[_\s-])", re.IGNORECASE)
LEGACY_ID_WORDS = ("id", "identifier", "uuid", "guid", "customer_code", "employee_code", "product_code", "account_number", "reference_number")


def named_like_id(name: str) -> bool:
    return bool(ID_NAME.search(name))


def semantic_type(p: dict) -> tuple[str, float]:
    """Type and confidence for a profile with physical, ratio, the three likeness shares, id_name_signal and the text measures."""
    physical, ratio, unique = p["physical_type"], p["uniqueness_ratio"], p["unique_count"]
    fixed = {"boolean": ("boolean", 1.0), "timedelta": ("timedelta", 1.0), "numeric": ("numeric", 1.0), "nested": ("unresolved", 0.0)}
    if physical in fixed:
        return fixed[physical]
    for like in ("numeric", "datetime", "boolean"):
        if (score := p[f"{like}_like_percentage"] / 100) >= ACCEPT:
            return like, round(score, 4)
    if p["id_name_signal"] and ratio >= HIGH_CARDINALITY:
        return "identifier", round(ratio, 4)
    if ratio <= LOW_CARDINALITY and unique > 1:
        return "categorical", round(1 - ratio, 4)
    if p["string_count"] and ratio >= HIGH_CARDINALITY and p["variable_length"]:
        return "free_text", round(ratio, 4)
    return "unresolved", 0.0


def legacy_type(p: dict) -> str:
    """The older vocabulary: shares count among values that are no null words, and formats come before plain numbers."""
    if not p["non_null_count"]:
        return "unknown"
    physical = p["physical_type"]
    if physical in ("boolean", "datetime", "timedelta"):
        return physical
    if physical == "numeric":
        return "integer" if p["integral"] else "float"
    if physical == "nested":
        return "unknown"
    if p["unique_count"] <= 1:
        return "categorical"
    for like in ("percentage", "currency", "boolean"):
        if p[f"{like}_parse_percentage"] >= LEGACY_ACCEPT:
            return like
    if p["numeric_parse_percentage"] >= LEGACY_ACCEPT:
        return "integer" if p["all_integral"] else "float"
    if p["datetime_parse_percentage"] >= LEGACY_ACCEPT:
        return "datetime"
    return "text" if p["unique_percentage"] >= 70 and (p["average_length"] or 0) >= 30 else "categorical"


def legacy_potential_id(name: str, unique_count: int) -> bool:
    """A bare substring of the name suffices here, so `paid` and `width` match; kept as the older rule has it."""
    return unique_count > 1 and any(w in name.strip().lower() for w in LEGACY_ID_WORDS)
