"""Structural checks of a table, and its header made safe."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tabulens.operators.columns import identical_pairs, kinds
from tabulens.operators.raw_profile import index_like

FEW_ROWS = 5


def normalise_name(name: str, position: int) -> str:
    """ASCII letters and digits in lower case, anything else as one underscore; blank names by position."""
    trimmed = name.strip()
    plain = re.sub(r"[^0-9a-zA-Z]+", "_", trimmed).strip("_").lower()
    return plain if plain and not trimmed.lower().startswith("unnamed:") else f"column_{position + 1}"


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _2, _3 and so on, past any name that the table has already."""
    taken, out = set(names), []
    used: set[str] = set()
    for n in names:
        chosen, k = n, 2
        while chosen in used or (chosen != n and chosen in taken):
            chosen, k = f"{n}_{k}", k + 1
        used.add(chosen)
        out.append(chosen)
    return out


def normalised_names(header: list[str]) -> list[str]:
    return unique_names([normalise_name(n, i) for i, n in enumerate(header)])


def check(df: DataFrame, header: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The table under normalised names, and what its structure shows; errors are fatal, warnings are not."""
    header = list(header or df.columns)
    report: dict = {"errors": [], "warnings": [], "original_columns": header, "row_count": 0, "column_count": len(header)}
    if not header:
        report["errors"].append("The table has no columns.")
        return df, report
    rows = df.count()
    report["row_count"] = rows
    if not rows:
        report["errors"].append("The table has no rows.")
        return df, report
    report["duplicate_column_names"] = list(dict.fromkeys(n for n in header if header.count(n) > 1))
    names = normalised_names(header)
    renamed = df.toDF(*names)
    report["columns"] = names
    report["renamed"] = {f"{i}:{a}": b for i, (a, b) in enumerate(zip(header, names, strict=True)) if a != b}
    report["duplicate_value_columns"] = [list(p) for p in identical_pairs(renamed)]
    shapes = dict(kinds(renamed))
    report["index_like_columns"] = [b for a, b in zip(header, names, strict=True) if index_like(renamed, a, b, shapes[b], rows)]
    if report["duplicate_column_names"]:
        report["warnings"].append("Column names repeat.")
    if report["duplicate_value_columns"]:
        report["warnings"].append("Columns hold equal values.")
    if report["index_like_columns"]:
        report["warnings"].append("A column repeats the row number.")
    if rows == 1:
        report["warnings"].append("The table has one row.")
    elif rows < FEW_ROWS:
        report["warnings"].append("The table has fewer than five rows.")
    if len(names) == 1:
        report["warnings"].append("The table has one column.")
    return renamed, report
