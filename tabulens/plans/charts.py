"""Chart candidates: a table of rules over a statistical profile, and a selection that keeps a report short."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from itertools import combinations

#: Rows from which distribution charts beyond the histogram make sense.
ENOUGH_ROWS = 20


@dataclass
class Candidate:
    rule_id: str
    chart_type: str
    columns: list[str]
    reason: str
    confidence: float
    priority: str

    def as_dict(self) -> dict:
        return asdict(self)


class View:
    """What the rules ask of a profile."""

    def __init__(self, profile: dict):
        self.profile = profile
        self.rows = profile.get("n_rows", 0)

    def of(self, kind: str) -> list[str]:
        return [n for n, c in self.profile["columns"].items() if c["semantic_type"] == kind]

    def unique(self, name: str) -> int:
        for family in ("categorical", "columns"):
            if (found := self.profile.get(family, {}).get(name, {}).get("unique_count")) is not None:
                return int(found)
        return 0

    def missing(self) -> list[str]:
        return [n for n, c in self.profile["columns"].items() if c["missing_count"] > 0]


def _each(kind: str, least: int = 0, low: int = 0, high: int | None = None) -> Callable[[View], Iterator[list[str]]]:
    def find(v: View) -> Iterator[list[str]]:
        if v.rows >= least:
            yield from ([n] for n in v.of(kind) if high is None or low <= v.unique(n) <= high)

    return find


def _category_pairs(v: View) -> Iterator[list[str]]:
    yield from ([a, b] for a, b in combinations(v.of("categorical"), 2) if 2 <= v.unique(a) <= 20 and 2 <= v.unique(b) <= 10)


def _group(find: Callable[[View], list[str]], low: int, high: float = float("inf")) -> Callable[[View], Iterator[list[str]]]:
    def found(v: View) -> Iterator[list[str]]:
        names = find(v)
        if low <= len(names) <= high:
            yield names

    return found


#: rule_id, chart_type, columns, confidence, priority, reason; in the order of listing. Ids, types, limits, confidences and
#: priorities are fixed values, which readers of a profile rely on.
RULES = (
    ("NUMERIC_HISTOGRAM", "histogram", _each("numeric"), 0.95, "high", "shows how the values are distributed"),
    ("NUMERIC_BOX_PLOT", "box_plot", _each("numeric"), 0.95, "medium", "shows median, quartiles and outliers"),
    ("CATEGORICAL_BAR", "bar_chart", _each("categorical"), 0.95, "high", "shows how often each category occurs"),
    ("LOW_CARDINALITY_PIE", "pie_donut_chart", _each("categorical", 0, 2, 6), 0.85, "medium", "shows the shares of a few categories"),
    ("NUMERIC_NUMERIC_SCATTER", "scatter_plot", lambda v: map(list, combinations(v.of("numeric"), 2)), 0.90, "high", "shows how two measures move together"),
    ("DATETIME_NUMERIC_LINE", "line_chart", lambda v: ([a, b] for a in v.of("datetime") for b in v.of("numeric")), 0.95, "high", "shows a measure over time"),
    ("CATEGORICAL_NUMERIC_GROUPED_BAR", "grouped_bar_chart", lambda v: ([a, b] for a in v.of("categorical") if 2 <= v.unique(a) <= 20 for b in v.of("numeric")), 0.85, "medium", "compares a measure between categories"),
    ("CATEGORICAL_CATEGORICAL_STACKED_BAR", "stacked_bar_chart", _category_pairs, 0.85, "medium", "shows how one category splits into another"),
    ("CATEGORICAL_CATEGORICAL_100_PERCENT", "100_percent_stacked_bar_chart", _category_pairs, 0.85, "medium", "compares shares of one category within another"),
    ("MULTIPLE_NUMERIC_CORRELATION", "correlation_heatmap", _group(lambda v: v.of("numeric"), 2), 0.95, "high", "shows all correlations at once"),
    ("MISSINGNESS_BAR", "missingness_bar_chart", _group(View.missing, 1), 0.95, "high", "compares missing values between columns"),
    ("MULTIPLE_COLUMN_MISSINGNESS", "missingness_heatmap", _group(View.missing, 2), 0.90, "medium", "shows which values are missing together"),
    ("NUMERIC_VIOLIN", "violin_plot", _each("numeric", ENOUGH_ROWS), 0.85, "medium", "shows shape and spread of the distribution"),
    ("NUMERIC_QQ", "qq_plot", _each("numeric", ENOUGH_ROWS), 0.80, "low", "compares the distribution with the normal one"),
    ("MULTIPLE_NUMERIC_PAIR_PLOT", "pair_plot", _group(lambda v: v.of("numeric"), 2, 8), 0.85, "medium", "shows all pairs of measures at once"),
)


def candidates(profile: dict) -> list[Candidate]:
    v = View(profile)
    return [Candidate(rule, chart, columns, f"{', '.join(columns)}: {why}.", confidence, priority) for rule, chart, find, confidence, priority, why in RULES for columns in find(v)]


#: Names under which selected charts are reported.
REPORTED = {"pie_donut_chart": "pie_chart", "correlation_heatmap": "heatmap"}
DISTRIBUTION = ("histogram", "box_plot", "violin_plot", "qq_plot")
MOST_CHARTS, LIMITS = 7, {"scatter_plot": 2, "line_chart": 2, "grouped_bar_chart": 1}


def reported(chart: str) -> str:
    return REPORTED.get(chart, chart)


def accept_all(found: list[Candidate], confidence: float = 0.8) -> list[dict]:
    """Every candidate as accepted, as when nothing selects."""
    return [c.as_dict() | {"chart_type": reported(c.chart_type), "decision": "accepted", "confidence": confidence} for c in found]


def select(found: list[Candidate], most: int = MOST_CHARTS) -> list[dict]:
    """A short set by fixed limits: one distribution chart a measure, bar or pie, one stacked form a pair, one chart of
    missing values, pair plot or heatmap with scatter plots; by priority, then confidence, then listing."""
    rank = {"high": 0, "medium": 1, "low": 2}
    out: list[dict] = []
    used: set = set()
    kept = 0
    for i, c in sorted(enumerate(found), key=lambda x: (rank[x[1].priority], -x[1].confidence, x[0])):
        slot = None
        if c.chart_type in DISTRIBUTION:
            slot = "distribution", *c.columns
        elif c.chart_type in ("bar_chart", "pie_donut_chart"):
            slot = "shares", *c.columns
        elif "stacked" in c.chart_type:
            slot = "stacked", *c.columns
        elif c.chart_type.startswith("missingness"):
            slot = ("missing",)
        elif c.chart_type in ("pair_plot", "correlation_heatmap"):
            slot = ("pairs",)
        count = sum(o["chart_type"] == reported(c.chart_type) and o["decision"] == "accepted" for o in out)
        fits = kept < most and slot not in used and count < LIMITS.get(c.chart_type, most)
        kept += fits
        if fits and slot:
            used.add(slot)
        out.append(c.as_dict() | {"chart_type": reported(c.chart_type), "decision": "accepted" if fits else "rejected", "place": i})
    return sorted(out, key=lambda o: o.pop("place"))
