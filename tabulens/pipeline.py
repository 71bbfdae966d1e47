"""The whole run: source, profile, plan, safe cleaning, comparison, statistics, charts, evidence, report.

Nothing is raised: a fault ends the run with its stage, type and message under pipeline_error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from tabulens.operators import executor, mixed, raw_profile, statistics, structure, summary
from tabulens.plans import charts, evidence, report
from tabulens.plans.planner import plan_cleaning
from tabulens.sources import ingest


def run(spark: SparkSession, source: str | DataFrame, data_loss_threshold: float = 0.30, case_strategy: str = "lower", date_dayfirst: bool | None = None, select_charts: bool = False, approximate: int = 0) -> dict:
    """Run on a path or a frame. The result holds frames (raw_frame, cleaned_frame) and plain data, under one key a stage."""
    out: dict = {"pipeline_error": None, "html_profile": {"status": "unavailable"}, "final_report": None}
    stage = "ingestion"
    try:
        if isinstance(source, DataFrame):
            frame, out["structure"] = structure.check(source)
            out["ingestion"] = {"errors": out["structure"]["errors"], "warnings": out["structure"]["warnings"]}
            if not out["ingestion"]["errors"]:
                out["raw_profile"] = raw_profile.profile(frame, "raw", source.columns, approximate, out["structure"])
                out["plan"] = plan_cleaning(out["raw_profile"], frame.columns, date_dayfirst)
            frame = mixed.as_text(frame)
        else:
            found = ingest.ingest(spark, source, date_dayfirst, approximate)
            frame, out["ingestion"], out["structure"], out["raw_profile"], out["plan"] = found.frame, found.report, found.structure, found.profile, found.plan
        if out["ingestion"]["errors"]:
            out["pipeline_error"] = {"stage": stage, "type": "IngestionError", "message": out["ingestion"]["errors"][0]}
            return out
        out["raw_frame"] = frame
        stage = "preprocessing"
        before = executor.fingerprint(frame)
        steps, out["execution_log"] = executor.audit(frame, out["plan"], data_loss_threshold, case_strategy, date_dayfirst, out["structure"]["original_columns"])
        seen = Observation("raw")  # the pass that makes the cleaned frame sees the raw one
        cleaned = executor.apply(frame.observe(seen, *executor.row_marks(frame)), steps).persist()
        out["cleaned_frame"] = cleaned
        rows = cleaned.count()
        after = tuple(int(seen.get[m]) for m in ("rows", "xor", "sum"))
        out["raw_snapshot_unchanged"] = after == before
        stage = "validation"
        if faults := executor.validate(frame, cleaned, (after[0], rows)):
            raise ValueError("; ".join(faults))
        stage = "summary"
        out["summary"] = summary.summarise(out["raw_profile"], cleaned, out["execution_log"], approximate)
        stage = "statistics"
        out["statistics"] = statistics.statistical_profile(cleaned, out["summary"], approximate)
        stage = "visualisation"
        found_charts = charts.candidates(out["statistics"])
        out["chart_candidates"] = [c.as_dict() for c in found_charts]
        out["chart_evidence"] = evidence.chart_evidence(out["statistics"], found_charts)
        out["grouped_evidence"] = evidence.grouped(out["chart_evidence"])
        out["chart_decisions"] = charts.select(found_charts) if select_charts else charts.accept_all(found_charts)
        stage = "report"
        out["report_evidence"] = evidence.report_evidence(out)
        out["sections"] = report.narrative_sections(out)
        out["markdown"] = report.markdown(out)
    except Exception as e:  # the result is the interface for faults
        out["pipeline_error"] = {"stage": stage, "type": type(e).__name__, "message": str(e).splitlines()[0] if str(e) else ""}
    finally:
        if "cleaned_frame" in out:
            out["cleaned_frame"].unpersist()  # the stages read it often; a caller who does so too persists it again
    return out
