"""A training-corpus pipeline of five operators.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. run() writes what each stage returns as a Parquet table and reads it back for the
next. A stage's result must be written before the next stage is called, which deletes the former's intermediate tables.
Results are computed when they are written, so a stage leaves the session with its limit of Arrow batches set (bound_batches).
SQL can't express the stages, so ORACLE_SQL is None and the tests hold them against brute force.

Every stage handles empty tables, null texts and ids, repeated rows and further columns as its operator defines it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import bpe, jaccard, language, mixing, pii
from tabulens.llm.common import bound_batches, cut, remove, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; a null lang takes the prediction."""
    model = language.fit(docs)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), "text")  # the text goes to Python once
    kept = language.identify(packed, model).where(~F.col("rejected"))
    own = {c: F.col(f"doc.`{c}`") for c in docs.columns if c != "text"} | {"lang": F.coalesce("doc.lang", "lang_pred"), "text": F.col("text")}
    return kept.select(*(own[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of linked documents."""
    return jaccard.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    return pii.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the ids decode to the text."""
    packed = docs.select(F.struct("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).alias("doc"), "text")
    done = bpe.encode_and_decode(packed, bpe.default_path(), "doc")
    return done.select("doc.doc_id", "doc.source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("doc.text")).alias("round_trip"))


_done_with: list[str] = []


def _tidy(stage):
    """The stage, after the intermediate tables of the stage before are deleted: by then its result is written."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _done_with)
        bound_batches(spark)
        start = len(written)
        out = stage(spark, docs, sf_dir)
        _done_with[:] = written[start:]
        return out

    return run_stage


STAGES = [
    ("language_id", _tidy(identify_language)),
    ("near_duplicates", _tidy(drop_near_duplicates)),
    ("personal_data", _tidy(mask_personal_data)),
    ("mixing", _tidy(mix_sources)),
    ("bpe", _tidy(encode)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return docs
