"""Mixing sources to target weights (op1), with DataFrame functions only.

Every source's documents, shuffled by a hash, form one stream of words that is cut into blocks of BLOCK_WORDS words.
Slot i of the schedule maps the golden-ratio point frac(i / phi) through the cumulative shares of the sources; the
rank of a slot among its source's slots names the block that fills it, and ranks beyond the last block start the
stream anew. Joining slots to the blocks of documents says which words the mix takes, in order. Since such points
have low discrepancy, every stretch of the schedule holds the sources in their shares.

A source gets exactly its target, rounded to whole words: slots beyond it are left out, its last slot is cut, and the
few slots that the points came short by are appended. Ranks and word offsets within a source are sums over hash
buckets (or runs of slots) plus running sums inside them, so a source with a third of all rows is spread over tasks.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source, last in order;
rows that repeat are documents of their own; an empty table gives an empty result. The order of rows and their
partitioning don't matter: reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import WORD, cut, table

BLOCK_WORDS = 512
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of all documents, and the most times that a source may repeat.
SHARE, REPEATS = 1.5, 2
#: Rows of a bucket, on average, and slots of a run.
BUCKET_ROWS, RUN_SLOTS = 2_000, 1 << 13

#: The golden ratio's fraction in units of 2**-31; odd, so the points of a period are all different.
GOLDEN, PERIOD = 1327217885, 1 << 31


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """source, sid, rows, source_size and target of each source in rows (source, size).

    A target is the smaller of REPEATS times the size and weight times one common level; the level is read off at the
    first source, by cap over weight, that doesn't reach its cap. The windows run over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double")
    by_ratio = every.orderBy("ratio", "sid")
    cap = F.col("source_size") * float(REPEATS)
    level = F.try_divide(
        SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    )
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    return (
        rows.groupBy("source")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("target", F.least("cap", found * F.col("weight")))
        .select("source", "sid", "rows", "source_size", "target")
    )


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the group that come before, in the order of bucket, then order."""
    inside = Window.partitionBy(*group, bucket)
    ahead = Window.unboundedPreceding, -1
    totals = (
        df.groupBy(*group, bucket)
        .agg(F.sum(value).alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(*ahead)), F.lit(0)))
        .drop("_total")
    )
    own = F.coalesce(F.sum(value).over(inside.orderBy(*order).rowsBetween(*ahead)), F.lit(0))
    return df.withColumn("_own", own).join(totals, [*group, bucket]).withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_base", "_own")


@dataclass
class Mix:
    """rows: doc_id, source, size, mark, mark2, sid, source_size, target, lo (the first word's place in the source's
    stream), piece_key (lo where the row has words). fragments: slot, sid, pass, piece_key, start, words, in the order
    of slot, then start: what the mix takes of a document."""

    rows: DataFrame
    fragments: DataFrame


def marks(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """Two hashes of a row; rows with equal marks are equal in id, source and text."""
    return [F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias(name) for seed, name in ((11, "mark"), (13, "mark2"))]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> Mix:
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *marks(id_col, source_col, text_col))
    narrow = cut(narrow, "mix-rows")  # the texts are read once
    sources = cut(source_targets(narrow).withColumn("blocks", F.ceil(F.col("source_size") / block_words)), "mix-sources")

    wanted = F.round("target").cast("long")
    left = F.when(F.col("source_size") > 0, F.col("wanted") % F.col("source_size")).otherwise(0)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0)
    plan = sources.withColumn("wanted", wanted).withColumn("passes", passes).withColumn("left", left).withColumn("slots", (F.col("passes") * F.col("blocks") + F.ceil(F.col("left") / block_words)).cast("long"))
    facts = plan.agg(F.count("*").alias("n"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()

    buckets = max(1, -(-facts["rows"] // BUCKET_ROWS))
    rows = (
        narrow.join(sources, narrow["source"].eqNullSafe(sources["source"]))
        .select("doc_id", narrow["source"], "size", "mark", "mark2", "sid", "source_size", "target")
        .withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    )
    rows = running(rows, ["sid"], "bucket", ["mark", "mark2", "size"], F.col("size"), "lo").drop("bucket")
    rows = cut(rows.withColumn("piece_key", F.when(F.col("size") > 0, F.col("lo"))), "mix-places")

    # Blocks of documents: one piece for each block that a document reaches into.
    first, last = F.floor(F.col("lo") / block_words), F.floor((F.col("lo") + F.col("size") - 1) / block_words)
    pieces = (
        rows.where("size > 0")
        .select("sid", "lo", "size", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("a", F.greatest("lo", F.col("block") * block_words))
        .withColumn("b", F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block_words))
    )

    slots = schedule(spark, plan, facts["n"], facts["slots"])
    stop = F.when(F.col("pass") == F.col("passes"), F.col("left")).otherwise(F.col("source_size"))
    fragments = (
        slots.join(pieces, ["sid", "block"])
        .withColumn("words", F.least("b", stop) - F.col("a"))
        .where("words > 0")
        .select("slot", "sid", "pass", F.col("lo").alias("piece_key"), (F.col("a") - F.col("lo")).alias("start"), "words")
    )
    return Mix(rows, fragments)


def schedule(spark, plan: DataFrame, n_sources: int, total: int) -> DataFrame:
    """slot, sid, pass and block of each slot, and passes, left and source_size of its source."""
    every = Window.partitionBy(F.lit(0)).orderBy("sid")
    cells = max(64, 4 * n_sources)
    ends = F.sum("slots").over(every)
    shares = (
        plan.where("slots > 0")
        .withColumn("to", ends / float(max(1, total)))
        .withColumn("from", F.coalesce(F.lag("to").over(every), F.lit(0.0)))
        .withColumn("to", F.when(ends == total, F.lit(1.0)).otherwise(F.col("to")))
    )
    # A point meets only the sources that reach into its cell of the unit interval.
    reach = shares.select("sid", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * cells), F.least(F.floor(F.col("to") * cells), F.lit(cells - 1)))).alias("cell"))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(PERIOD)) * GOLDEN, F.lit(PERIOD)) / float(PERIOD)
    drawn = (
        spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // 1_000_000)))
        .withColumnRenamed("id", "slot")
        .withColumn("point", point)
        .withColumn("cell", F.floor(F.col("point") * cells))
        .join(reach, "cell")
        .where("point >= from and point < to")
        .select("slot", "sid", F.floor(F.col("slot") / RUN_SLOTS).alias("run"))
    )
    ranked = running(drawn, ["sid"], "run", ["slot"], F.lit(1), "rank").select("slot", "sid", "rank")
    held = drawn.groupBy("sid").agg(F.count("*").alias("held"))
    short = (
        plan.join(held, "sid", "left")
        .withColumn("held", F.coalesce("held", F.lit(0)))
        .where("held < slots")
        .select("sid", F.explode(F.sequence(F.col("held"), F.col("slots") - 1)).alias("rank"))
        .select((F.lit(total) + F.col("rank")).alias("slot"), "sid", "rank")
    )
    return (
        ranked.unionByName(short)
        .join(plan.select("sid", "slots", "blocks", "passes", "left", "source_size"), "sid")
        .where("rank < slots")
        .select("slot", "sid", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"), "passes", "left", "source_size")
    )


def taken(mixed: Mix) -> DataFrame:
    """The mix's rows with taken, the words that it takes of each."""
    sums = mixed.fragments.groupBy("sid", "piece_key").agg(F.sum("words").alias("taken"))
    return mixed.rows.join(sums, ["sid", "piece_key"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents with the columns of docs: a row for each pass over a document that takes words of it.

    A pass that takes all of a document repeats its row; one that stops inside cuts the text after the last word taken.
    """
    mixed = mix(docs, id_col, text_col, source_col)
    by_pass = mixed.fragments.groupBy("sid", "piece_key", "pass").agg(F.sum("words").alias("words"))
    uses = by_pass.join(mixed.rows.where("size > 0").select("sid", "piece_key", "size", "mark", "mark2"), ["sid", "piece_key"])
    uses = uses.withColumn("nth", F.dense_rank().over(Window.partitionBy("mark", "mark2").orderBy("piece_key")))
    lists = uses.groupBy("mark", "mark2").agg(F.collect_list(F.struct("nth", "words", "size")).alias("uses"))
    own = docs.select(F.struct("*").alias("doc"), *marks(id_col, source_col, text_col))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("mark", "mark2").orderBy("mark")))
    found = own.join(lists, ["mark", "mark2"]).select("doc", F.explode(F.filter("uses", lambda u: u["nth"] == F.col("nth"))).alias("use"))
    text = F.col(f"doc.`{text_col}`")
    kept = F.when(F.col("use.words") < F.col("use.size"), first_words(text, F.col("use.words"))).otherwise(text)
    columns = [kept.alias(c) if c == text_col else F.length(kept).cast("long").alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source")
