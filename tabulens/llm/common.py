"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run without ASCII white space (JVM regular expression).
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker takes at a time.
SLICE_BYTES = 4 << 20

#: Strata whose counts are broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs in this process alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            return chosen.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tabulens-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


#: Paths of the tables that cut() wrote, in order; those written to last are not among them.
written: list[str] = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of which nothing is read any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation; the table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not lasting:
        written.append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's limit of the bytes of a batch that it sends to Python.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> bool:
    """From now on batches reach Python with SLICE_BYTES at most, or one row; a limit that the session has set stays. Returns whether it had none.

    Spark's own limits are 10 000 rows and 64 MB, which the JVM and the worker of every task hold.
    """
    free = spark.conf.get(BATCH_LIMIT, None) is None
    if free:
        spark.conf.set(BATCH_LIMIT, SLICE_BYTES)
    return free


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches for what runs meanwhile."""
    free = bound_batches(spark)
    try:
        yield
    finally:
        if free:
            spark.conf.unset(BATCH_LIMIT)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice have about limit bytes; a longer text is a slice of its own."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_remainder(col: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus; a null id has remainder -1, so it is never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % F.lit(modulus), F.lit(-1))


def bounded_sample(df: DataFrame, strata: str | None, keys: list[str], per_stratum: int, seed: int = 7) -> DataFrame:
    """At most per_stratum of the different rows of each stratum (None: of all rows), in the order of a hash of their keys.

    Rows with equal keys count once, so neither a repeated row nor a repeated or null id fills or empties a sample as long
    as keys tells rows apart. A first pass counts each stratum's hashes, so only about twice the wanted rows reach the
    window that ranks them.
    """
    marked = df.withColumn("_mark", F.xxhash64(F.lit(seed), *keys))
    hashes = F.approx_count_distinct("_mark", 0.02)
    if strata is None:
        least = min(1.0, (2.0 * per_stratum + 50) / max(1, marked.agg(hashes.alias("n")).first()["n"]))
        near = marked.where(F.pmod("_mark", F.lit(1 << 20)) < least * (1 << 20)).dropDuplicates(["_mark"])
        return near.orderBy("_mark").limit(per_stratum).drop("_mark")
    counts = cut(marked.groupBy(strata).agg(hashes.alias("count")), "strata")
    few = counts.count() <= BROADCAST_STRATA
    share = F.least(F.lit(1.0), F.lit(2.0 * per_stratum + 50) / F.col("count"))
    shares = counts.select(F.col(strata).alias("_s"), share.alias("_share"))
    kept = marked.join(F.broadcast(shares) if few else shares, F.col(strata) == F.col("_s")).where(F.pmod("_mark", F.lit(1 << 20)) < F.col("_share") * F.lit(1 << 20))
    ranked = kept.dropDuplicates(["_s", "_mark"]).withColumn("_rank", F.row_number().over(Window.partitionBy("_s").orderBy("_mark")))
    return ranked.where(F.col("_rank") <= per_stratum).drop("_mark", "_s", "_share", "_rank")


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df, and the fields of ddl after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
