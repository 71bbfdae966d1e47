"""Sinks, on request only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The cleaned table as CSV with a header, or as Parquet."""
    if kind not in ("csv", "parquet"):
        raise ValueError("kind must be csv or parquet")
    df.write.mode("overwrite").csv(path, header=True) if kind == "csv" else df.write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A report as one file, on any file system that Spark writes."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
