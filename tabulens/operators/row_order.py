"""The order of rows in the files that a table was read from, and row numbers by it, without sorting or gathering rows.

A scan hands out splits (a file and the byte its block starts at), and a task reads the rows of a split in order. Rows are
counted per split, the counts are added up over the splits before, and each row's place in its split is added to that.
What is shuffled are one count a split and task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "__row_idx"
#: Splits up to which their offsets (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000

PATH, BLOCK, AT = "__path", "__block", "__at"


def placed(df: DataFrame) -> tuple[DataFrame, bool]:
    """df with its rows' file, block and a number that ascends in each block; False where it isn't read from files, so that its partitions stand for blocks."""
    at = F.monotonically_increasing_id().alias(AT)
    try:
        return df.select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(BLOCK), at), True
    except AnalysisException:
        return df.select("*", F.lit("").alias(PATH), F.spark_partition_id().cast("long").alias(BLOCK), at), False


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """df with the number of each row, from 0, by path of the file and place in it.

    The relation lists its files once, so both passes over it read the same splits.
    """
    rows, _ = placed(df)
    splits = rows.groupBy(PATH, BLOCK).agg(F.count("*").alias("n"), F.min(AT).alias("first")).persist()
    # One row a file, then one row a split of each file: windows over these, not over rows of the table.
    files = splits.groupBy(PATH).agg(F.sum("n").alias("rows")).select(PATH, (F.sum("rows").over(Window.orderBy(PATH)) - F.col("rows")).alias("before"))
    within = F.sum("n").over(Window.partitionBy(PATH).orderBy(BLOCK)) - F.col("n")
    offsets = splits.select(PATH, BLOCK, "first", within.alias("within")).join(files, PATH).select(F.col(PATH).alias("_p"), F.col(BLOCK).alias("_b"), (F.col("before") + F.col("within") - F.col("first")).alias("_offset"))
    few = splits.count() <= BROADCAST_SPLITS
    joined = rows.join(F.broadcast(offsets) if few else offsets, (F.col(PATH) == F.col("_p")) & (F.col(BLOCK) == F.col("_b")))
    return joined.select(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns), (F.col(AT) + F.col("_offset")).alias(name))


def first_values(df: DataFrame, cells: dict[str, Column], limit: int) -> DataFrame:
    """(column, place, value) of the first non-null values of each expression, in the order of the source; one pass, in which each task keeps `limit` rows a column.

    A row number in df gives the order where there is one. Values are variants, so they keep their types.
    """
    if ROW in df.columns:
        rows, order = df, [ROW]
    else:
        rows, order = placed(df)[0], [PATH, BLOCK, AT]
    own = [F.struct(F.lit(n).alias("column"), c.cast("variant").alias("value"), c.isNotNull().alias("there"), *order) for n, c in cells.items()]
    long = rows.select(F.explode(F.array(*own)).alias("cell")).select("cell.*").where("there")
    ranked = long.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.where(F.col("place") <= limit).select("column", "place", "value")


def in_order(df: DataFrame, number: Column) -> bool | None:
    """Whether a column repeats the row numbers, from 0; None where the table has no order of its own."""
    if ROW in df.columns:
        rows = df.select(number.alias("number"), ROW)
    else:
        if not placed(df)[1]:
            return None
        rows = numbered(df.select(number.alias("number")))
    return rows.agg(F.count_if(~F.col("number").eqNullSafe(F.col(ROW)))).first()[0] == 0
