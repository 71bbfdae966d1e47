"""Columns whose cells are of several types, as variants: the type of each cell, and the columns as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.operators.columns import aggregate, col

#: Names of cell types, by the first word of a variant's schema; null is no type.
TYPES = {"int": ("BIGINT",), "float": ("DOUBLE", "FLOAT", "DECIMAL"), "str": ("STRING",), "bool": ("BOOLEAN",), "dict": ("OBJECT",), "list": ("ARRAY",), "datetime": ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ")}


def names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]


def is_type(c: Column, kind: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(c), "^[A-Z_]+", 0).isin(*TYPES[kind])


def type_counts(df: DataFrame, cells: dict[str, Column] | None = None) -> dict[str, dict[str, int]]:
    """Cells of each type in each variant column, or in each of the given variants; one aggregate."""
    cells = {n: col(n) for n in names(df)} if cells is None else cells
    found = aggregate(df, {(n, kind): F.count_if(is_type(c, kind)) for n, c in cells.items() for kind in TYPES})
    return {n: {kind: found[n, kind] for kind in TYPES if found[n, kind]} for n in cells}


def text_of(c: Column) -> Column:
    """A variant as text: strings as they are, the rest as JSON writes it; its null is null."""
    return F.when(F.schema_of_variant(c) != "VOID", F.variant_get(c, "$", "string"))


def as_text(df: DataFrame) -> DataFrame:
    """df with its variants as text, which is what cleaning and statistics work on."""
    own = set(names(df))
    return df.select(*(text_of(col(f.name)).alias(f.name) if f.name in own else col(f.name) for f in df.schema)) if own else df


def strings_only(df: DataFrame) -> DataFrame:
    """The variant columns with their strings alone."""
    return df.select(*(F.when(is_type(col(n), "str"), F.variant_get(col(n), "$", "string")).alias(n) for n in names(df)))


def field_of(record: Column, name: str, kind: str) -> Column:
    path = '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'
    return F.try_variant_get(record, path, kind)


def read_json(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """A JSON file under the types that Spark infers; columns that it makes text because their cells are of several types stay variants."""
    df = spark.read.json(path, multiLine=multi_line)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts or "_corrupt_record" in df.columns:
        return df
    records = spark.read.format("json").option("singleVariantColumn", "record").option("multiLine", multi_line).load(path)
    if multi_line:
        # A file that is one array is one variant; its elements are the records.
        whole = F.schema_of_variant("record").startswith("ARRAY")
        elements = records.where(whole).lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).select(F.col("value").alias("record"))
        records = records.where(~whole).unionByName(elements)
    counts = type_counts(records, {n: field_of(F.col("record"), n, "variant") for n in texts})
    several = {n for n, kinds in counts.items() if len(kinds) > 1}
    if not several:
        return df
    return records.select(*(field_of(F.col("record"), f.name, "variant" if f.name in several else f.dataType.simpleString()).alias(f.name) for f in df.schema))
