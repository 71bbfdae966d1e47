"""Stand-alone transforms: one-hot columns, mean imputation, outlier filter, logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions import stats, text
from tabulens.operators.columns import col, outlier_bounds, quantiles

#: One-hot columns of one source column; more would make a plan of as many expressions.
MOST_VALUES = 1_000


def one_hot(df: DataFrame, name: str, most: int = MOST_VALUES) -> DataFrame:
    """The column replaced by one boolean per value, sorted by value; null is false throughout."""
    values = [r[0] for r in df.select(col(name).cast("string")).where(col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} values")
    kept = [col(c) for c in df.columns if c != name]
    return df.select(*kept, *(F.coalesce(col(name).cast("string") == v, F.lit(False)).alias(f"{name}_{v}") for v in values))


def mean_impute(df: DataFrame, name: str) -> DataFrame:
    mean = df.agg(F.avg(stats.clean(col(name)))).first()[0]
    return df.withColumn(name, F.coalesce(stats.clean(col(name)), F.lit(mean)))


def drop_outliers(df: DataFrame, name: str, approximate: int = 0) -> DataFrame:
    """Rows between the fences, bounds included; rows without a value go as well."""
    c = stats.clean(col(name))
    bounds = outlier_bounds(*quantiles(df, {name: c}, (0.25, 0.75), df.count(), approximate)[name])
    return df.where(c.between(*bounds)) if bounds else df.where(F.lit(False))


def log_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, text.log_transform(stats.clean(col(name))))
