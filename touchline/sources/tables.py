"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The parquet table ``name`` of ``directory``, pruned to ``columns`` where given."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key: that of the greatest ``order`` (nulls lowest), ties by the greatest values.

    An aggregate, so repeated deliveries of a hot key are reduced before the shuffle, and the
    choice among equal ``order`` doesn't depend on how the rows are spread.
    """
    picked = F.max(F.struct(F.col(order).alias("_0"), *[F.col(c).alias(f"_{i + 1}") for i, c in enumerate(columns)]))
    return df.groupBy(*keys).agg(picked.alias("_last")).select(
        *keys, *[F.col(f"_last._{i + 1}").alias(c) for i, c in enumerate(columns)], F.col("_last._0").alias(order)
    )
