"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a folder, pruned to the named columns (all if none are named)."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def once(frame: DataFrame, keys: list[str], keep: Column | str | None = None) -> DataFrame:
    """Each key's row once, of those that the condition keeps.

    Repeated rows are equal in every column, so filtering before they are dropped keeps the same keys; that way the
    condition reaches the scan and only what passes is shuffled.
    """
    return (frame if keep is None else frame.where(keep)).dropDuplicates(keys)


def spread(frame: DataFrame, rows_per_part: int | None = None, *keys: str) -> DataFrame:
    """Spread rows of CPU-heavy work over all cores: small files arrive as one partition.

    The number of parts follows the session's shuffle partitions and its parallelism, whichever is more.
    """
    spark = frame.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism * 2)
    return frame.repartition(parts, *[F.col(k) for k in keys])
