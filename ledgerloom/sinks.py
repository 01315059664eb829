"""Writing results: JSON per claim, exports, appended events, upserts, corpora by task.

Every sink writes from the executors; nothing is gathered on the driver. Folders are given by the caller, on storage that
all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(frame: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """JSON lines; nulls are kept, so that every record has every field."""
    frame.write.mode(mode).option("ignoreNullFields", "false").partitionBy(*partitions).json(path)


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and doubled quotes; line breaks inside values are kept in quotes."""
    frame.write.mode(mode).options(header="true", escape='"', quoteAll="true", emptyValue="").csv(path)


def append_events(frame: DataFrame, path: str) -> None:
    """Adds audit events to a table; what is there is never rewritten."""
    frame.write.mode("append").parquet(path)


def latest(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the one that comes last by the order (nulls first), as an aggregate that combines before the shuffle."""
    rest = [c for c in frame.columns if c not in keys]
    best = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.`{c}`").alias(c) for c in rest])


def merged(table: DataFrame, batch: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The table after an upsert of the batch: keys of the batch replace those of the table if they are not older."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(rows, keys, *order, F.col("_new")).drop("_new")


def write_corpora(frame: DataFrame, path: str, task: str = "task") -> DataFrame:
    """One folder of JSON lines a task, and the summary (task, n) of what was written."""
    write_json(frame, path, task)
    return frame.sparkSession.read.json(path).groupBy(task).agg(F.count(F.lit(1)).alias("n"))
