"""Cutting lineage with copies that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's checkpoint folder: the one the cluster names, or a local one where none is set (tests, laptops)."""
    context = spark.sparkContext
    where = context._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerloom-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which the shuffles of an execution are removed as it ends (Spark 4.1 on).
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(frame: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared checkpoint folder and read back.

    Parquet rather than checkpoint(): it is compressed, and later reads prune its columns. The table is removed by
    drop(), release(), or when the driver's Python ends.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    # Nothing reads the shuffles of the write again; else they stay until the driver happens to collect its garbage.
    before = spark.conf.get(CLEAN, None)
    if before is not None:
        spark.conf.set(CLEAN, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEAN, before)
    table = spark.read.schema(frame.schema).parquet(path)
    table._durable = released(spark, path)
    return table


_written: list[str] = []


def released(spark: SparkSession, path: str) -> str:
    """The path, which is removed by release() or when the driver's Python ends."""
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    return path


def drop(frame: DataFrame) -> None:
    """Removes the table of a frame that durable() returned and that nothing reads any more."""
    path = vars(frame).pop("_durable", None)
    if path in _written:
        _written.remove(path)
        _drop(frame.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Removes all tables written so far. For long applications, once the results that read them are stored."""
    while _written:
        _drop(spark, _written.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is the cluster's to clean
        pass
