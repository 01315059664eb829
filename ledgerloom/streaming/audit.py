"""Stream forms of the activity metrics: event-time windows, redelivery, late rows, alerts and upserts.

A replay reads a table's files as a stream until they are consumed (availableNow) and returns what the sink holds, so a
stream can be held against its batch form. Timestamps without zone are cast first: watermarks need an instant.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.durable import ensure_checkpoint_dir


def stream_of(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The parquet file or folder as a stream, with its schema stated."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    kind = spark.read.parquet(path).inputFiles()
    if kind and not kind[0].rstrip("/").endswith(name):
        return spark.readStream.options(**options).schema(schema).parquet(path)
    return spark.readStream.options(**options).schema(schema).option("pathGlobFilter", name).parquet(folder)


def replayed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a parquet table (append) and read the table back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, state = f"{base}/out", f"{base}/state"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*" if mode == "append" else f"{out}/batch={_last(spark, out)}").select(*schema.names)


def _last(spark: SparkSession, out: str, part: str = "batch") -> int:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    return max(int(n.split("=")[1]) for n in names if n.startswith(f"{part}="))


def daily_actions(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(day, action, n): tumbling days of event time. In complete mode all days are kept; closed_days is the form whose state ends."""
    e = stream.withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", lateness)
    return e.groupBy(F.window("at", "1 day"), F.lower("action_name").alias("action")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "action", "n")


def first_deliveries(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each log_id once: redelivered rows within the lateness are dropped, with bounded state."""
    e = stream.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", lateness)
    return e.dropDuplicatesWithinWatermark(["log_id"]).drop("at")


def alerts(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream rows joined with a static table of (action, severity)."""
    return stream.withColumn("action", F.lower("action_name")).join(rules, "action").select("log_id", "user_id", "action", "severity")




def closed_days(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(day, action, n) of days that the watermark has passed, in append mode: their state is gone, rows that come later are dropped."""
    return daily_actions(stream, lateness)


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, start, n): runs of events of a user with no gap of that length."""
    e = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def upserted(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table that a stream of changes leaves: each micro-batch is reduced to its latest row a key and merged.

    A batch writes a new version of the table and only then forgets the one before, so a batch that is run again after a
    failure gives the same version.
    """
    from ledgerloom import sinks

    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        by = [F.col(c) for c in order]
        new = sinks.latest(batch, keys, *by)
        if number:
            new = sinks.merged(spark.read.schema(schema).parquet(f"{base}/version={number - 1}"), new, keys, *by)
        new.select(*schema.names).write.mode("overwrite").parquet(f"{base}/version={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/version={_last(spark, base, 'version')}")


def overdue(stream: DataFrame, after_days: int = 30, lateness: str = "1 hour") -> DataFrame:
    """(claim, last): claims without an event for so many days, told by an event-time timer when the watermark passes it.

    State is one instant a claim; a claim that is told is forgotten until it has an event again.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = after_days * 86_400_000

    def step(key, frames, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"claim": [key[0]], "last": pd.to_datetime([last], unit="ms", utc=True)})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["ms"].max()))
        if last + wait > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(last + wait)
        else:  # already overdue when it comes
            if state.exists:
                state.remove()
            yield pd.DataFrame({"claim": [key[0]], "last": pd.to_datetime([last], unit="ms", utc=True)})

    e = stream.where("logged_at IS NOT NULL").withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", lateness)
    e = e.select(F.regexp_extract("claim_id", "([0-9]+)", 1).alias("claim"), "at", F.unix_millis("at").alias("ms")).where("claim <> ''")
    return e.groupBy("claim").applyInPandasWithState(step, "claim string, last timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
