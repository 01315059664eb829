"""Exact quantiles of large groups without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(frame: DataFrame, group: str, value: str, fractions: dict[str, float], width: float = 1000.0) -> DataFrame:
    """(group, one DOUBLE column a fraction): interpolated quantiles of each group's values.

    Two passes: counts of cells of that width, combined before their shuffle, tell which cell holds a wanted rank; within
    those cells alone the distinct values are counted and ranked. What a task holds is one group's cells or one cell's
    distinct values, however many rows there are. Null values and null groups are left out; a group of one value has it
    for every fraction.
    """
    rows = frame.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g IS NOT NULL AND v IS NOT NULL").withColumn("cell", F.floor(F.col("v") / width))
    cells = rows.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("g")
    cells = cells.withColumns({"before": F.sum("n").over(whole.orderBy("cell")) - F.col("n"), "total": F.sum("n").over(whole)})
    place = {name: f * (F.col("total") - 1) for name, f in fractions.items()}
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(high).alias("high"), (F.ceil(p) if high else F.floor(p)).cast("bigint").alias("rank"), (p - F.floor(p)).alias("rest")) for name, p in place.items() for high in (False, True)])
    wanted = cells.select("g", "cell", F.col("before").alias("first"), "n", F.inline(ranks)).where("rank >= first AND rank < first + n").select("g", "cell", "name", "high", "rest", (F.col("rank") - F.col("first")).alias("k"))
    held = rows.join(wanted.select("g", "cell").distinct(), ["g", "cell"], "left_semi").groupBy("g", "cell", "v").agg(F.count(F.lit(1)).alias("m"))
    held = held.withColumn("up_to", F.sum("m").over(Window.partitionBy("g", "cell").orderBy("v")))
    met = held.join(wanted, ["g", "cell"]).where("k < up_to AND k >= up_to - m")
    side = lambda name, high: F.max(F.when((F.col("name") == name) & (F.col("high") == high), F.col("v")))
    rest = lambda name: F.max(F.when(F.col("name") == name, F.col("rest")))
    return met.groupBy(F.col("g").alias(group)).agg(*[(side(n, False) + (side(n, True) - side(n, False)) * rest(n)).alias(n) for n in fractions])
