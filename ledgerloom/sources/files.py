"""Reading files that others wrote: CSV, JSON, JSON lines in envelopes, texts of unknown encoding, folders of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A CSV folder or file with a header; what can't be cast is null, broken rows stand in _broken."""
    return spark.read.options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", multiLine="true", escape='"', **options).schema(f"{schema}, _broken STRING").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; the schema is stated where known, so that no pass over the data is spent on finding it."""
    reader = spark.read.options(mode="PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def documents_of(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, modified, bytes, content) of the files of a folder whose names match the pattern; content is read only if used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def newest(spark: SparkSession, path: str, pattern: str, n: int = 5) -> DataFrame:
    """The n files that changed last, newest first, ties by name: the top-k of a report list."""
    return documents_of(spark, path, pattern).drop("content").orderBy(F.col("modified").desc(), "path").limit(n)


def decoded(raw: Column) -> Column:
    """Text of bytes in an unknown encoding: a byte-order mark decides, then UTF-8 if it is valid, else Latin-1.

    Latin-1 gives every byte a sign, so no text is lost; null stays null and the mark itself is dropped.
    """
    head = F.hex(F.substring(raw, 1, 3))
    utf8 = raw.cast("string")
    return (
        F.when(head.startswith("EFBBBF"), F.decode(F.substring(raw, 4, 2_000_000_000), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(F.substring(raw, 3, 2_000_000_000), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substring(raw, 3, 2_000_000_000), "UTF-16BE"))
        .when(F.is_valid_utf8(utf8), utf8)
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def envelopes(lines: DataFrame, line: str = "value", kind: str = "RECORD") -> tuple[DataFrame, DataFrame]:
    """The rows inside JSON envelopes {"type": kind, "record": {"data": {"row": {...}}}} and, apart, counts of what isn't one.

    Rows: the other columns and row (VARIANT). Counts: (verdict, n), verdict being record, other type, no row or broken.
    """
    read = lines.withColumn("v", F.try_parse_json(line)).withColumn("row", F.try_variant_get("v", "$.record.data.row", "variant"))
    verdict = F.when(F.col("v").isNull(), "broken").when(~F.coalesce(F.try_variant_get("v", "$.type", "string") == kind, F.lit(False)), "other type").when(F.col("row").isNull(), "no row").otherwise("record")
    judged = read.withColumn("verdict", verdict)
    return judged.where("verdict = 'record'").drop("v", "verdict", line), judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
