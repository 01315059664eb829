"""What reaches the scan, and what a stream does with late rows."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import registry
from ledgerloom.sources import files
from ledgerloom.streaming import audit as S
from tests.conftest import SMALL


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["f02_date_range", "f03_id_contains", "f04_status_words", "f05_in_list", "f06_drill_down", "f10_code_filter", "k07_search"])
def test_filters_reach_the_scan(spark, name):
    text = plan(registry.queries()[name](spark, SMALL))
    assert "PushedFilters: [Is" in text and "DataFilters: [is" in text


def test_only_the_columns_asked_for_are_read(spark):
    text = plan(registry.queries()["k07_search"](spark, SMALL))
    schema = text.rpartition("ReadSchema: struct<")[2].partition(">")[0]
    assert {c.partition(":")[0] for c in schema.split(",")} == {"claim_id", "status", "billed_amount", "hospital_name"}


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    at = lambda day, hour=12: datetime.datetime(2024, 1, day, hour)
    for i, (rows, when) in enumerate((([(1, "a", at(1)), (2, "a", at(9))], 1), ([(4, "a", at(9, 13))], 2), ([(3, "a", at(2))], 3), ([(5, "a", at(20))], 4))):
        spark.createDataFrame(rows, "log_id bigint, action_name string, logged_at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/f{i}.parquet")
        for name in os.listdir(f"{tmp_path}/in/f{i}.parquet"):
            os.utime(f"{tmp_path}/in/f{i}.parquet/{name}", (when * 1000, when * 1000))
    schema = spark.read.parquet(f"{tmp_path}/in/f0.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(r.day.day, r.n) for r in S.replayed(S.closed_days(stream)).collect()}
    assert got == {(1, 1), (9, 2)}  # the row of the 2nd came when the watermark of a finished batch stood on the 9th


def test_bytes_of_unknown_encoding(spark):
    raw = {"plain": b"abc", "utf8": "₹ é".encode(), "mark": b"\xef\xbb\xbfx", "wide": "₹x".encode("utf-16"), "latin": "café".encode("latin-1"), "empty": b"", "null": None}
    frame = spark.createDataFrame(list(raw.items()), "k string, raw binary").select("k", files.decoded(F.col("raw")).alias("t"))
    assert {r.k: r.t for r in frame.collect()} == {"plain": "abc", "utf8": "₹ é", "mark": "x", "wide": "₹x", "latin": "café", "empty": "", "null": None}


def test_broken_rows_of_a_csv_are_told(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two, three"\nfour,5\n6,"line\nbreak"\n')
    rows = files.read_csv(spark, str(tmp_path), "a INT, b STRING").collect()
    assert sorted((r.a or 0, r.b, r._broken is None) for r in rows) == [(0, "5", False), (1, "two, three", True), (6, "line\nbreak", True)]
