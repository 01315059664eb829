import json

from ledgerloom.operators import drift


def frame(spark, rows):
    return spark.createDataFrame([(i, f, n, p if isinstance(p, str) or p is None else json.dumps(p)) for i, (f, n, p) in enumerate(rows)], "raw_id bigint, feed_id bigint, file_no int, payload string")


def changes(spark, rows):
    return {tuple(r) for r in drift.schema_changes(frame(spark, rows)).select("feed_id", "file_no", "field_name", "change_kind").collect()}


def test_kinds_of_change(spark):
    rows = [
        (1, 1, {"claim_id": "1", "fields": {"dob": "01.02.1990", "room": "ICU", "sum": 5, "old": "x"}}),
        (1, 1, {"claim_id": "2", "fields": {"dob": "03.04.1991", "room": "General", "sum": 7.5}}),
        (1, 2, {"claim_id": "1", "birth": "1990-02-01", "room": ["ICU"], "sum": 9, "new": True}),
        (1, 2, {"claim_id": "2", "birth": [1991, 4, 3], "room": ["General"], "sum": None}),
        (1, 2, '{"claim_id": "9", "cut": "off'),
        (1, 2, None),
        (1, 2, "[1, 2]"),
    ]
    assert changes(spark, rows) == {(1, 2, "birth", "renamed"), (1, 2, "room", "retyped"), (1, 2, "new", "added"), (1, 2, "old", "removed")}


def test_whole_and_fractional_numbers_are_one_type_and_repeats_count_once(spark):
    rows = [(1, 1, {"claim_id": "1", "a": 1}), (1, 3, {"claim_id": "1", "a": 1.5}), (1, 3, {"claim_id": "1", "a": 1.5}), (2, 1, {"claim_id": "1", "b": 1})]
    assert changes(spark, rows) == set()


def test_a_name_that_comes_without_equal_facts_is_added(spark):
    rows = [(1, 1, {"claim_id": "1", "a": "x"}), (1, 2, {"claim_id": "1", "b": "y"})]
    assert changes(spark, rows) == {(1, 2, "b", "added"), (1, 2, "a", "removed")}


def test_empty_and_broken_input(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, 1, ""), (1, 2, "{")]) == set()


def test_unified_cells_report_failed_casts(spark):
    rows = [(1, 1, {"claim_id": "1", "sum": 5}), (1, 1, {"claim_id": "2", "sum": "1,200.50"}), (1, 1, {"claim_id": "3", "sum": "n/a"}), (1, 1, {"claim_id": "4", "sum": 7})]
    got = {r.claim_id: (r.value_number, r.cast_failed) for r in drift.unified_cells(frame(spark, rows)).collect()}
    assert got == {"1": (5.0, False), "2": (1200.5, False), "3": (None, True), "4": (7.0, False)}
    table = {r.claim_id: (r.cells, r.failed_casts) for r in drift.consistent_table(frame(spark, rows)).collect()}
    assert table["3"] == ({}, 1) and table["1"] == ({"sum": "5.0"}, 0)


def test_extra_columns_do_not_matter(spark):
    extra = frame(spark, [(1, 1, {"claim_id": "1", "a": 1}), (1, 2, {"claim_id": "1", "c": "z"})]).selectExpr("*", "1 AS v", "'x' AS field_name", "2 AS before")
    assert {r.field_name for r in drift.schema_changes(extra).collect()} == {"a", "c"}


def test_typed_columns_and_the_report_of_failed_casts(spark):
    big = 123456789012345678
    rows = [
        (1, 1, {"claim_id": "1", "policyNo": big, "seen": "01.02.2024", "ok": True, "name": "A B"}),
        (1, 1, {"claim_id": None, "policy_no": big + 1, "policyNo": big + 2, "seen": "soon", "ok": "no"}),
        (1, 1, {"claim_id": None, "policy_no": 5, "raw_id": "x"}),
        (1, 1, {"claim_id": "1", "policy_no": 6}),
        (1, 1, None),
    ]
    cells = drift.unified_cells(frame(spark, rows))
    table = drift.typed_table(frame(spark, rows), cells)
    kinds = dict(table.dtypes)
    name = "policy_no" if "policy_no" in kinds else "policyNo"
    assert (kinds[name], kinds["seen"], kinds["ok"], kinds["name"], kinds["field_raw_id"]) == ("bigint", "date", "boolean", "string", "string")
    got = {r.raw_id: r for r in table.collect()}
    assert len(got) == 4 and got[0][name] == big and got[0].seen.isoformat() == "2024-02-01" and got[0].ok is True and got[1].ok is False
    assert got[1][name] == (big + 1 if name == "policy_no" else big + 2) and got[1].failed_casts == 1 and got[2].claim_id is None
    report = {(r.field_name, r.json_type): (r.cells, r.failed, r.example) for r in drift.cast_report(cells).collect()}
    assert report["seen", "string"] == (2, 1, "soon")
    assert drift.typed_table(frame(spark, [])).collect() == []
