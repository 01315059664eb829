from collections import Counter
from datetime import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.llm import survivor as S

COLUMNS = "rec_id bigint, claim_id string, file_name string, extraction_method string, extracted_at timestamp_ntz, loaded_at timestamp_ntz, policy_number string, hospital_name string, patient_name string, dob string, admission_date string, discharge_date string, total_amount double, rank int"


def row(rec, file="7.json", method="tesseract", at=1, claim=None, policy=None, house=None, name=None, dob=None, adm=None, dis=None, amount=None):
    return (rec, claim, file, method, dt(2024, 1, at), dt(2024, 2, 1), policy, house, name, dob, adm, dis, amount, 1)


def found(spark, rows):
    methods = spark.createDataFrame([("manual_review", 1), ("pymupdf", 2), ("tesseract", 4)], "extraction_method string, trust_rank int")
    return {(r.claim_no, r.field_name): r.rec_id for r in S.survivors(spark.createDataFrame(rows, COLUMNS), methods).collect()}


def test_order_of_survivors(spark):
    rows = [
        row(1, "0007 (2)_x.json", "tesseract", 9, policy="SWP00000007", amount=10.0),
        row(2, "7.json", " Manual-Review", 1, policy="N/A", house="Eye Hospital", amount=-1.0),
        row(3, None, None, 20, claim="CL-007", policy="SWP00000007", house="Eye", amount=9270145120.0),
        row(4, "7.json", "PYMUPDF", 2, policy="SWP-00000007"),
        row(5, "7.json", "pymupdf", 2, policy="swp 00000007"),
        row(5, "7.json", "pymupdf", 2, policy="swp 00000007"),
        row(6, "8.json", policy="SWP00000008"), row(6, "8.json", policy="SWP00000008"),
        row(8, None, claim="ificate", policy="SWP00000009"), row(9, "x.json", claim="7", policy="SWP00000009"),
    ]
    assert found(spark, rows) == {(7, "policy_number"): 5, (7, "hospital_name"): 2, (7, "total_amount"): 1}


def test_impossible_values_are_none(spark):
    bad = [None, "", "  ", "-", ",", "18", "31.02.2024", "32/13/2024", "00/00/0000", "dd/mm/yyyy", "Unknown"]
    rows = [row(i, dob=v, name=n) for i, (v, n) in enumerate(zip(bad, ["to be filled by", "N/A", "null", "--", "entity", "Indicate if", None, "", " ", "Documents", "Unknown"]), 1)]
    assert found(spark, rows) == {} and found(spark, []) == {}
    assert found(spark, [*rows, row(90, dob="9-May-2023")]) == {(7, "dob"): 90}


def test_dates(spark):
    given = ["3.12.2023", "2023-12-3", "03-12-23", "3 December 2023", "3-Dec-2023", "3/12/2023"]
    frame = spark.createDataFrame([(x,) for x in given], "v string")
    assert {str(r[0]) for r in frame.select(S.iso_date(F.col("v"))).collect()} == {"2023-12-03"}


def test_fusion_discounts_copies(spark):
    """Two copiers share false values; an accurate source that stands alone wins in the end."""
    rows, rec = [], 0
    for c in range(1, 41):
        true, false = f"SWP{c:08d}", f"SWP9{c:07d}"
        for method, v in (("a", true), ("b", true), ("e", true), ("c", false if c % 2 else true), ("d", false if c % 2 else true)):
            rec += 1
            rows.append(row(rec, f"{c}.json", method, policy=v))
    for c in range(100, 110):
        for method, v in (("a", f"SWP{c:08d}"), ("c", f"SWP9{c:07d}"), ("d", f"SWP9{c:07d}")):
            rec += 1
            rows.append(row(rec, f"{c}.json", method, policy=v))
    got = {r.claim_no: (r.value, r.posterior) for r in S.fused(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(got[c][0] == f"SWP{c:08d}" for c in range(1, 41)) and all(got[c][0] == f"SWP{c:08d}" for c in range(100, 110))
    assert all(0 < p <= 1 for _, p in got.values())


def test_fused_values_name_the_latest_record_that_has_them(spark):
    """Against a planted truth: two sources are right 9 times in 10, a third 6 times in 10, a fourth copies the third."""
    import random

    draw, rows, truth, rec = random.Random(9), [], {}, 0
    for c in range(1, 301):
        truth[c] = f"SWP{c:08d}"
        says = lambda p: truth[c] if draw.random() < p else f"SWP{draw.randrange(10**7, 10**8)}"  # noqa: B023, E731
        third = says(0.6)
        for method, v in (("a", says(0.9)), ("b", says(0.9)), ("c", third), ("d", third if draw.random() < 0.95 else says(0.6))):
            rec += 1
            rows.append(row(rec, f"{c}.json", method, policy=v))
    got = {r.claim_no: r for r in S.fused(spark.createDataFrame(rows, COLUMNS)).collect()}
    right = sum(got[c].value == truth[c] for c in truth) / len(truth)
    votes = {}
    for r in rows:
        votes.setdefault(r[2].partition(".")[0], Counter())[r[6]] += 1
    majority = sum(max(sorted(v), key=v.get) == truth[int(c)] for c, v in votes.items()) / len(truth)
    assert right > 0.94 and right > majority + 0.03, (right, majority)
    policy = {r[0]: r[6] for r in rows}
    assert all(policy[got[c].rec_id] == got[c].value for c in truth)
