"""Pairs of codes of claims with many codes."""

import itertools
from collections import Counter

from ledgerloom.plans import registry


def test_claims_of_many_codes_count(spark, tmp_path):
    codes = {1: [f"c{i:02d}" for i in range(50)], 2: ["c01", "c02", "c60"], 3: ["c01"]}
    rows = [(c, p, code) for c, many in codes.items() for p, code in enumerate(many)] + [(2, 9, None), (2, 0, "c01")]
    spark.createDataFrame(rows, "claim_id bigint, pos int, code string").write.parquet(f"{tmp_path}/claim_items.parquet")
    got = {(r.first, r.second): r.claims for r in registry.queries()["r07_item_pairs"](spark, str(tmp_path)).collect()}
    assert got == Counter(p for many in codes.values() for p in itertools.combinations(many, 2))
