"""Overlaps of the boxes of claims with many boxes."""

import itertools

from ledgerloom.plans import registry


def test_every_box_is_held_against_its_page(spark, tmp_path):
    rows = [(c, p, 1 + p % 9, "x" * (p % 17)) for c, n in ((1, 200), (2, 5)) for p in range(1, n + 1)]
    spark.createDataFrame(rows, "claim_id bigint, pos int, quantity int, description string").write.parquet(f"{tmp_path}/claim_items.parquet")
    boxes = [(c, p, p * 7 % 60, p * 13 % 40, 10 + q % 20, 8 + len(t) % 12) for c, p, q, t in rows]
    want = {}
    for (c, p, x, y, w, h), (e, q, u, v, k, m) in itertools.combinations(boxes, 2):
        inter = max(0, min(x + w, u + k) - max(x, u)) * max(0, min(y + h, v + m) - max(y, v))
        if c == e and (p - 1) // 60 == (q - 1) // 60 and inter > 0.5 * min(w * h, k * m):
            want[c, p, q] = inter / min(w * h, k * m)
    got = {(r[0], r[1], r[2]): r[3] for r in registry.queries()["i03_page_overlaps"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and max(p for _, p, _ in want) > 120
