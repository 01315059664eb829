"""Relational forms over the shared tables: joins of every kind, grouping sets, analytic windows, set differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.plans.book import AUDIT_SQL, CLAIMS_SQL, CODES_SQL, ITEMS_SQL, Book
from ledgerloom.plans.filters import claims
from ledgerloom.plans.metrics import audit, items
from ledgerloom.sources.tables import once, table

book = Book()


@book.add("g15_full_outer", f"WITH {CLAIMS_SQL}, a AS (SELECT hospital_name AS house, count(*)::BIGINT AS claims FROM claims WHERE hospital_name IS NOT NULL GROUP BY 1), b AS (SELECT provider_name AS house, round(sum(billed_amount), 2) AS billed FROM claims WHERE provider_name IS NOT NULL GROUP BY 1) SELECT coalesce(a.house, b.house) AS house, claims, billed FROM a FULL JOIN b ON a.house = b.house")
def _g15(s, d):
    """Both sides are aggregated before they meet, so a name of many claims is one row a side."""
    a = claims(s, d, "claim_id", "hospital_name", keep="hospital_name IS NOT NULL").groupBy(F.col("hospital_name").alias("house")).agg(F.count(F.lit(1)).alias("claims"))
    b = claims(s, d, "claim_id", "provider_name", "billed_amount", keep="provider_name IS NOT NULL").groupBy(F.col("provider_name").alias("house")).agg(F.round(F.sum("billed_amount"), 2).alias("billed"))
    return a.join(b, "house", "full_outer").select("house", "claims", "billed")


@book.add("g16_left_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _g16(s, d):
    large = table(s, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000").select("o_custkey")
    return table(s, d, "customer", "c_custkey", "c_name").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@book.add("g17_left_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _g17(s, d):
    return table(s, d, "customer", "c_custkey", "c_name").join(table(s, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@book.add("g18_cube", f"WITH {CLAIMS_SQL} SELECT insurance_company, room_type, grouping_id(insurance_company, room_type)::BIGINT AS level, count(*)::BIGINT AS claims, round(sum(billed_amount), 2) AS billed FROM claims GROUP BY CUBE (insurance_company, room_type)")
def _g18(s, d):
    c = claims(s, d, "claim_id", "insurance_company", "room_type", "billed_amount")
    return c.cube("insurance_company", "room_type").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("claims"), F.round(F.sum("billed_amount"), 2).alias("billed"))


@book.add("g19_grouping_sets", f"WITH {CLAIMS_SQL} SELECT insurance_company, room_type, count(*)::BIGINT AS claims FROM claims GROUP BY GROUPING SETS ((insurance_company), (room_type), ())")
def _g19(s, d):
    c = claims(s, d, "claim_id", "insurance_company", "room_type")
    return c.groupingSets([["insurance_company"], ["room_type"], []], "insurance_company", "room_type").agg(F.count(F.lit(1)).alias("claims"))


@book.add(
    "g20_analytic_windows",
    "SELECT o_orderkey, lead(o_totalprice) OVER w AS next_price, ntile(4) OVER w AS quarter, last_value(CASE WHEN o_totalprice > 150000 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_large, percent_rank() OVER w AS place"
    " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def _g20(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    large = F.last(F.when(F.col("o_totalprice") > 150000, F.col("o_orderkey")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return o.select("o_orderkey", F.lead("o_totalprice").over(w).alias("next_price"), F.ntile(4).over(w).alias("quarter"), large.alias("last_large"), F.percent_rank().over(w).alias("place"))


@book.add("g21_except_all", f"WITH {ITEMS_SQL} SELECT claim_id, code FROM items WHERE code IS NOT NULL EXCEPT ALL SELECT claim_id, code FROM items WHERE code IS NOT NULL AND quantity > 1")
def _g21(s, d):
    every = _lines(s, d, "code IS NOT NULL").select("claim_id", "code")
    return every.exceptAll(_lines(s, d, "code IS NOT NULL AND quantity > 1").select("claim_id", "code"))


@book.add("g22_intersect_all", f"WITH {ITEMS_SQL} SELECT claim_id, category FROM items WHERE amount > 10000 INTERSECT ALL SELECT claim_id, category FROM items WHERE quantity > 1")
def _g22(s, d):
    return _lines(s, d, "amount > 10000").select("claim_id", "category").intersectAll(_lines(s, d, "quantity > 1").select("claim_id", "category"))


def _lines(s, d, keep: str):
    """Item lines once each. Distinct over the columns read: a first() below EXCEPT ALL or INTERSECT ALL fails in Spark 4.1."""
    return table(s, d, "claim_items", "claim_id", "pos", "code", "category", "quantity", "amount").where(keep).distinct()


#: (word, least amount, label): a theta join's small side.
_WORDS = (("icu", 50000.0, "dear icu"), ("room", 30000.0, "dear room"), ("test", 5000.0, "dear test"), ("fee", 2000.0, "dear fee"))


@book.add("g23_theta_join", f"WITH {ITEMS_SQL}, r(word, least, label) AS (VALUES " + ", ".join(str(w) for w in _WORDS) + ") SELECT claim_id, pos, label FROM items JOIN r ON contains(lower(description), word) AND amount >= least")
def _g23(s, d):
    # The small side is four constants, so the nested loop is a broadcast one.
    r = s.createDataFrame(list(_WORDS), "word string, least double, label string")
    return items(s, d).join(F.broadcast(r), F.contains(F.lower("description"), F.col("word")) & (F.col("amount") >= F.col("least"))).select("claim_id", "pos", "label")


_RANGES = ((10004, 19499, "integumentary"), (20100, 29999, "musculoskeletal"), (30000, 32999, "respiratory"), (33016, 37799, "cardiovascular"), (40490, 49999, "digestive"), (70010, 79999, "imaging"), (80047, 89398, "laboratory"))


@book.add("g24_range_join", f"WITH {CODES_SQL}, r(lo, hi, area) AS (VALUES " + ", ".join(str(x) for x in _RANGES) + ") SELECT code_id, area FROM codes JOIN r ON TRY_CAST(code AS BIGINT) BETWEEN lo AND hi WHERE regexp_matches(code, '^[0-9]{5}$')")
def _g24(s, d):
    """Codes in ranges of any number: a range is listed under each block of a thousand it touches, so the join is on equality."""
    side = 1000
    r = s.createDataFrame(list(_RANGES), "lo bigint, hi bigint, area string").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / side), F.floor(F.col("hi") / side))))
    c = once(table(s, d, "claim_codes", "code_id", "code"), ["code_id"], F.col("code").rlike("^[0-9]{5}$")).withColumn("k", F.col("code").try_cast("bigint")).withColumn("block", F.floor(F.col("k") / side))
    return c.join(r, "block").where("k BETWEEN lo AND hi").select("code_id", "area")


@book.add("g25_as_of_join", f"WITH {CLAIMS_SQL}, {AUDIT_SQL}, a AS (SELECT TRY_CAST(regexp_extract(claim_id, '([0-9]+)', 1) AS BIGINT) AS k, logged_at, log_id FROM audit WHERE logged_at IS NOT NULL AND regexp_matches(claim_id, '[0-9]')), r AS (SELECT c.claim_id, a.log_id, row_number() OVER (PARTITION BY c.claim_id ORDER BY a.logged_at DESC NULLS LAST, a.log_id DESC) AS n FROM claims c LEFT JOIN a ON a.k = c.claim_id AND a.logged_at <= c.created_at + INTERVAL 30 DAY) SELECT claim_id, log_id FROM r WHERE n = 1")
def _g25(s, d):
    """The last event of a claim within 30 days of its creation: an as-of join of two tables without a join.

    Claims and events are one stream sorted by claim and time; a claim's row takes the last event before it. An event
    and a claim of the same instant meet, as events sort first.
    """
    c = claims(s, d, "claim_id", "created_at").select(F.col("claim_id").alias("k"), (F.col("created_at") + F.expr("INTERVAL 30 DAY")).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("log_id"))
    a = audit(s, d, keep="logged_at IS NOT NULL").where(F.col("claim_id").rlike("[0-9]"))
    a = a.select(F.regexp_extract("claim_id", "([0-9]+)", 1).try_cast("bigint").alias("k"), F.col("logged_at").alias("at"), F.lit(0).alias("side"), "log_id").where("k IS NOT NULL")
    last = F.last("log_id", ignorenulls=True).over(Window.partitionBy("k").orderBy("at", "side", "log_id").rowsBetween(Window.unboundedPreceding, 0))
    return c.unionByName(a).withColumn("last", last).where("side = 1").select(F.col("k").alias("claim_id"), F.col("last").alias("log_id"))


@book.add("g26_approximate_within_bound", "SELECT event_type, true AS within FROM (SELECT DISTINCT event_type FROM events)")
def _g26(s, d):
    """The approximate count of users holds its stated error of 5 percent (three times the deviation asked for)."""
    e = table(s, d, "events", "event_type", "user_id").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.0166).alias("about"), F.count_distinct("user_id").alias("exact"))
    return e.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))).alias("within"))


@book.add("g27_subqueries", f"WITH {CLAIMS_SQL}, m AS (SELECT insurance_company, avg(billed_amount) AS mean FROM claims GROUP BY 1) SELECT claim_id FROM claims c WHERE billed_amount > 2 * (SELECT mean FROM m WHERE m.insurance_company = c.insurance_company)")
def _g27(s, d):
    """A CTE and a correlated scalar subquery, in SQL over a frame given as an argument: no view is left in the session."""
    return s.sql(
        "WITH m AS (SELECT insurance_company, avg(billed_amount) AS mean FROM {c} GROUP BY 1) SELECT claim_id FROM {c} c WHERE billed_amount > 2 * (SELECT max(mean) FROM m WHERE m.insurance_company = c.insurance_company)",
        c=claims(s, d, "claim_id", "insurance_company", "billed_amount"),
    )


@book.add("g28_exact_quartiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS low, round(quantile_cont(o_totalprice, 0.5), 4) AS middle, round(quantile_cont(o_totalprice, 0.75), 4) AS high FROM orders GROUP BY 1")
def _g28(s, d):
    q = exact_quantiles(table(s, d, "orders", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", {"low": 0.25, "middle": 0.5, "high": 0.75})
    return q.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")])
