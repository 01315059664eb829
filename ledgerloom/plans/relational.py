"""Joins, windows, set operations, pivots, sources, sinks, corpora and box algebra over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.plans.book import AUDIT_SQL, CLAIMS_SQL, ITEMS_SQL, Book
from ledgerloom.plans.filters import claims
from ledgerloom.plans.metrics import audit, items
from ledgerloom.sources.tables import table

book = Book()


@book.add("g01_rollup", "SELECT r_name, n_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _g01(s, d):
    # nation and region have 25 and 5 rows by definition of the schema.
    j = table(s, d, "customer", "c_nationkey", "c_acctbal").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@book.add("g02_pivot_status", f"WITH {CLAIMS_SQL} SELECT insurance_company, " + ", ".join(f"count(*) FILTER (WHERE lower(trim(status)) = '{x}')::BIGINT AS {x}" for x in ("approved", "pending", "query", "rejected")) + " FROM claims GROUP BY 1")
def _g02(s, d):
    c = claims(s, d, "claim_id", "insurance_company", "status").withColumn("st", F.lower(F.trim("status")))
    return c.groupBy("insurance_company").pivot("st", ["approved", "pending", "query", "rejected"]).agg(F.count(F.lit(1))).na.fill(0)


@book.add("g03_unpivot", f"WITH {CLAIMS_SQL} SELECT claim_id, 'billed_amount' AS measure, billed_amount AS v FROM claims WHERE billed_amount IS NOT NULL UNION ALL SELECT claim_id, 'total_itemized', total_itemized FROM claims WHERE total_itemized IS NOT NULL UNION ALL SELECT claim_id, 'hospital_bill_total', hospital_bill_total FROM claims WHERE hospital_bill_total IS NOT NULL")
def _g03(s, d):
    return claims(s, d).unpivot("claim_id", ["billed_amount", "total_itemized", "hospital_bill_total"], "measure", "v").where("v IS NOT NULL")


@book.add("g04_as_of_previous_order", "SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS previous FROM orders")
def _g04(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


@book.add("g05_semi_and_anti", "SELECT c_custkey, true AS has_urgent FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _g05(s, d):
    c = table(s, d, "customer", "c_custkey")
    u = table(s, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    met = F.col("c_custkey") == F.col("o_custkey")
    return c.join(u, met, "left_semi").withColumn("has_urgent", F.lit(True)).unionByName(c.join(u, met, "left_anti").withColumn("has_urgent", F.lit(False)))


@book.add("g06_set_operations", "SELECT 'both' AS side, count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*)::BIGINT FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _g06(s, d):
    c, p = table(s, d, "customer", "c_nationkey"), table(s, d, "supplier", F.col("s_nationkey").alias("c_nationkey"))
    count = lambda f, side: f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(c.intersect(p), "both").unionByName(count(c.subtract(p), "customers only"))


@book.add("g07_moving_average", "WITH dy AS (SELECT CAST(ts AS DATE) AS day, count(*)::BIGINT AS n FROM events GROUP BY 1) SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS week_mean FROM dy")
def _g07(s, d):
    dy = table(s, d, "events", "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return dy.withColumn("week_mean", F.round(F.avg("n").over(Window.orderBy("day").rowsBetween(-6, 0)), 4))


@book.add("g08_median_by_category", f"WITH {ITEMS_SQL} SELECT category, round(median(amount), 4) AS middle, round(quantile_cont(amount, 0.9), 4) AS p90 FROM items WHERE category IS NOT NULL GROUP BY 1")
def _g08(s, d):
    q = exact_quantiles(items(s, d, keep="category IS NOT NULL"), "category", "amount", {"middle": 0.5, "p90": 0.9})
    return q.select("category", F.round("middle", 4).alias("middle"), F.round("p90", 4).alias("p90"))


@book.add("g09_approximate_distinct")
def _g09(s, d):
    return table(s, d, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@book.add("g10_json_details", f"WITH {AUDIT_SQL} SELECT log_id, json_extract_string(details, '$.from') AS old_status, json_extract_string(details, '$.to') AS new_status FROM audit WHERE details IS NOT NULL AND json_valid(details) AND json_extract_string(details, '$.to') IS NOT NULL")
def _g10(s, d):
    a = audit(s, d).withColumn("v", F.try_parse_json("details"))
    return a.select("log_id", F.try_variant_get("v", "$.from", "string").alias("old_status"), F.try_variant_get("v", "$.to", "string").alias("new_status")).where("new_status IS NOT NULL")


@book.add("g11_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _g11(s, d):
    li = table(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@book.add("g12_join_chain", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_custkey)::BIGINT AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _g12(s, d):
    # Line items are summed per order before the join, so the large side is shuffled once and small.
    li = table(s, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = li.join(table(s, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    c = o.join(table(s, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("customers"))
    return c.join(F.broadcast(table(s, d, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("customers").alias("customers"))


@book.add("g13_first_events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def _g13(s, d):
    return table(s, d, "events", "user_id", "event_type", "event_id", "ts").groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("b")).select("user_id", "b.event_type", "b.event_id")


@book.add("g14_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b, event_id FROM events), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM g) SELECT user_id, sess::BIGINT AS sess, count(*)::BIGINT AS n FROM k GROUP BY 1, 2")
def _g14(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events", "user_id", "ts", "event_id").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    b = F.when(F.col("t") - F.lag("t").over(w) <= 30 * 60 * 1_000_000, 0).otherwise(1)
    return e.withColumn("b", b).withColumn("sess", F.sum("b").over(w).cast("bigint")).groupBy("user_id", "sess").agg(F.count(F.lit(1)).alias("n"))


# --- sources and sinks -----------------------------------------------------------------------------------------


@book.add("s08_record_envelopes", "WITH r AS (SELECT DISTINCT * FROM raw_extractions) SELECT raw_id, json_extract_string(payload, '$.claim_id') AS claim_id, json_extract(payload, '$.fields') IS NOT NULL AS wrapped FROM r WHERE json_valid(payload)")
def _s08(s, d):
    r = table(s, d, "raw_extractions").dropDuplicates(["raw_id"]).withColumn("v", F.try_parse_json("payload")).where("v IS NOT NULL")
    return r.select("raw_id", F.try_variant_get("v", "$.claim_id", "string").alias("claim_id"), F.try_variant_get("v", "$.fields", "variant").isNotNull().alias("wrapped"))


@book.add("k01_claim_json", f"WITH {CLAIMS_SQL} SELECT claim_id, json_object('claim_id', claim_id, 'status', coalesce(status, 'Unknown'))::VARCHAR AS doc FROM claims")
def _k01(s, d):
    return claims(s, d, "claim_id", "status").select("claim_id", F.to_json(F.struct("claim_id", F.coalesce("status", F.lit("Unknown")).alias("status"))).alias("doc"))


@book.add("k02_last_write_wins", f"WITH {AUDIT_SQL}, r AS (SELECT regexp_extract(claim_id, '([0-9]+)', 1) AS k, log_id, lower(action_name) AS action, row_number() OVER (PARTITION BY regexp_extract(claim_id, '([0-9]+)', 1) ORDER BY logged_at DESC NULLS LAST, log_id DESC) AS n FROM audit WHERE regexp_matches(claim_id, '[0-9]')) SELECT k AS claim, log_id, action FROM r WHERE n = 1")
def _k02(s, d):
    a = audit(s, d, keep=F.col("claim_id").rlike("[0-9]")).withColumn("claim", F.regexp_extract("claim_id", "([0-9]+)", 1))
    return a.groupBy("claim").agg(F.max_by(F.struct("log_id", F.lower("action_name").alias("action")), F.struct("logged_at", "log_id")).alias("b")).select("claim", "b.log_id", "b.action")


@book.add("r16_status_history", f"WITH {AUDIT_SQL}, h AS (SELECT regexp_extract(claim_id, '([0-9]+)', 1) AS claim, logged_at, log_id, json_extract_string(details, '$.to') AS new_status FROM audit WHERE json_valid(details) AND regexp_matches(claim_id, '[0-9]')) SELECT claim, new_status, row_number() OVER (PARTITION BY claim ORDER BY logged_at, log_id)::INTEGER AS step FROM h WHERE new_status IS NOT NULL")
def _r16(s, d):
    a = audit(s, d, keep=F.col("claim_id").rlike("[0-9]")).withColumn("new_status", F.try_variant_get(F.try_parse_json("details"), "$.to", "string")).where("new_status IS NOT NULL")
    a = a.withColumn("claim", F.regexp_extract("claim_id", "([0-9]+)", 1))
    return a.select("claim", "new_status", F.row_number().over(Window.partitionBy("claim").orderBy("logged_at", "log_id")).alias("step"))


@book.add("r17_overdue", f"WITH {AUDIT_SQL}, t AS (SELECT max(logged_at) AS as_of FROM audit) SELECT log_id, date_diff('second', logged_at, as_of) > 30 * 24 * 3600 AS overdue FROM audit, t WHERE logged_at IS NOT NULL")
def _r17(s, d):
    a = audit(s, d, keep="logged_at IS NOT NULL")
    as_of = a.agg(F.max("logged_at").alias("as_of"))
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return a.join(F.broadcast(as_of)).select("log_id", (sec("as_of") - sec("logged_at") > 30 * 24 * 3600).alias("overdue"))


# --- corpora ---------------------------------------------------------------------------------------------------


@book.add("t01_example_ids", "WITH u AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'doc_' || substr(md5(text), 1, 12) AS example_id FROM u")
def _t01(s, d):
    return table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").distinct().select("doc_id", F.concat(F.lit("doc_"), F.substring(F.md5("text"), 1, 12)).alias("example_id"))


@book.add("t02_corpus_counts", "SELECT task, count(*)::BIGINT AS n FROM (SELECT 'text' AS task FROM (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL) UNION ALL SELECT 'scan' FROM (SELECT DISTINCT scan_id FROM scan_texts WHERE raw_text_preview IS NOT NULL) UNION ALL SELECT 'code' FROM (SELECT DISTINCT code_id FROM claim_codes WHERE context IS NOT NULL)) GROUP BY 1")
def _t02(s, d):
    part = lambda t, k, c, task: table(s, d, t, k, c).where(f"{c} IS NOT NULL").select(F.col(k).alias("id"), F.lit(task).alias("task"), F.lit(1).alias(f"has_{task}")).distinct()
    u = part("documents", "doc_id", "text", "text").unionByName(part("scan_texts", "scan_id", "raw_text_preview", "scan"), allowMissingColumns=True).unionByName(part("claim_codes", "code_id", "context", "code"), allowMissingColumns=True)
    return u.groupBy("task").agg(F.count(F.lit(1)).alias("n"))


_REMAP = {"Room": "B-ROOM", "ICU": "B-ROOM", "Pharmacy": "B-DRUG", "Laboratory": "B-LAB"}


@book.add("t03_tag_remap", f"WITH {ITEMS_SQL} SELECT claim_id, pos, CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REMAP.items()) + " ELSE coalesce(category, 'O') END AS tag FROM items")
def _t03(s, d):
    m = F.create_map(*[F.lit(x) for kv in _REMAP.items() for x in kv])
    return items(s, d).select("claim_id", "pos", F.coalesce(F.try_element_at(m, F.col("category")), "category", F.lit("O")).alias("tag"))


@book.add("t04_ordered_split", "WITH u AS (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM u) SELECT doc_id, CASE WHEN k <= floor(0.9 * n) THEN 'train' ELSE 'val' END AS part FROM r")
def _t04(s, d):
    # Rank within slices of the id range and add the slices' offsets: a language of a third of all rows isn't sorted in one task.
    u = table(s, d, "documents", "doc_id", "lang").where("lang IS NOT NULL").distinct().withColumn("slice", F.floor(F.col("doc_id") / 100_000))
    sizes = u.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lang").orderBy("slice")
    offsets = sizes.select("lang", "slice", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("lang")).alias("n"))
    r = u.withColumn("k0", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("doc_id"))).join(offsets, ["lang", "slice"])
    return r.select("doc_id", F.when(F.col("k0") + F.col("before") <= F.floor(0.9 * F.col("n")), "train").otherwise("val").alias("part"))


@book.add("t05_seeded_noise")
def _t05(s, d):
    """Characters dropped or doubled by a hash of (document, position, seed): the same noise on every run and cluster."""
    w = table(s, d, "claim_items", "claim_id", "pos", "description").where("description IS NOT NULL").distinct()
    chars = F.transform(F.split("description", ""), lambda c, i: F.when(F.pmod(F.xxhash64("claim_id", "pos", i, F.lit(17)), F.lit(50)) == 0, F.lit("")).when(F.pmod(F.xxhash64("claim_id", "pos", i, F.lit(18)), F.lit(50)) == 0, F.concat(c, c)).otherwise(c))
    return w.select("claim_id", "pos", F.array_join(chars, "").alias("noisy"))


@book.add("t06_label_preserving_split", f"WITH {ITEMS_SQL}, w0 AS (SELECT claim_id, pos, string_split(description, ' ') AS a FROM items WHERE description IS NOT NULL), w AS (SELECT claim_id, pos, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM w0) SELECT claim_id, pos, sum(CASE WHEN length(t) > 8 THEN 2 ELSE 1 END)::BIGINT AS tokens, sum(CASE WHEN length(t) > 8 THEN 1 ELSE 0 END)::BIGINT AS continued FROM w GROUP BY 1, 2")
def _t06(s, d):
    """Long words are split in two; the second half continues the label of the first."""
    a = F.split("description", " ")
    parts = F.flatten(F.transform(a, lambda t: F.when(F.length(t) > 8, F.array(F.lit("B"), F.lit("I"))).otherwise(F.array(F.lit("B")))))
    return items(s, d, keep="description IS NOT NULL").select("claim_id", "pos", F.size(parts).cast("bigint").alias("tokens"), F.size(F.filter(parts, lambda p: p == "I")).cast("bigint").alias("continued"))


_IDS = {"B-ROOM": 1, "B-DRUG": 2, "B-LAB": 3}


@book.add("t08_label_ids", f"WITH {ITEMS_SQL} SELECT claim_id, pos, CASE CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REMAP.items()) + " END " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _IDS.items()) + " ELSE 0 END::INTEGER AS label FROM items")
def _t08(s, d):
    m = F.create_map(*[F.lit(x) for kv in _IDS.items() for x in kv])
    return _t03(s, d).select("claim_id", "pos", F.coalesce(F.try_element_at(m, F.col("tag")), F.lit(0)).alias("label"))


@book.add(
    "i03_page_overlaps",
    f"WITH {ITEMS_SQL}, b AS (SELECT claim_id, pos, greatest(0, (pos - 1) // 60) AS page, (pos * 7) % 60 AS x, (pos * 13) % 40 AS y, 10 + coalesce(quantity, 1) % 20 AS w, 8 + length(coalesce(description, '')) % 12 AS h FROM items),"
    " p AS (SELECT a.claim_id, a.pos AS first, c.pos AS second, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS inter, least(a.w * a.h, c.w * c.h) AS area"
    " FROM b a JOIN b c ON a.claim_id = c.claim_id AND a.page = c.page AND a.pos < c.pos) SELECT claim_id, first, second, round(inter / area::DOUBLE, 6) AS ratio FROM p WHERE inter > 0.5 * area",
)
def _i03_pages(s, d):
    """The overlaps among all boxes of a claim, 60 boxes a page."""
    return _overlaps(_boxes(items(s, d)))


def _boxes(i):
    # No box is taller than 19, so 64 rows a page keep pages apart.
    page = F.greatest(F.lit(0), F.floor((F.col("pos") - 1) / 60))
    return i.select("claim_id", "pos", ((F.col("pos") * 7) % 60).alias("x"), ((F.col("pos") * 13) % 40 + 64 * page).alias("y"), (10 + F.coalesce("quantity", F.lit(1)) % 20).alias("w"), (8 + F.length(F.coalesce("description", F.lit(""))) % 12).alias("h"))


def _overlaps(b):
    """Boxes that overlap by more than half of the smaller one, found over the cells of a grid.

    A pair is reported in the cell of its upper left common corner only, so it comes out once; a claim with many boxes
    is spread over its cells.
    """
    side = 16
    span = lambda at, size: F.sequence(F.floor(F.col(at) / side), F.floor((F.col(at) + F.col(size) - 1) / side))
    cells = b.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    a, c = cells.select(*[F.col(n).alias(f"a_{n}") for n in ("pos", "x", "y", "w", "h")], "claim_id", "cx", "cy"), cells.select(*[F.col(n).alias(f"c_{n}") for n in ("pos", "x", "y", "w", "h")], "claim_id", "cx", "cy")
    p = a.join(c, ["claim_id", "cx", "cy"]).where("a_pos < c_pos")
    left, top = F.greatest("a_x", "c_x"), F.greatest("a_y", "c_y")
    inter = F.greatest(F.lit(0), F.least(F.expr("a_x + a_w"), F.expr("c_x + c_w")) - left) * F.greatest(F.lit(0), F.least(F.expr("a_y + a_h"), F.expr("c_y + c_h")) - top)
    area = F.least(F.expr("a_w * a_h"), F.expr("c_w * c_h"))
    p = p.where((F.floor(left / side) == F.col("cx")) & (F.floor(top / side) == F.col("cy"))).withColumns({"inter": inter, "area": area}).where("inter > 0.5 * area")
    return p.select("claim_id", F.col("a_pos").alias("first"), F.col("c_pos").alias("second"), F.round(F.col("inter") / F.col("area"), 6).alias("ratio"))


@book.add("i05_checkbox_state", f"WITH {ITEMS_SQL} SELECT claim_id, pos, CASE WHEN confidence >= 0.7 THEN 'checked' WHEN confidence >= 0.4 THEN 'unclear' WHEN confidence IS NULL THEN 'missing' ELSE 'empty' END AS state FROM items")
def _i05(s, d):
    c = F.col("confidence")
    return items(s, d).select("claim_id", "pos", F.when(c >= 0.7, "checked").when(c >= 0.4, "unclear").when(c.isNull(), "missing").otherwise("empty").alias("state"))


#: Sentence forms of generated examples; {0} is a house, {1} an amount.
_FORMS = ("The patient was admitted to {0} .", "{0} billed Rs. {1} .", "Receipt of Rs. {1} from {0} is attached .")


@book.add(
    "t07_generated_examples",
    f"WITH {CLAIMS_SQL}, f(k, form) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_FORMS)) + "), c AS (SELECT claim_id, trim(regexp_replace(hospital_name, '\\s+', ' ', 'g')) AS house, CAST(floor(billed_amount) AS BIGINT) AS amount, unnest([0, 1]) AS copy FROM claims WHERE hospital_name IS NOT NULL AND billed_amount IS NOT NULL)"
    " SELECT claim_id, copy, replace(replace(form, '{0}', house), '{1}', CAST(amount AS VARCHAR)) AS text, (length(house) - length(replace(house, ' ', '')) + 1)::INTEGER AS entity_words FROM c JOIN f ON k = (claim_id + copy) % 3",
)
def _t07(s, d):
    """Two labelled examples a claim from sentence forms: a form is picked by the id, so every run gives the same."""
    c = claims(s, d, "claim_id", "hospital_name", "billed_amount", keep="hospital_name IS NOT NULL AND billed_amount IS NOT NULL")
    house = F.trim(F.regexp_replace("hospital_name", r"\s+", " "))
    c = c.select("claim_id", house.alias("house"), F.floor("billed_amount").cast("bigint").cast("string").alias("amount"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    form = F.element_at(F.array(*[F.lit(t) for t in _FORMS]), (F.pmod(F.col("claim_id") + F.col("copy"), F.lit(3)) + 1).cast("int"))
    return c.select("claim_id", "copy", F.replace(F.replace(form, F.lit("{0}"), F.col("house")), F.lit("{1}"), F.col("amount")).alias("text"), F.size(F.split("house", " ")).alias("entity_words"))


@book.add("g29_registered_rules", f"WITH {CLAIMS_SQL} SELECT 'dear' AS rule, count(*) FILTER (WHERE billed_amount > 100000)::BIGINT AS claims FROM claims UNION ALL SELECT 'no diagnosis', count(*) FILTER (WHERE diagnosis IS NULL)::BIGINT FROM claims")
def _g29(s, d):
    """A registry of rules, name to function of a frame, is how others add operators; here two, counted in one pass each."""
    registry = {"dear": lambda f: f.where("billed_amount > 100000"), "no diagnosis": lambda f: f.where("diagnosis IS NULL")}
    c = claims(s, d, "claim_id", "billed_amount", "diagnosis")
    parts = [rule(c).agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("claims")) for name, rule in registry.items()]
    return parts[0].unionByName(parts[1])
