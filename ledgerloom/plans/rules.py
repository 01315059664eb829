"""Set-based rules and scores: every item rule is a conditional aggregate of one grouping, never a join per rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.plans.book import CLAIMS_SQL, CODES_SQL, ITEMS_SQL, Book
from ledgerloom.plans.extraction import codes
from ledgerloom.plans.filters import claims
from ledgerloom.plans.metrics import items
from ledgerloom.sources.tables import spread, table

book = Book()

#: Thresholds of the rules; both engines read them from here.
PARAMS = {"gap": 0.2, "high_claim": 100000.0, "high_line": 50000.0, "many_items": 12, "near": 50.0}
P = PARAMS

_AGG_SQL = f"""agg AS (SELECT claim_id, sum(amount) AS itemised, count(*) AS n, count(*) FILTER (WHERE amount > {P['high_line']}) AS high_lines,
 count(*) FILTER (WHERE regexp_matches(lower(description), 'total')) AS totals, (count(*) - count(DISTINCT (lower(trim(description)), amount))) AS repeats FROM items GROUP BY 1)"""


def item_facts(i):
    """One shuffle on claim_id; the collective claim is pre-aggregated before it."""
    line = i.groupBy("claim_id", F.lower(F.trim("description")).alias("t"), "amount").agg(F.count(F.lit(1)).alias("k"))
    return line.groupBy("claim_id").agg(
        F.sum(F.col("amount") * F.col("k")).alias("itemised"),
        F.sum("k").alias("n"),
        F.sum(F.when(F.col("amount") > P["high_line"], F.col("k")).otherwise(0)).alias("high_lines"),
        F.sum(F.when(F.col("t").rlike("total"), F.col("k")).otherwise(0)).alias("totals"),
        (F.sum("k") - F.count(F.lit(1))).alias("repeats"),
    )


_BILLING_SQL = f"""WITH {CLAIMS_SQL}, {ITEMS_SQL}, {_AGG_SQL},
 f AS (SELECT claim_id, coalesce(billed_amount, 0) AS billed, coalesce(itemised, 0) AS itemised, coalesce(n, 0) AS n, coalesce(high_lines, 0) AS high_lines, coalesce(repeats, 0) AS repeats FROM claims LEFT JOIN agg USING (claim_id)),
 g AS (SELECT *, (billed > 0 AND itemised > 0 AND round(abs(itemised - billed) / greatest(billed, 1), 9) > {P['gap']})::INTEGER AS gap, (round(greatest(billed, itemised), 2) > {P['high_claim']})::INTEGER AS high, (n > {P['many_items']})::INTEGER AS many, (repeats > 0)::INTEGER AS dup FROM f),
 h AS (SELECT *, gap + high + high_lines + many + dup AS flags FROM g),
 billing AS (SELECT claim_id, gap, high, high_lines, many, dup, flags, round(least(1, CASE WHEN billed > 0 OR n > 0 THEN 0.3 ELSE 0.1 END + 0.15 * flags), 6) AS confidence FROM h)"""


def billing(s, d):
    c = claims(s, d, "claim_id", "billed_amount").join(item_facts(items(s, d)), "claim_id", "left").na.fill(0)
    f = c.select(
        "claim_id",
        ((F.col("billed_amount") > 0) & (F.col("itemised") > 0) & (F.round(F.abs(F.col("itemised") - F.col("billed_amount")) / F.greatest("billed_amount", F.lit(1.0)), 9) > P["gap"])).cast("int").alias("gap"),
        (F.round(F.greatest("billed_amount", "itemised"), 2) > P["high_claim"]).cast("int").alias("high"),
        F.col("high_lines"),
        (F.col("n") > P["many_items"]).cast("int").alias("many"),
        (F.col("repeats") > 0).cast("int").alias("dup"),
        ((F.col("billed_amount") > 0) | (F.col("n") > 0)).alias("any"),
    )
    f = f.withColumn("flags", F.col("gap") + F.col("high") + F.col("high_lines") + F.col("many") + F.col("dup"))
    return f.withColumn("confidence", F.round(F.least(F.lit(1.0), F.when(F.col("any"), 0.3).otherwise(0.1) + 0.15 * F.col("flags")), 6)).drop("any")


@book.add("r01_billing_flags", _BILLING_SQL + " SELECT claim_id, gap, high, high_lines::BIGINT AS high_lines, many, dup, flags::BIGINT AS flags, confidence::DOUBLE AS confidence FROM billing")
def _r01(s, d):
    return billing(s, d)


def level(flags, confidence):
    s = F.round(flags * confidence, 6)
    return F.when(s >= 3, "CRITICAL").when(s >= 2, "HIGH").when(s >= 1, "MEDIUM").otherwise("LOW")


_LEVEL = "CASE WHEN round(flags * confidence, 6) >= 3 THEN 'CRITICAL' WHEN round(flags * confidence, 6) >= 2 THEN 'HIGH' WHEN round(flags * confidence, 6) >= 1 THEN 'MEDIUM' ELSE 'LOW' END"


@book.add("r00_risk_level", _BILLING_SQL + f" SELECT claim_id, {_LEVEL} AS risk FROM billing")
def _r00(s, d):
    return billing(s, d).select("claim_id", level(F.col("flags"), F.col("confidence")).alias("risk"))


@book.add("r022_code_spread", f"WITH {CODES_SQL} SELECT claim_id, count(*)::BIGINT AS codes, count(DISTINCT category)::BIGINT AS categories, count(*) >= 3 AND count(DISTINCT category) > 2 AS flagged FROM codes GROUP BY 1")
def _r022(s, d):
    g = codes(s, d).groupBy("claim_id", "category").agg(F.count(F.lit(1)).alias("k")).groupBy("claim_id").agg(F.sum("k").alias("codes"), F.count("category").alias("categories"))
    return g.withColumn("flagged", (F.col("codes") >= 3) & (F.col("categories") > 2))


@book.add("r025_history", f"WITH {CLAIMS_SQL}, o AS (SELECT claim_id, member_id, diagnosis, lag(diagnosis) OVER (PARTITION BY member_id ORDER BY date_of_service, claim_id) AS before FROM claims WHERE member_id IS NOT NULL AND date_of_service IS NOT NULL) SELECT claim_id, before, before IS NOT NULL AND diagnosis IS NOT NULL AND before <> diagnosis AS differs FROM o")
def _r025(s, d):
    c = claims(s, d, keep="member_id IS NOT NULL AND date_of_service IS NOT NULL")
    before = F.lag("diagnosis").over(Window.partitionBy("member_id").orderBy("date_of_service", "claim_id"))
    return c.select("claim_id", before.alias("before"), "diagnosis").select("claim_id", "before", F.coalesce(F.col("before") != F.col("diagnosis"), F.lit(False)).alias("differs"))


@book.add("r032_near_duplicates", f"WITH {ITEMS_SQL}, p AS (SELECT claim_id, pos, amount, lag(amount) OVER (PARTITION BY claim_id, lower(trim(description)) ORDER BY pos) AS before FROM items WHERE description IS NOT NULL) SELECT claim_id, pos, round(amount - before, 2) AS delta FROM p WHERE before IS NOT NULL AND round(abs(amount - before), 6) < {P['near']}")
def _r032(s, d):
    # The collective claim is parted by description as well, so no task holds all its items.
    before = F.lag("amount").over(Window.partitionBy("claim_id", F.lower(F.trim("description"))).orderBy("pos"))
    p = items(s, d, keep="description IS NOT NULL").select("claim_id", "pos", "amount", before.alias("before"))
    return p.where(F.round(F.abs(F.col("amount") - F.col("before")), 6) < P["near"]).select("claim_id", "pos", F.round(F.col("amount") - F.col("before"), 2).alias("delta"))


_ID_FLAGS = (
    ("missing_name", "claimant_name IS NULL"), ("short_name", "length(trim(claimant_name)) < 3"), ("figures_in_name", "{rx}(claimant_name, '[0-9]')"), ("missing_dob", "dob IS NULL"),
    ("bad_dob", "dob > date_of_service OR dob < DATE '1900-01-01'"), ("missing_policy", "policy_number IS NULL"), ("missing_provider", "provider_name IS NULL AND hospital_name IS NULL"),
)


@book.add("r04_identity_flags", f"WITH {CLAIMS_SQL} SELECT claim_id, " + ", ".join(f"coalesce({e.replace('{rx}', 'regexp_matches')}, false)::INTEGER AS {n}" for n, e in _ID_FLAGS) + " FROM claims")
def _r04(s, d):
    return claims(s, d).select("claim_id", *[F.coalesce(F.expr(e.replace("{rx}", "regexp_like")), F.lit(False)).cast("int").alias(n) for n, e in _ID_FLAGS])


@book.add(
    "r08_identity_vote",
    "WITH m AS (SELECT DISTINCT * FROM identity_sources), v AS (SELECT claim_id, trim(regexp_replace(regexp_replace(lower(full_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS v, source_order, mention_id FROM m WHERE full_name IS NOT NULL AND claim_id IS NOT NULL), g AS (SELECT claim_id, v, count(*)::BIGINT AS n, min(source_order) AS o, min(mention_id) AS i FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, o NULLS LAST, i) AS k, count(*) OVER (PARTITION BY claim_id) AS spellings FROM g) SELECT claim_id, v AS name, n, spellings > 1 AS mismatch FROM r WHERE k = 1",
)
def _r08(s, d):
    from ledgerloom.functions import text as T

    m = table(s, d, "identity_sources").dropDuplicates(["mention_id"]).where("full_name IS NOT NULL AND claim_id IS NOT NULL")
    g = m.groupBy("claim_id", T.identity_name(F.col("full_name")).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("source_order").alias("o"), F.min("mention_id").alias("i"))
    best = g.groupBy("claim_id").agg(F.max_by(F.struct("v", "n"), F.struct("n", -F.coalesce("o", F.lit(2**30)), -F.col("i"))).alias("b"), F.count(F.lit(1)).alias("spellings"))
    return best.select("claim_id", F.col("b.v").alias("name"), "b.n", (F.col("spellings") > 1).alias("mismatch"))


_TYPE_SQL = "CASE WHEN list_contains(coalesce(procedure_list, []), 'angioplasty') OR list_contains(coalesce(procedure_list, []), 'knee replacement') THEN 'surgical' WHEN regexp_matches(lower(coalesce(diagnosis, '')), 'acute|fracture') THEN 'emergency' WHEN regexp_matches(lower(coalesce(hospital_name, '')), 'diag') THEN 'imaging' ELSE 'office_visit' END"


def claim_type():
    has = lambda p: F.coalesce(F.array_contains("procedure_list", p), F.lit(False))
    return F.when(has("angioplasty") | has("knee replacement"), "surgical").when(F.lower(F.coalesce("diagnosis", F.lit(""))).rlike("acute|fracture"), "emergency").when(F.lower(F.coalesce("hospital_name", F.lit(""))).rlike("diag"), "imaging").otherwise("office_visit")


@book.add("r10_claim_type", f"WITH {CLAIMS_SQL} SELECT claim_id, {_TYPE_SQL} AS kind FROM claims")
def _r10(s, d):
    return claims(s, d).select("claim_id", claim_type().alias("kind"))


WEIGHTS = {"surgical": (0.3, 0.3, 0.25, 0.15), "emergency": (0.35, 0.3, 0.15, 0.2), "imaging": (0.4, 0.25, 0.2, 0.15), "office_visit": (0.35, 0.2, 0.2, 0.25)}
_W_SQL = "w(kind, a, b, c, e) AS (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in WEIGHTS.items()) + ")"
_WEIGHT_SQL = f"""WITH {CLAIMS_SQL}, {_W_SQL}, k AS (SELECT claim_id, {_TYPE_SQL} AS kind, coalesce(billed_amount, 0) AS amount, coalesce(patient_age, 50) AS age FROM claims),
 x AS (SELECT claim_id, kind, a * CASE WHEN amount > 100000 THEN 1.5 WHEN amount > 50000 THEN 1.25 WHEN amount < 1000 THEN 0.8 ELSE 1 END AS a, b * CASE WHEN amount > 100000 THEN 0.8 ELSE 1 END AS b, c, e * CASE WHEN age < 5 OR age > 95 THEN 1.5 ELSE 1 END AS e FROM k JOIN w USING (kind))"""


def weights(c):
    """Four weights that sum to 1: the row of the claim's kind, adapted to amount and age. The kinds are four constant rows: a CASE, no join."""
    amount, age = F.coalesce("billed_amount", F.lit(0.0)), F.coalesce("patient_age", F.lit(50))
    row = lambda i: F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in WEIGHTS.items()])
    x = c.withColumn("kind", claim_type()).withColumns({
        "wa": row(0) * F.when(amount > 100000, 1.5).when(amount > 50000, 1.25).when(amount < 1000, 0.8).otherwise(1.0),
        "wb": row(1) * F.when(amount > 100000, 0.8).otherwise(1.0),
        "wc": row(2),
        "we": row(3) * F.when((age < 5) | (age > 95), 1.5).otherwise(1.0),
    })
    total = F.col("wa") + F.col("wb") + F.col("wc") + F.col("we")
    return x.withColumns({n: F.round(F.col(n) / total, 6) for n in ("wa", "wb", "wc", "we")})


@book.add("r11_weights", _WEIGHT_SQL + " SELECT claim_id, kind, round(a / (a + b + c + e), 6)::DOUBLE AS wa, round(b / (a + b + c + e), 6)::DOUBLE AS wb, round(c / (a + b + c + e), 6)::DOUBLE AS wc, round(e / (a + b + c + e), 6)::DOUBLE AS we FROM x")
def _r11(s, d):
    return weights(claims(s, d)).select("claim_id", "kind", "wa", "wb", "wc", "we")


_SCORE_SQL = _BILLING_SQL + f""", {_W_SQL}, k AS (SELECT claim_id, {_TYPE_SQL} AS kind, coalesce(billed_amount, 0) AS amount, coalesce(patient_age, 50) AS age FROM claims),
 x AS (SELECT claim_id, a * CASE WHEN amount > 100000 THEN 1.5 WHEN amount > 50000 THEN 1.25 WHEN amount < 1000 THEN 0.8 ELSE 1 END AS a, b * CASE WHEN amount > 100000 THEN 0.8 ELSE 1 END AS b, c, e * CASE WHEN age < 5 OR age > 95 THEN 1.5 ELSE 1 END AS e FROM k JOIN w USING (kind)),
 y AS (SELECT claim_id, round(a / (a + b + c + e), 6) AS wa, round(b / (a + b + c + e), 6) AS wb, round(c / (a + b + c + e), 6) AS wc, round(e / (a + b + c + e), 6) AS we FROM x),
 codes AS (SELECT DISTINCT * FROM claim_codes), cf AS (SELECT claim_id, (count(*) >= 3 AND count(DISTINCT category) > 2)::INTEGER AS flags FROM codes GROUP BY 1),
 nf0 AS (SELECT claim_id, amount, lag(amount) OVER (PARTITION BY claim_id, lower(trim(description)) ORDER BY pos) AS before FROM items WHERE description IS NOT NULL), nf AS (SELECT claim_id, count(*) AS flags FROM nf0 WHERE round(abs(amount - before), 6) < {P['near']} GROUP BY 1),
 idf AS (SELECT claim_id, {' + '.join('coalesce(' + e.replace('{rx}', 'regexp_matches') + ', false)::INTEGER' for _, e in _ID_FLAGS)} AS flags FROM claims),
 ag AS (SELECT claim_id, wa AS w, flags, confidence FROM y JOIN billing USING (claim_id) UNION ALL SELECT claim_id, wb, coalesce(flags, 0), round(least(1, 0.3 + 0.2 * coalesce(flags, 0)), 6) FROM y LEFT JOIN cf USING (claim_id)
   UNION ALL SELECT claim_id, wc, coalesce(flags, 0), round(least(1, 0.35 + 0.15 * coalesce(flags, 0)), 6) FROM y LEFT JOIN nf USING (claim_id) UNION ALL SELECT claim_id, we, flags, round(least(1, 0.4 + 0.15 * flags), 6) FROM y JOIN idf USING (claim_id)),
 pt AS (SELECT claim_id, w, confidence, CASE WHEN round(flags * confidence, 6) >= 3 THEN 95 WHEN round(flags * confidence, 6) >= 2 THEN 70 WHEN round(flags * confidence, 6) >= 1 THEN 40 ELSE 10 END AS points FROM ag)"""


def agent_results(s, d):
    """(claim_id, agent, w, flags, confidence, points): the four detectors of every claim, as one long table."""
    c = weights(claims(s, d))
    ids = sum((F.coalesce(F.expr(e.replace("{rx}", "regexp_like")), F.lit(False)).cast("int") for _, e in _ID_FLAGS), F.lit(0))
    c = c.select("claim_id", "wa", "wb", "wc", "we", ids.alias("id_flags"))
    b = billing(s, d).select("claim_id", F.col("flags").alias("b_flags"), "confidence")
    cf = _r022(s, d).select("claim_id", F.col("flagged").cast("int").alias("c_flags"))
    nf = _r032(s, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_flags"))
    wide = c.join(b, "claim_id").join(cf, "claim_id", "left").join(nf, "claim_id", "left").na.fill(0, ["c_flags", "n_flags"])
    conf = lambda base, step, f: F.round(F.least(F.lit(1.0), base + step * F.col(f)), 6)
    row = lambda name, w, f, cf: F.struct(F.lit(name).alias("agent"), F.col(w).alias("w"), F.col(f).cast("bigint").alias("flags"), cf.alias("confidence"))
    agents = F.array(row("billing", "wa", "b_flags", F.col("confidence")), row("diagnostic", "wb", "c_flags", conf(0.3, 0.2, "c_flags")), row("unbundling", "wc", "n_flags", conf(0.35, 0.15, "n_flags")), row("identity", "we", "id_flags", conf(0.4, 0.15, "id_flags")))
    long = wide.select("claim_id", F.inline(agents))
    s_ = F.round(F.col("flags") * F.col("confidence"), 6)
    return long.withColumn("points", F.when(s_ >= 3, 95).when(s_ >= 2, 70).when(s_ >= 1, 40).otherwise(10))


@book.add("r12_claim_scores", _SCORE_SQL + ", sc AS (SELECT claim_id, CAST(floor(round(sum(points * w * confidence) / sum(w), 6)) AS BIGINT) AS score, count(*) FILTER (WHERE points >= 70)::BIGINT AS flagged FROM pt GROUP BY 1) SELECT claim_id, score, flagged, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM sc")
def _r12(s, d):
    g = agent_results(s, d).groupBy("claim_id").agg(F.floor(F.round(F.sum(F.col("points") * F.col("w") * F.col("confidence")) / F.sum("w"), 6)).cast("bigint").alias("score"), F.count_if(F.col("points") >= 70).alias("flagged"))
    return g.withColumn("band", F.when(F.col("score") >= 75, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 25, "MEDIUM").otherwise("LOW"))


@book.add("r14_explainable_score", _SCORE_SQL + " SELECT claim_id, CAST(floor(round(least(100, sum(confidence * CASE points WHEN 95 THEN 4 WHEN 70 THEN 3 WHEN 40 THEN 2 ELSE 1 END) / (4.0 * count(*)) * 100), 6)) AS BIGINT) AS score FROM pt GROUP BY 1")
def _r14(s, d):
    lvl = F.when(F.col("points") == 95, 4).when(F.col("points") == 70, 3).when(F.col("points") == 40, 2).otherwise(1)
    return agent_results(s, d).groupBy("claim_id").agg(F.floor(F.round(F.least(F.lit(100.0), F.sum(F.col("confidence") * lvl) / (4.0 * F.count(F.lit(1))) * 100), 6)).cast("bigint").alias("score"))


@book.add("r07_item_pairs", f"WITH {ITEMS_SQL}, k AS (SELECT DISTINCT claim_id, code FROM items WHERE code IS NOT NULL) SELECT a.code AS first, b.code AS second, count(*)::BIGINT AS claims FROM k a JOIN k b ON a.claim_id = b.claim_id AND a.code < b.code GROUP BY 1, 2")
def _r07(s, d):
    """How often two codes are billed together, in claims of any number of codes.

    The pairs of a claim of more than 40 different codes are spread over tasks by their first code.
    """
    k = items(s, d, keep="code IS NOT NULL").groupBy("claim_id").agg(F.sort_array(F.collect_set("code")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    later = k.where(F.size("c") > 40).select("claim_id", F.posexplode("c").alias("i", "first"), "c").select("claim_id", "first", F.slice("c", F.col("i") + 2, F.size("c")).alias("later"))
    large = spread(later, None, "claim_id", "first").select("first", F.explode("later").alias("second"))
    return k.where(F.size("c") <= 40).select(F.inline(pairs)).unionByName(large).groupBy("first", "second").agg(F.count(F.lit(1)).alias("claims"))


@book.add("r07_peer_zscore", f"WITH {CLAIMS_SQL}, p AS (SELECT room_type, avg(billed_amount) AS m, stddev_pop(billed_amount) AS sd FROM claims WHERE billed_amount > 0 GROUP BY 1) SELECT claim_id, round((billed_amount - m) / sd, 4) AS z FROM claims JOIN p USING (room_type) WHERE billed_amount > 0 AND sd > 0")
def _r07z(s, d):
    # Peers are grouped by room type, some of which hold a third of all rows: aggregate first, then join the few groups back.
    c = claims(s, d, "claim_id", "room_type", "billed_amount", keep="billed_amount > 0")
    p = c.groupBy("room_type").agg(F.avg("billed_amount").alias("m"), F.stddev_pop("billed_amount").alias("sd"))
    return c.join(p, "room_type").where("sd > 0").select("claim_id", F.round((F.col("billed_amount") - F.col("m")) / F.col("sd"), 4).alias("z"))


_GROUPS = ("Laboratory", "Radiology/Imaging", "Surgery")


@book.add("r031_bundles", f"WITH {ITEMS_SQL} SELECT claim_id, category, count(*)::BIGINT AS n, round(0.15 * round(sum(amount), 2), 4) AS savings FROM items WHERE category IN ('Laboratory', 'Radiology/Imaging', 'Surgery') GROUP BY 1, 2 HAVING count(*) >= 3")
def _r031(s, d):
    return items(s, d, keep=F.col("category").isin(*_GROUPS)).groupBy("claim_id", "category").agg(F.count(F.lit(1)).alias("n"), F.round(0.15 * F.round(F.sum("amount"), 2), 4).alias("savings")).where("n >= 3")


@book.add("r034_upcoding", f"WITH {ITEMS_SQL}, p AS (SELECT category, median(amount) AS mid FROM items WHERE amount > 0 GROUP BY 1) SELECT claim_id, pos, round(amount / mid, 4) AS ratio FROM items JOIN p USING (category) WHERE amount > 0 AND round(amount / mid, 6) > 8")
def _r034(s, d):
    i = items(s, d, keep="amount > 0")
    p = exact_quantiles(i, "category", "amount", {"mid": 0.5})
    return i.join(F.broadcast(p), "category").where("round(amount / mid, 6) > 8").select("claim_id", "pos", F.round(F.col("amount") / F.col("mid"), 4).alias("ratio"))


@book.add("r06_reconciliation", f"WITH {CLAIMS_SQL}, {ITEMS_SQL}, f AS (SELECT claim_id, sum(amount) AS pharmacy FROM items WHERE category = 'Pharmacy' AND amount > 0 GROUP BY 1) SELECT claim_id, round(pharmacy, 2) AS pharmacy, coalesce(hospital_bill_total > 0 AND round(pharmacy, 2) > round(0.3 * hospital_bill_total, 2), false) AS flagged FROM claims JOIN f USING (claim_id)")
def _r06(s, d):
    f = items(s, d, keep="category = 'Pharmacy' AND amount > 0").groupBy("claim_id").agg(F.sum("amount").alias("p"))
    h = F.col("hospital_bill_total")
    return claims(s, d, "claim_id", "hospital_bill_total").join(f, "claim_id").select("claim_id", F.round("p", 2).alias("pharmacy"), F.coalesce((h > 0) & (F.round("p", 2) > F.round(0.3 * h, 2)), F.lit(False)).alias("flagged"))


@book.add("r05_clinical_consistency", f"WITH {CLAIMS_SQL}, {CODES_SQL}, c AS (SELECT claim_id, bool_or(upper(code) LIKE 'H25%') AS eye_code FROM codes GROUP BY 1) SELECT claim_id, coalesce(eye_code, false) AND NOT list_contains(coalesce(procedure_list, []), 'cataract surgery') AS code_without_procedure, list_contains(coalesce(procedure_list, []), 'dialysis') AND coalesce(length_of_stay, 0) = 0 AS dialysis_without_stay FROM claims LEFT JOIN c USING (claim_id)")
def _r05(s, d):
    c = codes(s, d).groupBy("claim_id").agg(F.bool_or(F.upper("code").startswith("H25")).alias("e"))
    has = lambda p: F.coalesce(F.array_contains("procedure_list", p), F.lit(False))
    return claims(s, d).join(c, "claim_id", "left").select("claim_id", (F.coalesce("e", F.lit(False)) & ~has("cataract surgery")).alias("code_without_procedure"), (has("dialysis") & (F.coalesce("length_of_stay", F.lit(0)) == 0)).alias("dialysis_without_stay"))


# --- metrics over the scores ----------------------------------------------------------------------------------------

_BANDS_SQL = _SCORE_SQL + ", sc AS (SELECT claim_id, CAST(floor(round(sum(points * w * confidence) / sum(w), 6)) AS BIGINT) AS score FROM pt GROUP BY 1), bands AS (SELECT claim_id, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM sc)"


@book.add("m02_flagged_rate", _BANDS_SQL + " SELECT count(*)::BIGINT AS scored, count(*) FILTER (WHERE band IN ('CRITICAL', 'HIGH'))::BIGINT AS flagged, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (WHERE band IN ('CRITICAL', 'HIGH')) / count(*) ELSE 0 END, 4) AS rate FROM bands")
def _m02(s, d):
    g = _r12(s, d).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("band").isin("CRITICAL", "HIGH")).alias("flagged"))
    return g.withColumn("rate", F.round(F.coalesce(F.try_divide(100.0 * F.col("flagged"), F.col("scored")), F.lit(0.0)), 4))


@book.add("m05_risk_distribution", _BANDS_SQL + " SELECT band, count(*)::BIGINT AS claims, min(score) AS least, max(score) AS most FROM bands GROUP BY 1")
def _m05(s, d):
    return _r12(s, d).groupBy("band").agg(F.count(F.lit(1)).alias("claims"), F.min("score").alias("least"), F.max("score").alias("most"))


@book.add("m13_batch_outcomes", _BANDS_SQL + ", m AS (SELECT DISTINCT * FROM claim) SELECT m.claim_id, score, band, CASE WHEN hospital_name IS NULL THEN 'no hospital' WHEN billed_amount IS NULL THEN 'no amount' END AS error, CASE WHEN hospital_name IS NULL OR billed_amount IS NULL THEN 'complete the record' WHEN band IN ('CRITICAL', 'HIGH') THEN 'review' ELSE 'process' END AS action FROM m LEFT JOIN bands USING (claim_id)")
def _m13(s, d):
    """One row a claim of a batch: score, level, what to do, or what is wrong with the record."""
    c = claims(s, d, "claim_id", "hospital_name", "billed_amount").join(_r12(s, d).drop("flagged"), "claim_id", "left")
    error = F.when(F.col("hospital_name").isNull(), "no hospital").when(F.col("billed_amount").isNull(), "no amount")
    action = F.when(error.isNotNull(), "complete the record").when(F.col("band").isin("CRITICAL", "HIGH"), "review").otherwise("process")
    return c.select("claim_id", "score", "band", error.alias("error"), action.alias("action"))


@book.add("m12_monthly_levels", _BANDS_SQL + ", m AS (SELECT DISTINCT * FROM claim) SELECT CAST(date_trunc('month', date_of_service) AS DATE) AS month, " + ", ".join(f"count(*) FILTER (WHERE band = '{b}')::BIGINT AS {b.lower()}" for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + " FROM m JOIN bands USING (claim_id) WHERE date_of_service IS NOT NULL GROUP BY 1")
def _m12(s, d):
    """Levels by month, as columns."""
    c = claims(s, d, "claim_id", "date_of_service", keep="date_of_service IS NOT NULL").join(_r12(s, d), "claim_id")
    return c.groupBy(F.trunc("date_of_service", "month").alias("month")).agg(*[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
