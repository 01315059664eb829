"""Text extraction, normalisation and validation over claim tables, scanned lines and code contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions import text as T
from ledgerloom.plans.book import CLAIMS_SQL, CODES_SQL, ITEMS_SQL, Book
from ledgerloom.plans.filters import claims
from ledgerloom.plans.metrics import items
from ledgerloom.sources.tables import once, table

book = Book()


def codes(s, d, *, keep=None):
    return once(table(s, d, "claim_codes"), ["code_id"], keep)


def extractions(s, d, *, keep=None):
    return once(table(s, d, "claim_extractions"), ["rec_id"], keep)


_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _sq(x: str) -> str:
    return _SQUEEZE.format(x)


@book.add("n01_normalised_names", f"WITH {CLAIMS_SQL} SELECT claim_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(claimant_name, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '‘’“”–—', '''''\"\"--'), ' +([,.;:])', '\\1', 'g'), '\\s+', ' ', 'g')) AS normal FROM claims")
def _n01(s, d):
    return claims(s, d, "claim_id", "claimant_name").select("claim_id", T.normalise(F.col("claimant_name")).alias("normal"))


def _repairs(x: str) -> str:
    for wrong, right in T.DOMAIN_REPAIRS:
        x = f"regexp_replace({x}, '(?i){wrong}', '{right}', 'g')"
    return x


@book.add("n02_domain_repair", f"WITH {ITEMS_SQL} SELECT claim_id, pos, {_repairs('description')} AS repaired, {_repairs('description')} <> description AS changed FROM items")
def _n02(s, d):
    r = T.domain_repair(F.col("description"))
    return items(s, d).select("claim_id", "pos", r.alias("repaired"), (r != F.col("description")).alias("changed"))


@book.add("n04_confused_figures", f"WITH {CLAIMS_SQL} SELECT claim_id, translate(upper(policy_number), 'OILSZB', '011528') AS as_figures FROM claims")
def _n04(s, d):
    return claims(s, d, "claim_id", "policy_number").select("claim_id", T.digits_read(F.upper("policy_number")).alias("as_figures"))


@book.add("n06_policy_number", f"WITH {CLAIMS_SQL} SELECT claim_id, regexp_replace(regexp_replace(upper(trim(policy_number)), '[\\s/]+', '-', 'g'), '^-+|-+$', '', 'g') AS policy FROM claims")
def _n06(s, d):
    return claims(s, d, "claim_id", "policy_number").select("claim_id", T.policy_number(F.col("policy_number")).alias("policy"))


@book.add("n11_identity_name", f"WITH {CLAIMS_SQL} SELECT claim_id, {_sq(chr(40) + 'regexp_replace(lower(claimant_name), ' + chr(39) + '[^a-z0-9 ]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' + chr(41))} AS name FROM claims")
def _n11(s, d):
    return claims(s, d, "claim_id", "claimant_name").select("claim_id", T.identity_name(F.col("claimant_name")).alias("name"))


_BARE = f"trim(regexp_replace(regexp_replace({_sq('full_name')}, '(?i)^(?:(?:{T.HONORIFICS})(?:\\.|\\s|$)\\s*)+', ''), '(?i)(?:[,\\s]+(?:{T.DEGREES})\\.?)+$', ''))"


@book.add("e08_clean_names", f"WITH m AS (SELECT DISTINCT * FROM identity_sources) SELECT mention_id, CASE WHEN length({_BARE}) < 3 THEN '' ELSE coalesce({_BARE}, '') END AS cleaned FROM m")
def _e08(s, d):
    return table(s, d, "identity_sources").dropDuplicates(["mention_id"]).select("mention_id", T.clean_name(F.col("full_name")).alias("cleaned"))


@book.add("e09_clean_entities", f"WITH {CLAIMS_SQL} SELECT claim_id, regexp_replace(regexp_replace({_sq(chr(39).join(['regexp_replace(hospital_name, ', '[][(){}<>|]', ', ', ' ', ', ', 'g', ')']))}, '^[^A-Za-z]+', ''), '[^A-Za-z.]+$', '') AS entity FROM claims")
def _e09(s, d):
    return claims(s, d, "claim_id", "hospital_name").select("claim_id", T.clean_entity(F.col("hospital_name")).alias("entity"))


_HOUSES = ("eye hospital", "dental clinic", "heart institute", "nursing home", "diagnostics", "children hospital", "multispeciality hospital")


@book.add(
    "e10_fuzzy_house_kind",
    f"WITH {CLAIMS_SQL}, k(kind, rank) AS (VALUES " + ", ".join(f"('{h}', {i})" for i, h in enumerate(_HOUSES)) + f"), n AS (SELECT claim_id, lower({_sq('hospital_name')}) AS h FROM claims WHERE hospital_name IS NOT NULL),"
    " p AS (SELECT claim_id, kind, rank, CASE WHEN contains(h, kind) THEN 1.0::DOUBLE ELSE 1 - levenshtein(list_aggregate(list_sort(string_split(h, ' ')), 'string_agg', ' '), list_aggregate(list_sort(string_split(kind, ' ')), 'string_agg', ' ')) / greatest(length(h), length(kind), 1)::DOUBLE END AS s FROM n, k),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY s DESC, rank) AS r FROM p) SELECT claim_id, kind, round(s, 6) AS score FROM b WHERE r = 1 AND s >= 0.5",
)
def _e10(s, d):
    """The kinds are seven constants: an array per row, no join."""
    c = claims(s, d, "claim_id", "hospital_name", keep="hospital_name IS NOT NULL").withColumn("h", F.lower(T.squeeze(F.col("hospital_name"))))
    scored = [F.struct(F.round(F.when(F.contains("h", F.lit(k)), 1.0).otherwise(T.similarity(F.col("h"), F.lit(k))), 12).alias("s"), F.lit(-i).alias("r"), F.lit(k).alias("kind")) for i, k in enumerate(_HOUSES)]
    return c.select("claim_id", F.array_max(F.array(*scored)).alias("b")).where("b.s >= 0.5").select("claim_id", "b.kind", F.round("b.s", 6).alias("score"))


@book.add("e12_doctors", f"WITH {CLAIMS_SQL} SELECT claim_id, regexp_matches(provider_name, '(?i)(^|\\s)(dr|prof)\\.?\\s') AS is_doctor, {_sq('regexp_replace(provider_name, ' + chr(39) + '(?i)(^|\\s)dr\\.?\\s+' + chr(39) + ', ' + chr(39) + '\\1Dr. ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS provider FROM claims WHERE provider_name IS NOT NULL")
def _e12(s, d):
    p = F.col("provider_name")
    return claims(s, d, "claim_id", "provider_name", keep="provider_name IS NOT NULL").select("claim_id", p.rlike(r"(?i)(^|\s)(dr|prof)\.?\s").alias("is_doctor"), T.squeeze(F.regexp_replace(p, r"(?i)(^|\s)dr\.?\s+", "$1Dr. ")).alias("provider"))


# Lines of scanned texts: one explode feeds the line operators.
_LINES = "texts AS (SELECT DISTINCT scan_id, raw_text_preview FROM scan_texts WHERE raw_text_preview IS NOT NULL AND scan_id IS NOT NULL), l0 AS (SELECT scan_id, string_split(raw_text_preview, chr(10)) AS a FROM texts), lines AS (SELECT scan_id, generate_subscripts(a, 1)::INTEGER AS line_no, unnest(a) AS line FROM l0)"


def lines(s, d):
    t = table(s, d, "scan_texts", "scan_id", "raw_text_preview").where("raw_text_preview IS NOT NULL AND scan_id IS NOT NULL").dropDuplicates(["scan_id"])
    return t.select("scan_id", F.posexplode(F.split("raw_text_preview", "\n")).alias("p", "line")).select("scan_id", (F.col("p") + 1).alias("line_no"), "line")


_ITEM = r"^\s*([A-Za-z][A-Za-z -]+[A-Za-z])\s*(?:\.{3,}|:)?\s+(?:Rs\.?|INR|₹)\s*([0-9][0-9,]*(?:\.[0-9]{2})?)\s*$"


@book.add("e22_bill_lines", f"WITH {_LINES} SELECT scan_id, line_no, regexp_extract(line, '{_ITEM}', 1) AS description, TRY_CAST(replace(regexp_extract(line, '{_ITEM}', 2), ',', '') AS DOUBLE) AS amount FROM lines WHERE regexp_matches(line, '{_ITEM}') AND NOT regexp_matches(line, '(?i)total|discount')")
def _e22(s, d):
    amount = F.regexp_replace(F.regexp_extract("line", _ITEM, 2), ",", "").try_cast("double")
    return lines(s, d).where(F.col("line").rlike(_ITEM) & ~F.col("line").rlike("(?i)total|discount")).select("scan_id", "line_no", F.regexp_extract("line", _ITEM, 1).alias("description"), amount.alias("amount"))


_TOTAL = r"(?i)^\s*(?:sub |grand )?total\s+(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]{2})?)\s*$"


@book.add("e29_bill_totals", f"WITH {_LINES}, i AS (SELECT scan_id, sum(TRY_CAST(replace(regexp_extract(line, '{_ITEM}', 2), ',', '') AS DOUBLE)) AS itemised, count(*)::BIGINT AS n FROM lines WHERE regexp_matches(line, '{_ITEM}') AND NOT regexp_matches(line, '(?i)total|discount') GROUP BY 1), t AS (SELECT scan_id, max(TRY_CAST(replace(regexp_extract(line, '{_TOTAL}', 1), ',', '') AS DOUBLE)) AS total FROM lines WHERE regexp_matches(line, '{_TOTAL}') GROUP BY 1) SELECT scan_id, n, round(itemised, 2) AS itemised, round(total, 2) AS total, CASE WHEN total IS NULL THEN 0.3 WHEN abs(itemised - total) < 0.05 * total THEN 0.95 WHEN abs(itemised - total) < 0.15 * total THEN 0.8 WHEN abs(itemised - total) < 0.3 * total THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM i LEFT JOIN t USING (scan_id)")
def _e29(s, d):
    line, num = F.col("line"), lambda p, g: F.regexp_replace(F.regexp_extract("line", p, g), ",", "").try_cast("double")
    is_item = line.rlike(_ITEM) & ~line.rlike("(?i)total|discount")
    per = lines(s, d).groupBy("scan_id").agg(F.count_if(is_item).alias("n"), F.sum(F.when(is_item, num(_ITEM, 2))).alias("i"), F.max(F.when(line.rlike(_TOTAL), num(_TOTAL, 1))).alias("t")).where("n > 0")
    gap = F.abs(F.col("i") - F.col("t"))
    c = F.when(F.col("t").isNull(), 0.3).when(gap < 0.05 * F.col("t"), 0.95).when(gap < 0.15 * F.col("t"), 0.8).when(gap < 0.3 * F.col("t"), 0.6).otherwise(0.4)
    return per.select("scan_id", "n", F.round("i", 2).alias("itemised"), F.round("t", 2).alias("total"), c.alias("confidence"))


_HEAD = r"^\s*(?:Part [A-E]\b.*|[0-9]+(?:\.[0-9]+)*\.? [A-Z][a-z].*|[A-Z][A-Z ]{8,}|Annexure [0-9]+|Remarks|Note to file)\s*$"


@book.add(
    "e14_sections",
    "WITH texts AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1), l0 AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM texts), lines AS (SELECT doc_id, generate_subscripts(a, 1)::INTEGER AS line_no, unnest(a) AS line FROM l0),"
    f" h AS (SELECT *, CASE WHEN regexp_matches(line, '{_HEAD}') THEN line_no END AS head FROM lines), g AS (SELECT *, max(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h)"
    " SELECT doc_id, section AS start_line, max(line_no)::INTEGER AS end_line, count(*) FILTER (WHERE trim(line) <> '')::BIGINT AS filled FROM g WHERE section IS NOT NULL GROUP BY 1, 2",
)
def _e14(s, d):
    docs = table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    ls = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")
    # One document's lines share a task; that is bounded by the longest document.
    section = F.max(F.when(F.col("line").rlike(_HEAD), F.col("line_no"))).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return ls.withColumn("start_line", section).where("start_line IS NOT NULL").groupBy("doc_id", "start_line").agg(F.max("line_no").alias("end_line"), F.count_if(F.trim("line") != "").alias("filled"))


CATEGORIES = (("Room", "room"), ("ICU", "icu"), ("Surgery", "surg|theatre|anaesth"), ("Pharmacy", "medicine|pharma|drug"), ("Laboratory", "blood|liver|lab"), ("Imaging", "ct scan|mri|x-ray"), ("Consultation", "consult"), ("Nursing", "nurs|dressing"))
_CAT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{c}'" for c, p in CATEGORIES) + " ELSE 'Other' END"


def category(c):
    out = F.lit("Other")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


@book.add("e28_item_category", f"WITH {ITEMS_SQL} SELECT claim_id, pos, {_CAT_SQL} AS kind FROM items")
def _e28(s, d):
    return items(s, d).select("claim_id", "pos", category(F.col("description")).alias("kind"))


@book.add("e31_totals_by_category", f"WITH {ITEMS_SQL} SELECT claim_id, {_CAT_SQL} AS kind, round(sum(amount), 2) AS total, count(*)::BIGINT AS n FROM items GROUP BY 1, 2")
def _e31(s, d):
    return items(s, d).groupBy("claim_id", category(F.col("description")).alias("kind")).agg(F.round(F.sum("amount"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


_ICD = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9]{1,2})?)\b"


@book.add("e33_codes_in_context", f"WITH {CODES_SQL}, m AS (SELECT code_id, claim_id, context, unnest(regexp_extract_all(context, '{_ICD}', 1)) AS found FROM codes WHERE context IS NOT NULL) SELECT claim_id, found, count(*)::BIGINT AS n, min(code_id) AS first_code_id FROM m GROUP BY 1, 2")
def _e33(s, d):
    m = codes(s, d, keep="context IS NOT NULL").select("code_id", "claim_id", F.explode(F.regexp_extract_all("context", F.lit(_ICD), F.lit(1))).alias("found"))
    return m.groupBy("claim_id", "found").agg(F.count(F.lit(1)).alias("n"), F.min("code_id").alias("first_code_id"))


_KNOWN = "^(J18|K35|K80|E11|I10|M17|H25|S72|C50|A90|N20|O80)"
_MED, _NOT, _FORM = "(?i)diagnos|disease|illness|primary code|icd", "(?i)plot|house|pin|phone", "(?i)form|regn|policy no"


@book.add("e34_code_confidence", f"WITH {CODES_SQL} SELECT code_id, round(greatest(0, least(1, 0.5 + CASE WHEN regexp_matches(upper(code), '{_KNOWN}') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(context, '{_MED}') THEN 0.15 ELSE 0 END + CASE WHEN contains(code, '.') THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(context, '{_NOT}') THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches(context, '{_FORM}') THEN 0.3 ELSE 0 END)), 6)::DOUBLE AS score FROM codes")
def _e34(s, d):
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    x = F.col("context")
    score = 0.5 + on(F.upper("code").rlike(_KNOWN), 0.3) + on(x.rlike(_MED), 0.15) + on(F.contains("code", F.lit(".")), 0.05) - on(x.rlike(_NOT), 0.4) - on(x.rlike(_FORM), 0.3)
    return codes(s, d).select("code_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


_CHAPTERS = (("A", "Infectious"), ("C", "Neoplasm"), ("E", "Endocrine"), ("H", "Eye"), ("I", "Circulatory"), ("J", "Respiratory"), ("K", "Digestive"), ("M", "Musculoskeletal"), ("N", "Genitourinary"), ("O", "Pregnancy"), ("S", "Injury"))


@book.add("e37_code_chapter", f"WITH {CODES_SQL}, c(letter, chapter) AS (VALUES " + ", ".join(str(x) for x in _CHAPTERS) + ") SELECT code_id, upper(code) AS code, chapter FROM codes LEFT JOIN c ON substr(upper(code), 1, 1) = letter WHERE code IS NOT NULL")
def _e37(s, d):
    chapters = s.createDataFrame(list(_CHAPTERS), "letter string, chapter string")
    c = codes(s, d, keep="code IS NOT NULL").withColumn("letter", F.substring(F.upper("code"), 1, 1))
    return c.join(F.broadcast(chapters), "letter", "left").select("code_id", F.upper("code").alias("code"), "chapter")  # eleven constant rows


_RANGES = ((10000, 19999, "integumentary"), (20000, 29999, "musculoskeletal"), (30000, 49999, "organs"), (70000, 79999, "imaging"), (80000, 89999, "laboratory"))


@book.add("e38_procedure_ranges", f"WITH {CODES_SQL}, r(lo, hi, area) AS (VALUES " + ", ".join(str(x) for x in _RANGES) + ") SELECT code_id, area FROM codes JOIN r ON TRY_CAST(code AS BIGINT) BETWEEN lo AND hi WHERE regexp_matches(code, '^[0-9]{5}$')")
def _e38(s, d):
    # A range join against a few constant ranges: one struct per range folded into the row.
    n = F.col("code").try_cast("bigint")
    area = F.coalesce(*[F.when(n.between(lo, hi), a) for lo, hi, a in _RANGES])
    return codes(s, d, keep=F.col("code").rlike("^[0-9]{5}$")).select("code_id", area.alias("area")).where("area IS NOT NULL")


@book.add(
    "e39_code_summary",
    f"WITH {CODES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY coalesce(is_primary, false) DESC, confidence DESC NULLS LAST, pos, code_id) AS k FROM codes WHERE code IS NOT NULL) SELECT claim_id, max(CASE WHEN k = 1 THEN upper(code) END) AS primary_code, round(avg(confidence), 6) AS mean_confidence, string_agg(upper(code), ', ' ORDER BY k) FILTER (WHERE k <= 5) AS shown FROM r GROUP BY 1",
)
def _e39(s, d):
    k = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.coalesce("is_primary", F.lit(False)).desc(), F.col("confidence").desc_nulls_last(), "pos", "code_id"))
    r = codes(s, d, keep="code IS NOT NULL").withColumn("k", k)
    return r.groupBy("claim_id").agg(F.max(F.when(F.col("k") == 1, F.upper("code"))).alias("primary_code"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", F.upper("code").alias("c"))))), lambda x: x["c"]), ", ").alias("shown"))


@book.add("e41_code_format", f"WITH {CODES_SQL} SELECT code_id, coalesce(regexp_matches(upper(code), '^[A-Z][0-9]{{2}}(\\.[0-9]{{1,4}})?$'), false) AS is_icd, coalesce(regexp_matches(code, '^[0-9]{{5}}$'), false) AS is_cpt, coalesce(regexp_matches(upper(code), '^[A-V][0-9]{{4}}$'), false) AS is_hcpcs FROM codes")
def _e41(s, d):
    is_ = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    return codes(s, d).select("code_id", is_(F.upper("code"), r"^[A-Z][0-9]{2}(\.[0-9]{1,4})?$").alias("is_icd"), is_(F.col("code"), "^[0-9]{5}$").alias("is_cpt"), is_(F.upper("code"), "^[A-V][0-9]{4}$").alias("is_hcpcs"))


_DSQL = "coalesce(CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN CAST(TRY_STRPTIME(t, '%Y-%m-%d') AS DATE) END, CASE WHEN regexp_matches(t, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$') THEN CAST(TRY_STRPTIME(t, '%d-%m-%Y') AS DATE) END, CASE WHEN regexp_matches(t, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$') THEN CAST(TRY_STRPTIME(regexp_extract(t, '^([0-9]{1,2}-[0-9]{1,2}-)', 1) || CASE WHEN CAST(right(t, 2) AS INTEGER) >= 50 THEN '19' ELSE '20' END || right(t, 2), '%d-%m-%Y') AS DATE) END, CASE WHEN regexp_matches(t, '^[0-9]{1,2}-[A-Za-z]{3}[a-z]*-[0-9]{4}$') THEN CAST(TRY_STRPTIME(regexp_replace(t, '^([0-9]{1,2}-[A-Za-z]{3})[a-z]*', '\\1'), '%d-%b-%Y') AS DATE) END)"


@book.add("e44_parse_dates", f"WITH x AS (SELECT DISTINCT * FROM claim_extractions), u AS (SELECT rec_id, 'dob' AS field, dob AS raw FROM x UNION ALL SELECT rec_id, 'admission_date', admission_date FROM x UNION ALL SELECT rec_id, 'discharge_date', discharge_date FROM x), t AS (SELECT rec_id, field, regexp_replace(trim(raw), '[./\\s,-]+', '-', 'g') AS t FROM u WHERE raw IS NOT NULL) SELECT rec_id, field, {_DSQL} AS day FROM t WHERE {_DSQL} IS NULL OR year({_DSQL}) > 1000")
def _e44(s, d):
    # inline rather than unpivot: the generated code of an Expand under this expression doesn't compile.
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in ("dob", "admission_date", "discharge_date")])
    u = extractions(s, d).select("rec_id", F.inline(cells)).where("raw IS NOT NULL")
    return u.select("rec_id", "field", D.parse_date(F.col("raw")).alias("day"))


@book.add("e48_stay_and_age", f"WITH {CLAIMS_SQL} SELECT claim_id, CASE WHEN date_diff('day', date_of_admission, date_of_discharge) BETWEEN 0 AND 365 THEN date_diff('day', date_of_admission, date_of_discharge) END::INTEGER AS stay, CASE WHEN dob IS NOT NULL AND date_of_admission IS NOT NULL AND datesub('year', dob, date_of_admission) BETWEEN 0 AND 120 THEN datesub('year', dob, date_of_admission) END::INTEGER AS years FROM claims")
def _e48(s, d):
    years = F.year("date_of_admission") - F.year("dob") - F.when(F.date_format("date_of_admission", "MMdd") < F.date_format("dob", "MMdd"), 1).otherwise(0)
    return claims(s, d).select("claim_id", D.length_of_stay(F.col("date_of_admission"), F.col("date_of_discharge")).alias("stay"), F.when(years.between(0, 120), years).alias("years"))


@book.add(
    "e04_field_vote",
    "WITH x AS (SELECT DISTINCT * FROM claim_extractions), v AS (SELECT TRY_CAST(regexp_extract(file_name, '^0*([0-9]+)', 1) AS BIGINT) AS claim_no, upper(replace(policy_number, ' ', '')) AS v, rec_id FROM x WHERE policy_number IS NOT NULL AND regexp_matches(policy_number, '[0-9]{4}')), g AS (SELECT claim_no, v, count(*)::BIGINT AS n, min(rec_id) AS first FROM v WHERE claim_no IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY claim_no ORDER BY n DESC, first) AS k FROM g) SELECT claim_no, v AS policy, n, round(least(0.95, 0.5 + 0.1 * n), 2)::DOUBLE AS confidence FROM r WHERE k = 1",
)
def _e04(s, d):
    x = extractions(s, d, keep=F.col("policy_number").rlike("[0-9]{4}"))
    v = x.select(F.regexp_extract("file_name", "^0*([0-9]+)", 1).try_cast("bigint").alias("claim_no"), F.upper(F.replace("policy_number", F.lit(" "), F.lit(""))).alias("v"), "rec_id").where("claim_no IS NOT NULL")
    g = v.groupBy("claim_no", "v").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first"))
    best = g.groupBy("claim_no").agg(F.max_by(F.struct("v", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("claim_no", F.col("b.v").alias("policy"), "b.n", F.round(F.least(F.lit(0.95), 0.5 + 0.1 * F.col("b.n")), 2).alias("confidence"))


@book.add(
    "e51_tag_spans",
    f"WITH {CLAIMS_SQL}, w0 AS (SELECT claim_id, string_split({_sq('hospital_name || ' + chr(39) + ' treats ' + chr(39) + ' || diagnosis')}, ' ') AS a, len(string_split({_sq('hospital_name')}, ' ')) AS h FROM claims WHERE hospital_name IS NOT NULL AND diagnosis IS NOT NULL), t AS (SELECT claim_id, h, generate_subscripts(a, 1) AS pos, unnest(a) AS w FROM w0), g AS (SELECT claim_id, pos, w, CASE WHEN pos <= h THEN 'ORG' WHEN pos > h + 1 THEN 'DIS' END AS kind, CASE WHEN pos = 1 OR pos = h + 2 THEN 1 ELSE 0 END AS b FROM t), k AS (SELECT *, sum(b) OVER (PARTITION BY claim_id ORDER BY pos) AS span FROM g) SELECT claim_id, kind, string_agg(w, ' ' ORDER BY pos) AS entity, count(*)::BIGINT AS words FROM k WHERE kind IS NOT NULL GROUP BY claim_id, kind, span",
)
def _e51(s, d):
    """BIO tags to entity spans by gaps and islands."""
    c = claims(s, d, keep="hospital_name IS NOT NULL AND diagnosis IS NOT NULL")
    h = F.size(F.split(T.squeeze(F.col("hospital_name")), " "))
    t = c.select("claim_id", h.alias("h"), F.posexplode(F.split(T.squeeze(F.concat("hospital_name", F.lit(" treats "), "diagnosis")), " ")).alias("p", "w"))
    tag = F.when(F.col("p") == 0, "B-ORG").when(F.col("p") < F.col("h"), "I-ORG").when(F.col("p") == F.col("h"), "O").when(F.col("p") == F.col("h") + 1, "B-DIS").otherwise("I-DIS")
    t = t.withColumn("tag", tag)
    span = F.sum(F.when(F.col("tag").startswith("B-"), 1).otherwise(0)).over(Window.partitionBy("claim_id").orderBy("p"))
    k = t.withColumn("span", span).where("tag <> 'O'")
    return k.groupBy("claim_id", F.substring("tag", 3, 3).alias("kind"), "span").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias("entity"), F.count(F.lit(1)).alias("words")).drop("span")


@book.add("v03_amount_issues", f"WITH {ITEMS_SQL} SELECT claim_id, pos, concat_ws(';', CASE WHEN amount IS NULL THEN 'missing' END, CASE WHEN amount < 1 THEN 'too small' END, CASE WHEN amount > 1000000 THEN 'too large' END, CASE WHEN amount = floor(amount) AND amount BETWEEN 100000 AND 999999 THEN 'like a postal code' END, CASE WHEN amount > 10000 AND amount % 10000 = 0 THEN 'round' END) AS issues FROM items")
def _v03(s, d):
    a = F.col("amount")
    issues = [F.when(a.isNull(), "missing"), F.when(a < 1, "too small"), F.when(a > 1000000, "too large"), F.when((a == F.floor(a)) & a.between(100000, 999999), "like a postal code"), F.when((a > 10000) & (a % 10000 == 0), "round")]
    return items(s, d).select("claim_id", "pos", F.concat_ws(";", *issues).alias("issues"))


_META = "(?i)regn|indoor no|policy no|phone|page [0-9]|registration no"


@book.add("v04_item_validity", f"WITH {ITEMS_SQL} SELECT claim_id, pos, CASE WHEN description IS NULL OR length(trim(description)) < 3 THEN 'short' WHEN regexp_matches(description, '{_META}') THEN 'metadata' WHEN length(regexp_replace(description, '[A-Za-z0-9 .()-]', '', 'g')) > 0.08 * length(description) THEN 'signs' WHEN amount IS NULL OR amount <= 0 OR amount > 50000000 THEN 'amount' WHEN regexp_matches(lower(description), 'icu') AND amount < 1000 THEN 'icu below range' ELSE 'ok' END AS verdict FROM items")
def _v04(s, d):
    t, a = F.col("description"), F.col("amount")
    verdict = (
        F.when(t.isNull() | (F.length(F.trim(t)) < 3), "short")
        .when(t.rlike(_META), "metadata")
        .when(F.length(F.regexp_replace(t, "[A-Za-z0-9 .()-]", "")) > 0.08 * F.length(t), "signs")
        .when(a.isNull() | (a <= 0) | (a > 50000000), "amount")
        .when(F.lower(t).rlike("icu") & (a < 1000), "icu below range")
        .otherwise("ok")
    )
    return items(s, d).select("claim_id", "pos", verdict.alias("verdict"))


@book.add("v07_clean_totals", f"WITH {CLAIMS_SQL}, {ITEMS_SQL}, v AS (SELECT claim_id, sum(amount) AS itemised, count(*)::BIGINT AS kept FROM items WHERE amount > 0 AND amount <= 50000000 AND description IS NOT NULL GROUP BY 1) SELECT claim_id, kept, round(itemised, 2) AS itemised, round(CASE WHEN billed_amount > 0 THEN billed_amount ELSE itemised END, 2) AS total, coalesce(abs(itemised - billed_amount) > 100, false) AS corrected FROM claims LEFT JOIN v USING (claim_id)")
def _v07(s, d):
    v = items(s, d, keep="amount > 0 AND amount <= 50000000 AND description IS NOT NULL").groupBy("claim_id").agg(F.sum("amount").alias("i"), F.count(F.lit(1)).alias("kept"))
    b = F.col("billed_amount")
    return claims(s, d, "claim_id", "billed_amount").join(v, "claim_id", "left").select("claim_id", "kept", F.round("i", 2).alias("itemised"), F.round(F.when(b > 0, b).otherwise(F.col("i")), 2).alias("total"), F.coalesce(F.abs(F.col("i") - b) > 100, F.lit(False)).alias("corrected"))


@book.add("v16_diagnosis_parts", f"WITH {CLAIMS_SQL}, p AS (SELECT claim_id, trim(unnest(string_split_regex(diagnosis, '[,;/|]'))) AS part FROM claims WHERE diagnosis IS NOT NULL) SELECT claim_id, count(*)::BIGINT AS parts, min(part) AS first_part FROM p WHERE length(part) >= 3 AND NOT regexp_matches(part, '(?i)name of|to be filled') GROUP BY 1")
def _v16(s, d):
    p = claims(s, d, "claim_id", "diagnosis", keep="diagnosis IS NOT NULL").select("claim_id", F.explode(F.split("diagnosis", "[,;/|]")).alias("part")).select("claim_id", F.trim("part").alias("part"))
    return p.where("length(part) >= 3 AND NOT part RLIKE '(?i)name of|to be filled'").groupBy("claim_id").agg(F.count(F.lit(1)).alias("parts"), F.min("part").alias("first_part"))


_CRITICAL = ("policy_number", "claimant_name", "hospital_name", "diagnosis", "billed_amount")


@book.add("v19_completeness", f"WITH {CLAIMS_SQL} SELECT claim_id, round((" + " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in _CRITICAL) + ") / 5.0, 2)::DOUBLE AS completeness, CASE WHEN billed_amount IS NULL OR hospital_name IS NULL THEN 'error' WHEN diagnosis IS NULL OR policy_number IS NULL THEN 'warning' ELSE 'valid' END AS status FROM claims")
def _v19(s, d):
    filled = sum((F.col(c).isNotNull().cast("int") for c in _CRITICAL), F.lit(0))
    status = F.when(F.col("billed_amount").isNull() | F.col("hospital_name").isNull(), "error").when(F.col("diagnosis").isNull() | F.col("policy_number").isNull(), "warning").otherwise("valid")
    return claims(s, d).select("claim_id", F.round(filled / 5.0, 2).alias("completeness"), status.alias("status"))


_GIB = (("[bcdfghjklmnpqrstvwxyz]{5}", 1.5), ("[a-z][0-9][a-z]|[0-9][a-z][0-9]", 1.0), ("[!?|]{2}", 0.5))


@book.add("v01_gibberish", f"WITH {ITEMS_SQL}, g AS (SELECT claim_id, pos, " + " + ".join(f"CASE WHEN regexp_matches(lower(description), '{p}') THEN {w} ELSE 0 END" for p, w in _GIB) + " + CASE WHEN length(regexp_replace(lower(description), '[^aeiou]', '', 'g')) < 0.15 * length(regexp_replace(lower(description), '[^a-z]', '', 'g')) THEN 1.5 ELSE 0 END AS score FROM items WHERE description IS NOT NULL) SELECT claim_id, pos, score::DOUBLE AS score, score >= 2 AS is_gibberish, round(least(1, score / 3), 4)::DOUBLE AS confidence FROM g")
def _v01(s, d):
    t = F.lower("description")
    score = sum((F.when(t.rlike(p), w).otherwise(0.0) for p, w in _GIB), F.lit(0.0)) + F.when(F.length(F.regexp_replace(t, "[^aeiou]", "")) < 0.15 * F.length(F.regexp_replace(t, "[^a-z]", "")), 1.5).otherwise(0.0)
    return items(s, d, keep="description IS NOT NULL").select("claim_id", "pos", score.alias("score"), (score >= 2).alias("is_gibberish"), F.round(F.least(F.lit(1.0), score / 3), 4).alias("confidence"))


_LABEL = r"^\s*(Name of Patient|Insured|Address|Mobile|E-mail|ID proof|Treating consultant)\s*:\s*(.+?)\s*$"


@book.add("e20_label_values", f"WITH {_LINES} SELECT scan_id, line_no, regexp_extract(line, '{_LABEL}', 1) AS label, regexp_extract(line, '{_LABEL}', 2) AS filled FROM lines WHERE regexp_matches(line, '{_LABEL}')")
def _e20(s, d):
    return lines(s, d).where(F.col("line").rlike(_LABEL)).select("scan_id", "line_no", F.regexp_extract("line", _LABEL, 1).alias("label"), F.regexp_extract("line", _LABEL, 2).alias("filled"))


_BY_CLAIM = "x AS (SELECT DISTINCT * FROM claim_extractions), n AS (SELECT TRY_CAST(regexp_extract(file_name, '^0*([0-9]+)', 1) AS BIGINT) AS claim_no, * FROM x), u AS (SELECT * FROM n WHERE claim_no IS NOT NULL)"


def by_claim(s, d):
    return extractions(s, d).withColumn("claim_no", F.regexp_extract("file_name", "^0*([0-9]+)", 1).try_cast("bigint")).where("claim_no IS NOT NULL")


@book.add("e52_best_per_label", f"WITH {_BY_CLAIM}, c AS (SELECT claim_no, 'hospital' AS label, hospital_name AS v, confidence, rec_id FROM u UNION ALL SELECT claim_no, 'patient', patient_name, confidence, rec_id FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY claim_no, label ORDER BY confidence DESC, rec_id) AS k FROM c WHERE v IS NOT NULL AND trim(v) <> '' AND confidence IS NOT NULL) SELECT claim_no, label, v AS best, confidence FROM r WHERE k = 1")
def _e52(s, d):
    cells = F.array(F.struct(F.lit("hospital").alias("label"), F.col("hospital_name").alias("v")), F.struct(F.lit("patient").alias("label"), F.col("patient_name").alias("v")))
    c = by_claim(s, d).select("claim_no", "confidence", "rec_id", F.inline(cells)).where("v IS NOT NULL AND trim(v) <> '' AND confidence IS NOT NULL")
    return c.groupBy("claim_no", "label").agg(F.max_by(F.struct("v", "confidence"), F.struct("confidence", -F.col("rec_id"))).alias("b")).select("claim_no", "label", F.col("b.v").alias("best"), "b.confidence")


@book.add("e53_hybrid_precedence", f"WITH {_BY_CLAIM}, a AS (SELECT claim_no, max(policy_number) AS a, max(confidence) AS ca FROM u WHERE lower(trim(extraction_method)) = 'pymupdf' AND regexp_matches(policy_number, '[0-9]{{4}}') GROUP BY 1), b AS (SELECT claim_no, max(policy_number) AS b FROM u WHERE lower(trim(extraction_method)) = 'tesseract' AND regexp_matches(policy_number, '[0-9]{{4}}') GROUP BY 1) SELECT coalesce(a.claim_no, b.claim_no) AS claim_no, CASE WHEN ca >= 0.7 THEN a ELSE coalesce(b, a) END AS policy, CASE WHEN ca >= 0.7 OR b IS NULL THEN 'text' ELSE 'scan' END AS source FROM a FULL JOIN b ON a.claim_no = b.claim_no")
def _e53(s, d):
    """A confident first extractor, else the second, else the unsure first: one aggregate instead of a full join of the table with itself."""
    m = F.lower(F.trim("extraction_method"))
    u = by_claim(s, d).where(F.col("policy_number").rlike("[0-9]{4}") & m.isin("pymupdf", "tesseract"))
    g = u.groupBy("claim_no").agg(F.max(F.when(m == "pymupdf", F.col("policy_number"))).alias("a"), F.max(F.when(m == "pymupdf", F.col("confidence"))).alias("ca"), F.max(F.when(m == "tesseract", F.col("policy_number"))).alias("b"))
    return g.select("claim_no", F.when(F.col("ca") >= 0.7, F.col("a")).otherwise(F.coalesce("b", "a")).alias("policy"), F.when((F.col("ca") >= 0.7) | F.col("b").isNull(), "text").otherwise("scan").alias("source"))


@book.add("v18_field_checks", f"WITH {CLAIMS_SQL} SELECT claim_id, coalesce(year(date_of_service) BETWEEN 1900 AND 2030, false) AS date_ok, coalesce(billed_amount > 0 AND billed_amount <= 10000000, false) AS amount_ok, coalesce(regexp_matches(npi_number, '^[0-9]{{10}}$'), false) AS npi_ok, coalesce(date_of_discharge >= date_of_admission, false) AS stay_ok FROM claims")
def _v18(s, d):
    ok = lambda c, n: F.coalesce(c, F.lit(False)).alias(n)
    return claims(s, d).select("claim_id", ok(F.year("date_of_service").between(1900, 2030), "date_ok"), ok((F.col("billed_amount") > 0) & (F.col("billed_amount") <= 10_000_000), "amount_ok"), ok(F.col("npi_number").rlike("^[0-9]{10}$"), "npi_ok"), ok(F.col("date_of_discharge") >= F.col("date_of_admission"), "stay_ok"))
