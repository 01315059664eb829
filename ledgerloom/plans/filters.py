"""Projections, filters and predicates over the worklist of claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.book import CLAIMS_SQL, CODES_SQL, ITEMS_SQL, Book
from ledgerloom.sources.tables import once, table

book = Book()
_OUT = ["claim_id", "claim_number", "status"]


def claims(spark, folder, *columns, keep: Column | str | None = None) -> DataFrame:
    return once(table(spark, folder, "claim", *columns), ["claim_id"], keep)


def any_column_contains(text: str, columns: list[str]) -> Column:
    """Some column contains the text, ignoring case; a match never spans two columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns])


def worklist(*, since: Column | None = None, until: Column | None = None, statuses: list[str] = (), insurers: list[str] = (), id_like: str = "") -> Column:
    """All filters of the worklist in one condition, which goes to the scan as a whole."""
    keep = [F.col("claim_id").isNotNull()]
    if since is not None:
        keep.append(F.col("date_of_service") >= since)
    if until is not None:
        keep.append(F.col("date_of_service") <= until)
    if statuses:
        keep.append(reduce(lambda a, b: a | b, [F.lower("status").contains(s.split(" ")[0].lower()) for s in statuses]))
    if insurers:
        keep.append(F.col("insurance_company").isin(*insurers))
    if id_like:
        keep.append(F.lower("claim_number").contains(id_like.lower()))
    return reduce(lambda a, b: a & b, keep)


@book.add("f01_any_column_contains", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, status FROM claims WHERE lower(claim_number) LIKE '%eye%' OR lower(hospital_name) LIKE '%eye%' OR lower(diagnosis) LIKE '%eye%' OR lower(notes) LIKE '%eye%'")
def _f01(s, d):
    return claims(s, d, keep=any_column_contains("EYE", ["claim_number", "hospital_name", "diagnosis", "notes"])).select(*_OUT)


@book.add("f02_date_range", f"WITH {CLAIMS_SQL}, t AS (SELECT max(date_of_service) AS as_of FROM claims) SELECT claim_id, claim_number, status FROM claims, t WHERE date_of_service >= as_of - INTERVAL 90 DAY AND date_of_service <= as_of")
def _f02(s, d):
    # One row comes to the driver: the last day, which the scan can then be filtered by.
    as_of = table(s, d, "claim", "date_of_service").agg(F.max("date_of_service")).first()[0]
    return claims(s, d, keep=worklist(since=F.date_sub(F.lit(as_of), 90), until=F.lit(as_of))).select(*_OUT)


@book.add("f03_id_contains", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, status FROM claims WHERE lower(claim_number) LIKE '%cl 0%'")
def _f03(s, d):
    return claims(s, d, keep=worklist(id_like="CL 0")).select(*_OUT)


@book.add("f04_status_words", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, status FROM claims WHERE lower(status) LIKE '%query%' OR lower(status) LIKE '%approved%'")
def _f04(s, d):
    return claims(s, d, keep=worklist(statuses=["Query raised", "Approved in full"])).select(*_OUT)


@book.add("f05_in_list", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, status FROM claims WHERE insurance_company IN ('Kaveto General', 'Bimarak Health')")
def _f05(s, d):
    return claims(s, d, keep=worklist(insurers=["Kaveto General", "Bimarak Health"])).select(*_OUT)


@book.add("f06_drill_down", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, status FROM claims WHERE room_type = 'ICU'")
def _f06(s, d):
    return claims(s, d, keep="room_type = 'ICU'").select(*_OUT)


RULES = (
    ("eye house", "hospital_name", "contains", "eye", "low"),
    ("cataract", "diagnosis", "equals", "Senile cataract", "medium"),
    ("large bill", "billed_amount", "gt", "100,000", "high"),
    ("large bill sign", "billed_amount", ">", "$200000", "high"),
    ("small bill", "billed_amount", "<", "1000", "low"),
    ("intensive care", "room_type", "=", "ICU", "medium"),
)
_RULES_SQL = "rules(name, field, op, val, severity) AS (VALUES " + ", ".join(str(r) for r in RULES) + ")"
_FIELDS = ("hospital_name", "diagnosis", "billed_amount", "room_type")


def rule_hits(frame: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(claim_id, name, severity, evidence, confidence) for every rule a row meets.

    The rules are a handful of rows written in code, so they fold into one array per row: no join, one pass.
    """
    plain = lambda c: F.regexp_replace(c, r"[$,]", "").try_cast("double")
    hits = []
    for name, field, op, value, severity in rules:
        text = F.col(field).cast("string")
        number, bound = plain(text), float(value.replace("$", "").replace(",", "")) if op in ("gt", ">", "lt", "<") else None
        met = {"contains": F.lower(text).contains(value.lower()), "equals": text == value, "=": text == value, "gt": number > bound if bound is not None else None, ">": number > bound if bound is not None else None, "lt": number < bound if bound is not None else None, "<": number < bound if bound is not None else None}[op]
        confidence = 0.85 if op == "contains" else 0.9 if op in ("equals", "=") else 0.8
        hits.append(F.when(met, F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), text.alias("evidence"), F.lit(confidence).alias("confidence"))))
    return frame.select("claim_id", "npi_number", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("claim_id", "npi_number", "h.name", "h.severity", "h.evidence", "h.confidence")


_HITS_SQL = f"""WITH {CLAIMS_SQL}, {_RULES_SQL},
 cells AS (SELECT claim_id, npi_number, f.field, CASE f.field WHEN 'hospital_name' THEN hospital_name WHEN 'diagnosis' THEN diagnosis WHEN 'room_type' THEN room_type ELSE CAST(billed_amount AS VARCHAR) END AS v, billed_amount AS n
   FROM claims, (VALUES ('hospital_name'), ('diagnosis'), ('billed_amount'), ('room_type')) f(field)),
 hits AS (SELECT claim_id, npi_number, name, severity, CASE WHEN op = 'contains' THEN 0.85 WHEN op IN ('equals', '=') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM cells JOIN rules USING (field)
   WHERE (op = 'contains' AND lower(v) LIKE '%' || lower(val) || '%') OR (op IN ('equals', '=') AND v = val)
      OR (op IN ('gt', '>') AND n > TRY_CAST(replace(replace(val, '$', ''), ',', '') AS DOUBLE)) OR (op IN ('lt', '<') AND n < TRY_CAST(replace(replace(val, '$', ''), ',', '') AS DOUBLE)))"""


@book.add("f07_rule_confidence", _HITS_SQL + " SELECT name, confidence, count(*)::BIGINT AS hits FROM hits GROUP BY ALL")
def _f07(s, d):
    return rule_hits(claims(s, d)).groupBy("name", "confidence").agg(F.count(F.lit(1)).alias("hits"))


@book.add("f08_rule_hits", _HITS_SQL + " SELECT claim_id, name, severity, confidence FROM hits")
def _f08(s, d):
    return rule_hits(claims(s, d)).select("claim_id", "name", "severity", "confidence")


@book.add("f09_whitelist", _HITS_SQL + ", white AS (SELECT npi_number FROM claims WHERE npi_number IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) SELECT claim_id, name FROM hits WHERE npi_number IS NULL OR npi_number NOT IN (SELECT npi_number FROM white)")
def _f09(s, d):
    c = claims(s, d)
    white = c.where("npi_number IS NOT NULL").groupBy("npi_number").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return rule_hits(c).join(white, "npi_number", "left_anti").select("claim_id", "name")


@book.add("f10_code_filter", f"WITH {CODES_SQL} SELECT code_id, code, confidence FROM codes WHERE regexp_matches(upper(code), '^[A-Z][0-9]{{2}}(\\.[0-9]{{1,4}})?$') AND confidence >= 0.7")
def _f10(s, d):
    return once(table(s, d, "claim_codes", "code_id", "code", "confidence"), ["code_id"], F.upper("code").rlike(r"^[A-Z][0-9]{2}(\.[0-9]{1,4})?$") & (F.col("confidence") >= 0.7))


@book.add(
    "f11_previews",
    f"WITH {ITEMS_SQL}, r AS (SELECT claim_id, description, row_number() OVER (PARTITION BY claim_id ORDER BY amount DESC NULLS LAST, pos) AS k FROM items) SELECT claim_id, string_agg(coalesce(substr(description, 1, 12), '?'), '; ' ORDER BY k) AS top_items FROM r WHERE k <= 5 GROUP BY 1",
)
def _f11(s, d):
    # The five largest by a bounded aggregate would need a UDAF; the window's rank limit is pushed below the shuffle.
    from pyspark.sql import Window

    items = table(s, d, "claim_items", "claim_id", "pos", "description", "amount", "quantity", "unit_price", "code", "category", "confidence").distinct()
    k = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.col("amount").desc_nulls_last(), "pos"))
    top = items.withColumn("k", k).where("k <= 5")
    return top.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(F.substring("description", 1, 12), F.lit("?")).alias("t")))), lambda x: x["t"]), "; ").alias("top_items"))


STANDARD = {"claimant_name": "patient_name", "npi_number": "provider_id", "billed_amount": "total_amount"}


@book.add("f12_standard_names", f"WITH {CLAIMS_SQL} SELECT claim_id, claimant_name AS patient_name, npi_number AS provider_id, billed_amount AS total_amount FROM claims")
def _f12(s, d):
    return claims(s, d, "claim_id", *STANDARD).withColumnsRenamed(STANDARD)


@book.add("f13_unknown_provider", f"WITH {CLAIMS_SQL}, known AS (SELECT DISTINCT npi_number FROM claims WHERE lower(trim(status)) = 'approved' AND npi_number IS NOT NULL) SELECT claim_id, npi_number FROM claims WHERE npi_number IS NULL OR npi_number NOT IN (SELECT npi_number FROM known)")
def _f13(s, d):
    c = claims(s, d)
    known = c.where("lower(trim(status)) = 'approved' AND npi_number IS NOT NULL").select("npi_number").distinct()
    return c.join(known, "npi_number", "left_anti").select("claim_id", "npi_number")


_COMPARED = ["hospital_name", "diagnosis", "room_type", "status", "insurance_company"]


@book.add(
    "f14_side_by_side",
    f"WITH {CLAIMS_SQL}, u AS (" + " UNION ALL ".join(f"SELECT claim_id, '{c}' AS attribute, {c} AS v FROM claims WHERE claim_id IN (5, 9)" for c in _COMPARED) + ") SELECT attribute, max(CASE WHEN claim_id = 5 THEN v END) AS left_value, max(CASE WHEN claim_id = 9 THEN v END) AS right_value FROM u GROUP BY 1",
)
def _f14(s, d):
    two = claims(s, d, keep="claim_id IN (5, 9)").unpivot("claim_id", _COMPARED, "attribute", "v")
    return two.groupBy("attribute").agg(F.max(F.when(F.col("claim_id") == 5, F.col("v"))).alias("left_value"), F.max(F.when(F.col("claim_id") == 9, F.col("v"))).alias("right_value"))
