"""Sources and sinks as queries: what is written is read back and held against the table it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.durable import ensure_checkpoint_dir, released
from ledgerloom.plans.book import AUDIT_SQL, CLAIMS_SQL, Book
from ledgerloom.plans.filters import claims
from ledgerloom.plans.metrics import audit
from ledgerloom.sources import files
from ledgerloom.sources.tables import table

book = Book()


def _folder(s) -> str:
    """A folder of this query's own on the shared storage; it goes when the application ends."""
    return released(s, f"{ensure_checkpoint_dir(s)}/files-{uuid.uuid4().hex}")


@book.add("s03_decoded_texts", "SELECT DISTINCT scan_id, raw_text_preview AS text, e AS encoding FROM scan_texts, (VALUES ('utf-8'), ('utf-8-sig'), ('utf-16')) x(e) WHERE raw_text_preview IS NOT NULL")
def _s03(s, d):
    """Texts written in three encodings and read without being told which."""
    t = table(s, d, "scan_texts", "scan_id", "raw_text_preview").where("raw_text_preview IS NOT NULL").distinct()
    text = F.col("raw_text_preview")
    raw = {"utf-8": F.encode(text, "UTF-8"), "utf-8-sig": F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")), "utf-16": F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))}
    rows = t.select("scan_id", F.inline(F.array(*[F.struct(F.lit(e).alias("encoding"), r.alias("raw")) for e, r in raw.items()])))
    return rows.select("scan_id", files.decoded(F.col("raw")).alias("text"), "encoding")


@book.add("s05_document_files", f"WITH {CLAIMS_SQL} SELECT insurance_company, count(*)::BIGINT AS claims FROM claims WHERE insurance_company IS NOT NULL GROUP BY 1")
def _s05(s, d):
    """A folder of text files by insurer, scanned as binary files and counted by line."""
    at = _folder(s)
    named = claims(s, d, "claim_id", "insurance_company", keep="insurance_company IS NOT NULL")
    named.select("insurance_company", F.col("claim_id").cast("string").alias("value")).repartition("insurance_company").write.partitionBy("insurance_company").text(at)
    scanned = files.documents_of(s, at, "*.txt").select(F.regexp_extract("path", "insurance_company=([^/]+)/", 1).alias("folder"), files.decoded(F.col("content")).alias("text"))
    counted = scanned.select(F.url_decode("folder").alias("insurance_company"), F.regexp_count("text", F.lit("\n")).alias("k"))
    return counted.groupBy("insurance_company").agg(F.sum("k").cast("bigint").alias("claims"))


@book.add("s06_newest_reports", f"WITH {CLAIMS_SQL} SELECT least(5, count(DISTINCT status))::BIGINT AS listed, true AS in_order FROM claims WHERE status IS NOT NULL")
def _s06(s, d):
    at = _folder(s)
    sinks.write_json(claims(s, d, "claim_id", "status", keep="status IS NOT NULL").withColumn("part", F.dense_rank().over(_by_status())).repartition("part"), at, "part")
    top = files.newest(s, at, "*.json", 5)
    ranked = top.agg(F.count(F.lit(1)).alias("listed"), F.collect_list("modified").alias("m"))
    return ranked.select("listed", (F.col("m") == F.sort_array("m", asc=False)).alias("in_order"))


def _by_status():
    from pyspark.sql import Window

    # The distinct values of status are a short list of words; the rank only names the report files.
    return Window.orderBy("status")


_S7 = "claim_id BIGINT, claim_number STRING, hospital_name STRING, notes STRING, billed_amount DOUBLE, date_of_service DATE"
_S7_NAMES = [c.split()[0] for c in _S7.split(", ")]
_S7_SQL = f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, hospital_name, notes, billed_amount, date_of_service FROM claims"


@book.add("s07_csv_import", _S7_SQL)
def _s07(s, d):
    at = _folder(s)
    sinks.write_csv(claims(s, d, *_S7_NAMES).fillna("\x00", ["claim_number", "hospital_name", "notes"]), at)
    back = files.read_csv(s, at, _S7).where("_broken IS NULL")
    return back.select("claim_id", *[F.nullif(F.col(c), F.lit("\x00")).alias(c) for c in ("claim_number", "hospital_name", "notes")], "billed_amount", "date_of_service")


@book.add("s07_json_import", _S7_SQL)
def _s07j(s, d):
    at = _folder(s)
    sinks.write_json(claims(s, d, *_S7_NAMES), at)
    return files.read_json(s, at, _S7)


_ENVELOPES = "WITH r AS (SELECT DISTINCT raw_id, payload FROM raw_extractions)"


def _enveloped(s, d):
    r = table(s, d, "raw_extractions", "raw_id", "payload").where("raw_id IS NOT NULL").distinct()
    kind = F.when(F.col("raw_id") % 3 == 0, "STATE").otherwise("RECORD")
    return r.select("raw_id", F.concat(F.lit('{"type": "'), kind, F.lit('", "record": {"data": {"row": '), F.coalesce("payload", F.lit("null")), F.lit("}}}")).alias("value"))


@book.add("s08_envelope_rows", _ENVELOPES + " SELECT raw_id, json_extract_string(payload, '$.claim_id') AS claim_id FROM r WHERE raw_id % 3 <> 0 AND json_valid(payload) AND json_type(payload) <> 'NULL'")
def _s08_rows(s, d):
    return files.envelopes(_enveloped(s, d))[0].select("raw_id", F.try_variant_get("row", "$.claim_id", "string").alias("claim_id"))


@book.add("s08_envelope_counts", _ENVELOPES + " SELECT CASE WHEN payload IS NOT NULL AND NOT json_valid(payload) THEN 'broken' WHEN raw_id % 3 = 0 THEN 'other type' WHEN payload IS NULL OR json_type(payload) = 'NULL' THEN 'no row' ELSE 'record' END AS verdict, count(*)::BIGINT AS n FROM r WHERE raw_id IS NOT NULL GROUP BY 1")
def _s08_counts(s, d):
    return files.envelopes(_enveloped(s, d))[1]


@book.add("k01_claim_files", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number, status, billed_amount FROM claims")
def _k01(s, d):
    at = _folder(s)
    sinks.write_json(claims(s, d, "claim_id", "claim_number", "status", "billed_amount"), at)
    return files.read_json(s, at, "claim_id BIGINT, claim_number STRING, status STRING, billed_amount DOUBLE")


@book.add("k03_appended_events", f"WITH {AUDIT_SQL} SELECT log_id, claim_id, action_name FROM audit")
def _k03(s, d):
    at = _folder(s)
    a = audit(s, d).select("log_id", "claim_id", "action_name", F.year("logged_at").alias("y"))
    sinks.append_events(a.where("y <= 2023").drop("y"), at)
    sinks.append_events(a.where("NOT coalesce(y <= 2023, false)").drop("y"), at)
    return s.read.schema("log_id BIGINT, claim_id STRING, action_name STRING").parquet(at)


@book.add("k04_by_engine", "WITH x AS (SELECT DISTINCT * FROM claim_extractions) SELECT engine, count(*)::BIGINT AS records, count(policy_number)::BIGINT AS policies FROM (SELECT lower(trim(extraction_method)) AS engine, policy_number FROM x WHERE extraction_method IS NOT NULL) GROUP BY 1")
def _k04(s, d):
    """Each engine's results in a folder of its own; a query on one engine reads that folder only."""
    at = _folder(s)
    x = table(s, d, "claim_extractions", "rec_id", "extraction_method", "policy_number").where("extraction_method IS NOT NULL").dropDuplicates(["rec_id"])
    x.select("rec_id", "policy_number", F.lower(F.trim("extraction_method")).alias("engine")).write.partitionBy("engine").parquet(at)
    return s.read.schema("rec_id BIGINT, policy_number STRING, engine STRING").parquet(at).groupBy("engine").agg(F.count(F.lit(1)).alias("records"), F.count("policy_number").alias("policies"))


@book.add("k05_exports", _S7_SQL.replace("claim_id, claim_number, hospital_name, notes, billed_amount, date_of_service FROM", "'csv' AS kind, count(*)::BIGINT AS n, round(sum(billed_amount), 2) AS billed FROM") + " UNION ALL SELECT 'json', count(*)::BIGINT, round(sum(billed_amount), 2) FROM claims")
def _k05(s, d):
    c, csv, json = claims(s, d, *_S7_NAMES), _folder(s), _folder(s)
    sinks.write_csv(c, csv)
    sinks.write_json(c, json)
    total = lambda frame, kind: frame.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("billed_amount"), 2).alias("billed"))
    return total(files.read_csv(s, csv, _S7), "csv").unionByName(total(files.read_json(s, json, _S7), "json"))


@book.add("k06_corpora", "SELECT 'text' AS task, count(DISTINCT doc_id)::BIGINT AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'scan', count(DISTINCT scan_id)::BIGINT FROM scan_texts WHERE raw_text_preview IS NOT NULL UNION ALL SELECT 'code', count(DISTINCT code_id)::BIGINT FROM claim_codes WHERE context IS NOT NULL")
def _k06(s, d):
    part = lambda t, k, c, task: table(s, d, t, k, c).where(f"{c} IS NOT NULL AND {k} IS NOT NULL").distinct().select(F.lit(task).alias("task"), F.concat_ws("_", F.lit(task), k).alias("example"), F.col(c).alias("text"))
    u = part("documents", "doc_id", "text", "text").unionByName(part("scan_texts", "scan_id", "raw_text_preview", "scan")).unionByName(part("claim_codes", "code_id", "context", "code"))
    return sinks.write_corpora(u, _folder(s))


@book.add("k07_search", f"WITH {CLAIMS_SQL} SELECT claim_id, status, billed_amount FROM claims WHERE lower(hospital_name) LIKE '%nursing%' AND billed_amount >= 50000 ORDER BY billed_amount DESC, claim_id LIMIT 20")
def _k07(s, d):
    """The search of the service surface: a filter and the twenty largest."""
    c = claims(s, d, "claim_id", "status", "billed_amount", "hospital_name", keep=F.lower("hospital_name").contains("nursing") & (F.col("billed_amount") >= 50000))
    return c.orderBy(F.col("billed_amount").desc(), "claim_id").limit(20).select("claim_id", "status", "billed_amount")


@book.add("k07_status_update", f"WITH {CLAIMS_SQL}, {AUDIT_SQL}, u AS (SELECT TRY_CAST(regexp_extract(claim_id, '([0-9]+)', 1) AS BIGINT) AS claim_id, json_extract_string(details, '$.to') AS status, logged_at, log_id FROM audit WHERE json_valid(details) AND json_extract_string(details, '$.to') IS NOT NULL AND regexp_matches(claim_id, '[0-9]')), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY logged_at DESC NULLS LAST, log_id DESC) AS k FROM u) SELECT c.claim_id, coalesce(r.status, c.status) AS status FROM claims c LEFT JOIN r ON c.claim_id = r.claim_id AND k = 1")
def _k07_status(s, d):
    """Updates reach the claim they name, the latest winning, in one aggregate over both."""
    a = audit(s, d, keep=F.col("claim_id").rlike("[0-9]")).withColumn("status", F.try_variant_get(F.try_parse_json("details"), "$.to", "string")).where("status IS NOT NULL")
    updates = sinks.latest(a.select(F.regexp_extract("claim_id", "([0-9]+)", 1).try_cast("bigint").alias("claim_id"), "status", "logged_at", "log_id"), ["claim_id"], F.col("logged_at"), F.col("log_id"))
    return claims(s, d, "claim_id", "status").join(updates.select("claim_id", F.col("status").alias("u")), "claim_id", "left").select("claim_id", F.coalesce("u", "status").alias("status"))
