"""The llm queries by name: (spark, folder) -> DataFrame; oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import addresses, encode, names, packing, pii, repair, sentences, survivor
from ledgerloom.sources.tables import table

#: Tokens of a container in p8.
CAPACITY = 2048

Query = Callable[[SparkSession, str], DataFrame]


def p1_places(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.places(table(spark, folder, "facility_addresses"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.place_pairs(p1_places(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repair.noise(table(spark, folder, "scan_texts"), table(spark, folder, "claim_codes"))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired(table(spark, folder, "scan_texts"), table(spark, folder, "claim_codes"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal(table(spark, folder, "scan_texts"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "scan_texts"))


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.entities(table(spark, folder, "identity_sources"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(p5_entities(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.survivors(table(spark, folder, "claim_extractions"), table(spark, folder, "extraction_methods"))


def p6_fused(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.fused(table(spark, folder, "claim_extractions"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.token_ids(table(spark, folder, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, folder, "documents", "doc_id", "text"))
    return packing.pack(sizes, CAPACITY)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: one row."""
    return packing.fill_report(p8_containers(spark, folder), CAPACITY)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.units(table(spark, folder, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_places": p1_places, "p3_found": p3_found, "p3_text": p3_text, "p4_found": p4_found, "p4_text": p4_text, "p5_found": p5_found, "p5_entities": p5_entities, "p6_found": p6_found, "p6_fused": p6_fused, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found}


_NO_VALUE = ", ".join(f"'{w}'" for w in (*survivor.PLACEHOLDERS, *survivor.FORM_WORDING))
_DAY = """CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN TRY_STRPTIME(t, '%Y-%m-%d')
 WHEN regexp_matches(t, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$') THEN TRY_STRPTIME(t, '%d-%m-%Y') WHEN regexp_matches(t, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$') THEN TRY_STRPTIME(regexp_replace(t, '-([0-9]{2})$', '-20\\1'), '%d-%m-%Y')
 WHEN regexp_matches(t, '^[0-9]{1,2}-[a-z]{3,9}-[0-9]{4}$') THEN TRY_STRPTIME(regexp_replace(t, '^([0-9]{1,2}-[a-z]{3})[a-z]*', '\\1'), '%d-%b-%Y') END"""
_P6 = f"""WITH x AS (SELECT DISTINCT * FROM claim_extractions),
 m AS (SELECT regexp_replace(lower(trim(extraction_method)), '[\\s-]+', '_', 'g') AS method, min(trust_rank) AS rank FROM extraction_methods GROUP BY 1),
 b AS (SELECT x.*, coalesce(rank, 1000000) AS rank, CASE WHEN file_name IS NOT NULL THEN TRY_CAST(regexp_extract(trim(file_name), '^0*([0-9]{{1,18}})', 1) AS BIGINT) ELSE TRY_CAST(regexp_extract(trim(claim_id), '^(?:[Cc][Ll](?:[Aa][Ii][Mm])?[-_ #/]*)?0*([0-9]{{1,18}})(?:$|[^0-9])', 1) AS BIGINT) END AS claim_no
   FROM x LEFT JOIN m ON regexp_replace(lower(trim(extraction_method)), '[\\s-]+', '_', 'g') = method),
 c AS (SELECT * FROM b WHERE claim_no IS NOT NULL AND rec_id IS NOT NULL AND claim_no IN (SELECT claim_no FROM b GROUP BY 1 HAVING count(DISTINCT rec_id) > 1)),
 u AS (SELECT claim_no, rec_id, rank, extracted_at, 'policy_number' AS field_name, policy_number AS v FROM c UNION ALL SELECT claim_no, rec_id, rank, extracted_at, 'hospital_name', hospital_name FROM c UNION ALL SELECT claim_no, rec_id, rank, extracted_at, 'patient_name', patient_name FROM c
   UNION ALL SELECT claim_no, rec_id, rank, extracted_at, 'dob', dob FROM c UNION ALL SELECT claim_no, rec_id, rank, extracted_at, 'admission_date', admission_date FROM c UNION ALL SELECT claim_no, rec_id, rank, extracted_at, 'discharge_date', discharge_date FROM c
   UNION ALL SELECT claim_no, rec_id, rank, extracted_at, 'total_amount', CAST(total_amount AS VARCHAR) FROM c),
 w AS (SELECT *, regexp_replace(lower(trim(v)), '[./,\\s-]+', '-', 'g') AS t, regexp_replace(lower(trim(v)), '\\s+', ' ', 'g') AS f FROM u WHERE v IS NOT NULL),
 ok AS (SELECT * FROM w WHERE CASE WHEN field_name = 'total_amount' THEN TRY_CAST(v AS DOUBLE) > 0 AND TRY_CAST(v AS DOUBLE) <= {survivor.MOST}
   WHEN field_name IN ('dob', 'admission_date', 'discharge_date') THEN ({_DAY}) BETWEEN TIMESTAMP '1850-01-01' AND TIMESTAMP '2100-12-31'
   WHEN f IN ({_NO_VALUE}) OR NOT regexp_matches(f, '[a-z0-9]') THEN false WHEN field_name = 'policy_number' THEN regexp_matches(v, '[0-9].*[0-9].*[0-9].*[0-9]')
   WHEN field_name = 'patient_name' THEN regexp_matches(v, '[A-Za-z]{{2}}') AND NOT regexp_matches(v, '(?i)\\b(hospital|clinic|diagnostics|nursing home)\\b') ELSE regexp_matches(v, '[A-Za-z]{{2}}') END),
 r AS (SELECT *, row_number() OVER (PARTITION BY claim_no, field_name ORDER BY rank, extracted_at DESC NULLS LAST, rec_id DESC) AS k FROM ok)
 SELECT claim_no, field_name, rec_id FROM r WHERE k = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _P6}
