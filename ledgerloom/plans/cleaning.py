"""Cleaning of extracted values: word validity, templates, amounts, items, diagnoses, and the report of what was dropped."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.plans.book import CLAIMS_SQL, ITEMS_SQL, Book
from ledgerloom.plans.extraction import _LINES, by_claim, extractions, lines
from ledgerloom.plans.filters import claims
from ledgerloom.plans.metrics import items
from ledgerloom.sources.tables import table

book = Book()

#: Wording of form templates, which is no diagnosis, procedure or item (each ignoring case).
TEMPLATES = (
    "infectious.*parasitic.*diseases", "pregnancy.*childbirth.*puerperium", "eye.*ear.*diseases", "mental.*behavioral.*disorders", "diseases\\s+of\\s+the\\s+(?:eye|ear|skin|nervous|circulatory)",
    "certain\\s+conditions\\s+originating", "congenital\\s+malformations", "factors\\s+influencing\\s+health", "symptoms.*signs.*abnormal.*findings", "external\\s+causes\\s+of\\s+morbidity", "codes\\s+for\\s+special\\s+purposes",
    "tick\\s+(?:the\\s+)?(?:appropriate|relevant)", "please\\s+(?:tick|mark|select)", "if\\s+(?:yes|no|applicable)", "\\(\\s*\\)\\s*yes\\s*\\(\\s*\\)\\s*no", "form\\s+instructions?",
    "^\\s*reg\\.?\\s*no\\.?\\s*:?\\s*\\d", "^\\s*r\\.?\\s*no\\.?\\s*:?\\s*\\d", "^\\s*bill\\s*no\\.?\\s*:?\\s*\\d", "^\\s*date\\s*:?\\s*[\\d/\\-]", "^\\s*time\\s*:?\\s*[\\d:]", "^\\s*patient\\s*(?:name|id|no)",
)
_TEMPLATE = "(?i)" + "|".join(f"(?:{t})" for t in TEMPLATES)
#: Wording that makes a description a real item whatever else it looks like, and explicit signs of misreading.
BILLING_WORDS = "charge|fee|room|bed|icu|surgery|operation|medicine|pharmacy|consult|nursing|lab|test|scan|x-ray|injection|implant|theatre|anaesth"
GARBLED = ("[bcdfghjklmnpqrstvwxyz]{6,}", "[|!]{2,}", "[\\[\\]{}]{3,}", "[0-9][a-z][0-9][a-z][0-9]")
_GARBLED = "|".join(GARBLED)


def is_template(c):
    return F.coalesce(c.rlike(_TEMPLATE), F.lit(False))


def is_garbled(c):
    """Signs of misreading, unless a billing word stands in it."""
    low = F.lower(c)
    return F.coalesce(~low.rlike(BILLING_WORDS) & low.rlike(_GARBLED), F.lit(False))


def valid_word(w):
    """A word of language by its shape: short words and figures pass, words without vowels or with two consonant runs don't."""
    low = F.lower(F.regexp_replace(w, "^[.,!?;:()\\[\\]{}]+|[.,!?;:()\\[\\]{}]+$", ""))
    vowels, consonants = F.length(F.regexp_replace(low, "[^aeiou]", "")), F.length(F.regexp_replace(low, "[^bcdfghjklmnpqrstvwxyz]", ""))
    figures = F.regexp_replace(low, "[.,]", "").rlike("^[0-9]+$")
    clusters = F.regexp_count(low, F.lit("[bcdfghjklmnpqrstvwxyz]{3,}"))
    bad = (F.length(low) > 3) & (((vowels == 0) & (consonants > 2)) | (consonants > 0.85 * F.length(low)) | (clusters >= 2))
    return (F.length(low) < 3) | figures | ~bad


_STRIP = "lower(regexp_replace({0}, '^[.,!?;:()\\[\\]{{}}]+|[.,!?;:()\\[\\]{{}}]+$', '', 'g'))"


def _valid_sql(w: str) -> str:
    low = _STRIP.format(w)
    consonants, vowels = f"length(regexp_replace({low}, '[^bcdfghjklmnpqrstvwxyz]', '', 'g'))", f"length(regexp_replace({low}, '[^aeiou]', '', 'g'))"
    return f"(length({low}) < 3 OR regexp_matches(regexp_replace({low}, '[.,]', '', 'g'), '^[0-9]+$') OR NOT (length({low}) > 3 AND (({vowels} = 0 AND {consonants} > 2) OR {consonants} > 0.85 * length({low}) OR len(regexp_extract_all({low}, '[bcdfghjklmnpqrstvwxyz]{{3,}}')) >= 2)))"


@book.add("v02_invalid_words", f"WITH {ITEMS_SQL}, w AS (SELECT claim_id, pos, unnest(string_split(trim(regexp_replace(description, '\\s+', ' ', 'g')), ' ')) AS w FROM items WHERE description IS NOT NULL) SELECT claim_id, pos, count(*)::BIGINT AS words, count(*) FILTER (WHERE NOT {_valid_sql('w')})::BIGINT AS invalid FROM w GROUP BY 1, 2")
def _v02(s, d):
    words = F.split(T.squeeze(F.col("description")), " ")
    return items(s, d, keep="description IS NOT NULL").select("claim_id", "pos", F.size(words).cast("bigint").alias("words"), F.size(F.filter(words, lambda w: ~valid_word(w))).cast("bigint").alias("invalid"))


@book.add("v05_clean_lines", f"WITH {_LINES}, j AS (SELECT scan_id, line_no, line, regexp_matches(lower(line), '{_GARBLED}') AND NOT regexp_matches(lower(line), '{BILLING_WORDS}') AS bad FROM lines) SELECT scan_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT bad), '') AS text, round(avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END), 6) AS clean_share FROM j GROUP BY 1")
def _v05(s, d):
    """Texts without their garbled lines: a filter over the lines as an array, so no line is shuffled."""
    t = table(s, d, "scan_texts", "scan_id", "raw_text_preview").where("raw_text_preview IS NOT NULL AND scan_id IS NOT NULL").dropDuplicates(["scan_id"])
    every = F.split("raw_text_preview", "\n")
    kept = F.filter(every, lambda x: ~is_garbled(x))
    return t.select("scan_id", F.array_join(kept, "\n").alias("text"), F.round(F.size(kept) / F.size(every), 6).alias("clean_share"))


@book.add("v13_templates", f"WITH {ITEMS_SQL} SELECT claim_id, pos, coalesce(regexp_matches(description, '{_TEMPLATE}'), false) AS template FROM items")
def _v13(s, d):
    return items(s, d).select("claim_id", "pos", is_template(F.col("description")).alias("template"))


@book.add("v12_garbled_descriptions", f"WITH {ITEMS_SQL} SELECT claim_id, pos, coalesce(NOT regexp_matches(lower(description), '{BILLING_WORDS}') AND regexp_matches(lower(description), '{_GARBLED}'), false) AS garbled FROM items")
def _v12(s, d):
    return items(s, d).select("claim_id", "pos", is_garbled(F.col("description")).alias("garbled"))


#: What a line item and a whole bill may come to, and figures that are ids, postal codes or dates.
RANGES = {"line_item": (1, 1_000_000), "total_bill": (1_000, 50_000_000)}
NOT_AMOUNTS = "^(?:[0-9]{10,}|[0-9]{8})$"


def cleaned_amount(c, kind: str):
    """(cleaned, reason): null and why, where the amount is out of range or reads like an id."""
    low, high = RANGES[kind]
    reason = F.when(c.isNull(), None).when(~c.between(low, high), "out of range").when(c.cast("bigint").cast("string").rlike(NOT_AMOUNTS), "like an id")
    return F.when(reason.isNull(), c), reason


def _amount_sql(c: str, kind: str) -> str:
    low, high = RANGES[kind]
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN NOT ({c} BETWEEN {low} AND {high}) THEN 'out of range' WHEN regexp_matches(CAST(CAST(trunc({c}) AS BIGINT) AS VARCHAR), '{NOT_AMOUNTS}') THEN 'like an id' END"


@book.add("v10_clean_amounts", f"WITH {CLAIMS_SQL}, u AS (SELECT claim_id, 'billed_amount' AS field, billed_amount AS v, {_amount_sql('billed_amount', 'total_bill')} AS reason FROM claims UNION ALL SELECT claim_id, 'total_itemized', total_itemized, {_amount_sql('total_itemized', 'total_bill')} FROM claims) SELECT claim_id, field, CASE WHEN reason IS NULL THEN v END AS cleaned, reason FROM u")
def _v10(s, d):
    cells = F.array(*[F.struct(F.lit(c).alias("field"), cleaned_amount(F.col(c), "total_bill")[0].alias("cleaned"), cleaned_amount(F.col(c), "total_bill")[1].alias("reason")) for c in ("billed_amount", "total_itemized")])
    return claims(s, d, "claim_id", "billed_amount", "total_itemized").select("claim_id", F.inline(cells))


def item_reason(t, a):
    """Why an item is dropped; null if it stays."""
    return F.when(t.isNull() | (F.length(F.trim(t)) < 3), "short").when(is_garbled(t), "garbled").when(is_template(t), "template").when(a.isNull() | (a <= 0) | (a > 50_000_000), "amount")


_ITEM_SQL = f"CASE WHEN description IS NULL OR length(trim(description)) < 3 THEN 'short' WHEN NOT regexp_matches(lower(description), '{BILLING_WORDS}') AND regexp_matches(lower(description), '{_GARBLED}') THEN 'garbled' WHEN regexp_matches(description, '{_TEMPLATE}') THEN 'template' WHEN amount IS NULL OR amount <= 0 OR amount > 50000000 THEN 'amount' END"


@book.add("v09_item_reasons", f"WITH {ITEMS_SQL} SELECT claim_id, pos, {_ITEM_SQL} AS reason FROM items")
def _v09(s, d):
    return items(s, d).select("claim_id", "pos", item_reason(F.col("description"), F.col("amount")).alias("reason"))


_PARTS = "list_filter(list_transform(string_split_regex(diagnosis, '[,;/|]'), lambda x: trim(x)), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '{0}'))".format(_TEMPLATE)


@book.add("v11_clean_diagnoses", f"WITH {CLAIMS_SQL} SELECT claim_id, nullif(array_to_string({_PARTS}, ', '), '') AS diagnosis, array_to_string(list_filter(procedure_list, lambda x: length(trim(x)) >= 3 AND NOT regexp_matches(x, '{_TEMPLATE}')), ';') AS procedures FROM claims")
def _v11(s, d):
    parts = F.filter(F.transform(F.split("diagnosis", "[,;/|]"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 3) & ~x.rlike(_TEMPLATE))
    kept = F.filter("procedure_list", lambda x: (F.length(F.trim(x)) >= 3) & ~x.rlike(_TEMPLATE))
    return claims(s, d, "claim_id", "diagnosis", "procedure_list").select("claim_id", F.nullif(F.array_join(parts, ", "), F.lit("")).alias("diagnosis"), F.array_join(kept, ";").alias("procedures"))


_V8 = f"WITH {CLAIMS_SQL}, {ITEMS_SQL}, j AS (SELECT claim_id, amount, {_ITEM_SQL} AS reason FROM items), v AS (SELECT claim_id, count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS dropped, sum(amount) FILTER (WHERE reason IS NULL) AS kept_sum FROM j GROUP BY 1)"


def cleaned_claims(s, d):
    """Claims with their items judged once: how many were dropped, the sum of the rest, and the total that stands."""
    reason = item_reason(F.col("description"), F.col("amount"))
    v = items(s, d).groupBy("claim_id").agg(F.count_if(reason.isNotNull()).alias("dropped"), F.sum(F.when(reason.isNull(), F.col("amount"))).alias("kept_sum"))
    return claims(s, d, "claim_id", "billed_amount", "diagnosis").join(v, "claim_id", "left")


@book.add("v08_cleaned_claims", _V8 + " SELECT c.claim_id, coalesce(dropped, 0)::BIGINT AS dropped, round(kept_sum, 2) AS kept_sum, round(CASE WHEN billed_amount > 0 AND billed_amount <= 50000000 THEN billed_amount ELSE kept_sum END, 2) AS total, coalesce(abs(kept_sum - billed_amount) > 100, false) AS corrected FROM claims c LEFT JOIN v USING (claim_id)")
def _v08(s, d):
    b, k = F.col("billed_amount"), F.col("kept_sum")
    return cleaned_claims(s, d).select("claim_id", F.coalesce("dropped", F.lit(0)).alias("dropped"), F.round(k, 2).alias("kept_sum"), F.round(F.when((b > 0) & (b <= 50_000_000), b).otherwise(k), 2).alias("total"), F.coalesce(F.abs(k - b) > 100, F.lit(False)).alias("corrected"))


_CHECKS = (("policy_number", "policy_number IS NULL", "missing"), ("policy_number", "NOT regexp_like(policy_number, '[0-9]{4}')", "no number"), ("billed_amount", "billed_amount IS NULL OR billed_amount <= 0", "missing"), ("billed_amount", "billed_amount > 50000000", "out of range"), ("diagnosis", "diagnosis IS NULL OR length(trim(diagnosis)) < 3", "missing"), ("patient_age", "patient_age < 0 OR patient_age > 120", "out of range"), ("date_of_discharge", "date_of_discharge < date_of_admission", "before admission"), ("npi_number", "NOT regexp_like(npi_number, '^[0-9]{10}$')", "no number"))


@book.add("v06_claim_report", f"WITH {CLAIMS_SQL}, u AS (" + " UNION ALL ".join(f"SELECT claim_id, '{f}' AS field, '{r}' AS issue FROM claims WHERE {c.replace('regexp_like', 'regexp_matches')}" for f, c, r in _CHECKS) + ") SELECT * FROM u")
def _v06(s, d):
    """Every issue of every claim, from one pass: checks are an array that explodes where they hold."""
    issues = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(f).alias("field"), F.lit(r).alias("issue"))) for f, c, r in _CHECKS]))
    return claims(s, d).select("claim_id", F.inline(issues))


@book.add("v14_issue_messages", f"WITH {CLAIMS_SQL}, u AS (" + " UNION ALL ".join(f"SELECT claim_id, {i} AS k, '{f}: {r}' AS m FROM claims WHERE {c.replace('regexp_like', 'regexp_matches')}" for i, (f, c, r) in enumerate(_CHECKS)) + ") SELECT claim_id, string_agg(m, '; ' ORDER BY k) AS messages FROM u GROUP BY 1")
def _v14(s, d):
    text = F.concat_ws("; ", *[F.when(F.expr(c), F.lit(f"{f}: {r}")) for f, c, r in _CHECKS])
    return claims(s, d).select("claim_id", text.alias("messages")).where("messages <> ''")


# --- repair of misread values ------------------------------------------------------------------------------------

#: Honorifics as they are written out, and words in which rn was read for m.
HONORIFICS = (("mr", "Mr."), ("mrs", "Mrs."), ("ms", "Ms."), ("dr", "Dr."), ("shri", "Shri"), ("smt", "Smt."), ("kum", "Kum."), ("prof", "Prof."))
RN_WORDS = (("narne", "name"), ("rnedical", "medical"), ("nurnber", "number"), ("arnount", "amount"), ("forni", "form"), ("inforniation", "information"), ("treatrnent", "treatment"), ("govemrnent", "government"))
SPACED = (("h\\s+o\\s+s\\s+p\\s+i\\s+t\\s+a\\s+l", "hospital"), ("p\\s+a\\s+t\\s+i\\s+e\\s+n\\s+t", "patient"), ("n\\s+a\\s+m\\s+e", "name"))


def standard_honorifics(c):
    """Every word that is an honorific, with or without a period, in its standard writing."""
    known = F.create_map(*[F.lit(x) for pair in HONORIFICS for x in pair])
    return F.array_join(F.transform(F.split(T.squeeze(c), " "), lambda w: F.coalesce(F.try_element_at(known, F.lower(F.regexp_replace(w, "\\.+$", ""))), w)), " ")


_HON_SQL = "CASE lower(regexp_replace(w, '\\.+$', '')) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in HONORIFICS) + " ELSE w END"


@book.add("n03_honorifics", f"WITH m AS (SELECT DISTINCT mention_id, full_name FROM identity_sources) SELECT mention_id, array_to_string(list_transform(string_split(trim(regexp_replace(full_name, '\\s+', ' ', 'g')), ' '), lambda w: {_HON_SQL}), ' ') AS name FROM m")
def _n03(s, d):
    return table(s, d, "identity_sources", "mention_id", "full_name").distinct().select("mention_id", standard_honorifics(F.col("full_name")).alias("name"))


def degarbled(c):
    """rn read for m, repeated punctuation, stray brackets and bars, words with spaces between their letters."""
    for wrong, right in RN_WORDS:
        c = F.regexp_replace(c, f"(?i){wrong}", right)
    c = F.regexp_replace(F.regexp_replace(c, "(^|\\s)[|\\\\]{1,3}(\\s|$)", "$1$2"), "[\\[\\]{}]", "")
    for mark in ".,;:":
        c = F.regexp_replace(c, f"[{mark}]{{2,}}", mark)
    for wrong, right in SPACED:
        c = F.regexp_replace(c, f"(?i){wrong}", right)
    return c


def _degarbled_sql(c: str) -> str:
    for wrong, right in RN_WORDS:
        c = f"regexp_replace({c}, '(?i){wrong}', '{right}', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(^|\\s)[|\\\\]{{1,3}}(\\s|$)', '\\1\\2', 'g'), '[\\[\\]{{}}]', '', 'g')"
    for mark in ".,;:":
        c = f"regexp_replace({c}, '[{mark}]{{2,}}', '{mark}', 'g')"
    for wrong, right in SPACED:
        c = f"regexp_replace({c}, '(?i){wrong}', '{right}', 'g')"
    return c


@book.add("n05_degarbled", f"WITH c AS (SELECT DISTINCT code_id, context FROM claim_codes WHERE context IS NOT NULL) SELECT code_id, {_degarbled_sql('context')} AS context FROM c")
def _n05(s, d):
    return table(s, d, "claim_codes", "code_id", "context").where("context IS NOT NULL").distinct().select("code_id", degarbled(F.col("context")).alias("context"))


@book.add("n06_field_processors", f"WITH x AS (SELECT DISTINCT rec_id, patient_name, policy_number, hospital_name, total_amount FROM claim_extractions) SELECT rec_id, CASE WHEN regexp_matches(patient_name, '[A-Za-z]') THEN trim(regexp_replace(regexp_replace(lower(patient_name), '[^a-z .]', '', 'g'), '\\s+', ' ', 'g')) END AS patient, nullif(regexp_replace(regexp_replace(upper(trim(policy_number)), '[\\s/]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS policy, CASE WHEN total_amount > 0 AND total_amount <= 50000000 THEN round(total_amount, 2) END AS amount FROM x")
def _n06(s, d):
    """Each field by its own processor: names to plain letters, policy numbers to one writing, amounts to their range."""
    x = table(s, d, "claim_extractions", "rec_id", "patient_name", "policy_number", "hospital_name", "total_amount").distinct()
    name = F.when(F.col("patient_name").rlike("[A-Za-z]"), T.squeeze(F.regexp_replace(F.lower("patient_name"), "[^a-z .]", "")))
    a = F.col("total_amount")
    return x.select("rec_id", name.alias("patient"), F.nullif(T.policy_number(F.col("policy_number")), F.lit("")).alias("policy"), F.when((a > 0) & (a <= 50_000_000), F.round(a, 2)).alias("amount"))


@book.add("n07_repair_summary", f"WITH c AS (SELECT DISTINCT code_id, context FROM claim_codes WHERE context IS NOT NULL) SELECT count(*)::BIGINT AS texts, count(*) FILTER (WHERE {_degarbled_sql('context')} <> context)::BIGINT AS changed FROM c")
def _n07(s, d):
    c = table(s, d, "claim_codes", "code_id", "context").where("context IS NOT NULL").distinct()
    return c.agg(F.count(F.lit(1)).alias("texts"), F.count_if(degarbled(F.col("context")) != F.col("context")).alias("changed"))


#: Words that the speller knows, commonest first.
DICTIONARY = ("hospital", "patient", "medicine", "surgery", "consultation", "charges", "laboratory", "pharmacy", "nursing", "theatre", "oxygen", "dressing", "implant", "anaesthesia")
_DICT_SQL = "dict(word, rank) AS (VALUES " + ", ".join(f"('{w}', {i})" for i, w in enumerate(DICTIONARY)) + ")"


@book.add("n08_spelled", f"WITH {ITEMS_SQL}, {_DICT_SQL}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(description, '[A-Za-z]{{5,}}'))) AS w FROM items), p AS (SELECT w, word, 1 - levenshtein(w, word) / greatest(length(w), length(word))::DOUBLE AS likeness, rank FROM w, dict), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY likeness DESC, rank) AS k FROM p WHERE likeness > 0.7) SELECT w AS spelling, word, round(likeness, 6) AS likeness FROM r WHERE k = 1")
def _n08(s, d):
    """The nearest dictionary word of each spelling; the dictionary is a constant, so it folds into the row."""
    w = items(s, d, keep="description IS NOT NULL").select(F.explode(F.regexp_extract_all("description", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    like = lambda x: 1 - F.levenshtein("w", F.lit(x)) / F.greatest(F.length("w"), F.lit(len(x)))
    best = F.array_max(F.array(*[F.struct(like(x).alias("likeness"), F.lit(-i).alias("rank"), F.lit(x).alias("word")) for i, x in enumerate(DICTIONARY)]))
    return w.select(F.col("w").alias("spelling"), best.alias("b")).where("b.likeness > 0.7").select("spelling", "b.word", F.round("b.likeness", 6).alias("likeness"))


#: Labels that scanners garble, with their right wording; a bar before a capital letter is an I.
LABELS = (("po[il1]icy", "policy"), ("c[il1]aim", "claim"), ("pat[il1]ent", "patient"), ("d[il1]agnos[il1]s", "diagnosis"), ("hosp[il1]ta[il1]", "hospital"))


@book.add("n09_labels_repaired", f"WITH {_LINES} SELECT scan_id, line_no, " + "".join(f"regexp_replace(" for _ in LABELS) + "regexp_replace(line, '\\|([A-Z])', 'I\\1', 'g')" + "".join(f", '(?i)\\b{a}\\b', '{b}', 'g')" for a, b in LABELS) + " AS line FROM lines WHERE regexp_matches(line, '[|]|(?i)" + "|".join(a for a, _ in LABELS) + "')")
def _n09(s, d):
    fixed = F.regexp_replace("line", "\\|([A-Z])", "I$1")
    for a, b in LABELS:
        fixed = F.regexp_replace(fixed, f"(?i)\\b{a}\\b", b)
    return lines(s, d).where(F.col("line").rlike("[|]|(?i)" + "|".join(a for a, _ in LABELS))).select("scan_id", "line_no", fixed.alias("line"))


@book.add("n10_post_processed", "WITH c AS (SELECT DISTINCT code_id, code, description, confidence FROM claim_codes) SELECT code_id, CASE WHEN regexp_matches(upper(trim(code)), '^[A-TV-Z][0-9]{2}(\\.[0-9]{1,4})?[A-Z]?$') THEN upper(trim(code)) END AS icd, upper(substr(trim(description), 1, 1)) || lower(substr(trim(description), 2)) AS description FROM c")
def _n10(s, d):
    """Codes that are none become null, descriptions get one way of capitals."""
    code, text = F.upper(F.trim("code")), F.trim("description")
    return table(s, d, "claim_codes", "code_id", "code", "description", "confidence").distinct().select("code_id", F.when(code.rlike("^[A-TV-Z][0-9]{2}(\\.[0-9]{1,4})?[A-Z]?$"), code).alias("icd"), F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000))).alias("description"))


# --- gap filling ---------------------------------------------------------------------------------------------------


def low_quality(c):
    """Too short, mostly signs, without a vowel, or wording of the form."""
    signs = F.length(F.regexp_replace(c, "[A-Za-z0-9\\s]", ""))
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return c.isNull() | (F.length(F.trim(c)) < 2) | (signs > 0.4 * F.length(c)) | ((letters >= 4) & ~F.lower(c).rlike("[aeiouy]")) | F.lower(F.trim(c)).rlike("^(?:unknown|n/?a|nil|none|null|-+|name of .*|please .*|same as above)$")


_LOW_SQL = "({0} IS NULL OR length(trim({0})) < 2 OR length(regexp_replace({0}, '[A-Za-z0-9\\s]', '', 'g')) > 0.4 * length({0}) OR (length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) >= 4 AND NOT regexp_matches(lower({0}), '[aeiouy]')) OR regexp_matches(lower(trim({0})), '^(?:unknown|n/?a|nil|none|null|-+|name of .*|please .*|same as above)$'))"


@book.add("e50_low_quality", f"WITH x AS (SELECT DISTINCT rec_id, hospital_name FROM claim_extractions) SELECT rec_id, {_LOW_SQL.format('hospital_name')} AS low FROM x")
def _e50(s, d):
    return table(s, d, "claim_extractions", "rec_id", "hospital_name").distinct().select("rec_id", low_quality(F.col("hospital_name")).alias("low"))


@book.add("e49_gaps_filled", f"WITH x AS (SELECT DISTINCT * FROM claim_extractions), n AS (SELECT TRY_CAST(regexp_extract(file_name, '^0*([0-9]+)', 1) AS BIGINT) AS claim_no, * FROM x), g AS (SELECT claim_no, max(hospital_name) FILTER (WHERE NOT {_LOW_SQL.format('hospital_name')}) AS best FROM n WHERE claim_no IS NOT NULL GROUP BY 1) SELECT rec_id, CASE WHEN {_LOW_SQL.format('hospital_name')} THEN coalesce(best, hospital_name) ELSE hospital_name END AS hospital, {_LOW_SQL.format('hospital_name')} AND best IS NOT NULL AS filled FROM n JOIN g USING (claim_no)")
def _e49(s, d):
    """Only missing or poor values are filled, from the claim's other records."""
    n = by_claim(s, d).select("claim_no", "rec_id", "hospital_name")
    low, h = low_quality(F.col("hospital_name")), F.col("hospital_name")
    best = n.groupBy("claim_no").agg(F.max(F.when(~low, h)).alias("best"))
    return n.join(best, "claim_no").select("rec_id", F.when(low, F.coalesce("best", h)).otherwise(h).alias("hospital"), (low & F.col("best").isNotNull()).alias("filled"))


@book.add("e54_page_merge", "WITH x AS (SELECT DISTINCT * FROM claim_extractions), n AS (SELECT TRY_CAST(regexp_extract(file_name, '^0*([0-9]+)', 1) AS BIGINT) AS claim_no, * FROM x), u AS (SELECT claim_no, 'policy_number' AS field, policy_number AS v, confidence, rec_id FROM n UNION ALL SELECT claim_no, 'dob', dob, confidence, rec_id FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY claim_no, field ORDER BY confidence DESC, rec_id) AS k, avg(confidence) OVER (PARTITION BY claim_no, field) AS mean FROM u WHERE claim_no IS NOT NULL AND v IS NOT NULL AND trim(v) <> '' AND confidence IS NOT NULL) SELECT claim_no, field, v AS merged, round(mean, 6) AS mean FROM r WHERE k = 1")
def _e54(s, d):
    """Per field the page of the greatest confidence, and the mean confidence over its pages."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("policy_number", "dob")])
    u = by_claim(s, d).where("confidence IS NOT NULL").select("claim_no", "confidence", "rec_id", F.inline(cells)).where("v IS NOT NULL AND trim(v) <> ''")
    return u.groupBy("claim_no", "field").agg(F.max_by("v", F.struct("confidence", -F.col("rec_id"))).alias("merged"), F.round(F.avg("confidence"), 6).alias("mean"))


@book.add("i04_best_setting", "WITH x AS (SELECT DISTINCT * FROM claim_extractions), n AS (SELECT TRY_CAST(regexp_extract(file_name, '^0*([0-9]+)', 1) AS BIGINT) AS claim_no, lower(trim(extraction_method)) AS setting, confidence, rec_id FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY claim_no ORDER BY confidence DESC, rec_id) AS k FROM n WHERE claim_no IS NOT NULL AND confidence IS NOT NULL AND setting IS NOT NULL) SELECT claim_no, setting, confidence FROM r WHERE k = 1")
def _i04(s, d):
    """Of the settings tried on one file, the one of greatest confidence."""
    n = by_claim(s, d).where("confidence IS NOT NULL AND extraction_method IS NOT NULL")
    return n.groupBy("claim_no").agg(F.max_by(F.struct(F.lower(F.trim("extraction_method")).alias("setting"), "confidence"), F.struct("confidence", -F.col("rec_id"))).alias("b")).select("claim_no", "b.setting", "b.confidence")


@book.add("i06_routed_fields", "WITH x AS (SELECT DISTINCT * FROM claim_extractions), u AS (SELECT rec_id, 'dob' AS field, dob AS v FROM x UNION ALL SELECT rec_id, 'policy_number', policy_number FROM x UNION ALL SELECT rec_id, 'patient_name', patient_name FROM x) SELECT rec_id, field, CASE field WHEN 'dob' THEN regexp_replace(trim(v), '[./\\s,-]+', '-', 'g') WHEN 'policy_number' THEN regexp_replace(regexp_replace(upper(trim(v)), '[\\s/]+', '-', 'g'), '^-+|-+$', '', 'g') ELSE trim(regexp_replace(v, '\\s+', ' ', 'g')) END AS routed FROM u WHERE v IS NOT NULL")
def _i06(s, d):
    """Each field goes to the processor of its type."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("v")) for n in ("dob", "policy_number", "patient_name")])
    u = extractions(s, d).select("rec_id", F.inline(cells)).where("v IS NOT NULL")
    routed = F.when(F.col("field") == "dob", F.regexp_replace(F.trim("v"), "[./\\s,-]+", "-")).when(F.col("field") == "policy_number", T.policy_number(F.col("v"))).otherwise(T.squeeze(F.col("v")))
    return u.select("rec_id", "field", routed.alias("routed"))


# --- scores of misreading ------------------------------------------------------------------------------------------

#: Words in capitals that are no nonsense, short words that are words, and acronyms of three letters.
CAPITALS = "HOSPITAL MEDICAL PATIENT HEALTH INSURANCE CLAIM DOCTOR MEDICINE SURGERY TOTAL AMOUNT INDIA DELHI MUMBAI KOLKATA CHENNAI BANGALORE BLOOD URINE LIPID KIDNEY LIVER HEART HDFC ICICI AXIS STATE UNION CENTRAL STAIN ACCOUNT DETAILS BRANCH AADHAAR".split()
SHORT_WORDS = "the and for are but not you all can had her was one our out day get has him his how its may new now old see way who boy did own say she too use room bed icu ward dr mr mrs ms no rs per qty amt date name age sex dob mob tel".split()
ACRONYMS = "ICU OPD IPD MRI ECG EKG HIV BMI DNA RNA TPA MLC DOB DOA DOD GST PAN PIN UPI EMI ENT OT MRD BPL APL SSC HSC PDF RAG THE AND FOR ARE NOT BUT YOU ALL".split()


def gibberish_score(t):
    """The sum of ten checks of a text; 2 and more is gibberish. Null for null and for less than three signs."""
    found = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    count = lambda a, keep: F.size(F.filter(a, keep))
    points = lambda *cases: _first_of(cases)
    letters, vowels = F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.length(F.regexp_replace(t, "[^AEIOUaeiou]", ""))
    words = F.filter(F.transform(F.split(T.squeeze(t), " "), lambda w: F.regexp_replace(w, "^[.,!?;:()\\[\\]{}]+|[.,!?;:()\\[\\]{}]+$", "")), lambda w: F.length(w) >= 4)
    invalid = count(words, lambda w: ~valid_word(w))
    capitals = count(found("\\b[A-Z]{5,}\\b"), lambda w: ~w.isin(*CAPITALS) & (w.rlike("[BCDFGHJKLMNPQRSTVWXYZ]{3,}") | w.rlike("AA|EE|II|OO|UU|I[AI]I|AI[AI]") | (F.length(w) > 7)))
    small = found("\\b[a-z]{2,4}\\b")
    three = count(found("\\b[A-Z]{3}\\b"), lambda w: ~w.isin(*ACRONYMS))
    mixed = F.size(found("\\b\\w*[a-z][A-Z]\\w*\\b"))
    total = (
        points((t.rlike("(?i)[bcdfghjklmnpqrstvwxyz]{4,}"), 1.5))
        + points((mixed >= 2, 2.5), (mixed == 1, 1.5))
        + points((t.rlike("\\b[A-Za-z]+[0-9][A-Za-z]*\\b|\\b[A-Za-z]*[0-9][A-Za-z]+\\b"), 1.0))
        + points(((letters >= 5) & (vowels < 0.15 * letters), 1.5), ((letters >= 5) & (vowels < 0.22 * letters), 0.75))
        + points((invalid > 0.4 * F.size(words), 2.0), (invalid > 0.2 * F.size(words), 1.0))
        + points((capitals >= 2, 2.0), (capitals == 1, 1.0))
        + points((t.rlike("[Il1|]{3,}|[O0]{2,}|\\bt[DT][IiLl1]|[A-Z]{2,}[a-z][A-Z]{2,}"), 1.0))
        + points((t.rlike("[.]{3,}|[,]{2,}|[;:]{2,}"), 0.5))
        + points((count(small, lambda w: ~w.isin(*SHORT_WORDS)) > 0.6 * F.size(small), 0.75))
        + points((three >= 2, 2.0))
    )
    return F.when(F.length(F.trim(t)) >= 3, total)


def _first_of(cases):
    out = F.lit(0.0)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _gibberish_sql(t: str) -> str:
    found = lambda p: f"regexp_extract_all({t}, '{p}')"
    letters, vowels = f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))", f"length(regexp_replace({t}, '[^AEIOUaeiou]', '', 'g'))"
    words = f"list_filter(list_transform(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[.,!?;:()\\[\\]{{}}]+|[.,!?;:()\\[\\]{{}}]+$', '', 'g')), lambda w: length(w) >= 4)"
    invalid = f"len(list_filter({words}, lambda w: NOT {_valid_sql('w')}))"
    bad_capitals = "[BCDFGHJKLMNPQRSTVWXYZ]{3,}"
    capitals = f"len(list_filter({found(chr(92) + 'b[A-Z]{5,}' + chr(92) + 'b')}, lambda w: w NOT IN {_listed(CAPITALS)} AND (regexp_matches(w, '{bad_capitals}') OR regexp_matches(w, 'AA|EE|II|OO|UU|I[AI]I|AI[AI]') OR length(w) > 7)))"
    small = found("\\b[a-z]{2,4}\\b")
    three = f"len(list_filter({found(chr(92) + 'b[A-Z]{3}' + chr(92) + 'b')}, lambda w: w NOT IN {_listed(ACRONYMS)}))"
    mixed = f"len({found(chr(92) + 'b' + chr(92) + 'w*[a-z][A-Z]' + chr(92) + 'w*' + chr(92) + 'b')})"
    case = lambda *cases: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " ELSE 0 END"
    parts = [
        case((f"regexp_matches({t}, '(?i)[bcdfghjklmnpqrstvwxyz]{{4,}}')", 1.5)), case((f"{mixed} >= 2", 2.5), (f"{mixed} = 1", 1.5)), case((f"regexp_matches({t}, '\\b[A-Za-z]+[0-9][A-Za-z]*\\b|\\b[A-Za-z]*[0-9][A-Za-z]+\\b')", 1.0)),
        case((f"{letters} >= 5 AND {vowels} < 0.15 * {letters}", 1.5), (f"{letters} >= 5 AND {vowels} < 0.22 * {letters}", 0.75)), case((f"{invalid} > 0.4 * len({words})", 2.0), (f"{invalid} > 0.2 * len({words})", 1.0)),
        case((f"{capitals} >= 2", 2.0), (f"{capitals} = 1", 1.0)), case((f"regexp_matches({t}, '[Il1|]{{3,}}|[O0]{{2,}}|\\bt[DT][IiLl1]|[A-Z]{{2,}}[a-z][A-Z]{{2,}}')", 1.0)), case((f"regexp_matches({t}, '[.]{{3,}}|[,]{{2,}}|[;:]{{2,}}')", 0.5)),
        case((f"len(list_filter({small}, lambda w: w NOT IN {_listed(SHORT_WORDS)})) > 0.6 * len({small})", 0.75)), case((f"{three} >= 2", 2.0)),
    ]
    return f"CASE WHEN length(trim({t})) >= 3 THEN ({' + '.join(parts)})::DOUBLE END"


@book.add("v01_gibberish_checks", f"WITH t AS (SELECT DISTINCT code_id, context FROM claim_codes WHERE context IS NOT NULL), g AS (SELECT code_id, {_gibberish_sql('context')} AS score FROM t) SELECT code_id, score, score >= 2 AS is_gibberish, round(least(1.0, score / 3), 6) AS confidence FROM g")
def _v01(s, d):
    g = table(s, d, "claim_codes", "code_id", "context").where("context IS NOT NULL").distinct().select("code_id", gibberish_score(F.col("context")).alias("score"))
    return g.select("code_id", "score", (F.col("score") >= 2).alias("is_gibberish"), F.round(F.least(F.lit(1.0), F.col("score") / 3), 6).alias("confidence"))


#: Wording that makes a six-figure sum an amount after all.
AMOUNT_WORDS = "charge|amount|total|bill|fee|cost|surgery|medicine|room|icu|ot"


def amount_issues(a, context):
    """Why an amount may be none: out of range, or figures like a postal code, a date, a telephone or an id; with its confidence."""
    whole = a == F.floor(a)
    text = F.when(whole, a.cast("bigint").cast("string")).otherwise(F.floor(a).cast("bigint").cast("string"))
    day_first = text.rlike("^(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])[0-9]{4}$")
    issues = [
        F.when(a < 1, "too low").when(a > 1_000_000, "too high"),
        F.when(whole & text.rlike("^[1-8][0-9]{5}$") & (a % 5000 != 0) & ~F.coalesce(F.lower(context).rlike(AMOUNT_WORDS), F.lit(False)), "like a postal code"),
        F.when(day_first, "like a date").when(text.rlike("^202[0-9](?:0[1-9]|1[0-2])[0-9]{2}$"), "like a date"),
        F.when(text.rlike("^[6-9][0-9]{9}$"), "like a telephone"),
        F.when((a > 1_000_000) & whole & (F.length(F.regexp_replace(text, "[^0]", "")) >= 5), "suspiciously round"),
    ]
    return F.array_compact(F.array(*issues))


@book.add("v03_amount_checks", f"WITH {ITEMS_SQL}, x AS (SELECT claim_id, pos, amount AS a, description, CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR) AS t FROM items WHERE amount IS NOT NULL), i AS (SELECT claim_id, pos, list_filter([CASE WHEN a < 1 THEN 'too low' WHEN a > 1000000 THEN 'too high' END, CASE WHEN a = floor(a) AND regexp_matches(t, '^[1-8][0-9]{{5}}$') AND a % 5000 <> 0 AND NOT coalesce(regexp_matches(lower(description), '{AMOUNT_WORDS}'), false) THEN 'like a postal code' END, CASE WHEN regexp_matches(t, '^(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])[0-9]{{4}}$') OR regexp_matches(t, '^202[0-9](?:0[1-9]|1[0-2])[0-9]{{2}}$') THEN 'like a date' END, CASE WHEN regexp_matches(t, '^[6-9][0-9]{{9}}$') THEN 'like a telephone' END, CASE WHEN a > 1000000 AND a = floor(a) AND length(regexp_replace(t, '[^0]', '', 'g')) >= 5 THEN 'suspiciously round' END], lambda z: z IS NOT NULL) AS k FROM x) SELECT claim_id, pos, array_to_string(k, ';') AS issues, greatest(0.0, 1 - 0.25 * len(k))::DOUBLE AS confidence FROM i")
def _v03(s, d):
    i = items(s, d, keep="amount IS NOT NULL").select("claim_id", "pos", amount_issues(F.col("amount"), F.col("description")).alias("k"))
    return i.select("claim_id", "pos", F.array_join("k", ";").alias("issues"), F.greatest(F.lit(0.0), 1 - 0.25 * F.size("k")).alias("confidence"))


@book.add("n04_confusion_by_context", f"WITH {CLAIMS_SQL}, w AS (SELECT claim_id, string_split(trim(regexp_replace(policy_number || ' ' || coalesce(hospital_name, ''), '\\s+', ' ', 'g')), ' ') AS a FROM claims WHERE policy_number IS NOT NULL) SELECT claim_id, array_to_string(list_transform(a, lambda x: CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) * 2 > length(x) THEN translate(x, 'OoIlSsZzB', '001155228') WHEN length(regexp_replace(x, '[^A-Za-z]', '', 'g')) * 2 > length(x) AND regexp_matches(x, '^[A-Za-z01528]+$') THEN translate(x, '01528', 'OISZB') ELSE x END), ' ') AS repaired FROM w")
def _n04(s, d):
    """Words that are mostly figures are read as figures, words that are mostly letters as letters."""
    c = claims(s, d, "claim_id", "policy_number", "hospital_name", keep="policy_number IS NOT NULL")
    words = F.split(T.squeeze(F.concat("policy_number", F.lit(" "), F.coalesce("hospital_name", F.lit("")))), " ")
    share = lambda x, p: F.length(F.regexp_replace(x, p, "")) * 2 > F.length(x)
    fixed = F.transform(words, lambda x: F.when(share(x, "[^0-9]"), F.translate(x, "OoIlSsZzB", "001155228")).when(share(x, "[^A-Za-z]") & x.rlike("^[A-Za-z01528]+$"), F.translate(x, "01528", "OISZB")).otherwise(x))
    return c.select("claim_id", F.array_join(fixed, " ").alias("repaired"))
