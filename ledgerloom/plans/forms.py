"""Claim forms as text: fields by ordered patterns, records, sections, dates and codes with their context.

Everything about one text is found within its row, by functions over arrays of its lines or matches; no line is shuffled.
Patterns are tables of plain text from which both the column expressions and the SQL are made; they use no look-around,
so that any engine reads them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.plans.book import Book
from ledgerloom.plans.extraction import _DSQL
from ledgerloom.sources.tables import table

book = Book()

_DATE = "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"
_ID, _NAME = "[A-Za-z0-9/-]{5,25}", "[A-Za-z][A-Za-z.]*(?: [A-Za-z][A-Za-z.]*){0,4}"
_SUM = "(?:rs\\.?|inr|₹)? ?([0-9][0-9,]*(?:\\.[0-9]{1,2})?)"
_IS = "[ :=#-]*"
#: The fields of a claim with their patterns, best first; each has one group. All ignore case.
PATTERNS: dict[str, tuple[str, ...]] = {
    "policy_number": (f"\\bpolicy (?:number|no\\.?){_IS}({_ID})", f"\\bpolicy (swp[ -]?[0-9]{{4,}})", f"\\bcert(?:ificate)?\\.? no\\.?{_IS}({_ID})"),
    "claim_number": (f"\\bclaim (?:number|no\\.?|id){_IS}({_ID})", "\\bclaim (cl ?[0-9]{4,})", f"\\breference no\\.?{_IS}({_ID})", f"\\bcase no\\.?{_IS}({_ID})"),
    "claimant_name": (f"\\bname of (?:the )?(?:patient|insured|claimant){_IS}({_NAME})", f"\\b(?:patient|claimant|insured)(?: name)?: *({_NAME})", f"\\bI, ({_NAME}), declare"),
    "date_of_birth": (f"\\b(?:dob|d\\.o\\.b\\.?|date of birth|birth date){_IS}({_DATE})", f"\\bborn(?: on)?{_IS}({_DATE})"),
    "date_of_admission": (f"\\b(?:date of admission|admission date|doa){_IS}({_DATE})", f"\\badmitted on{_IS}({_DATE})"),
    "date_of_discharge": (f"\\b(?:date of discharge|discharge date|dod){_IS}({_DATE})", f"\\bdischarged on{_IS}({_DATE})"),
    "date_of_service": (f"\\b(?:date of service|service date|dos){_IS}({_DATE})", f"\\bon ({_DATE})"),
    "hospital_name": (f"\\b(?:hospital name|name of hospital){_IS}({_NAME})", "\\b(?:tariff of|visit to) ([A-Za-z]+(?: [A-Za-z]+){0,4}? (?:hospital|clinic|diagnostics|institute|nursing home))"),
    "provider_name": (f"\\b(?:treating|attending) (?:doctor|consultant|physician){_IS}(?:dr\\.? )?({_NAME})", f"\\bdr\\.? ({_NAME})"),
    "npi_number": ("\\b(?:npi|provider id)[ :#]*([0-9]{10})\\b",),
    "diagnosis_icd": ("\\bicd(?:-?10)?[ :=-]*([A-TV-Z][0-9]{2}(?:\\.[0-9]{1,4})?)\\b", "\\b([A-TV-Z][0-9]{2}(?:\\.[0-9]{1,4})?) as the primary code", "\\bmarked ([A-TV-Z][0-9]{2}(?:\\.[0-9]{1,4})?)\\b"),
    "diagnosis_text": (f"\\b(?:provisional |final )?diagnosis(?: of)?{_IS}({_NAME})", "\\bcomplaints of ([a-z]+(?: and [a-z]+)?)"),
    "procedure_code": ("\\b(?:procedure|cpt|hcpcs)(?: code)?[ :#]*([0-9]{5})\\b",),
    "procedure_name": ("\\b(?:procedure of|estimate for) ([a-z]+(?: [a-z]+)?)",),
    "billed_amount": (f"\\b(?:grand total|net amount|total due){_IS}{_SUM}", f"\\bfinal bill(?: of)? {_SUM}", f"\\bsub total {{1,4}}{_SUM}"),
    "insurance_company": ("\\b(?:insurer|insurance company|tpa)[ :]+([A-Za-z]+ (?:health|general|assurance|life))\\b", "\\bofficer of ([A-Za-z]+ (?:health|general|assurance|life))\\b"),
    "member_id": (f"\\b(?:member|subscriber)(?: id| no\\.?){_IS}({_ID})", f"\\b(?:uhid|mrn|patient id){_IS}({_ID})"),
    "group_number": (f"\\b(?:group|grp) (?:number|no\\.?){_IS}({_ID})",),
    "room_type": ("\\b(?:room type|room category|type of room|accommodation)[ :]+([a-z]+(?:-[a-z]+)?)",),
}
FIELDS = tuple(PATTERNS)
_TEXTS = "t AS (SELECT DISTINCT scan_id, raw_text_preview AS text FROM scan_texts WHERE raw_text_preview IS NOT NULL AND scan_id IS NOT NULL), s AS (SELECT scan_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM t)"


def texts(s, d):
    """(scan_id, text, line): line is the text with every white space as one blank, so that values may run over line ends."""
    t = table(s, d, "scan_texts", "scan_id", "raw_text_preview").where("raw_text_preview IS NOT NULL AND scan_id IS NOT NULL").distinct()
    return t.select("scan_id", F.col("raw_text_preview").alias("text"), F.trim(F.regexp_replace("raw_text_preview", "\\s+", " ")).alias("line"))


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """(value, rank) of the first pattern that matches; null if none does."""
    at = lambda p: F.trim(F.regexp_extract(text, f"(?i){p}", 1))
    return F.coalesce(*[F.when(at(p) != "", F.struct(at(p).alias("value"), F.lit(i).alias("rank"))) for i, p in enumerate(patterns)])


def _first_sql(patterns: tuple[str, ...], text: str = "line") -> str:
    q = lambda p: f"trim(regexp_extract({text}, '(?i){p}', 1))"
    return "CASE " + " ".join(f"WHEN {q(p)} <> '' THEN {{'value': {q(p)}, 'rank': {i}}}" for i, p in enumerate(patterns)) + " END"


_LONG = "WITH " + _TEXTS + ", f AS (" + " UNION ALL ".join(f"SELECT scan_id, '{n}' AS field, {_first_sql(p)} AS m FROM s" for n, p in PATTERNS.items()) + ")"


def found_fields(t):
    """(scan_id, field, value, rank), one row per field found."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), first_match(F.col("line"), p).alias("m")) for n, p in PATTERNS.items()])
    return t.select("scan_id", F.inline(F.filter(cells, lambda c: c["m"].isNotNull()))).select("scan_id", "field", "m.value", "m.rank")


@book.add("e03_field_patterns", _LONG + " SELECT scan_id, field, m.value AS found, m.rank AS rank FROM f WHERE m IS NOT NULL")
def _e03(s, d):
    return found_fields(texts(s, d)).select("scan_id", "field", F.col("value").alias("found"), "rank")


@book.add("e06_field_confidence", _LONG + " SELECT scan_id, count(*)::BIGINT AS fields, round(avg(0.9 - 0.1 * m.rank), 6) AS confidence FROM f WHERE m IS NOT NULL GROUP BY 1")
def _e06(s, d):
    """Fields found and their mean confidence, 0.9 for the best pattern and a tenth less for each that failed first."""
    return found_fields(texts(s, d)).groupBy("scan_id").agg(F.count(F.lit(1)).alias("fields"), F.round(F.avg(0.9 - 0.1 * F.col("rank")), 6).alias("confidence"))


_NUMBERS = "[0-9][0-9,]*(?:\\.[0-9]{1,2})?"
_LARGEST = f"list_max(list_transform(regexp_extract_all(line, '{_NUMBERS}'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)))"
_E2 = ("policy_number", "claim_number", "claimant_name", "date_of_admission", "date_of_discharge", "hospital_name", "provider_name", "diagnosis_text", "procedure_name", "insurance_company")


@book.add("e02_legacy_fields", "WITH " + _TEXTS + " SELECT scan_id, " + ", ".join(f"coalesce(({_first_sql(PATTERNS[n])}).value, 'UNKNOWN') AS {n}" for n in _E2) + f", coalesce(TRY_CAST(replace(({_first_sql(PATTERNS['billed_amount'])}).value, ',', '') AS DOUBLE), {_LARGEST}) AS total FROM s")
def _e02(s, d):
    """Ten fields with a word for what is missing; the total falls back on the largest number of the text."""
    numbers = F.transform(F.regexp_extract_all("line", F.lit(_NUMBERS), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    total = F.replace(first_match(F.col("line"), PATTERNS["billed_amount"])["value"], F.lit(","), F.lit("")).try_cast("double")
    return texts(s, d).select("scan_id", *[F.coalesce(first_match(F.col("line"), PATTERNS[n])["value"], F.lit("UNKNOWN")).alias(n) for n in _E2], F.coalesce(total, F.array_max(numbers)).alias("total"))


def _day_sql(t: str) -> str:
    return f"(SELECT coalesce({_DSQL}, CASE WHEN regexp_matches(t, '^[0-9]{{8}}$') THEN CAST(TRY_STRPTIME(t, '%d%m%Y') AS DATE) END) FROM (SELECT regexp_replace(regexp_replace(trim({t}), '[./\\s,-]+', '-', 'g'), '(?i)^([a-z]{{3}})[a-z]*-([0-9]{{1,2}})-([0-9]{{4}})$', '\\2-\\1-\\3') AS t))"


def day_of(c: Column) -> Column:
    """The day that a date of any layout means, also of one that begins with the month's name."""
    return D.parse_date(F.regexp_replace(F.regexp_replace(F.trim(c), "[./\\s,-]+", "-"), "(?i)^([a-z]{3})[a-z]*-([0-9]{1,2})-([0-9]{4})$", "$2-$1-$3"))


_DATES = ("date_of_birth", "date_of_admission", "date_of_discharge")
_PLAIN = ("policy_number", "claim_number", "claimant_name", "hospital_name", "provider_name", "insurance_company", "diagnosis_icd", "diagnosis_text", "procedure_code", "room_type")


@book.add(
    "e05_records",
    "WITH " + _TEXTS + ", r AS (SELECT scan_id, " + ", ".join(f"({_first_sql(PATTERNS[n])}).value AS {n}" for n in (*_PLAIN, *_DATES, "billed_amount")) + " FROM s) SELECT scan_id, " + ", ".join(_PLAIN) + ", "
    + ", ".join(f"{_day_sql(n)} AS {n}" for n in _DATES) + ", TRY_CAST(replace(billed_amount, ',', '') AS DOUBLE) AS billed_amount, " + " + ".join(f"({n} IS NOT NULL)::INTEGER" for n in (*_PLAIN, *_DATES, "billed_amount")) + " AS filled FROM r",
)
def _e05(s, d):
    """One typed record a text: plain fields, days, the amount, and how many are filled."""
    names = (*_PLAIN, *_DATES, "billed_amount")
    r = texts(s, d).select("scan_id", *[first_match(F.col("line"), PATTERNS[n])["value"].alias(n) for n in names])
    return r.select("scan_id", *_PLAIN, *[day_of(F.col(n)).alias(n) for n in _DATES], F.replace("billed_amount", F.lit(","), F.lit("")).try_cast("double").alias("billed_amount"), sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)).alias("filled"))


#: Houses and insurers that a misspelt name may mean: the master lists are small constants.
INSURERS = ("Kaveto General", "Bimarak Health", "Dhanvira Life & Health")


@book.add("e13_matched_names", "WITH c AS (SELECT DISTINCT * FROM claim), m(name, rank) AS (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(INSURERS)) + "), p AS (SELECT claim_id, name, rank, 1 - levenshtein(lower(insurance_company), lower(name)) / greatest(length(insurance_company), length(name))::DOUBLE AS likeness FROM c, m WHERE insurance_company IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY likeness DESC, rank) AS k FROM p WHERE likeness >= 0.7) SELECT c.claim_id, coalesce(name, insurance_company) AS insurer, CASE WHEN regexp_matches(hospital_name, '[A-Za-z]') THEN hospital_name WHEN regexp_matches(provider_name, '(?i)hospital|clinic|nursing|diagnostics|institute') THEN provider_name END AS house FROM c LEFT JOIN r ON r.claim_id = c.claim_id AND k = 1")
def _e13(s, d):
    """Insurers by the nearest known name; a provider that is a house fills in for a missing hospital."""
    c = table(s, d, "claim", "claim_id", "insurance_company", "hospital_name", "provider_name").distinct()
    like = lambda n: 1 - F.levenshtein(F.lower("insurance_company"), F.lit(n.lower())) / F.greatest(F.length("insurance_company"), F.lit(len(n)))
    best = F.array_max(F.array(*[F.struct(like(n).alias("likeness"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, n in enumerate(INSURERS)]))
    c = c.withColumn("b", best)
    house = F.when(F.col("hospital_name").rlike("[A-Za-z]"), F.col("hospital_name")).when(F.col("provider_name").rlike("(?i)hospital|clinic|nursing|diagnostics|institute"), F.col("provider_name"))
    return c.select("claim_id", F.when(F.col("b.likeness") >= 0.7, F.col("b.name")).otherwise(F.col("insurance_company")).alias("insurer"), house.alias("house"))


# --- sections ------------------------------------------------------------------------------------------------------

_PART = "\\b(?:part|section) ?-? ?{0}\\b"
_ABOUT = "\\b(?:{0}) (?:details?|information|particulars)\\b"
#: What heads a section, by kind, the first kind that matches a line winning; all ignore case.
SECTIONS = (
    ("insured", f"{_PART.format('a')}|{_ABOUT.format('insured|patient|policyholder|member')}|to be filled (?:in )?by (?:the )?insured"),
    ("hospital", f"{_PART.format('b')}|{_ABOUT.format('hospital|provider|admission|hospitali[sz]ation')}|to be filled (?:in )?by (?:the )?hospital"),
    ("claim", f"{_PART.format('c')}|{_ABOUT.format('claim|billing|expense|charges?')}|bill particulars|amount claimed"),
    ("medical", f"{_PART.format('d')}|{_ABOUT.format('medical|treatment|diagnosis|clinical')}|attending (?:doctor|physician)"),
    ("declaration", f"{_PART.format('e')}|declaration (?:by|of)|\\bundertaking\\b|\\bi,? (?:hereby )?declare|, declare that"),
)
#: Wording that a section's content holds, each kind of wording counting once.
CONTENT = {
    "insured": ("policy (?:no|number|swp)", "name of (?:the )?(?:insured|patient|member)|insured:", "date of birth", "\\b(?:age|gender|sex)\\b", "address", "mobile|contact|phone", "e-?mail", "sum insured"),
    "hospital": ("hospital", "date of admission|admitted", "date of discharge|discharged?", "room", "(?:treating|attending)", "regn|registration", "ward"),
    "claim": ("(?:total|billed?) amount|sub total", "room charges?", "icu charges?", "(?:operation|surgery|theatre)", "medicines?|pharmacy", "laborator", "consultation", "net amount|payable|receipt"),
    "medical": ("diagnos", "\\bicd\\b|primary code", "procedure", "illness|complaints?", "investigation", "treatment", "surgery|operation", "therapy"),
    "declaration": ("signature", "declare", "authori[sz]e", "consent", "witness", "stamp"),
}
_DOCS = "docs AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1)"


def docs(s, d):
    t = table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return t.withColumn("lines", F.split("text", "\n"))


def heading(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECTIONS):
        out = F.when(line.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return F.when(F.length(F.trim(line)) <= 60, out)


_HEADING = "CASE WHEN length(trim(x)) <= 60 THEN CASE " + " ".join(f"WHEN regexp_matches(x, '(?i){p}') THEN '{k}'" for k, p in SECTIONS) + " END END"


def score(text: Column, kind: str) -> Column:
    return sum((text.rlike(f"(?i){p}").cast("int") for p in CONTENT[kind]), F.lit(0))


def _score_sql(kind: str, text: str = "x") -> str:
    return "(" + " + ".join(f"regexp_matches({text}, '(?i){p}')::INTEGER" for p in CONTENT[kind]) + ")"


def headed_sections(t):
    """(doc_id, n, kind, start, stop, content): from each heading to the line before the next; lines count from 0."""
    heads = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), heading(x).alias("kind"))), lambda h: h["kind"].isNotNull())
    t = t.withColumn("heads", heads).where("size(heads) > 0")
    spans = F.transform("heads", lambda h, k: F.struct(k.alias("n"), h["kind"].alias("kind"), h["at"].alias("start"), F.coalesce(F.get("heads", k + 1)["at"], F.size("lines")).alias("stop")))
    out = t.select("doc_id", "lines", F.inline(spans))
    return out.withColumn("content", F.array_join(F.slice("lines", F.col("start") + 1, F.col("stop") - F.col("start")), "\n")).drop("lines")


_HEADED = f"WITH {_DOCS}, l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS ln, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs)), h AS (SELECT doc_id, ln, {_HEADING} AS kind FROM l), k AS (SELECT doc_id, ln AS start, kind, lead(ln) OVER (PARTITION BY doc_id ORDER BY ln) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS n FROM h WHERE kind IS NOT NULL), z AS (SELECT doc_id, max(ln) + 1 AS size FROM l GROUP BY 1), spans AS (SELECT k.doc_id, n, kind, start, coalesce(nxt, size) AS stop FROM k JOIN z USING (doc_id)), sec AS (SELECT s.doc_id, s.n, s.kind, s.start, s.stop, string_agg(x, chr(10) ORDER BY ln) AS x FROM spans s JOIN l ON l.doc_id = s.doc_id AND ln >= start AND ln < stop GROUP BY 1, 2, 3, 4, 5)"


@book.add("e15_headed_sections", _HEADED + " SELECT doc_id, n::INTEGER AS n, kind, CASE WHEN row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) = 1 THEN kind ELSE kind || '_' || n END AS name, start::INTEGER AS start, stop::INTEGER AS stop FROM sec")
def _e15(s, d):
    """Sections by their headings; a kind that comes again gets its number as well."""
    t = headed_sections(docs(s, d).withColumn("kinds", F.lit(None)))
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("n"))  # the sections of one document
    return t.select("doc_id", "n", "kind", F.when(again == 1, F.col("kind")).otherwise(F.concat_ws("_", "kind", "n")).alias("name"), "start", "stop")


def _expected(kind: Column, text: Column) -> Column:
    out = F.lit(0)
    for k in CONTENT:
        out = F.when(kind == k, score(text, k)).otherwise(out)
    return out


_EXPECTED = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_score_sql(k)}" for k in CONTENT) + " ELSE 0 END"
_LABELS = "(?m)^ *([A-Za-z][A-Za-z ]{2,30}?) *:"


@book.add("e17_section_confidence", _HEADED + f", c AS (SELECT doc_id, kind, least(1.0, 0.5 + least(0.4, 0.1 * {_EXPECTED}) + CASE WHEN len(list_distinct(regexp_extract_all(x, '{_LABELS}', 1))) > 5 THEN 0.1 ELSE 0 END) AS c FROM sec) SELECT doc_id, count(*)::BIGINT AS sections, round(least(1.0, avg(c) + least(0.2, 0.05 * count(*) FILTER (WHERE kind IN ('insured', 'hospital', 'claim')))), 6) AS confidence FROM c GROUP BY 1")
def _e17(s, d):
    labels = F.size(F.array_distinct(F.regexp_extract_all("content", F.lit(_LABELS), F.lit(1))))
    c = F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.4), 0.1 * _expected(F.col("kind"), F.col("content"))) + F.when(labels > 5, 0.1).otherwise(0.0))
    t = headed_sections(docs(s, d)).select("doc_id", "kind", c.alias("c"))
    usual = F.count_if(F.col("kind").isin("insured", "hospital", "claim"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.round(F.least(F.lit(1.0), F.avg("c") + F.least(F.lit(0.2), 0.05 * usual)), 6).alias("confidence"))


@book.add("e16_sections_by_content", f"WITH {_DOCS}, a AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs), w AS (SELECT doc_id, ln, array_to_string(list_slice(a, ln + 1, ln + 20), chr(10)) AS x FROM (SELECT doc_id, a, unnest(range(0, len(a), 10)) AS ln FROM a)), p AS (SELECT doc_id, ln, kind, rank, score FROM (" + " UNION ALL ".join(f"SELECT doc_id, ln, '{k}' AS kind, {i} AS rank, {_score_sql(k)} AS score FROM w" for i, k in enumerate(CONTENT)) + ")), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ln ORDER BY score DESC, rank) AS r FROM p WHERE score >= 2), c AS (SELECT doc_id, ln, kind, score, lag(kind) OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM b WHERE r = 1) SELECT doc_id, ln::INTEGER AS start, kind, score FROM c WHERE before IS NULL OR before <> kind")
def _e16(s, d):
    """Where no heading tells: windows of 20 lines, ten apart, go to the kind whose wording they hold most; changes begin sections."""
    best = lambda x: F.array_max(F.array(*[F.struct(score(x, k).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(CONTENT)]))
    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(10)), lambda at: F.struct(at.alias("at"), best(F.array_join(F.slice("lines", at + 1, 20), "\n")).alias("b")))
    t = docs(s, d).select("doc_id", F.filter(windows, lambda w: w["b"]["score"] >= 2).alias("w"))
    changes = F.filter("w", lambda w, i: (i == 0) | (w["b"]["kind"] != F.get("w", i - 1)["b"]["kind"]))
    return t.select("doc_id", F.inline(F.transform(changes, lambda w: F.struct(w["at"].alias("start"), w["b"]["kind"].alias("kind"), w["b"]["score"].alias("score")))))


_FORMS = (("cashless request", "cashless|pre[ -]?auth"), ("reimbursement claim", "reimbursement|claim form"), ("health insurance claim", "health insurance|mediclaim"), ("hospital bill", "hospital bill"), ("discharge summary", "discharge summary|final bill"))


@book.add("e18_form_types", f"WITH {_DOCS} SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in _FORMS) + " ELSE 'insurance claim' END AS form FROM docs")
def _e18(s, d):
    form = F.lit("insurance claim")
    for k, p in reversed(_FORMS):
        form = F.when(F.lower("text").rlike(p), k).otherwise(form)
    return docs(s, d).select("doc_id", form.alias("form"))


@book.add("e19_labels", "WITH " + _TEXTS + f", x AS (SELECT scan_id, list_sort(list_distinct(regexp_extract_all(text, '{_LABELS}', 1))) AS a FROM s) SELECT scan_id, len(a)::INTEGER AS labels, array_to_string(list_slice(a, 1, 20), ';') AS first_20 FROM x WHERE len(a) > 0")
def _e19(s, d):
    a = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_LABELS), F.lit(1))))
    return texts(s, d).select("scan_id", a.alias("a")).where("size(a) > 0").select("scan_id", F.size("a").alias("labels"), F.array_join(F.slice("a", 1, 20), ";").alias("first_20"))


#: The fields of each kind of section, by name of their patterns.
SECTION_FIELDS = {"insured": ("policy_number", "claimant_name", "date_of_birth", "member_id"), "hospital": ("hospital_name", "date_of_admission", "date_of_discharge", "room_type", "provider_name"), "claim": ("billed_amount", "claim_number"), "medical": ("diagnosis_icd", "diagnosis_text", "procedure_code", "procedure_name"), "declaration": ("claimant_name", "date_of_service")}


@book.add("e20_section_data", _HEADED + ", q AS (SELECT doc_id, n, kind, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS line FROM sec), f AS (" + " UNION ALL ".join(f"SELECT doc_id, n, kind, '{f}' AS field, ({_first_sql(PATTERNS[f])}).value AS found FROM q WHERE kind = '{k}'" for k, fs in SECTION_FIELDS.items() for f in fs) + ") SELECT doc_id, n::INTEGER AS n, kind, field, found FROM f WHERE found IS NOT NULL")
def _e20(s, d):
    """The fields that each kind of section is asked for, from its own content."""
    t = headed_sections(docs(s, d)).withColumn("line", F.trim(F.regexp_replace("content", "\\s+", " ")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col("kind") == k, first_match(F.col("line"), PATTERNS[f])["value"]).alias("found")) for k, fs in SECTION_FIELDS.items() for f in fs])
    return t.select("doc_id", "n", "kind", F.inline(F.filter(cells, lambda c: c["found"].isNotNull())))


@book.add("e07_sectioned_records", _HEADED + ", q AS (SELECT doc_id, kind, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS line FROM sec) SELECT doc_id, " + ", ".join(f"max(CASE WHEN kind = '{k}' THEN ({_first_sql(PATTERNS[fs[0]])}).value END) AS {k}_{fs[0]}" for k, fs in SECTION_FIELDS.items()) + " FROM q GROUP BY 1")
def _e07(s, d):
    """One record a document, a column for the leading field of each kind of section."""
    t = headed_sections(docs(s, d)).withColumn("line", F.trim(F.regexp_replace("content", "\\s+", " ")))
    return t.groupBy("doc_id").agg(*[F.max(F.when(F.col("kind") == k, first_match(F.col("line"), PATTERNS[fs[0]])["value"])).alias(f"{k}_{fs[0]}") for k, fs in SECTION_FIELDS.items()])


# --- dates and codes with their context ------------------------------------------------------------------------------

_MON = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
ANY_DATE = f"(?i)\\b([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:[0-9]{{4}}|[0-9]{{2}})|(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])(?:19|20)[0-9]{{2}}|[0-9]{{1,2}}[ -]{_MON}[ -][0-9]{{4}}|{_MON} [0-9]{{1,2}},? [0-9]{{4}})\\b"
#: What a date is, by the wording before it, the first kind that matches winning.
DATE_KINDS = (("admission", "admi(?:ssion|tted)|\\bdoa\\b"), ("discharge", "discharged?|\\bdod\\b"), ("birth", "birth|\\bborn\\b|\\bdob\\b"), ("policy start", "policy (?:start|from)|in force from|valid from"), ("policy end", "policy (?:end|to|expiry)|valid (?:to|till)|expir"), ("accident", "accident|date of loss"), ("bill", "bills?|invoice|receipt"), ("follow-up", "follow-?up|appointment"), ("service", "service|taken|performed"))


@book.add("e43_dates_in_text", "WITH " + _TEXTS + f", m AS (SELECT scan_id, unnest(regexp_extract_all(line, '{ANY_DATE}', 1)) AS raw FROM s) SELECT scan_id, {_day_sql('raw')} AS day, count(*)::BIGINT AS n FROM m GROUP BY 1, 2")
def _e43(s, d):
    """All dates of a text in five layouts, any century; a day that isn't in the calendar is null."""
    m = texts(s, d).select("scan_id", F.explode(F.regexp_extract_all("line", F.lit(ANY_DATE), F.lit(1))).alias("raw"))
    return m.groupBy("scan_id", day_of(F.col("raw")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(context, '(?i){p}') THEN '{k}'" for k, p in DATE_KINDS) + " ELSE 'unknown' END"


@book.add("e46_typed_dates", "WITH " + _TEXTS + f", a AS (SELECT scan_id, regexp_extract_all(line, '{ANY_DATE}', 1) AS m, string_split_regex(line, '{ANY_DATE}') AS p FROM s), u AS (SELECT scan_id, unnest(m) AS raw, generate_subscripts(m, 1) AS k, unnest(list_transform(p[1:len(m)], lambda x: substr(x, greatest(1, length(x) - 59)))) AS context FROM a), y AS (SELECT scan_id, k, raw, {_KIND_SQL} AS kind FROM u) SELECT scan_id, k::INTEGER AS k, kind, {_day_sql('raw')} AS day, round(least(1.0, 0.7 + CASE WHEN kind <> 'unknown' THEN 0.2 ELSE 0 END + CASE WHEN length(raw) >= 8 THEN 0.1 ELSE 0 END), 6) AS confidence FROM y")
def _e46(s, d):
    """Each date with what the 60 signs before it, back to the date before, say it is."""
    kind = F.lit("unknown")
    for k, p in reversed(DATE_KINDS):
        kind = F.when(F.col("context").rlike(f"(?i){p}"), k).otherwise(kind)
    a = texts(s, d).select("scan_id", F.regexp_extract_all("line", F.lit(ANY_DATE), F.lit(1)).alias("m"), F.split("line", ANY_DATE).alias("p"))
    u = a.select("scan_id", F.posexplode(F.transform("m", lambda x, i: F.struct(x.alias("raw"), F.right(F.get("p", i), F.lit(60)).alias("context")))).alias("k", "u")).select("scan_id", (F.col("k") + 1).alias("k"), "u.raw", "u.context")
    t = u.withColumn("kind", kind)
    c = F.least(F.lit(1.0), 0.7 + F.when(F.col("kind") != "unknown", 0.2).otherwise(0.0) + F.when(F.length("raw") >= 8, 0.1).otherwise(0.0))
    return t.select("scan_id", "k", "kind", day_of(F.col("raw")).alias("day"), F.round(c, 6).alias("confidence"))


_KEY = {"admitted": "admi(?:ssion|tted)(?: on| date)?", "discharged": "discharged?(?: on| date| is planned for)?", "born": "(?:date of birth|born(?: on)?|dob)", "follow_up": "appointment has been scheduled for"}
_KEY_DATE = ANY_DATE.replace("(?i)\\b", "").removesuffix("\\b")


@book.add("e47_key_dates", "WITH " + _TEXTS + ", r AS (SELECT scan_id, " + ", ".join(f"regexp_extract(line, '(?i){p}[ :]+{_KEY_DATE}', 1) AS {n}" for n, p in _KEY.items()) + " FROM s) SELECT scan_id, " + ", ".join(f"{_day_sql(n)} AS {n}" for n in _KEY) + " FROM r")
def _e47(s, d):
    return texts(s, d).select("scan_id", *[day_of(F.regexp_extract("line", f"(?i){p}[ :]+{_KEY_DATE}", 1)).alias(n) for n, p in _KEY.items()])


ANY_ICD = "\\b([A-TV-Z][0-9]{2}(?:\\.[0-9]{1,4})?[A-Z]?)\\b"
#: Wording before a code that makes it something else, that makes it the primary one, or that shows it is medical.
NO_CODE = "(?i)(?:pin|zip|mobile|phone|tel|fax|plot|shop|flat|house|sector|block|wing|tower|branch|account|a/c|ifsc|pan|page|serial|reg|registration|invoice|bill|room|bed|policy|claim|lot|order)[ :.]*(?:no)?[ :.]*$"
PRIMARY = "(?i)(?:primary|principal|main|chief) (?:diagnosis|dx|complaint)|admitting (?:diagnosis|dx)|reason for admission"
MEDICAL = "(?i)icd|diagnos|disease|condition|procedure|surgery|medical|clinical|treatment|therapy|illness|marked|mentions"
_CTX = "ctx AS (SELECT DISTINCT code_id, trim(regexp_replace(context, '\\s+', ' ', 'g')) AS line FROM claim_codes WHERE context IS NOT NULL)"


def contexts(s, d):
    c = table(s, d, "claim_codes", "code_id", "context").where("context IS NOT NULL").distinct()
    return c.select("code_id", F.trim(F.regexp_replace("context", "\\s+", " ")).alias("line"))


_FOUND = f"WITH {_CTX}, a AS (SELECT code_id, regexp_extract_all(line, '{ANY_ICD}', 1) AS m, string_split_regex(line, '{ANY_ICD}') AS p FROM ctx), u AS (SELECT code_id, unnest(m) AS code, generate_subscripts(m, 1) AS k, unnest(list_transform(p[1:len(m)], lambda x: substr(x, greatest(1, length(x) - 49)))) AS before, unnest(list_transform(p[2:len(m) + 1], lambda x: substr(x, 1, 50))) AS after FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY code_id, code ORDER BY k) AS r FROM u)"


def found_codes(t):
    """(code_id, code, k, before, after): the first occurrence of each code of a text with the 50 signs around it."""
    a = t.select("code_id", F.regexp_extract_all("line", F.lit(ANY_ICD), F.lit(1)).alias("m"), F.split("line", ANY_ICD).alias("p"))
    every = F.transform("m", lambda x, i: F.struct(x.alias("code"), (i + 1).alias("k"), F.right(F.get("p", i), F.lit(50)).alias("before"), F.left(F.get("p", i + 1), F.lit(50)).alias("after")))
    first = F.filter(every, lambda e: F.array_position("m", e["code"]) == e["k"])
    return a.select("code_id", F.inline(first))


@book.add("e35_codes_judged", _FOUND + f" SELECT code_id, code, regexp_matches(before, '{NO_CODE}') AS no_code, regexp_matches(before || after, '{PRIMARY}') AS is_primary, round(greatest(0, least(1, 0.5 + CASE WHEN regexp_matches(before || after, '{MEDICAL}') THEN 0.15 ELSE 0 END + CASE WHEN contains(code, '.') THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(before, '{NO_CODE}') THEN 0.4 ELSE 0 END)), 6) AS score FROM f WHERE r = 1")
def _e35(s, d):
    """Codes in their wording: which are something else, which is primary, and how sure each is."""
    around = F.concat("before", "after")
    score_ = 0.5 + F.when(around.rlike(MEDICAL), 0.15).otherwise(0.0) + F.when(F.contains("code", F.lit(".")), 0.05).otherwise(0.0) - F.when(F.col("before").rlike(NO_CODE), 0.4).otherwise(0.0)
    return found_codes(contexts(s, d)).select("code_id", "code", F.col("before").rlike(NO_CODE).alias("no_code"), around.rlike(PRIMARY).alias("is_primary"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score_)), 6).alias("score"))


@book.add("e40_nearby_descriptions", _FOUND + " SELECT code_id, code, nullif(trim(regexp_extract(after, '^[ :,-]*([A-Za-z][A-Za-z ]{3,40})', 1)), '') AS description FROM f WHERE r = 1")
def _e40(s, d):
    return found_codes(contexts(s, d)).select("code_id", "code", F.nullif(F.trim(F.regexp_extract("after", "^[ :,-]*([A-Za-z][A-Za-z ]{3,40})", 1)), F.lit("")).alias("description"))


_CPT = "\\b([0-9]{5})(?:-([A-Z0-9]{2}))?\\b"


@book.add("e38_procedures_in_text", f"WITH {_CTX}, m AS (SELECT code_id, unnest(regexp_extract_all(line, '{_CPT}', 1)) AS code, unnest(regexp_extract_all(line, '{_CPT}', 2)) AS modifier FROM ctx) SELECT code_id, code, max(nullif(modifier, '')) AS modifier, count(*)::BIGINT AS n FROM m WHERE TRY_CAST(code AS INTEGER) BETWEEN 10004 AND 69990 OR TRY_CAST(code AS INTEGER) BETWEEN 70010 AND 89398 OR TRY_CAST(code AS INTEGER) BETWEEN 90281 AND 99607 GROUP BY 1, 2")
def _e38(s, d):
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(_CPT), F.lit(1)).alias("code"), F.regexp_extract_all("line", F.lit(_CPT), F.lit(2)).alias("modifier"))
    m = contexts(s, d).select("code_id", F.inline(both)).withColumn("k", F.col("code").cast("int")).where("k BETWEEN 10004 AND 69990 OR k BETWEEN 70010 AND 89398 OR k BETWEEN 90281 AND 99607")
    return m.groupBy("code_id", "code").agg(F.max(F.nullif("modifier", F.lit(""))).alias("modifier"), F.count(F.lit(1)).alias("n"))
