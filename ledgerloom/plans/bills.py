"""Bills in scanned texts: the section of the bill, its lines, amounts, quantities, and what only looks like a bill line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.book import Book
from ledgerloom.plans.extraction import CATEGORIES
from ledgerloom.sources.tables import table

book = Book()

#: What heads a bill, what ends one, what its lines are about, what sums it up, and what is an address or id instead.
HEADER = "bill (?:of )?particulars|itemi[sz]ed (?:bill|statement)|hospital bill|final bill|statement of charges|charges details|interim bills|charges *:|charges +(?:rs|inr|₹)"
END = "declaration|signature|bank details|terms and conditions|sd/-"
ABOUT = "|".join(p for _, p in CATEGORIES) + "|charge|fee|bed|ward|injection|implant|oxygen|diet|scan|x-?ray|physio|ambulance|registration|consumable"
SUMMARY = "total|discount|net amount|balance|advance|refund|payable"
ELSEWHERE = "(?:plot|flat|shop|house|block|sector|floor|room) no|\\bpin\\b|mobile|phone|tel\\b|a/c|account|ifsc|policy|certificate|member|uhid|page [0-9]|uid|passport|voter"
_T = "t AS (SELECT DISTINCT scan_id, raw_text_preview AS text FROM scan_texts WHERE raw_text_preview IS NOT NULL AND scan_id IS NOT NULL), l AS (SELECT scan_id, generate_subscripts(a, 1)::INTEGER AS line_no, unnest(a) AS line FROM (SELECT scan_id, string_split(text, chr(10)) AS a FROM t))"


def lined(s, d):
    t = table(s, d, "scan_texts", "scan_id", "raw_text_preview").where("raw_text_preview IS NOT NULL AND scan_id IS NOT NULL").distinct()
    return t.select("scan_id", F.col("raw_text_preview").alias("text"), F.split("raw_text_preview", "\n").alias("lines"))


def lines(s, d):
    return lined(s, d).select("scan_id", F.posexplode("lines").alias("p", "line")).select("scan_id", (F.col("p") + 1).alias("line_no"), "line")


@book.add("e21_bill_sections", f"WITH {_T}, h AS (SELECT scan_id, min(line_no) AS start FROM l WHERE regexp_matches(line, '(?i){HEADER}') GROUP BY 1), e AS (SELECT h.scan_id, start, min(line_no) AS stop FROM h LEFT JOIN l ON l.scan_id = h.scan_id AND line_no > start AND regexp_matches(line, '(?i){END}') GROUP BY 1, 2) SELECT scan_id, start, stop FROM e")
def _e21(s, d):
    """From the first heading of a bill to the first line after it that ends one (null: to the end of the text)."""
    at = lambda pattern: F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(f"(?i){pattern}"), i + 1)), lambda n: n.isNotNull())
    t = lined(s, d).select("scan_id", F.array_min(at(HEADER)).alias("start"), at(END).alias("ends")).where("start IS NOT NULL")
    return t.select("scan_id", "start", F.array_min(F.filter("ends", lambda n: n > F.col("start"))).alias("stop"))


_PRE = "(?i)(?:rs\\.?|inr|₹) ?([0-9][0-9,]*(?:\\.[0-9]{1,2})?)"
_POST = "(?i)\\b([0-9][0-9,]*(?:\\.[0-9]{1,2})?) ?(?:rs\\b|inr|₹|/-)"
_DEC = "\\b([0-9][0-9,]*\\.[0-9]{2})\\b"
_INT = "\\b([0-9]{4,})\\b"


def amount(line):
    """The first amount of a line: with a currency sign in 1..5e7, else with two decimals from 10, else a whole number from 1000 that is no PIN."""
    numbers = lambda p: F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    first = lambda a: F.get(a, F.lit(0))
    signed = F.filter(F.concat(numbers(_PRE), numbers(_POST)), lambda x: x.between(1, 5e7))
    decimal = F.filter(numbers(_DEC), lambda x: x >= 10)
    whole = F.filter(numbers(_INT), lambda x: (x >= 1000) & (x <= 5e7) & ~x.between(400_000, 899_999))
    return F.coalesce(first(signed), first(decimal), first(whole))


def _amount_sql(line: str = "line") -> str:
    n = lambda p: f"list_transform(regexp_extract_all({line}, '{p}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))"
    return f"coalesce(list_filter(list_concat({n(_PRE)}, {n(_POST)}), lambda x: x BETWEEN 1 AND 5e7)[1], list_filter({n(_DEC)}, lambda x: x >= 10)[1], list_filter({n(_INT)}, lambda x: x >= 1000 AND x <= 5e7 AND NOT x BETWEEN 400000 AND 899999)[1])"


@book.add("e23_line_amounts", f"WITH {_T} SELECT scan_id, line_no, amount FROM (SELECT scan_id, line_no, {_amount_sql()} AS amount FROM l) WHERE amount IS NOT NULL")
def _e23(s, d):
    return lines(s, d).select("scan_id", "line_no", amount(F.col("line")).alias("amount")).where("amount IS NOT NULL")


def billing_like(line):
    """Letters and figures, no words of an address or id, and not a short line of capitals."""
    return line.rlike("[A-Za-z]{2}") & line.rlike("[0-9]{3}") & ~line.rlike(f"(?i){ELSEWHERE}") & ~(line.rlike("^[A-Z0-9 ,.-]+$") & (F.length(line) < 20))


_LIKE_SQL = f"(regexp_matches(line, '[A-Za-z]{{2}}') AND regexp_matches(line, '[0-9]{{3}}') AND NOT regexp_matches(line, '(?i){ELSEWHERE}') AND NOT (regexp_matches(line, '^[A-Z0-9 ,.-]+$') AND length(line) < 20))"


@book.add("e24_billing_like_lines", f"WITH {_T} SELECT scan_id, line_no FROM l WHERE {_LIKE_SQL}")
def _e24(s, d):
    return lines(s, d).where(billing_like(F.col("line"))).select("scan_id", "line_no")


_QTY = "(?i)(?:qty|quantity|x|nos?\\.?)[ :]*([0-9]{1,3})\\b|\\b([0-9]{1,3}) ?(?:days?|nos|units?)\\b"


def described(line):
    """The words of a bill line: without amounts, signs of currency, brackets and a quantity at its end."""
    bare = F.regexp_replace(F.regexp_replace(line, "(?i)(?:rs\\.?|inr|₹) ?[0-9][0-9,]*(?:\\.[0-9]{1,2})?|\\b[0-9][0-9,]*\\.[0-9]{2}\\b|\\b[0-9]{4,}\\b", ""), "[\\[\\](){}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(bare), "(?i)[ ]+(?:x|qty)?[ :]*[0-9]{1,3}$", ""), "[ .:=-]+$", ""))


_DESCRIBED = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(line, '(?i)(?:rs\\.?|inr|₹) ?[0-9][0-9,]*(?:\\.[0-9]{1,2})?|\\b[0-9][0-9,]*\\.[0-9]{2}\\b|\\b[0-9]{4,}\\b', '', 'g'), '[\\[\\](){}]', '', 'g')), '(?i)[ ]+(?:x|qty)?[ :]*[0-9]{1,3}$', ''), '[ .:=-]+$', ''))"


@book.add("e25_line_items", f"WITH {_T}, i AS (SELECT scan_id, line_no, line, {_amount_sql()} AS amount, regexp_matches(line, '(?i){ABOUT}') AS about FROM l WHERE NOT regexp_matches(line, '(?i){ELSEWHERE}') AND NOT regexp_matches(line, '(?i){SUMMARY}')), q AS (SELECT *, coalesce(TRY_CAST(nullif(coalesce(nullif(regexp_extract(line, '{_QTY}', 1), ''), regexp_extract(line, '{_QTY}', 2)), '') AS INTEGER), 1) AS quantity FROM i WHERE amount IS NOT NULL AND (about OR {_LIKE_SQL})) SELECT scan_id, line_no, {_DESCRIBED} AS description, amount, quantity, round(amount / quantity, 4) AS unit_price, CASE WHEN about THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM q WHERE quantity > 0")
def _e25(s, d):
    """Lines that bill something: words, amount, quantity and unit price; sure where a billing word stands in the line."""
    line = F.col("line")
    i = lines(s, d).where(~line.rlike(f"(?i){ELSEWHERE}") & ~line.rlike(f"(?i){SUMMARY}")).withColumns({"amount": amount(line), "about": line.rlike(f"(?i){ABOUT}")})
    i = i.where(F.col("amount").isNotNull() & (F.col("about") | billing_like(line)))
    number = F.coalesce(F.nullif(F.regexp_extract(line, _QTY, 1), F.lit("")), F.nullif(F.regexp_extract(line, _QTY, 2), F.lit(""))).try_cast("int")
    i = i.withColumn("quantity", F.coalesce(number, F.lit(1))).where("quantity > 0")
    return i.select("scan_id", "line_no", described(line).alias("description"), "amount", "quantity", F.round(F.col("amount") / F.col("quantity"), 4).alias("unit_price"), F.when(F.col("about"), 0.8).otherwise(0.5).alias("confidence"))


_FALSE = "\\b([4-8][0-9]{5}|[0-9]{10,12})\\b"


@book.add("e27_false_amounts", f"WITH {_T}, n AS (SELECT scan_id, list_transform(regexp_extract_all(text, '{_FALSE}', 1), lambda x: TRY_CAST(x AS DOUBLE)) AS bad FROM t), i AS (SELECT scan_id, line_no, line, {_amount_sql()} AS amount FROM l) SELECT scan_id, line_no, amount, amount < 50 OR list_contains(bad, amount) OR regexp_matches(line, '(?i){ELSEWHERE}') AS false_positive FROM i JOIN n USING (scan_id) WHERE amount IS NOT NULL")
def _e27(s, d):
    """Amounts that are a postal code or a telephone of the same text, too small, or in a line about an address or id."""
    bad = F.transform(F.regexp_extract_all("text", F.lit(_FALSE), F.lit(1)), lambda x: x.try_cast("double"))
    i = lined(s, d).withColumn("bad", bad).select("scan_id", "bad", F.posexplode("lines").alias("p", "line")).withColumn("amount", amount(F.col("line"))).where("amount IS NOT NULL")
    return i.select("scan_id", (F.col("p") + 1).alias("line_no"), "amount", ((F.col("amount") < 50) | F.array_contains("bad", F.col("amount")) | F.col("line").rlike(f"(?i){ELSEWHERE}")).alias("false_positive"))


_TOTALS = {"total": ("\\b(?:grand total|net payable|total amount)[ :]*{0}", "\\btotal[ :]*{0}", "\\bfinal bill(?: of)? {0}", "\\bamount payable[ :]*{0}"), "discount": ("\\b(?:discount|concession|deduction)(?: of)?[ :]*{0}",), "tax": ("\\b(?:gst|tax|cess)[ :@0-9%]*{0}",)}
_ANY_SUM = "(?:rs\\.?|inr|₹) ?([0-9][0-9,]*(?:\\.[0-9]{1,2})?)"


def _total_sql(n: str) -> str:
    q = lambda p: f"TRY_CAST(replace(regexp_extract(line, '(?i){p.replace('{0}', _ANY_SUM)}', 1), ',', '') AS DOUBLE)"
    return "coalesce(" + ", ".join(q(p) for p in _TOTALS[n]) + ", NULL)"


@book.add("e29_ordered_totals", f"WITH {_T}, x AS (SELECT scan_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM t) SELECT * FROM (SELECT scan_id, " + ", ".join(f"{_total_sql(n)} AS {n}" for n in _TOTALS) + " FROM x) WHERE total IS NOT NULL OR discount IS NOT NULL OR tax IS NOT NULL")
def _e29(s, d):
    """Total, discount and tax, each by the first of its patterns that matches."""
    x = lined(s, d).select("scan_id", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("line"))
    of = lambda n: F.coalesce(*[F.replace(F.regexp_extract("line", "(?i)" + p.replace("{0}", _ANY_SUM), 1), F.lit(","), F.lit("")).try_cast("double") for p in _TOTALS[n]])
    return x.select("scan_id", *[of(n).alias(n) for n in _TOTALS]).where("total IS NOT NULL OR discount IS NOT NULL OR tax IS NOT NULL")


@book.add("e32_largest_amounts", f"WITH {_T}, i AS (SELECT scan_id, {_amount_sql()} AS amount FROM l WHERE NOT regexp_matches(line, '(?i){ELSEWHERE}')) SELECT scan_id, max(amount) AS largest FROM i WHERE amount BETWEEN 100 AND 10000000 GROUP BY 1")
def _e32(s, d):
    """The fallback total: the largest amount in 100..10 million outside lines about addresses and ids."""
    kept = F.filter(F.transform("lines", lambda x: F.when(~x.rlike(f"(?i){ELSEWHERE}"), amount(x))), lambda a: a.between(100, 10_000_000))
    return lined(s, d).select("scan_id", F.array_max(kept).alias("largest")).where("largest IS NOT NULL")
