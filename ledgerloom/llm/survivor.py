"""One surviving record per claim, field by field.

Two selections share the usable values of each (claim, field):

* ``survivors``: the record whose value survives by the order the data's owner states (trust of the method, then
  recency, then rec_id). Votes play no part in that order, so fusion can't give it; see the README.
* ``fused``: Bayesian fusion with copy detection. Accuracies of the sources and their dependence are estimated in turn:
  values that two sources share although another value is the more probable point to copying, a copied vote counts
  only by the chance that it is independent, and the value of the greatest posterior survives.

Defined results: null, blank, placeholder, form wording, partial or impossible dates and sums that can't be one are no
values; a (claim, field) without a usable value has no row; repeated rows count once; a record whose claim can't be
told belongs to no claim; an unnamed or unknown method ranks after the named ones. Only the columns named here are
read, so further columns don't matter.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.durable import durable

TEXTS = ("policy_number", "hospital_name", "patient_name")
DATES = ("dob", "admission_date", "discharge_date")
AMOUNT = "total_amount"
#: Sums above this are phone or reference numbers; the same bound as for billing amounts elsewhere.
MOST = 50_000_000.0
#: Words that stand for a missing value, and wording of the printed form caught in a field.
PLACEHOLDERS = ("null", "none", "nil", "na", "n/a", "nan", "unknown", "not found", "not available", "not applicable", "tbd", "test", "xxx", "dd/mm/yyyy")
FORM_WORDING = ("theatre notes", "ificate", "name of the insured", "where applicable", "(in block letters)", "in block letters", "information", "to be filled by", "documents", "indicate if", "main bill original", "entity")


def claim_number(file_name: Column, claim_id: Column) -> Column:
    """The number a record is about: the file name's leading digits, or where there is no file name those of claim_id."""
    of_file = F.regexp_extract(F.trim(file_name), r"^0*(\d{1,18})", 1)
    of_id = F.regexp_extract(F.trim(claim_id), r"(?i)^(?:cl(?:aim)?[-_ #/]*)?0*(\d{1,18})(?:$|[^0-9])", 1)
    return F.when(file_name.isNotNull(), of_file).otherwise(of_id).try_cast("bigint")


def folded_method(method: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(method)), r"[\s-]+", "_"), F.lit(""))


def iso_date(value: Column) -> Column:
    """The day a text names, day first unless it begins with the year; null for partial and impossible ones."""
    return F.get(iso_dates(F.array(value)), F.lit(0))


def iso_dates(values: Column) -> Column:
    """iso_date of each member of an array. The members are bound by lambdas, so that each text is cleaned once and not in every branch."""
    text = F.transform(values, lambda v: F.regexp_replace(F.lower(F.trim(v)), r"[./,\s-]+", "-"))
    parts = F.transform(text, lambda t: F.split(t, "-"))
    day = F.transform(parts, _day)
    return F.transform(day, lambda d: F.when(F.year(d).between(1850, 2100), d))


#: The first three letters of month names, in their order.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _day(p: Column) -> Column:
    """DATE of the three parts of a text, null if they are none."""
    number = lambda i: F.get(p, F.lit(i)).try_cast("int")
    size = lambda i: F.length(F.get(p, F.lit(i)))
    named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(F.get(p, F.lit(1)), 1, 3)).cast("int")
    month = F.when(F.get(p, F.lit(1)).rlike("^[a-z]{3,9}$"), F.nullif(named, F.lit(0))).when(size(1) <= 2, number(1))
    iso = size(0) == 4
    year = F.when(iso, number(0)).when(size(2) == 4, number(2)).when((size(2) == 2) & (size(1) <= 2), 2000 + number(2))
    at = F.when(iso, F.when(size(2) <= 2, number(2))).when(size(0) <= 2, number(0))
    return F.when(
        (F.size(p) == 3) & year.isNotNull() & month.between(1, 12) & at.between(1, 31), F.try_to_timestamp(F.concat_ws("-", year, month, at), F.lit("y-M-d")).cast("date")
    )


def _folded(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def usable_text(value: Column) -> Column:
    folded = _folded(value)
    return value.isNotNull() & folded.rlike(r"[\p{L}\p{N}]") & ~folded.isin(*PLACEHOLDERS, *FORM_WORDING)


def _values(extractions: DataFrame) -> DataFrame:
    """One row per record: claim_no, method, extracted_at, rec_id and an array of (field, value) of the usable values."""
    rows = extractions.select(
        "rec_id",
        "extracted_at",
        claim_number(F.col("file_name"), F.col("claim_id")).alias("claim_no"),
        folded_method(F.col("extraction_method")).alias("method"),
        *TEXTS,
        *DATES,
        AMOUNT,
    ).where("claim_no IS NOT NULL AND rec_id IS NOT NULL")
    can_be = {
        "policy_number": F.col("policy_number").rlike(r"\d.*\d.*\d.*\d") & F.col("policy_number").rlike(r"^\s*[\p{L}\p{N}][\p{L}\p{N} /._-]{3,30}\s*$"),
        "hospital_name": F.col("hospital_name").rlike(r"\p{L}{2}"),
        "patient_name": F.col("patient_name").rlike(r"\p{L}{2}") & ~F.col("patient_name").rlike(r"(?i)\b(hospital|clinic|diagnostics|nursing home)\b"),
    }
    canonical = {
        "policy_number": F.regexp_replace(F.translate(F.regexp_replace(F.upper("policy_number"), r"[^A-Z0-9]", ""), "O", "0"), r"^5WP", "SWP"),
        "hospital_name": F.trim(F.regexp_replace(F.lower("hospital_name"), r"[^\p{L}\p{N}]+", " ")),
        "patient_name": F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower("patient_name"), r"[^\p{L}\p{N}]+", " ")), " ")), " "),
    }
    cells = [F.when(usable_text(F.col(c)) & can_be[c], F.struct(F.lit(c).alias("field"), canonical[c].alias("value"))) for c in TEXTS]
    days = F.zip_with(F.array(*map(F.lit, DATES)), iso_dates(F.array(*DATES)), lambda c, d: F.when(d.isNotNull(), F.struct(c.alias("field"), d.cast("string").alias("value"))))
    amount = F.col(AMOUNT).cast("double")
    cells.append(F.when((amount > 0) & (amount <= MOST), F.struct(F.lit(AMOUNT).alias("field"), F.round(amount, 2).cast("string").alias("value"))))
    return rows.select("rec_id", "extracted_at", "claim_no", "method", F.array_compact(F.concat(F.array(*cells), days)).alias("cells"))


def survivors(extractions: DataFrame, methods: DataFrame) -> DataFrame:
    """(claim_no, field_name, rec_id) of claims with at least two records."""
    named = methods.select(folded_method(F.col("extraction_method")).alias("method"), F.col("trust_rank").cast("int").alias("rank")).where("method IS NOT NULL").groupBy("method").agg(F.min("rank").alias("rank"))
    rows = _values(extractions).join(named, "method", "left")
    order = F.struct(-F.coalesce("rank", F.lit(1_000_000)), F.col("extracted_at"), F.col("rec_id"))
    every = (*TEXTS, *DATES, AMOUNT)
    best = [F.max(F.when(F.array_contains(F.transform("cells", lambda c: c["field"]), f), order)).alias(f) for f in every]
    # One partial aggregate per claim over all fields: a hot claim is reduced before the shuffle.
    claims = rows.groupBy("claim_no").agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"), *best).where("lo <> hi")
    pairs = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.rec_id").alias("rec_id"))) for f in every]))
    return claims.select("claim_no", F.explode(pairs).alias("x")).select("claim_no", "x.field_name", "x.rec_id")


#: Sources are methods; more than this many means the column holds something else.
MAX_SOURCES = 500


def fused(extractions: DataFrame, rounds: int = 4, wrong: int = 10, prior: float = 0.2) -> DataFrame:
    """(claim_no, field_name, rec_id, value, posterior): the canonical value of the greatest posterior (ties: by a hash of it).

    rec_id is the record that gives the value: the latest of those that have it, then the largest rec_id. wrong is the number of false values assumed for a field, prior the chance that two sources depend on each other. How
    much of its values a copier copies is estimated for each pair of sources.
    """
    votes = durable(
        _values(extractions)
        .select("claim_no", F.coalesce("method", F.lit("unnamed")).alias("source"), F.struct("extracted_at", "rec_id").alias("record"), F.explode("cells").alias("c"))
        .groupBy("claim_no", F.col("c.field").alias("field_name"), F.col("c.value").alias("value"), "source")
        .agg(F.max("record").alias("record"))
    )
    grouped = votes.groupBy("claim_no", "field_name", "value").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("record")["rec_id"].alias("rec_id"))
    sources = [r[0] for r in votes.select("source").distinct().orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    accuracy = dict.fromkeys(sources, 0.8)
    copies: dict[tuple[str, str], float] = {}
    result = _posterior(grouped, sources, accuracy, copies, wrong)
    for _ in range(rounds):
        # Dependence first: votes that were only copied must not make their sources look accurate.
        copies = _dependence(durable(result), accuracy, wrong, prior)
        result = durable(_posterior(grouped, sources, accuracy, copies, wrong))
        right = {r["source"]: r["a"] for r in result.select(F.explode("sources").alias("source"), "posterior").groupBy("source").agg(F.avg("posterior").alias("a")).collect()}
        accuracy = {s: min(0.99, max(0.05, right.get(s, 0.8))) for s in sources}
        result = _posterior(grouped, sources, accuracy, copies, wrong)
    best = result.groupBy("claim_no", "field_name").agg(F.max_by(F.struct("rec_id", "value", "posterior"), F.struct("posterior", F.hash("value"))).alias("b"))
    return best.select("claim_no", "field_name", "b.rec_id", "b.value", F.round("b.posterior", 6).alias("posterior"))


def _posterior(grouped: DataFrame, sources: list[str], accuracy: dict[str, float], copies: dict[tuple[str, str], float], wrong: int) -> DataFrame:
    """Adds score and posterior to each value; a source's vote is discounted by the more accurate ones it may copy."""
    score = F.lit(0.0)
    ranked = sorted(sources, key=lambda s: (-accuracy[s], s))
    for i, s in enumerate(ranked):
        independent = F.lit(1.0)
        for other in ranked[:i]:
            p = copies.get((min(s, other), max(s, other)), 0.0)
            if p > 0.01:
                independent = independent * F.when(F.array_contains("sources", other), 1.0 - p).otherwise(1.0)
        vote = math.log(wrong * accuracy[s] / (1 - accuracy[s]))
        score = score + F.when(F.array_contains("sources", s), independent * vote).otherwise(0.0)
    scored = grouped.select("claim_no", "field_name", "value", "sources", "rec_id", score.alias("score"))
    total = scored.groupBy("claim_no", "field_name").agg(F.sum(F.exp("score")).alias("total"), F.count(F.lit(1)).alias("values"))
    return scored.join(total, ["claim_no", "field_name"]).select("claim_no", "field_name", "value", "sources", "rec_id", (F.exp("score") / (F.col("total") + F.greatest(F.lit(0), wrong + 1 - F.col("values")))).alias("posterior"))


def _dependence(values: DataFrame, accuracy: dict[str, float], wrong: int, prior: float) -> dict[tuple[str, str], float]:
    """The share of its values that one source of a pair copies from the other, times the posterior chance that it copies at all.

    Told from shared true, shared false and differing values; the share is the likeliest in steps of a twentieth.
    """
    pairs = F.flatten(F.transform("sources", lambda a: F.transform(F.filter("sources", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    same = values.select(F.explode(pairs).alias("p"), "posterior").groupBy("p.a", "p.b").agg(F.sum("posterior").alias("true"), F.sum(1 - F.col("posterior")).alias("false"))
    by_field = values.groupBy("claim_no", "field_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    both = by_field.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("both"))
    found = {}
    counts = {(r["a"], r["b"]): r for r in both.join(same, ["a", "b"], "left").collect()}
    for a, b in combinations(sorted(accuracy), 2):
        if not (r := counts.get((a, b))):
            continue
        true, false = r["true"] or 0.0, r["false"] or 0.0
        differ = max(0.0, r["both"] - true - false)
        pa, pb = accuracy[a], accuracy[b]
        t, f = pa * pb, (1 - pa) * (1 - pb) / wrong
        d = max(1e-9, 1 - t - f)
        mean = (pa + pb) / 2
        lone = true * math.log(t) + false * math.log(f) + differ * math.log(d)
        tied = lambda c: true * math.log(mean * c + t * (1 - c)) + false * math.log((1 - mean) * c + f * (1 - c)) + differ * math.log(d * (1 - c))  # noqa: B023, E731
        share = max((i / 20 for i in range(1, 20)), key=tied)
        odds = lone - tied(share) + math.log((1 - prior) / prior)
        found[(a, b)] = share / (1 + math.exp(min(700.0, max(-700.0, odds))))
    return found
