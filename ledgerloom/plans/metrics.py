"""Metrics, reports and data-quality scorecards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.plans.book import AUDIT_SQL, CLAIMS_SQL, ITEMS_SQL, Book
from ledgerloom.plans.filters import claims
from ledgerloom.sources.tables import once, table

book = Book()


def items(s, d, *, keep=None):
    return once(table(s, d, "claim_items"), ["claim_id", "pos"], keep)


def audit(s, d, *, keep=None):
    return once(table(s, d, "audit_log"), ["log_id"], keep)


_AS_OF = "t AS (SELECT CAST(max(created_at) AS DATE) AS as_of FROM claims)"


@book.add("m01_kpis", f"WITH {CLAIMS_SQL} SELECT count(*)::BIGINT AS total_claims, count(*) FILTER (WHERE billed_amount > 100000)::BIGINT AS large_claims, round(coalesce(sum(billed_amount) FILTER (WHERE lower(trim(status)) = 'rejected'), 0), 2) AS amount_protected, round(CASE WHEN count(*) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (WHERE billed_amount > 100000) / count(*) END, 4) AS large_share FROM claims")
def _m01(s, d):
    c = claims(s, d)
    large = F.count_if(F.col("billed_amount") > 100000)
    return c.agg(F.count(F.lit(1)).alias("total_claims"), large.alias("large_claims"), F.round(F.coalesce(F.sum(F.when(F.lower(F.trim("status")) == "rejected", F.col("billed_amount"))), F.lit(0.0)), 2).alias("amount_protected"), F.round(F.coalesce(F.try_divide(100.0 * large, F.count(F.lit(1))), F.lit(0.0)), 4).alias("large_share"))


@book.add("m05_size_distribution", f"WITH {CLAIMS_SQL} SELECT CASE WHEN billed_amount IS NULL THEN 'unknown' WHEN billed_amount <= 0 THEN 'none' WHEN billed_amount < 10000 THEN 'small' WHEN billed_amount < 100000 THEN 'medium' ELSE 'large' END AS band, count(*)::BIGINT AS n FROM claims GROUP BY 1")
def _m05(s, d):
    a = F.col("billed_amount")
    band = F.when(a.isNull(), "unknown").when(a <= 0, "none").when(a < 10000, "small").when(a < 100000, "medium").otherwise("large")
    return claims(s, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@book.add("m06_status_distribution", f"WITH {CLAIMS_SQL} SELECT coalesce(lower(trim(status)), 'unknown') AS status, count(*)::BIGINT AS n FROM claims GROUP BY 1")
def _m06(s, d):
    return claims(s, d).groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@book.add("m07_recent", f"WITH {CLAIMS_SQL} SELECT claim_id, claim_number FROM claims ORDER BY created_at DESC NULLS LAST, claim_id DESC LIMIT 10")
def _m07(s, d):
    return claims(s, d).orderBy(F.col("created_at").desc_nulls_last(), F.col("claim_id").desc()).limit(10).select("claim_id", "claim_number")


@book.add("m08_daily_trend", f"WITH {CLAIMS_SQL}, {_AS_OF} SELECT CAST(created_at AS DATE) AS day, count(*)::BIGINT AS n, count(*) FILTER (WHERE billed_amount > 50000)::BIGINT AS large FROM claims, t WHERE CAST(created_at AS DATE) BETWEEN as_of - INTERVAL 30 DAY AND as_of GROUP BY 1")
def _m08(s, d):
    c = claims(s, d)
    as_of = c.agg(F.max(F.to_date("created_at")).alias("as_of"))
    day = F.to_date("created_at")
    return c.join(F.broadcast(as_of)).where(day.between(F.date_sub("as_of", 30), F.col("as_of"))).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("billed_amount") > 50000).alias("large"))


@book.add("m09_money_text", "WITH t AS (SELECT '$' || CAST(l_quantity AS INTEGER) || ',500' AS amount, l_returnflag FROM lineitem) SELECT l_returnflag, count(v)::BIGINT AS n, round(avg(v), 4) AS mean, round(sum(v), 2) AS total FROM (SELECT l_returnflag, TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE) AS v FROM t) GROUP BY 1")
def _m09(s, d):
    v = T.money(F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.lit(",500")))
    return table(s, d, "lineitem", "l_quantity", "l_returnflag").groupBy("l_returnflag").agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.sum(v), 2).alias("total"))


@book.add("m10_action_counts", f"WITH {AUDIT_SQL} SELECT lower(action_name) AS action, user_id, count(*)::BIGINT AS n FROM audit GROUP BY 1, 2")
def _m10(s, d):
    return audit(s, d).groupBy(F.lower("action_name").alias("action"), "user_id").agg(F.count(F.lit(1)).alias("n"))


@book.add("m11_provider_table", f"WITH {CLAIMS_SQL} SELECT npi_number, count(*)::BIGINT AS claims, round(sum(billed_amount), 2) AS billed, round(avg(CASE WHEN billed_amount > 100000 THEN 1.0 ELSE 0.0 END), 6) AS large_share FROM claims WHERE npi_number IS NOT NULL GROUP BY 1")
def _m11(s, d):
    return claims(s, d, keep="npi_number IS NOT NULL").groupBy("npi_number").agg(F.count(F.lit(1)).alias("claims"), F.round(F.sum("billed_amount"), 2).alias("billed"), F.round(F.avg(F.when(F.col("billed_amount") > 100000, 1.0).otherwise(0.0)), 6).alias("large_share"))


@book.add("m12_monthly_change", f"WITH {CLAIMS_SQL}, m AS (SELECT CAST(date_trunc('month', date_of_service) AS DATE) AS month, count(*)::BIGINT AS n FROM claims WHERE date_of_service IS NOT NULL GROUP BY 1) SELECT month, n, n - lag(n) OVER (ORDER BY month) AS change, n - lag(n, 12) OVER (ORDER BY month) AS year_change FROM m")
def _m12(s, d):
    # The window runs over one row a month, whatever the number of claims.
    m = claims(s, d, keep="date_of_service IS NOT NULL").groupBy(F.trunc("date_of_service", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("month")
    return m.select("month", "n", (F.col("n") - F.lag("n").over(w)).alias("change"), (F.col("n") - F.lag("n", 12).over(w)).alias("year_change"))


@book.add("m13_batch_summary", f"WITH {CLAIMS_SQL} SELECT claim_id, CASE WHEN hospital_name IS NULL THEN 'error: no hospital' WHEN billed_amount IS NULL THEN 'error: no amount' ELSE 'ok' END AS outcome FROM claims")
def _m13(s, d):
    return claims(s, d).select("claim_id", F.when(F.col("hospital_name").isNull(), "error: no hospital").when(F.col("billed_amount").isNull(), "error: no amount").otherwise("ok").alias("outcome"))


@book.add("m15_masked_log", f"WITH {AUDIT_SQL} SELECT log_id, substr(user_id, 1, 1) || '***' AS who, lower(action_name) AS action FROM audit")
def _m15(s, d):
    return audit(s, d).select("log_id", T.masked_user(F.col("user_id")).alias("who"), F.lower("action_name").alias("action"))


_CATS = ["Room", "Surgery", "ICU", "Pharmacy", "Laboratory"]


@book.add("m16_category_pivot", f"WITH {ITEMS_SQL} SELECT claim_id, " + ", ".join(f"round(sum(amount) FILTER (WHERE category = '{c}'), 2) AS {c.lower()}" for c in _CATS) + " FROM items GROUP BY 1")
def _m16(s, d):
    return items(s, d).groupBy("claim_id").pivot("category", _CATS).agg(F.round(F.sum("amount"), 2)).withColumnsRenamed({c: c.lower() for c in _CATS})


@book.add("v20_quality_scorecard", "SELECT count(*)::BIGINT AS rows_total, (count(*) - count(DISTINCT claim_id))::BIGINT AS duplicates, (count(*) FILTER (WHERE hospital_name IS NULL) + count(*) FILTER (WHERE diagnosis IS NULL) + count(*) FILTER (WHERE billed_amount IS NULL))::BIGINT AS nulls, greatest(0, 100 - 10 * (count(*) - count(DISTINCT claim_id)) - 2 * (count(*) FILTER (WHERE hospital_name IS NULL) + count(*) FILTER (WHERE diagnosis IS NULL) + count(*) FILTER (WHERE billed_amount IS NULL)))::BIGINT AS score FROM claim")
def _v20(s, d):
    c = table(s, d, "claim", "claim_id", "hospital_name", "diagnosis", "billed_amount")
    per = c.agg(F.count(F.lit(1)).alias("rows_total"), (F.count(F.lit(1)) - F.count_distinct("claim_id")).alias("duplicates"), (F.count_if(F.col("hospital_name").isNull()) + F.count_if(F.col("diagnosis").isNull()) + F.count_if(F.col("billed_amount").isNull())).alias("nulls"))
    return per.withColumn("score", F.greatest(F.lit(0).cast("bigint"), 100 - 10 * F.col("duplicates") - 2 * F.col("nulls")))
