from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions import text as T


def one(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.select("i", make(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_clean_name(spark):
    given = ["Miss", "Dr Asha Example", "Mrs. Jane Sample", "Ann Other MD", "Al", None, "  Shri  A.  B "]
    assert one(spark, given, T.clean_name) == ["", "Asha Example", "Jane Sample", "Ann Other", "", "", "A. B"]


def test_money(spark):
    assert one(spark, ["₹1,234.50", "Rs. 1,50,000.00", "abc", "", None, "INR 20", "1,50,000/-"], T.money) == [1234.5, 150000.0, None, None, None, 20.0, 150000.0]


def test_parse_date(spark):
    given = ["2025-02-06", "5-8-24", "05/08/2024", "31.02.2024", "18", "1 Jan 1973", "12-May-2023", "07041965", None, "", "3/4/71"]
    assert one(spark, given, D.parse_date) == [date(2025, 2, 6), date(2024, 8, 5), date(2024, 8, 5), None, None, date(1973, 1, 1), date(2023, 5, 12), date(1965, 4, 7), None, None, date(1971, 4, 3)]


def test_policy_number_and_masks(spark):
    assert one(spark, ["ab 12/34", None], T.policy_number) == ["AB-12-34", None]
    assert one(spark, ["user_7"], T.masked_user) == ["u***"]


def test_similarity_ignores_word_order(spark):
    frame = spark.createDataFrame([("eye hospital", "hospital eye"), ("a", "b")], "a string, b string")
    assert [r[0] for r in frame.select(T.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_quantiles_equal_those_of_gathered_groups(spark):
    import numpy as np

    from ledgerloom.operators.quantiles import exact_quantiles

    draw = np.random.default_rng(5)
    groups = {"a": draw.normal(0, 5000, 501).tolist(), "b": [7.0], "c": [1.0, 1.0, 1.0, 2.0], "d": [-1000.0, 1000.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("b", None), (None, 3.0)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"m": 0.5, "p90": 0.9, "max": 1.0}).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        assert np.allclose([r.m, r.p90, r.max], np.quantile(groups[r.g], [0.5, 0.9, 1.0]))
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", {"m": 0.5}).collect() == []
