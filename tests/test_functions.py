import math

from pyspark.sql import functions as F

from vectriage.functions.bands import confidence_band, duplicate_assessment, sentiment_from_score, similarity_band
from vectriage.functions.numeric import round_half_away, safe_ratio
from vectriage.functions.text import preview, stars, strip_ws


def test_round_half_away(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (1.005,), (None,), (-0.004,)], "x double")
    got = [r[0] for r in df.select(round_half_away("x", 2)).collect()]
    assert got[0] == 2.5 and got[1] == -2.5
    assert got[2] == 0.13          # 0.125 is exact in binary: half goes away from zero
    assert got[3] == 1.0           # 1.005 is 1.00499999... in binary
    assert got[4] is None
    assert got[5] == 0.0 and math.copysign(1, got[5]) == -1  # same sign rule as the SQL form
    whole = [r[0] for r in df.select(round_half_away("x", 0)).collect()]
    assert whole[:2] == [3.0, -3.0]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(3, 4), (5, 0), (7, 2)], "n long, d long")
    assert [r[0] for r in df.select(safe_ratio("n", "d")).collect()] == [0.75, 0.0, 3.5]


def test_strip_and_preview(spark):
    df = spark.createDataFrame([("\t a b \n",), ("x" * 201,), ("short",)], "s string")
    rows = df.select(strip_ws("s"), preview("s")).collect()
    assert rows[0][0] == "a b"
    assert rows[1][1] == "x" * 200 + "..."
    assert rows[2][1] == "short"
    assert spark.range(1).select(stars(F.lit(3))).first()[0] == "⭐⭐⭐"


def test_bands(spark):
    df = spark.createDataFrame([(0.01,), (0.07,), (0.15,), (0.3,)], "d double")
    assert [r[0] for r in df.select(duplicate_assessment("d")).collect()] == [
        "Very Likely Duplicate", "Likely Duplicate", "Possibly Related", "Different Issue"]
    s = spark.createDataFrame([(95.0,), (85.0,), (75.0,), (65.0,), (10.0,)], "s double")
    assert [r[0] for r in s.select(similarity_band("s")).collect()] == [
        "Nearly identical", "Very similar", "Similar", "Somewhat related", "Different"]
    assert [r[0] for r in s.select(similarity_band("s", five=False)).collect()] == [
        "high", "high", "medium", "medium", "low"]
    c = spark.createDataFrame([(270.0,), (60.0,), (40.0,), (39.99,)], "c double")
    assert [r[0] for r in c.select(confidence_band("c")).collect()] == ["HIGH", "MEDIUM", "LOW", "VERY LOW"]
    sc = spark.createDataFrame([(1,), (5,), (0,), (6,)], "s int")
    assert [r[0] for r in sc.select(sentiment_from_score("s")).collect()] == [
        "Very Negative", "Very Positive", None, None]
