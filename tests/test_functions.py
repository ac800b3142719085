import math

import pytest
from pyspark.sql import functions as F

from fraud_engine import functions as fn


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("hour, text", [
    (0, "0:00 AM (early morning)"), (5, "5:00 AM (early morning)"), (6, "6:00 AM"),
    (11.9, "11:00 AM"), (12, "12:00 PM"), (12.5, "0:00 PM"), (13, "1:00 PM"), (23, "11:00 PM"),
    (None, "12:00 PM"), (float("nan"), "12:00 PM"), (-1, "12:00 PM"),
])
def test_clock_text(spark, hour, text):
    assert value(spark, fn.clock_text(F.lit(hour).cast("double"))) == text


@pytest.mark.parametrize("text, hour", [
    ("2019-01-01 00:00:18", 0), ("2019-03-10 02:30:00", 2), ("not a time", None), (None, None),
])
def test_hour_of_day(spark, text, hour):
    assert value(spark, fn.hour_of_day(F.lit(text).cast("string"))) == hour


def test_hour_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # This hour does not exist in New York.
        assert value(spark, fn.hour_of_day(F.lit("2019-03-10 02:30:00"))) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("dob, year", [("1985-05-05", 1985), ("05/05/1985", None), ("1985-5-5", None), ("1985-02-30", None), (None, None)])
def test_birth_year(spark, dob, year):
    assert value(spark, fn.birth_year(F.lit(dob).cast("string"))) == year


@pytest.mark.parametrize("year, start, flag", [
    (1919, 1920, 0), (1920, 1920, 1), (1929, 1920, 1), (1930, 1920, 0), (2009, 2000, 1),
    (2010, 2000, 0), (None, 1920, 0),
])
def test_decade_flag(spark, year, start, flag):
    assert value(spark, fn.decade_flag(F.lit(year).cast("int"), start)) == flag


@pytest.mark.parametrize("points, km", [
    ((10.0, 20.0, 10.0, 20.0), 0.0),
    ((0.0, 0.0, 0.0, 180.0), math.pi * 6371),
    ((90.0, 0.0, -90.0, 0.0), math.pi * 6371),
    ((0.0, 0.0, 0.0, 90.0), math.pi * 6371 / 2),
])
def test_haversine(spark, points, km):
    assert value(spark, fn.haversine_km(*map(F.lit, points))) == pytest.approx(km, abs=1e-3)


def test_haversine_of_a_missing_point_is_null(spark):
    assert value(spark, fn.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None


@pytest.mark.parametrize("number, places", [
    (54.65, 1), (0.25, 1), (0.35, 1), (1.15, 1), (1.005, 2), (0.125, 2), (12345.678, 2), (0.0, 2), (100.0, 1),
])
def test_fixed_text_rounds_as_python_does(spark, number, places):
    assert value(spark, fn.fixed_text(F.lit(number), places)) == f"{number:.{places}f}"


def test_all_commas_are_replaced(spark):
    assert value(spark, fn.comma_to_dash(F.lit("a, b, c"))) == "a - b - c"


def test_threshold_is_strict(spark):
    assert value(spark, fn.above_threshold(F.lit(0.9), 0.9)) == 0
    assert value(spark, fn.above_threshold(F.lit(0.91), 0.9)) == 1


def test_percent_change(spark):
    assert value(spark, fn.percent_change(F.lit(3.0), F.lit(2.0))) == 50.0
    assert value(spark, fn.percent_change(F.lit(3.0), F.lit(0.0))) is None


@pytest.mark.parametrize("amount, average, ratio", [(6.0, 2.0, 3.0), (6.0, 0.0, 1.0), (6.0, None, 1.0)])
def test_amount_ratio(spark, amount, average, ratio):
    assert value(spark, fn.amount_ratio(F.lit(amount), F.lit(average).cast("double"))) == ratio


@pytest.mark.parametrize("ratio, text", [(3.04, "3.0x"), (1.0, "normal"), (0.4, "normal")])
def test_anomaly_text(spark, ratio, text):
    assert value(spark, fn.anomaly_text(F.lit(ratio))) == text


@pytest.mark.parametrize("hour, usual, bucket", [
    (23, 1.0, "significant"), (10, 4.0, "moderate"), (10, 3.9, "significant"), (10, 7.0, "minor"),
])
def test_hour_gap_bucket(spark, hour, usual, bucket):
    assert value(spark, fn.hour_gap_bucket(F.lit(hour), F.lit(usual))) == bucket


@pytest.mark.parametrize("text, clean", [
    ("  Explanation: too high \n", "too high"), ("ANALYSIS odd hour", "odd hour"),
    ("flagged as fraud:far away", "far away"), ("The Analysis: kept", "The Analysis: kept"),
])
def test_clean_response(spark, text, clean):
    assert value(spark, fn.clean_response(F.lit(text))) == clean


def test_display_label(spark):
    assert value(spark, fn.display_label(F.lit("JOBctg_Legal_&_Government"), "JOBctg_")) == "Legal & Government"
    assert value(spark, fn.display_label(F.lit("dob_80s"), "dob_", upper=True)) == "80S"
