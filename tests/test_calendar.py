import datetime as dt

import pytest
from pyspark.sql import functions as F

from earnloom.functions import calendar as cal
from tests import brute

D = dt.date


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def day(text):
    return F.lit(D.fromisoformat(text))


def dates(*texts):
    return [D.fromisoformat(t) for t in texts]


@pytest.mark.parametrize(
    "start, unit, n, expected",
    [
        ("2022-01-31", "MONTH", 4, ("2022-01-31", "2022-02-28", "2022-03-31", "2022-04-30")),
        ("2022-01-30", "MONTH", 3, ("2022-01-30", "2022-02-28", "2022-03-30")),
        ("2022-01-29", "MONTH", 3, ("2022-01-29", "2022-02-28", "2022-03-29")),
        ("2022-02-28", "MONTH", 3, ("2022-02-28", "2022-03-31", "2022-04-30")),
        ("2022-01-15", "QUARTER", 3, ("2022-01-15", "2022-04-15", "2022-07-15")),
        ("2022-11-30", "QUARTER", 3, ("2022-11-30", "2023-02-28", "2023-05-31")),
        ("2024-02-29", "YEAR", 6, ("2024-02-29", "2025-02-28", "2026-02-28", "2027-02-28", "2028-02-28", "2029-02-28")),
        ("2022-12-31", "DAY", 2, ("2022-12-31", "2023-01-01")),
        ("2022-12-31", "WEEK", 2, ("2022-12-31", "2023-01-07")),
        ("2022-12-31", "WEEK", 0, ()),
    ],
)
def test_relative_dates(spark, start, unit, n, expected):
    assert value(spark, cal.relative_dates(day(start), unit, n)) == dates(*expected)


def test_relative_dates_until_is_inclusive(spark):
    series = cal.relative_dates_until(day("2022-01-31"), "QUARTER", day("2022-07-31"))
    assert value(spark, series) == dates("2022-01-31", "2022-04-30", "2022-07-31")
    assert value(spark, cal.relative_dates_until(day("2022-01-31"), "DAY", day("2022-01-30"))) == []


def test_quarter_ends_start_strictly_after(spark):
    assert value(spark, cal.quarter_ends(day("2022-03-31"), 2)) == dates("2022-06-30", "2022-09-30")
    assert value(spark, cal.quarter_ends(day("2022-03-30"), 2)) == dates("2022-03-31", "2022-06-30")
    assert value(spark, cal.quarter_ends(day("2022-12-31"), 1, True)) == dates("2023-03-31", "2023-06-30")
    until = cal.quarter_ends_until(day("2022-01-01"), day("2022-07-01"), True)
    assert value(spark, until) == dates("2022-03-31", "2022-06-30", "2022-09-30")
    early = cal.quarter_ends_until(day("2022-01-01"), day("2021-07-01"), True)
    assert value(spark, early) == dates("2022-03-31")
    assert value(spark, cal.quarter_ends_until(day("2022-01-01"), day("2021-07-01"))) == []


def test_month_and_quarter_series(spark):
    assert value(spark, cal.month_ends(day("2024-01-31"), 2)) == dates("2024-01-31", "2024-02-29")
    assert value(spark, cal.month_ends_until(day("2024-01-15"), day("2024-03-30"))) == dates("2024-01-31", "2024-02-29")
    assert value(spark, cal.quarter_starts(day("2024-05-15"), 2)) == dates("2024-04-01", "2024-07-01")
    assert value(spark, cal.quarter_starts_until(day("2024-05-15"), day("2024-07-01"))) == dates("2024-04-01", "2024-07-01")
    assert value(spark, cal.month_starts(day("2024-12-15"), 2)) == dates("2024-12-01", "2025-01-01")
    assert value(spark, cal.month_starts_until(day("2024-12-15"), day("2024-12-31"))) == dates("2024-12-01")


def test_durations(spark):
    assert value(spark, cal.add_duration_360(day("2022-01-01"), 392)) == D(2023, 2, 3)
    assert value(spark, cal.add_duration_360(day("2022-01-31"), 30)) == D(2022, 2, 28)
    # one step keeps day 29, two steps lose it in February
    assert value(spark, cal.add_duration_360(day("2024-02-29"), 390)) == D(2025, 3, 29)
    assert value(spark, cal.normalised_days(day("2024-02-29"), 390)) == (D(2025, 3, 28) - D(2024, 2, 29)).days
    assert value(spark, cal.normalised_days(day("2023-11-30"), 90)) == 91
    assert value(spark, cal.normalised_days(day("2023-11-30"), 90, "feb28")) == 90
    assert value(spark, cal.unit_days(F.lit("QUARTER"))) == 90


def test_durations_against_loops(spark):
    starts = [D(2023, 1, 1) + dt.timedelta(k) for k in range(0, 800, 7)] + [D(2024, 2, 29), D(2023, 11, 30), D(2024, 1, 31)]
    rows = [(s, n) for s in starts for n in (0, 1, 29, 30, 90, 359, 360, 361, 900)]
    df = spark.createDataFrame(rows, "d date, n int").select(
        "d", "n", cal.normalised_days("d", F.col("n")).alias("a"), cal.normalised_days("d", F.col("n"), "feb28").alias("b")
    )
    for r in df.collect():
        assert r["a"] == brute.duration_days(r["d"], r["n"])
        assert r["b"] == brute.duration_days(r["d"], r["n"], True)


def test_period_ends_drift(spark):
    ends = value(spark, cal.period_ends(day("2023-01-31"), day("2023-12-31"), "QUARTER"))
    assert ends == dates("2023-04-29", "2023-07-29", "2023-10-29")
    assert value(spark, cal.period_ends(day("2023-01-01"), day("2023-12-31"), "QUARTER")) == dates(
        "2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31"
    )
    weeks = value(spark, cal.period_ends(day("2023-01-01"), day("2023-12-31"), "WEEK"))
    assert len(weeks) == 52 and weeks[-1] == D(2023, 12, 30)


def test_financial_development_combined(spark):
    financial = cal.financial_quarter_ends(day("2023-05-01"), day("2024-01-01"))
    assert len(value(spark, financial)) == 8
    development = cal.development_dates(day("2024-08-01"), day("2025-02-01"))
    assert value(spark, development)[-1] == D(2025, 11, 1)
    both = value(spark, cal.combined_dates(financial, development))
    assert both == sorted(set(both)) and len(both) == 14


def test_limits_of_period_ends_are_worked_out_once_a_row(spark):
    """Start and limit stand outside the lambdas; inside one they are worked out for every entry."""
    found = spark.range(1).select(
        cal.period_ends(F.make_date(F.col("id").cast("int") + 2020, F.lit(1), F.lit(31)), cal.year_end(F.lit(D(2021, 5, 5))), "QUARTER").alias("ends")
    )
    assert found._jdf.queryExecution().analyzed().toString().count("make_date") == 1
    assert found.first()["ends"] == dates(
        "2020-04-29", "2020-07-29", "2020-10-29", "2021-01-29", "2021-04-29", "2021-07-29", "2021-10-29"
    )
    none = spark.range(1).select(
        cal.period_ends(day("2023-05-01"), day("2023-05-02"), "YEAR").alias("short"),
        cal.period_ends(day("2023-05-01"), F.lit(None).cast("date"), "QUARTER").alias("open"),
    ).first()
    assert none["short"] == [] and none["open"] == []


def test_one_month_step_for_all_units(spark):
    starts = [D(2024, 1, 31), D(2024, 2, 29), D(2023, 11, 30), D(2023, 1, 29)]
    rows = [(s, u) for s in starts for u in cal.UNIT_DAYS]
    df = spark.createDataFrame(rows, "d date, u string")
    for clamp in cal.CLAMPS:
        chain = F.lit(None).cast("date")
        for unit in cal.UNIT_DAYS:
            chain = F.when(F.col("u") == unit, cal.advance(F.col("d"), unit, True, clamp)).otherwise(chain)
        moved = df.select(cal.advance(F.col("d"), F.col("u"), True, clamp).alias("a"), chain.alias("b")).collect()
        assert all(r["a"] == r["b"] for r in moved)
