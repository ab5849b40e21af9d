"""Date series and 30/360 arithmetic over the order dates (C1-C13, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnloom.functions import calendar as cal

from . import inputs
from .inputs import sql_days_360
from .registry import query

COUNT = 6
_DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS start FROM orders)"


def order_days(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("start")).distinct()


def _listed(df, series, value="day"):
    return df.select("start", F.posexplode(series).alias("k", value))


_SERIES = f"WITH {_DAYS}, d AS (SELECT start, CAST(k AS INTEGER) AS k FROM days, generate_series(0, {COUNT - 1}) g(k))"


def _sticky(months: int) -> str:
    moved = f"CAST(start + to_months({months} * k) AS DATE)"
    return f"CASE WHEN start = last_day(start) THEN last_day({moved}) ELSE {moved} END"


_STEPS = {
    "DAY": "start + k",
    "WEEK": "start + 7 * k",
    "MONTH": _sticky(1),
    "QUARTER": _sticky(3),
    "YEAR": "CASE WHEN month(start) = 2 AND day(start) = 29 AND k > 0 THEN make_date(year(start) + k, 2, 28) "
    "ELSE CAST(start + to_months(12 * k) AS DATE) END",
}


def _register_relative():
    for unit, sql in _STEPS.items():

        def build(spark, sf_dir, unit=unit):
            return _listed(order_days(spark, sf_dir), cal.relative_dates("start", unit, COUNT))

        name = "c3_relative_years" if unit == "YEAR" else f"c1_relative_{unit.lower()}s"
        query(name, f"{_SERIES} SELECT start, k, {sql} AS day FROM d")(build)


_register_relative()


@query("c2_relative_quarters_until", f"""
WITH {_DAYS}, d AS (SELECT start, CAST(k AS INTEGER) AS k FROM days, generate_series(0, 11) g(k))
SELECT start, k, {_STEPS['QUARTER']} AS day FROM d WHERE {_STEPS['QUARTER']} <= CAST(start + to_months(20) AS DATE)""")
def c2(spark, sf_dir):
    days = order_days(spark, sf_dir)
    return _listed(days, cal.relative_dates_until("start", "QUARTER", F.add_months("start", 20)))


_QUARTER_END = "CAST(date_trunc('quarter', start + INTERVAL 1 DAY) + to_months(3 * (k + 1)) - INTERVAL 1 DAY AS DATE)"
_MONTH_END = "last_day(CAST(date_trunc('month', start) + to_months(k) AS DATE))"


@query("c4_quarter_ends", f"{_SERIES} SELECT start, k, {_QUARTER_END} AS day FROM d")
def c4(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.quarter_ends("start", COUNT - 1, include_final=True))


@query("c4_quarter_ends_until", f"""
WITH {_DAYS}, d AS (SELECT start, CAST(k AS INTEGER) AS k FROM days, generate_series(0, 11) g(k)),
e AS (SELECT start, k, {_QUARTER_END} AS day, CAST(start + to_months(14) AS DATE) AS until FROM d)
SELECT start, k, day FROM e WHERE day <= until OR k = (SELECT count(*) FROM e f WHERE f.start = e.start AND f.day <= f.until)""")
def c4_until(spark, sf_dir):
    series = cal.quarter_ends_until("start", F.add_months("start", 14), include_final=True)
    return _listed(order_days(spark, sf_dir), series)


@query("c5_month_ends", f"{_SERIES} SELECT start, k, {_MONTH_END} AS day FROM d")
def c5(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.month_ends("start", COUNT))


@query("c5_month_ends_until", f"""
WITH {_DAYS}, d AS (SELECT start, CAST(k AS INTEGER) AS k FROM days, generate_series(0, 11) g(k))
SELECT start, k, {_MONTH_END} AS day FROM d WHERE {_MONTH_END} <= start + 100""")
def c5_until(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.month_ends_until("start", F.date_add("start", 100)))


@query("c6_quarter_starts", f"""
{_SERIES} SELECT start, k, CAST(date_trunc('quarter', start) + to_months(3 * k) AS DATE) AS day FROM d""")
def c6(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.quarter_starts("start", COUNT))


@query("c6_quarter_starts_until", f"""
WITH {_DAYS}, d AS (SELECT start, CAST(date_trunc('quarter', start) + to_months(CAST(3 * k AS INTEGER)) AS DATE) AS day, CAST(k AS INTEGER) AS k
  FROM days, generate_series(0, 11) g(k))
SELECT start, k, day FROM d WHERE day <= start + 400""")
def c6_until(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.quarter_starts_until("start", F.date_add("start", 400)))


@query("c7_month_starts", f"""
{_SERIES} SELECT start, k, CAST(date_trunc('month', start) + to_months(k) AS DATE) AS day FROM d""")
def c7(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.month_starts("start", COUNT))


@query("c7_month_starts_until", f"""
WITH {_DAYS}, d AS (SELECT start, CAST(date_trunc('month', start) + to_months(CAST(k AS INTEGER)) AS DATE) AS day, CAST(k AS INTEGER) AS k
  FROM days, generate_series(0, 11) g(k))
SELECT start, k, day FROM d WHERE day <= start + 100""")
def c7_until(spark, sf_dir):
    return _listed(order_days(spark, sf_dir), cal.month_starts_until("start", F.date_add("start", 100)))


@query("c8_month_end", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS day FROM orders")
def c8(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", cal.month_end(F.to_date("o_orderdate")).alias("day"))


_LINE = "l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity * 23 AS INTEGER) AS n FROM lineitem)"


def _lines(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), (F.col("l_quantity") * 23).cast("int").alias("n")
    )


@query("c9_add_duration_360", f"""
WITH {_LINE} SELECT l_orderkey, l_linenumber,
  CAST(d + to_months(CAST(12 * (n // 360) + (n % 360) // 30 AS INTEGER)) AS DATE) + CAST(n % 30 AS INTEGER) AS day FROM l""")
def c9(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", cal.add_duration_360("d", F.col("n")).alias("day"))


@query("c10_normalised_duration", f"""
WITH {_LINE} SELECT l_orderkey, l_linenumber, CAST({sql_days_360('d', 'n')} AS INTEGER) AS days,
  CAST({sql_days_360('d', 'n', 'feb28')} AS INTEGER) AS days_feb28 FROM l""")
def c10(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        cal.normalised_days("d", F.col("n")).alias("days"),
        cal.normalised_days("d", F.col("n"), "feb28").alias("days_feb28"),
    )


@query("c11_unit_days", """
SELECT l_returnflag, sum(CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 90 ELSE 360 END)::BIGINT AS nominal_days
FROM lineitem GROUP BY 1""")
def c11(spark, sf_dir):
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", "MONTH").when(flag == "N", "QUARTER").otherwise("YEAR")
    return inputs.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(cal.unit_days(unit)).alias("nominal_days")
    )


_RANGE = """r AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last
  FROM lineitem GROUP BY 1)"""


def _ranges(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last")
    )


@query("c12_financial_quarter_ends", f"""
WITH {_RANGE} SELECT l_orderkey, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS day
FROM (SELECT l_orderkey, unnest(generate_series(date_trunc('year', first), CAST(make_date(year(last), 12, 31) AS TIMESTAMP), INTERVAL 3 MONTH)) AS q FROM r)""")
def c12(spark, sf_dir):
    return _ranges(spark, sf_dir).select("l_orderkey", F.explode(cal.financial_quarter_ends("first", "last")).alias("day"))


_DEVELOPMENT = """
dev AS (
  SELECT l_orderkey, last, CASE WHEN first = last_day(first) THEN last_day(CAST(first + to_months(3 * k) AS DATE))
    ELSE CAST(first + to_months(3 * k) AS DATE) END AS day
  FROM (SELECT *, CAST(unnest(generate_series(0, 40)) AS INTEGER) AS k FROM r))"""


@query("c13_development_dates", f"""
WITH {_RANGE}, {_DEVELOPMENT} SELECT l_orderkey, day FROM dev WHERE day <= make_date(year(last), 12, 31)""")
def c13(spark, sf_dir):
    return _ranges(spark, sf_dir).select("l_orderkey", F.explode(cal.development_dates("first", "last")).alias("day"))


@query("u3_combined_dates", f"""
WITH {_RANGE}, {_DEVELOPMENT}
SELECT l_orderkey, day FROM dev WHERE day <= make_date(year(last), 12, 31)
UNION
SELECT l_orderkey, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)
FROM (SELECT l_orderkey, unnest(generate_series(date_trunc('year', first), CAST(make_date(year(last), 12, 31) AS TIMESTAMP), INTERVAL 3 MONTH)) AS q FROM r)""")
def u3(spark, sf_dir):
    both = cal.combined_dates(cal.financial_quarter_ends("first", "last"), cal.development_dates("first", "last"))
    return _ranges(spark, sf_dir).select("l_orderkey", F.explode(both).alias("day"))
