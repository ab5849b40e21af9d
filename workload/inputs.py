"""Domain tables derived from the given tables, as DataFrames and as SQL with the same rows.

Book A: the coverages are the orders; their 25-odd writing patterns come from the parts of a brand.
Book B: every order is a pattern of its own, made of its line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- book A --------------------------------------------------------------------------------------


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coverage per order; the pattern follows from the customer key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("coverage_id"),
        (F.col("o_custkey") % 25 + 1).alias("writing_premium_pattern_id"),
        F.to_date("o_orderdate").alias("pattern_start_date"),
        F.col("o_totalprice").alias("premium"),
    )


def brand_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern factors per brand: shares by retail price, up-front for promotional and small parts."""
    parts = table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("pattern_id"),
        F.when(F.col("p_type").isin("PROMO", "SMALL"), "QS").otherwise("Q").alias("period_frequency"),
        (F.col("p_size") % 4 + 1).alias("period"),
        "p_retailprice",
        "p_size",
    )
    sums = parts.groupBy("pattern_id", "period_frequency", "period").agg(
        F.sum("p_retailprice").alias("_price"),
        F.floor(F.sum("p_size") * 12.0 / F.count(F.lit(1))).cast("int").alias("duration"),
    )
    # a brand has some eight sums
    whole = sums.withColumn("_all", F.sum("_price").over(Window.partitionBy("pattern_id")))
    return whole.select(
        "pattern_id",
        "period_frequency",
        "period",
        (F.col("_price") / F.col("_all")).alias("factor_value"),
        "duration",
    )


def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("pattern_id"), F.col("p_brand").alias("pattern_name")
    ).distinct()


BOOK_A = """
alloc AS (
  SELECT o_orderkey AS coverage_id, o_custkey % 25 + 1 AS pattern_id, CAST(o_orderdate AS DATE) AS start_date,
         o_totalprice AS premium
  FROM orders),
pairs AS (SELECT DISTINCT pattern_id, start_date FROM alloc),
brand_sums AS (
  SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS pattern_id,
         CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'QS' ELSE 'Q' END AS period_frequency,
         p_size % 4 + 1 AS period, sum(p_retailprice) AS price,
         CAST(floor(sum(p_size) * 12.0::DOUBLE / count(*)) AS INTEGER) AS duration
  FROM part GROUP BY ALL),
factor AS (
  SELECT pattern_id, period_frequency, period, price / sum(price) OVER (PARTITION BY pattern_id) AS factor_value, duration
  FROM brand_sums),
element AS (
  SELECT pattern_id, period,
         coalesce(max(factor_value) FILTER (period_frequency = 'QS'), 0.0) AS up,
         coalesce(max(duration) FILTER (period_frequency = 'QS'), 1) AS up_dur,
         coalesce(max(factor_value) FILTER (period_frequency = 'Q'), 0.0) AS dist,
         coalesce(max(duration) FILTER (period_frequency = 'Q'), 1) AS dist_dur
  FROM factor GROUP BY ALL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY period) AS k FROM element),
instance AS (SELECT p.start_date, e.* FROM pairs p JOIN numbered e USING (pattern_id))
"""


# --- book B --------------------------------------------------------------------------------------


def order_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern factors per order: one row per line item, repeated line numbers included."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pattern_id"),
        F.when(F.col("l_returnflag") == "R", "QS").otherwise("Q").alias("period_frequency"),
        F.col("l_linenumber").alias("period"),
        (F.col("l_extendedprice") / 700001).alias("factor_value"),
        (F.col("l_quantity") * 8).cast("int").alias("duration"),
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def order_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pattern_id"), F.to_date("o_orderdate").alias("start_date")
    )


BOOK_B = """
line_factor AS (
  SELECT l_orderkey AS pattern_id, CASE WHEN l_returnflag = 'R' THEN 'QS' ELSE 'Q' END AS period_frequency,
         l_linenumber AS period, l_extendedprice / 700001 AS factor_value,
         CAST(l_quantity * 8 AS INTEGER) AS duration,
         row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'QS' ELSE 'Q' END
           ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS latest
  FROM lineitem),
element AS (
  SELECT pattern_id, period,
         coalesce(max(factor_value) FILTER (period_frequency = 'QS'), 0.0) AS up,
         coalesce(max(duration) FILTER (period_frequency = 'QS'), 1) AS up_dur,
         coalesce(max(factor_value) FILTER (period_frequency = 'Q'), 0.0) AS dist,
         coalesce(max(duration) FILTER (period_frequency = 'Q'), 1) AS dist_dur
  FROM line_factor WHERE latest = 1 GROUP BY ALL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY period) AS k FROM element),
instance AS (
  SELECT CAST(o.o_orderdate AS DATE) AS start_date, e.*
  FROM orders o JOIN numbered e ON o.o_orderkey = e.pattern_id)
"""


# --- SQL pieces ----------------------------------------------------------------------------------


def sql_month_step(date: str, months: str, clamp: str = "calendar") -> str:
    moved = f"CAST({date} + to_months(CAST({months} AS INTEGER)) AS DATE)"
    if clamp == "calendar":
        return moved
    return f"(CASE WHEN month({moved}) = 2 AND day({moved}) = 29 AND day({date}) > 29 THEN {moved} - 1 ELSE {moved} END)"


def sql_days_360(date: str, duration: str, clamp: str = "calendar") -> str:
    """Calendar days of a 30/360 duration from a date: years, then months, then days."""
    by_years = f"CAST({date} + to_months(CAST(12 * ({duration} // 360) AS INTEGER)) AS DATE)"
    by_months = sql_month_step(by_years, f"(({duration} % 360) // 30)", clamp)
    return f"(({by_months} + CAST({duration} % 30 AS INTEGER)) - {date})"


def sql_quarter_end(date: str) -> str:
    return f"CAST(date_trunc('quarter', {date}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"


def sql_schedule(clamp: str = "feb28") -> str:
    """CTE ``sched`` from ``instance``: quarterly elements, one after the other by recursion."""
    next_start = sql_month_step("c.es", "3", clamp)
    return f"""
chain AS (
  SELECT pattern_id, start_date, 1 AS k, start_date AS es FROM (SELECT DISTINCT pattern_id, start_date FROM instance)
  UNION ALL
  SELECT c.pattern_id, c.start_date, c.k + 1, {next_start}
  FROM chain c JOIN instance i ON i.pattern_id = c.pattern_id AND i.start_date = c.start_date AND i.k = c.k),
sched AS (
  SELECT i.*, c.es, CAST({sql_month_step('c.es', '3', clamp)} - c.es AS INTEGER) AS ne,
         CAST({sql_days_360('c.es', 'i.up_dur', clamp)} AS INTEGER) AS nu,
         CAST({sql_days_360('c.es', 'i.dist_dur', clamp)} AS INTEGER) AS n
  FROM instance i JOIN chain c ON i.pattern_id = c.pattern_id AND i.start_date = c.start_date AND i.k = c.k)
"""


def sql_cells() -> str:
    """CTE ``cell`` from ``sched``: every incurred day by itself, its exposed days counted per quarter."""

    def upto(x: str) -> str:
        return f"(CASE WHEN {x} < 0 THEN 0.0 WHEN {x} < n THEN {x} + 0.5 ELSE n END)"

    return f"""
inc_day AS (
  SELECT pattern_id, start_date, dist / n / ne AS rate, n, es + CAST(j AS INTEGER) AS inc
  FROM (SELECT *, unnest(generate_series(0, ne - 1)) AS j FROM sched WHERE n > 0 AND ne > 0)),
inc_quarter AS (
  SELECT pattern_id, start_date, rate, n, inc, CAST(q AS DATE) AS qs, {sql_quarter_end('q')} AS qe
  FROM (SELECT *, unnest(generate_series(date_trunc('quarter', inc), CAST(inc + n AS TIMESTAMP), INTERVAL 3 MONTH)) AS q
        FROM inc_day)),
up_day AS (
  SELECT pattern_id, start_date, es, up / nu AS rate, es + CAST(unnest(generate_series(0, nu - 1)) AS INTEGER) AS exp
  FROM sched WHERE nu > 0),
piece AS (
  SELECT pattern_id, start_date, {sql_quarter_end('inc')} AS incurred_bucket, qe AS exposure_bucket,
         rate * ({upto('(qe - inc)')} - {upto('(qs - 1 - inc)')}) AS v
  FROM inc_quarter
  UNION ALL
  SELECT pattern_id, start_date, {sql_quarter_end('es')}, {sql_quarter_end('exp')}, rate FROM up_day),
cell AS (
  SELECT pattern_id, start_date, incurred_bucket, exposure_bucket, sum(v) AS v
  FROM piece GROUP BY ALL HAVING abs(sum(v)) > 1e-10)
"""


def with_cells(book: str, body: str, more: str = "", clamp: str = "feb28") -> str:
    ctes = [book, sql_schedule(clamp), sql_cells()] + ([more] if more else [])
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"
