"""Configuration and scenario documents: period sets, matrices and vectors (E2, E3, E22, C14, C15, A4, S6, S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnloom.functions import calendar as cal
from earnloom.operators import buckets, patterns
from earnloom.plans import results
from earnloom.session import scratch_path
from earnloom.sources import documents

from . import inputs
from .inputs import sql_days_360
from .registry import query


def order_documents(spark, sf_dir, weekly: bool = False):
    """Every order as a configuration document whose elements are its line items.

    Plain: monthly and quarterly elements. Weekly: one-week elements spread over the line's quantity,
    in linear mode.
    """
    # repeated line numbers are merged first, so a document has one element per line number
    lines = inputs.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_linestatus").alias("status"),
        (F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)) / 1.0007).alias("initial"),
        (F.sum(F.abs("l_discount")) / 1.0007).alias("distribution"),
        F.max("l_quantity").cast("int").alias("quantity"),
    )
    if weekly:
        unit, duration = F.lit("WEEK"), F.col("quantity")
    else:
        unit = F.when(F.col("status") == "O", "QUARTER").otherwise("MONTH")
        duration = F.when(F.col("quantity") > 25, F.col("quantity") * 5).otherwise(-1)
    entry = F.struct(
        F.col("l_linenumber").alias("at"),
        unit.alias("type"),
        "initial",
        "distribution",
        duration.alias("duration"),
        F.lit(-1).alias("initialDuration"),
    )
    packed = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    fields = ("type", "initial", "distribution", "duration", "initialDuration")
    return inputs.table(spark, sf_dir, "orders").join(packed, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("config_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("insuredPeriodStartDate"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valuationDate"),
        F.lit(6).alias("precision"),
        F.lit(True).alias("calendar"),
        F.lit(weekly).alias("linear"),
        (F.col("o_orderstatus") != "F").alias("endOfPeriod"),
        F.lit(100).alias("defaultDuration"),
        F.lit("quarter").alias("incurredTimeUnit"),
        F.when(F.col("o_orderstatus") == "P", "year").otherwise("quarter").alias("exposedTimeUnit"),
        F.array(F.struct(F.lit("PREMIUM").alias("type"), F.col("o_totalprice").alias("value"))).alias("ultimateValues"),
        F.transform("_e", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("elements"),
    )


def order_configs(spark, sf_dir, weekly: bool = False):
    return patterns.config_elements(documents.shape_configs(order_documents(spark, sf_dir, weekly)))


def _sql_documents(weekly: bool = False) -> str:
    """CTEs ``doc``, ``el``, ``sched`` and ``span`` (date ranges of significant factors)."""
    if weekly:
        unit, months, days = "'WEEK'", "0", "7"
        duration = "CAST(max(l_quantity) AS INTEGER)"
    else:
        unit = "CASE WHEN max(l_linestatus) = 'O' THEN 'QUARTER' ELSE 'MONTH' END"
        months, days = "CASE WHEN i.unit = 'QUARTER' THEN 3 ELSE 1 END", "0"
        duration = "CASE WHEN max(l_quantity) > 25 THEN CAST(max(l_quantity) * 5 AS INTEGER) ELSE -1 END"
    following = f"CAST(c.es + to_months(CAST({months} AS INTEGER)) + to_days({days}) AS DATE)"
    last_inc = "es" if weekly else "es + ne - 1"
    last_exp = "es + n - 1" if weekly else "es + ne - 1 + n"
    return f"""
doc AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, o_orderstatus <> 'F' AS to_end,
         CASE WHEN o_orderstatus = 'P' THEN 12 ELSE 3 END AS exp_months
  FROM orders),
el AS (
  SELECT id, start, unit, up, dist, row_number() OVER (PARTITION BY id ORDER BY ln) AS k,
         100 AS up_dur, CASE WHEN dur > 0 THEN dur ELSE 100 END AS dist_dur
  FROM (SELECT l_orderkey AS id, l_linenumber AS ln, {unit} AS unit,
               sum(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0.0 END) / 1.0007::DOUBLE AS up,
               sum(abs(l_discount)) / 1.0007::DOUBLE AS dist, {duration} AS dur
        FROM lineitem GROUP BY ALL) JOIN doc USING (id)),
chain AS (
  SELECT DISTINCT id, 1::BIGINT AS k, start AS es FROM el
  UNION ALL
  SELECT c.id, c.k + 1, {following} FROM chain c JOIN el i ON i.id = c.id AND i.k = c.k),
sched AS (
  SELECT i.*, c.es, CAST({following} - c.es AS INTEGER) AS ne,
         CAST({sql_days_360('c.es', 'i.up_dur')} AS INTEGER) AS nu, CAST({sql_days_360('c.es', 'i.dist_dur')} AS INTEGER) AS n
  FROM el i JOIN chain c ON i.id = c.id AND i.k = c.k),
live AS (SELECT *, abs(up / nu) > 1e-10 AS has_up, abs(dist / n / ne) > 1e-10 AS has_dist FROM sched),
span AS (
  SELECT id, any_value(start) AS start, min(es) AS min_exp,
         max(greatest(CASE WHEN has_up THEN es + nu - 1 END, CASE WHEN has_dist THEN {last_exp} END)) AS max_exp,
         max(CASE WHEN has_dist THEN {last_inc} ELSE es END) AS max_inc
  FROM live WHERE has_up OR has_dist GROUP BY id)"""


def _sql_ends(name: str, letter: str, months: str, last: str) -> str:
    """CTE of bucket ends per document for one axis."""
    financial = f"""
  SELECT id, CAST(f + to_months(CAST({months} AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS hi
  FROM (SELECT id, exp_months, unnest(generate_series(date_trunc('year', min_exp), CAST(make_date(year(max_exp), 12, 31) AS TIMESTAMP),
        to_months(CAST({months} AS INTEGER)))) AS f FROM span JOIN doc USING (id))"""
    development = f"SELECT id, hi FROM {name}_walk WHERE hi <= make_date(year({last}), 12, 31)"
    walk = f"""{name}_walk AS (
  SELECT id, {last}, CAST(start + to_months(CAST({months} AS INTEGER)) AS DATE) AS pos,
         CAST(start + to_months(CAST({months} AS INTEGER)) AS DATE) - 1 AS hi, exp_months
  FROM span JOIN (SELECT id, exp_months FROM doc) d USING (id)
  UNION ALL
  SELECT id, {last}, CAST(pos + to_months(CAST({months} AS INTEGER)) AS DATE),
         CAST(pos + to_months(CAST({months} AS INTEGER)) AS DATE) - 1, exp_months
  FROM {name}_walk WHERE pos <= make_date(year({last}), 12, 31))"""
    chosen = {"F": financial, "D": development, "C": f"{financial} UNION {development}"}[letter]
    return f"""{walk},
{name}_ends AS ({chosen}),
{name} AS (
  SELECT * FROM (
    SELECT e.id, coalesce(lag(hi) OVER (PARTITION BY e.id ORDER BY hi) + 1, d.start) AS lo, hi, d.to_end
    FROM {name}_ends e JOIN doc d USING (id)) WHERE lo <= hi)"""


def _sql_result(selector: str, weekly: bool = False) -> str:
    inc_set, exp_set, output = selector
    label = "CASE WHEN {b}.to_end THEN {b}.hi ELSE {b}.lo END"
    if weekly:
        pieces = """
  SELECT id, es AS inc, es + i AS exp, CASE WHEN i < ne - e OR i > n - e THEN dist / n / 2 / (ne - e) ELSE dist / n / ne END AS v
  FROM (SELECT *, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS i FROM (
        SELECT *, CAST(unnest(generate_series(0, ne - 1)) AS INTEGER) AS e FROM live WHERE n > 0))"""
        split = f"""
located AS (
  SELECT p.id, {label.format(b='b')} AS ib, {label.format(b='x')} AS eb, p.v
  FROM piece p JOIN inc_b b ON b.id = p.id AND p.inc BETWEEN b.lo AND b.hi
  JOIN exp_b x ON x.id = p.id AND p.exp BETWEEN x.lo AND x.hi)"""
        up = "SELECT id, es AS inc, es + CAST(unnest(generate_series(0, nu - 1)) AS INTEGER) AS exp, up / nu AS v FROM live"
        pieces = f"{up} UNION ALL {pieces}"
        body = f"piece AS ({pieces}), {split}"
    else:
        upto = "(CASE WHEN {x} < 0 THEN 0.0 WHEN {x} < p.n THEN {x} + 0.5 ELSE p.n END)"
        share = f"p.rate * ({upto.format(x='(x.hi - p.inc)')} - {upto.format(x='(x.lo - 1 - p.inc)')})"
        body = f"""
day AS (
  SELECT id, dist / n / ne AS rate, n, es + CAST(unnest(generate_series(0, ne - 1)) AS INTEGER) AS inc FROM live WHERE n > 0),
day_b AS (
  SELECT p.id, p.rate, p.n, p.inc, {label.format(b='b')} AS ib FROM day p JOIN inc_b b ON b.id = p.id AND p.inc BETWEEN b.lo AND b.hi),
up_day AS (SELECT id, es AS inc, es + CAST(unnest(generate_series(0, nu - 1)) AS INTEGER) AS exp, up / nu AS v FROM live),
located AS (
  SELECT p.id, p.ib, {label.format(b='x')} AS eb, {share} AS v
  FROM day_b p JOIN exp_b x ON x.id = p.id AND x.hi >= p.inc AND x.lo <= p.inc + p.n
  UNION ALL
  SELECT p.id, {label.format(b='b')}, {label.format(b='x')}, p.v
  FROM up_day p JOIN inc_b b ON b.id = p.id AND p.inc BETWEEN b.lo AND b.hi
  JOIN exp_b x ON x.id = p.id AND p.exp BETWEEN x.lo AND x.hi)"""
    final = {
        "M": "SELECT CAST(id AS VARCHAR) AS config_id, ib AS incurred_bucket, eb AS exposure_bucket, round(v, 6) AS value FROM cell",
        "C": "SELECT CAST(id AS VARCHAR) AS config_id, eb AS date_bucket, round(sum(v), 6) AS value FROM cell GROUP BY ALL",
        "R": "SELECT CAST(id AS VARCHAR) AS config_id, ib AS date_bucket, round(sum(v), 6) AS value FROM cell GROUP BY ALL",
    }[output]
    return f"""WITH RECURSIVE {_sql_documents(weekly)},
{_sql_ends('inc_b', inc_set, '3', 'max_inc')},
{_sql_ends('exp_b', exp_set, 'exp_months', 'max_exp')},
{body},
cell AS (SELECT id, ib, eb, sum(v) AS v FROM located GROUP BY ALL HAVING abs(sum(v)) > 1e-10)
{final}"""


def _register_results():
    for selector in ("FFM", "DDM", "CCC", "DCR", "CFM"):

        def build(spark, sf_dir, selector=selector):
            found = results.result(order_configs(spark, sf_dir), selector)
            return found.withColumn("value", F.round("value", 6))

        query(f"e22_result_{selector.lower()}", _sql_result(selector))(build)

    for selector in ("FFM", "DDC"):

        def build_linear(spark, sf_dir, selector=selector):
            found = results.result(order_configs(spark, sf_dir, weekly=True), selector, linear=True)
            return found.withColumn("value", F.round("value", 6))

        query(f"e22_linear_result_{selector.lower()}", _sql_result(selector, weekly=True))(build_linear)


_register_results()


@query("e22_book_of_both_modes", f"""
SELECT config_id, incurred_bucket, exposure_bucket, value FROM ({_sql_result("FFM")})
UNION ALL
SELECT 'w' || config_id, incurred_bucket, exposure_bucket, value FROM ({_sql_result("FFM", weekly=True)})""")
def e22_book(spark, sf_dir):
    even = order_configs(spark, sf_dir)
    weekly = order_configs(spark, sf_dir, weekly=True).withColumn("config_id", F.concat(F.lit("w"), "config_id"))
    found = results.book_result(even.unionByName(weekly), "FFM")
    return found.withColumn("value", F.round("value", 6))


@query("e2_config_elements", f"""
WITH RECURSIVE {_sql_documents()}
SELECT CAST(id AS VARCHAR) AS config_id, k - 1 AS ord, unit, round(up, 6) AS up_front, up_dur AS up_front_days,
  round(dist, 6) AS distribution, dist_dur AS distribution_days FROM el""")
def e2(spark, sf_dir):
    listed = order_configs(spark, sf_dir).select("config_id", F.inline("elements"))
    return listed.withColumns({
        "ord": F.col("ord").cast("long"),
        "up_front": F.round("up_front", 6),
        "distribution": F.round("distribution", 6),
    })


@query("s6_config_documents", f"""
WITH RECURSIVE {_sql_documents()}
SELECT CAST(d.id AS VARCHAR) AS config_id, d.start AS start_date, 6 AS precision, true AS calendar, false AS linear, d.to_end AS end_of_period,
  100 AS default_duration, 'QUARTER' AS incurred_unit, CASE WHEN d.exp_months = 12 THEN 'YEAR' ELSE 'QUARTER' END AS exposed_unit,
  count(*) AS elements
FROM doc d JOIN el ON el.id = d.id GROUP BY ALL""")
def s6(spark, sf_dir):
    """Documents written as JSON and read back with the declared schema and defaults."""
    path = scratch_path(spark, "configs")
    documents.write_json(order_documents(spark, sf_dir), path)
    raw = spark.read.schema("config_id string, " + documents.CONFIG_SCHEMA).json(path)
    shaped = documents.shape_configs(raw)
    return shaped.drop("valuation_date", "ultimates").withColumn("elements", F.size("elements").cast("long"))


@query("c14_period_ends", f"""
WITH RECURSIVE {_sql_documents()}, {_sql_ends('exp_b', 'D', 'exp_months', 'max_exp')}
SELECT CAST(id AS VARCHAR) AS config_id, hi AS period_end FROM exp_b_ends""")
def c14(spark, sf_dir):
    joined = results.with_spans(order_configs(spark, sf_dir))
    quarter = cal.period_ends("start_date", cal.year_end("max_exposed"), "QUARTER")
    year = cal.period_ends("start_date", cal.year_end("max_exposed"), "YEAR")
    ends = F.when(F.col("exposed_unit") == "YEAR", year).otherwise(quarter)
    return joined.select("config_id", F.explode(ends).alias("period_end"))


@query("c15_combined_periods", f"""
WITH RECURSIVE {_sql_documents()}, {_sql_ends('exp_b', 'C', 'exp_months', 'max_exp')}
SELECT CAST(id AS VARCHAR) AS config_id, lo, hi, CASE WHEN to_end THEN hi ELSE lo END AS label FROM exp_b""")
def c15(spark, sf_dir):
    joined = results.with_spans(order_configs(spark, sf_dir))
    ends = buckets.period_set(
        "C", F.col("start_date"), F.col("min_exposed"), F.col("max_exposed"), F.col("max_exposed"), F.col("exposed_unit")
    )
    ranges = buckets.from_period(F.col("start_date"), ends, F.col("end_of_period"))
    return joined.select("config_id", F.inline(ranges))


@query("e3_scenario_elements", """
SELECT 'part ' || p_partkey AS key, p_name AS name, CAST(i AS INTEGER) AS ord, p_size * (i + 1) / 1000.0::DOUBLE AS distribution,
  360 AS distribution_days, CASE WHEN i % 2 = 0 THEN 'Q' ELSE 'QE' END AS period_frequency
FROM part, generate_series(0, 3) g(i)""")
def e3(spark, sf_dir):
    shares = F.array(*[
        F.struct(F.lit("Q" if i % 2 == 0 else "QE").alias("type"), (F.col("p_size") * (i + 1) / 1000.0).alias("distribution"))
        for i in range(4)
    ])
    scenarios = inputs.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey")).alias("key"), F.col("p_name").alias("name"), shares.alias("factors")
    )
    return patterns.scenario_elements(scenarios).select(
        "key", "name", "ord", "distribution", "distribution_days", "period_frequency"
    )


@query("s7_scenario_documents", """
SELECT CASE WHEN p_size > 45 THEN NULL ELSE 'part ' || p_partkey END AS key, p_size > 45 AS corrupt,
  CASE WHEN p_size > 45 THEN NULL ELSE p_size / 100.0::DOUBLE END AS distribution
FROM part""")
def s7(spark, sf_dir):
    """One JSON text per part, those of large parts cut off before their end; broken texts are kept apart."""
    document = F.to_json(F.struct(
        F.concat(F.lit("part "), F.col("p_partkey")).alias("key"),
        F.array(F.struct(F.lit("Q").alias("type"), (F.col("p_size") / 100.0).alias("distribution"))).alias("factors"),
    ))
    path = scratch_path(spark, "scenarios")
    texts = inputs.table(spark, sf_dir, "part").select("p_size", document.alias("text"))
    texts.select(
        F.when(F.col("p_size") > 45, F.expr("substring(text, 1, length(text) - 3)")).otherwise(F.col("text")).alias("value")
    ).write.text(path)
    read = documents.read_scenarios(spark, path, multi_line=False)
    broken = F.col("corrupt").isNotNull()
    return read.select(
        F.when(~broken, F.col("key")).alias("key"),
        broken.alias("corrupt"),
        F.when(~broken, F.get("factors", F.lit(0))["distribution"]).alias("distribution"),
    )
