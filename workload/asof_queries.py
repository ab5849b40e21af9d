"""As-of and interval look-ups from tables of bounds (J12, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnloom.operators import asof

from . import inputs
from .registry import query

# six of ten users share one key, so that it holds most rows
_EVENTS = """
e AS (SELECT event_id, ts, event_type, value, CASE WHEN user_id % 10 < 6 THEN 0 ELSE user_id END AS k FROM events),
"""


def _events(spark, sf_dir):
    key = F.when(F.col("user_id") % 10 < 6, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    return inputs.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", key.alias("k"))


@query("j12_asof_last_click", f"""
WITH {_EVENTS} b AS (SELECT k, ts, max(value) AS v FROM e WHERE event_type = 'click' GROUP BY k, ts)
SELECT event_id, r.k, b.ts AS click_at, b.v AS click_value
FROM (SELECT * FROM e WHERE event_type <> 'click') r ASOF LEFT JOIN b ON r.k = b.k AND r.ts >= b.ts""")
def last_click(spark, sf_dir):
    """The last click of the key at or before every other event."""
    events = _events(spark, sf_dir)
    clicks = events.filter("event_type = 'click'")
    found = asof.asof_join(
        events.filter("event_type <> 'click'"), clicks, ["k"], "ts", "ts", {"click_at": "ts", "click_value": "value"}, block_rows=100_000
    )
    return found.select("event_id", "k", "click_at", "click_value")


@query("j12_asof_next_error", f"""
WITH {_EVENTS} b AS (SELECT k, ts, max(event_id) AS error_id FROM e WHERE event_type = 'error' GROUP BY k, ts)
SELECT event_id, error_id, b.ts AS error_at
FROM e r ASOF LEFT JOIN b ON r.k = b.k AND r.ts < b.ts""")
def next_error(spark, sf_dir):
    """The first error of the key after every event."""
    events = _events(spark, sf_dir)
    errors = events.filter("event_type = 'error'")
    found = asof.asof_join(
        events, errors, ["k"], "ts", "ts", {"error_id": "event_id", "error_at": "ts"}, backward=False, strict=True, block_rows=100_000
    )
    return found.select("event_id", "error_id", "error_at")


@query("j13_event_in_incident", f"""
WITH {_EVENTS} b AS (
  SELECT k, ts AS low, max(ts + INTERVAL 20 MINUTE) AS high, max(event_id) AS incident FROM e WHERE event_type = 'error' GROUP BY k, ts)
SELECT event_id, CASE WHEN r.ts <= high THEN incident END AS incident
FROM e r ASOF LEFT JOIN b ON r.k = b.k AND r.ts >= b.low""")
def in_incident(spark, sf_dir):
    """An incident is the twenty minutes from an error on; of incidents that overlap the later one counts."""
    events = _events(spark, sf_dir)
    incidents = events.filter("event_type = 'error'").select(
        "k", F.col("ts").alias("low"), (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("high"), F.col("event_id").alias("incident_id")
    )
    found = asof.interval_join(events, incidents, ["k"], "ts", "low", "high", {"incident": "incident_id"}, block_rows=100_000)
    return found.select("event_id", "incident")


@query("j12_bucket_from_table", """
WITH b AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT CAST(l_shipdate AS DATE) AS day, l_quantity FROM lineitem)
SELECT month_end AS bucket, count(*) AS lines, round(sum(l_quantity), 2) AS quantity
FROM r ASOF LEFT JOIN b ON r.day <= b.month_end GROUP BY month_end""")
def bucket_from_table(spark, sf_dir):
    """Line items by the first month end at or after their ship date; the ends are read from the orders."""
    ends = inputs.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.last_day(F.to_date("o_orderdate")).alias("month_end"))
    lines = inputs.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_quantity")
    found = asof.assign_bucket_from(lines, "day", ends.distinct(), "month_end", block_rows=200_000)
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
