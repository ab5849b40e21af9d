"""Pattern tables: consolidation, elements from documents, checks, ultimate values, normalising.

An element row has ``ord, unit, up_front, up_front_days, distribution, distribution_days``; a pattern
row carries its elements as an array of that struct in ``elements``, ordered by ``ord``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import HOT_ROWS, lookup_join, with_key_totals

ELEMENT_FIELDS = ("ord", "unit", "up_front", "up_front_days", "distribution", "distribution_days")
ELEMENTS_TYPE = (
    "array<struct<ord:int,unit:string,up_front:double,up_front_days:int,"
    "distribution:double,distribution_days:int>>"
)

# period_frequency codes of the two shares of a period, and of a derived loss row.
UP_FRONT_CODE = "QS"
DISTRIBUTED_CODE = "Q"
LOSS_CODE = "QE"

ZERO = 1e-10


def whole_days(duration: Column) -> Column:
    """Durations are whole days, never below zero."""
    return F.greatest(duration.cast("int"), F.lit(0))


def consolidate(
    factors: DataFrame,
    keys: Sequence[str] = ("pattern_id",),
    order: Sequence[str] | None = None,
    first_seen: bool = False,
) -> DataFrame:
    """One quarterly element per pattern and period from its up-front and distributed rows.

    A missing share counts as value 0 over 1 day. Of repeated rows the last by ``order`` wins (without
    ``order``: the longest, then the largest). Elements are ordered by period, or with ``first_seen`` by
    the first ``order`` value of the period. Both aggregates combine before the shuffle.
    """
    keys = list(keys)
    rank = F.struct(*order) if order else F.struct("duration", "factor_value")
    share = F.struct(F.col("factor_value").alias("value"), F.col("duration").cast("int").alias("days"))

    def last_of(code):
        mine = F.col("period_frequency") == code
        return F.max_by(F.when(mine, share), F.when(mine, rank))

    grouped = factors.groupBy(*keys, "period").agg(
        last_of(UP_FRONT_CODE).alias("_up"),
        last_of(DISTRIBUTED_CODE).alias("_dist"),
        *([F.min(rank).alias("first_row")] if first_seen else []),
    )
    up_days = F.coalesce(F.col("_up.days"), F.lit(1))
    dist_days = F.coalesce(F.col("_dist.days"), F.lit(1))
    return grouped.select(
        *keys,
        "period",
        F.col("period").cast("int").alias("ord"),
        F.lit("QUARTER").alias("unit"),
        F.coalesce(F.col("_up.value"), F.lit(0.0)).cast("double").alias("up_front"),
        whole_days(up_days).alias("up_front_days"),
        F.coalesce(F.col("_dist.value"), F.lit(0.0)).cast("double").alias("distribution"),
        whole_days(dist_days).alias("distribution_days"),
        F.greatest(up_days, dist_days).alias("duration"),
        *(["first_row"] if first_seen else []),
    )


def nest_elements(elements: DataFrame, keys: Sequence[str] = ("pattern_id",), carry: Sequence[str] = ()) -> DataFrame:
    """One row per pattern with its ordered element array.

    A pattern has one element per period, so the array is as long as the pattern has periods; repeated
    source rows are gone by then (``consolidate``).
    """
    lead = ["first_row"] if "first_row" in elements.columns else []
    packed = F.sort_array(F.collect_list(F.struct(*lead, *ELEMENT_FIELDS)))
    if lead:
        packed = F.transform(packed, lambda e: F.struct(*[e[f].alias(f) for f in ELEMENT_FIELDS]))
    return elements.groupBy(*keys).agg(
        packed.cast(ELEMENTS_TYPE).alias("elements"), *[F.first(c).alias(c) for c in carry]
    )


def config_elements(configs: DataFrame) -> DataFrame:
    """Element arrays of configuration documents; a duration of 0 or less means the document's default."""

    def build(e: Column, i: Column) -> Column:
        def days(name):
            own = F.coalesce(e[name], F.lit(-1))
            return F.when(own > 0, own).otherwise(F.coalesce(F.col("default_duration"), F.lit(0))).cast("int")

        return F.struct(
            i.cast("int").alias("ord"),
            F.upper(e["type"]).alias("unit"),
            F.coalesce(e["initial"], F.lit(0.0)).alias("up_front"),
            days("initialDuration").alias("up_front_days"),
            F.coalesce(e["distribution"], F.lit(0.0)).alias("distribution"),
            days("duration").alias("distribution_days"),
        )

    return configs.withColumn("elements", F.transform("elements", build).cast(ELEMENTS_TYPE))


def scenario_elements(scenarios: DataFrame, duration: int = 360) -> DataFrame:
    """Element rows of scenario documents: each listed share is one quarter of distribution."""
    return scenarios.select(
        "key", "name", F.posexplode("factors").alias("_pos", "_share")
    ).select(
        "key",
        "name",
        F.col("_pos").cast("int").alias("ord"),
        F.lit("QUARTER").alias("unit"),
        F.lit(0.0).alias("up_front"),
        F.lit(0).alias("up_front_days"),
        F.col("_share.distribution").alias("distribution"),
        F.lit(duration).alias("distribution_days"),
        F.col("_share.type").alias("period_frequency"),
    )


def invalid_durations(factors: DataFrame) -> DataFrame:
    """Factor rows whose duration is below one day."""
    days = F.col("duration").cast("int")
    return factors.filter(days < 1).select(
        "pattern_id", "period", "period_frequency", "factor_value", days.alias("duration")
    )


def invalid_durations_by_coverage(
    factors: DataFrame, coverages: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The same for every coverage that uses the pattern: one row per period and share code.

    Repeated factor rows are counted (``factor_rows``, with the shortest duration and largest value), so
    the list that joins the coverages is as short as a pattern has periods.
    """
    per_period = invalid_durations(factors).groupBy("pattern_id", "period", "period_frequency").agg(
        F.max("factor_value").alias("factor_value"),
        F.min("duration").alias("duration"),
        F.count(F.lit(1)).alias("factor_rows"),
    )
    packed = per_period.groupBy("pattern_id").agg(
        F.collect_list(F.struct("period", "period_frequency", "factor_value", "duration", "factor_rows")).alias("_bad")
    )
    used = coverages.select("coverage_id", F.col("writing_premium_pattern_id").alias("pattern_id"))
    joined = lookup_join(used, packed, ["pattern_id"], "inner", spread=["coverage_id"], hot_rows=hot_rows)
    return joined.select("coverage_id", "pattern_id", F.inline("_bad"))


def distribution_check(patterns: DataFrame, keys: Sequence[str] = ("pattern_id",), tolerance: float = 1e-9) -> DataFrame:
    """Sum of all shares, whether it is 1 within a tolerance, and whether adding in order gives exactly 1."""
    total = F.aggregate("elements", F.lit(0.0), lambda acc, e: acc + (e["distribution"] + e["up_front"]))
    return patterns.select(*keys, total.alias("share_total")).select(
        *keys,
        "share_total",
        (F.abs(F.col("share_total") - 1) < tolerance).alias("sums_to_one"),
        (F.col("share_total") == 1).alias("exactly_one"),
    )


def apply_ultimates(df: DataFrame, ultimates, value: str = "value") -> DataFrame:
    """Multiply a value by each ultimate amount, one row per ultimate type.

    ``ultimates`` is a plan-time list of (type, amount) or the name of an array<struct<type,value>>
    column of the same row, so nothing is joined.
    """
    if isinstance(ultimates, str):
        listed = F.transform(
            ultimates,
            lambda u: F.struct(
                F.upper(F.coalesce(u["type"], F.lit("PREMIUM"))).alias("type"),
                F.coalesce(u["value"], F.lit(1.0)).alias("amount"),
            ),
        )
        rest = [c for c in df.columns if c not in (value, ultimates)]
    else:
        listed = F.array(
            *[
                F.struct(F.lit(kind.upper()).alias("type"), F.lit(1.0 if amount is None else float(amount)).alias("amount"))
                for kind, amount in ultimates
            ]
        )
        rest = [c for c in df.columns if c != value]
    return df.select(*rest, value, F.explode(listed).alias("_u")).select(
        *rest, F.col("_u.type").alias("ultimate_type"), (F.col(value) * F.col("_u.amount")).alias(value)
    )


def normalise(
    df: DataFrame, keys: Sequence[str], position: str, value: str = "value", together: bool = False
) -> DataFrame:
    """Divide by the key's total; a total of about zero is an error. Rows without a key drop out, those
    without a position count in the total and drop out.

    ``position`` is a date or integer column; the total comes back to the rows per (key, block of positions),
    so no task has to hold all factors of a pattern. That works the rows out twice. With ``together`` the rows of a
    key are few (one per day) and lie in one task already: the total is a window there, without a shuffle.
    """
    if together:
        placed = df.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
        summed = placed.withColumn("_total", F.sum(value).over(Window.partitionBy(*keys))).filter(F.col(position).isNotNull())
    else:
        summed = with_key_totals(df, keys, position, {"_total": (F.sum, F.col(value))})
    safe = F.when(
        F.abs(F.col("_total")) < ZERO, F.raise_error(F.lit("the factors of a pattern add up to zero")).cast("double")
    ).otherwise(F.col("_total"))
    return summed.withColumn(value, F.col(value) / safe).drop("_total")
