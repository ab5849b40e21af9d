"""Results of configuration documents: matrix or vectors over financial, development or combined periods.

A document row has ``config_id, start_date, elements`` and the settings ``calendar, linear,
end_of_period, incurred_unit, exposed_unit, default_duration, precision, ultimates``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import buckets, matrix
from ..operators.expand import (
    bucket_cells,
    daily_factors,
    element_schedule,
    linear_bucket_cells,
    row_factor_summary,
    scheduled_elements,
)
from ..operators.joins import spread_rows


def parse_selector(selector: str) -> tuple[str, str, str]:
    """Incurred period set (F, D, C), exposure period set (F, D, C), output (C, R, M)."""
    letters = (selector or "").upper()
    if len(letters) != 3 or letters[0] not in "FDC" or letters[1] not in "FDC" or letters[2] not in "CRM":
        raise ValueError(f"result selector {selector!r} must be two of F/D/C and one of C/R/M")
    return letters[0], letters[1], letters[2]


def config_schedule(configs: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """Element schedule of each document with its own calendar switch."""
    return element_schedule(configs, list(keys), calendar="calendar")


def config_factors(configs: DataFrame, keys: Sequence[str] = ("config_id",), linear: bool = False) -> DataFrame:
    """Significant daily factors, listed by incurred then exposed date by ``factor_listing``."""
    return daily_factors(
        config_schedule(spread_rows(configs, keys), keys), keys, linear=linear, significant_only=True, detailed_types=False
    )


def factor_listing(factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ordered by incurred and exposed date, values to six decimals."""
    return factors.select(
        *keys, "incurred_date", "exposed_date", F.round("value", 6).alias("value"), "factor_type"
    ).orderBy(*keys, "incurred_date", "exposed_date")


def with_spans(configs: DataFrame, linear: bool = False) -> DataFrame:
    """``configs`` with ``min_exposed``, ``max_exposed`` and ``max_incurred`` of their significant factors, worked out in the row.

    They are null for documents without a significant factor; series of periods up to them are null too.
    """
    rows = configs.withColumn("_schedule", scheduled_elements(F.col("start_date"), F.col("calendar")))
    facts = row_factor_summary("_schedule", significant_only=True, linear=linear)
    return rows.withColumns({n: facts[n] for n in ("min_exposed", "max_exposed", "max_incurred")}).drop("_schedule")


def with_periods(
    configs: DataFrame, selector: str, keys: Sequence[str] = ("config_id",), linear: bool = False
) -> DataFrame:
    """Each document's schedule array and its bucket arrays for the selected period sets.

    The period sets depend on the document's own date ranges: the financial set of both axes spans the
    years of the exposure dates, the development sets run from the insured start to the end of the
    last exposure or incurred year. All of it is worked out inside the document's row. Documents
    without a significant factor are left out.
    """
    incurred_set, exposure_set, _ = parse_selector(selector)
    keys = list(keys)
    start = F.col("start_date")
    rows = spread_rows(configs, keys).select(
        *keys, "start_date", "incurred_unit", "exposed_unit", "end_of_period",
        scheduled_elements(start, F.col("calendar")).alias("schedule"),
    )
    facts = row_factor_summary("schedule", significant_only=True, linear=linear)
    spanned = rows.select("*", *[facts[n].alias(n) for n in ("min_exposed", "max_exposed", "max_incurred")])
    incurred_ends = buckets.period_set(
        incurred_set, start, F.col("min_exposed"), F.col("max_exposed"), F.col("max_incurred"), F.col("incurred_unit")
    )
    exposure_ends = buckets.period_set(
        exposure_set, start, F.col("min_exposed"), F.col("max_exposed"), F.col("max_exposed"), F.col("exposed_unit")
    )
    label_end = F.col("end_of_period")
    known = F.col("min_exposed").isNotNull()
    return spanned.select(
        *keys,
        F.when(known, F.col("schedule")).alias("schedule"),
        F.when(known, buckets.from_period(start, incurred_ends, label_end)).alias("incurred_buckets"),
        F.when(known, buckets.from_period(start, exposure_ends, label_end)).alias("exposure_buckets"),
    )


def result_cells(
    configs: DataFrame, selector: str, keys: Sequence[str] = ("config_id",), linear: bool = False
) -> DataFrame:
    """Cells of every document over the period sets that the selector names."""
    keys = list(keys)
    rows = with_periods(configs, selector, keys, linear)
    # outer: the plain form would test the arrays beforehand and work them out twice for that
    schedule = rows.select(*keys, "incurred_buckets", "exposure_buckets", F.inline_outer("schedule")).filter(
        F.col("element_start").isNotNull()
    )
    return (linear_bucket_cells if linear else bucket_cells)(schedule, keys)


def result(
    configs: DataFrame, selector: str, keys: Sequence[str] = ("config_id",), linear: bool = False
) -> DataFrame:
    """The selected output of one mode: M the cells, C the exposure vector, R the incurred vector.

    Rows whose ``linear`` setting differs from ``linear`` are left out; ``book_result`` takes both modes.
    """
    chosen = configs.filter(F.coalesce(F.col("linear"), F.lit(False)) == linear) if "linear" in configs.columns else configs
    cells = result_cells(chosen, selector, keys, linear)
    output = parse_selector(selector)[2]
    if output == "M":
        return cells
    axis = "exposure" if output == "C" else "incurred"
    return (
        cells.groupBy(*keys, F.col(f"{axis}_bucket").alias("date_bucket")).agg(F.sum("value").alias("value"))
    )


def book_result(configs: DataFrame, selector: str, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """The selected output of every row, each in the mode of its own ``linear`` setting (even without one)."""
    if "linear" not in configs.columns:
        return result(configs, selector, keys)
    return result(configs, selector, keys).unionByName(result(configs, selector, keys, linear=True))


def result_table(
    cells: DataFrame, keys: Sequence[str], exposure_buckets=None, precision: int = 6, unlisted: str = "error"
) -> DataFrame:
    """Wide table without totals, rounded half up; without a list of buckets those that occur are the columns."""
    return matrix.table(cells, keys, exposure_buckets, precision, totals=False, unlisted=unlisted)
