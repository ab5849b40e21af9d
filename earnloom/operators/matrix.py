"""Incurred x exposure matrices in long form: vectors, totals, tables and sums by position.

A cell frame has key columns, ``incurred_bucket``, ``exposure_bucket`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window, functions as F

from .expand import sum_cells
from .patterns import ZERO
from .sorted_arrays import count_below


def matrix(factors: DataFrame, keys: Sequence[str], incurred: Column, exposure: Column) -> DataFrame:
    """Bucket daily factors (bucket columns may be null: such rows drop out) and add them up."""
    labelled = factors.select(
        *keys, incurred.alias("incurred_bucket"), exposure.alias("exposure_bucket"), "value"
    ).filter(F.col("incurred_bucket").isNotNull() & F.col("exposure_bucket").isNotNull())
    return sum_cells(labelled, keys)


def vector(cells: DataFrame, keys: Sequence[str], axis: str = "exposure") -> DataFrame:
    """Sums along one axis, near-zero entries dropped."""
    return (
        cells.groupBy(*keys, F.col(f"{axis}_bucket").alias("date_bucket"))
        .agg(F.sum("value").alias("value"))
        .filter(F.abs("value") > ZERO)
    )


def total(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("cells"))


def cell_value(cells: DataFrame, keys: Sequence[str], incurred, exposure) -> DataFrame:
    """The value of one cell per key, 0 where the key has no such cell."""
    hit = (F.col("incurred_bucket") == incurred) & (F.col("exposure_bucket") == exposure)
    return cells.groupBy(*keys).agg(F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0)).alias("value"))


def active_buckets(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted lists of the buckets that hold a value (as long as the calendar, not as the data)."""
    return cells.groupBy(*keys).agg(
        F.sort_array(F.collect_set("incurred_bucket")).alias("incurred_buckets"),
        F.sort_array(F.collect_set("exposure_bucket")).alias("exposure_buckets"),
    )


def with_totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells plus a total per row, per column and overall (a null bucket marks the total)."""
    keys = list(keys)
    compact = cells.groupBy(*keys, "incurred_bucket", "exposure_bucket").agg(F.sum("value").alias("value"))
    axes = F.explode(F.array(*[
        F.struct(F.lit(inc).alias("inc"), F.lit(exp).alias("exp")) for inc in (True, False) for exp in (True, False)
    ]))
    return (
        compact.select("*", axes.alias("_keep"))
        .groupBy(
            *keys,
            F.when(F.col("_keep.inc"), F.col("incurred_bucket")).alias("incurred_bucket"),
            F.when(F.col("_keep.exp"), F.col("exposure_bucket")).alias("exposure_bucket"),
        )
        .agg(F.sum("value").alias("value"))
    )


# More columns than this are a long-form result, not a table.
MAX_COLUMNS = 2_000


def bucket_labels(cells: DataFrame, axis: str = "exposure") -> list[str]:
    """The buckets that occur on an axis, in order: one pass that brings one value per bucket of the calendar."""
    name = f"{axis}_bucket"
    rows = cells.select(F.col(name).cast("string").alias("b")).filter("b IS NOT NULL").distinct().limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} buckets: use the long form")
    return sorted(r["b"] for r in rows)


def table(
    cells: DataFrame,
    keys: Sequence[str],
    exposure_buckets: Sequence[Date] | None = None,
    precision: int = 2,
    totals: bool = True,
    unlisted: str = "error",
) -> DataFrame:
    """Wide table: one row per incurred bucket, one column per exposure bucket, 0 where empty.

    Without ``exposure_buckets`` the columns are those that occur (see ``bucket_labels``). With a list no
    extra job runs; a cell outside it is an error, or left out of the columns with ``unlisted="drop"``. With
    ``totals`` there are a Total column and a total row (null incurred bucket) over all cells; without, only
    the rounded cells.
    """
    if unlisted not in ("error", "drop"):
        raise ValueError("unlisted must be 'error' or 'drop'")
    keys = list(keys)
    if exposure_buckets is None:
        labels = bucket_labels(cells)
    else:
        labels = [d.isoformat() if isinstance(d, Date) else str(d) for d in exposure_buckets]
    named = cells.withColumn("_col", F.col("exposure_bucket").cast("string"))
    if exposure_buckets is not None and unlisted == "error":
        stray = F.raise_error(F.concat(F.lit("no column for the exposure bucket "), F.coalesce("_col", F.lit("null")))).cast("double")
        named = named.withColumn("value", F.when(F.col("_col").isin(*labels), F.col("value")).otherwise(stray))
    picks = [F.sum(F.when(F.col("_col") == label, F.col("value"))).alias(label) for label in labels]
    every = F.sum("value").alias("Total")
    if totals:
        both = F.explode(F.array(F.lit(True), F.lit(False)))
        rows = named.select("*", both.alias("_own")).groupBy(
            *keys, F.when(F.col("_own"), F.col("incurred_bucket")).alias("incurred_bucket")
        )
        wide = rows.agg(*picks, every)
    else:
        rows = named.groupBy(*keys, "incurred_bucket")
        wide = rows.agg(*picks) if picks else rows.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    numbers = [c for c in wide.columns if c not in keys and c != "incurred_bucket"]

    def shown(c: str) -> Column:
        v = F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
        return F.round(F.when(F.abs(v) > ZERO, v).otherwise(F.lit(0.0)), precision).alias(c)

    return wide.select(*keys, "incurred_bucket", *[shown(c) for c in numbers])


DIRECTIONS = ("left", "right", "top", "bottom", "top-left", "top-right", "bottom-left", "bottom-right")


def directional_sums(cells: DataFrame, keys: Sequence[str], reference, at_most: bool = True) -> DataFrame:
    """Sums of the cells left, right, above, below and in the four corners of a reference date.

    One pass: eight conditional sums. ``at_most=False`` turns every comparison round.
    """
    inc, exp = F.col("incurred_bucket"), F.col("exposure_bucket")
    early_inc, late_inc = (inc <= reference), (inc >= reference)
    early_exp, late_exp = (exp <= reference), (exp >= reference)
    if not at_most:
        early_inc, late_inc, early_exp, late_exp = late_inc, early_inc, late_exp, early_exp
    tests = {
        "left": early_exp,
        "right": late_exp,
        "top": early_inc,
        "bottom": late_inc,
        "top-left": early_inc & early_exp,
        "top-right": early_inc & late_exp,
        "bottom-left": late_inc & early_exp,
        "bottom-right": late_inc & late_exp,
    }
    return cells.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(tests[d], F.col("value"))), F.lit(0.0)).alias(d.replace("-", "_"))
            for d in DIRECTIONS
        ]
    )


# --- sums by date criteria -----------------------------------------------------------------------

OPERATORS = ("<", "<=", ">", ">=")


def _check(op: str) -> str:
    if op not in OPERATORS:
        raise ValueError(f"date comparison must be one of {OPERATORS}, not {op!r}")
    return op


def _compare(column: Column, op: str, date) -> Column:
    return {"<": column < date, "<=": column <= date, ">": column > date, ">=": column >= date}[_check(op)]


def sum_by_criteria(
    rows: DataFrame,
    keys: Sequence[str],
    criteria: Sequence[tuple[str, Date, str, str]],
    incurred: str = "incurred_bucket",
    exposed: str = "exposure_bucket",
) -> DataFrame:
    """One conditional sum per (name, date, incurred operator, exposed operator), all in one pass."""
    return rows.groupBy(*keys).agg(
        *[
            F.coalesce(
                F.sum(
                    F.when(
                        _compare(F.col(incurred), inc_op, F.lit(day)) & _compare(F.col(exposed), exp_op, F.lit(day)),
                        F.col("value"),
                    )
                ),
                F.lit(0.0),
            ).alias(name)
            for name, day, inc_op, exp_op in criteria
        ]
    )


def _day_sums(rows: DataFrame, keys: Sequence[str], incurred: Column, exposed: Column) -> DataFrame:
    """One row per key: for each measure the sorted days and the sums up to each of them.

    Measures: incurred day, exposed day, the later of both, and the later of both with one of them a day
    on. The arrays are as long as the calendar of the key's rows, however many rows there are.
    """
    days = {
        "i": incurred,
        "e": exposed,
        "ie": F.greatest(incurred, exposed),
        "id": F.greatest(incurred, F.date_add(exposed, 1)),
        "de": F.greatest(F.date_add(incurred, 1), exposed),
    }
    points = [F.struct(F.lit(name).alias("measure"), day.alias("day")) for name, day in days.items()]
    by_day = (
        rows.filter(incurred.isNotNull() & exposed.isNotNull())
        .select(*keys, "value", F.explode(F.array(*points)).alias("_p"))
        .groupBy(*keys, F.col("_p.measure").alias("_measure"), F.col("_p.day").alias("_day"))
        .agg(F.sum("value").alias("_sum"))
        .repartition(*keys)  # what follows is per key and needs no other shuffle
    )
    upto = Window.partitionBy(*keys, "_measure").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    running = by_day.withColumn("_upto", F.sum("_sum").over(upto))
    packed = running.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("_measure") == m, F.struct("_day", "_upto")))).alias(f"_{m}") for m in days]
    )
    return packed.select(
        *keys,
        *[F.col(f"_{m}._day").alias(f"_days_{m}") for m in days],
        *[F.col(f"_{m}._upto").alias(f"_sums_{m}") for m in days],
    )


def sum_by_criteria_table(
    rows: DataFrame,
    keys: Sequence[str],
    criteria: DataFrame,
    incurred: str = "incurred_bucket",
    exposed: str = "exposure_bucket",
) -> DataFrame:
    """Sums for a table of criteria (keys, as_of, incurred_op, exposed_op), any number per key.

    Both comparisons use the same date D, so no range join is needed. "At or before D" on both axes
    means max(incurred, exposed) <= D, a strict comparison moves its date by a day, and "after" is the
    complement. Every criterion is then a signed sum of at most four sums up to a day, found by binary search in
    its key's arrays. Repeated criteria give one row; a key without rows and a null date give 0.
    """
    keys = list(keys)
    if not keys:
        one = F.lit(0)
        whole = sum_by_criteria_table(
            rows.withColumn("_k", one), ["_k"], criteria.withColumn("_k", one), incurred, exposed
        )
        return whole.drop("_k")
    known = F.col("incurred_op").isin(*OPERATORS) & F.col("exposed_op").isin(*OPERATORS)
    checked = F.when(known, F.col("as_of")).otherwise(F.raise_error(F.lit("date comparison must be <, <=, > or >=")).cast("date"))
    # repeats go before the shuffle; a key has at most sixteen different criteria a day
    asked = (
        criteria.select(*keys, F.struct(checked.alias("as_of"), "incurred_op", "exposed_op").alias("_c"))
        .groupBy(*keys).agg(F.collect_set("_c").alias("_c"))
        .select(*keys, F.inline("_c"))
    )
    joined = asked.join(_day_sums(rows, keys, F.col(incurred), F.col(exposed)), keys, "left")

    def upto(measure: str, day: Column) -> Column:
        found = count_below(F.col(f"_days_{measure}"), day, or_equal=True)
        return F.coalesce(F.get(f"_sums_{measure}", found - 1), F.lit(0.0))

    # "<=" and ">" look at the date itself, "<" and ">=" at the day before
    at = F.col("as_of")
    inc_on, exp_on = F.col("incurred_op").isin("<=", ">"), F.col("exposed_op").isin("<=", ">")
    inc_after, exp_after = F.col("incurred_op").isin(">", ">="), F.col("exposed_op").isin(">", ">=")
    inc_day, exp_day = F.when(inc_on, at).otherwise(F.date_sub(at, 1)), F.when(exp_on, at).otherwise(F.date_sub(at, 1))
    both = F.when(inc_on == exp_on, upto("ie", inc_day)).when(inc_on, upto("id", at)).otherwise(upto("de", at))
    whole = F.coalesce(F.get("_sums_i", F.size("_sums_i") - 1), F.lit(0.0))
    value = (
        F.when(at.isNull(), F.lit(0.0))
        .when(inc_after & exp_after, whole - upto("i", inc_day) - upto("e", exp_day) + both)
        .when(inc_after, upto("e", exp_day) - both)
        .when(exp_after, upto("i", inc_day) - both)
        .otherwise(both)
    )
    return joined.select(*keys, "as_of", "incurred_op", "exposed_op", value.alias("value"))
