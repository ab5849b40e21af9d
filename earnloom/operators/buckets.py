"""Date buckets: arrays of (lo, hi, label), the period sets of a pattern, and dates put into buckets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from .joins import lookup_join
from .sorted_arrays import count_below


def _bucket(lo: Column, hi: Column, label: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), label.alias("label"))


def from_ends(ends: Column) -> Column:
    """A date belongs to the first end on or after it; the first bucket is open below."""
    ends = F.array_sort(ends)
    before = F.concat(F.array(F.lit(None).cast("date")), ends)
    pairs = F.zip_with(
        before,
        ends,
        lambda last, end: _bucket(F.coalesce(F.date_add(last, 1), F.lit(cal.FIRST_DAY).cast("date")), end, end),
    )
    return F.filter(pairs, lambda b: b["hi"].isNotNull())


def from_starts(starts: Column) -> Column:
    """A date belongs to the last start on or before it; the last bucket is open above."""
    starts = F.array_sort(starts)
    after = F.slice(starts, 2, F.size(starts))
    return F.zip_with(
        starts,
        after,
        lambda begin, following: _bucket(
            begin, F.coalesce(F.date_sub(following, 1), F.lit(cal.LAST_DAY).cast("date")), begin
        ),
    )


def from_period(start: Column, ends: Column, to_end=True) -> Column:
    """Consecutive ranges up to each end, the first from the insured start; labelled by end or by start.

    Ranges that would stop before they start (ends before the insured start) are left out.
    """
    label_end = to_end if isinstance(to_end, Column) else F.lit(bool(to_end))

    def build(last: Column, end: Column) -> Column:
        lo = F.date_add(last, 1)
        return _bucket(lo, end, F.when(label_end, end).otherwise(lo))

    def ranges(ends: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.date_sub(start, 1)), ends), ends, build)

    return F.filter(cal.once(ends, ranges), lambda b: b["lo"] <= b["hi"])


PERIOD_SETS = {"F": "financial", "D": "development", "C": "combined"}


def _by_unit_column(unit: Column, build) -> Column:
    names = list(cal.UNIT_DAYS)
    chain = F.when(unit == names[0], build(names[0]))
    for name in names[1:]:
        chain = chain.when(unit == name, build(name))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown time unit "), F.coalesce(unit, F.lit("null")))))


def period_set(letter: str, start: Column, first: Column, last: Column, development_last: Column, unit) -> Column:
    """Bucket ends of a pattern: F whole calendar years of [first, last], D from the start, C both.

    ``unit`` is a name or a string column; the last partial period of a year range is not a bucket.
    """

    def build(name: str) -> Column:
        financial = cal.period_ends(cal.year_start(first), cal.year_end(last), name)
        development = cal.period_ends(start, cal.year_end(development_last), name)
        if letter == "F":
            return financial
        if letter == "D":
            return development
        return F.sort_array(F.array_union(financial, development))  # no null among them

    if letter not in PERIOD_SETS:
        raise ValueError(f"unknown period set {letter!r}: use F, D or C")
    return _by_unit_column(unit, build) if isinstance(unit, Column) else build(unit)


# --- dates of a large table into buckets ---------------------------------------------------------


def calendar_period_end(date, unit: str = "QUARTER") -> Column:
    """Label of the calendar month, quarter or year that holds a date (no join)."""
    step = cal.UNIT_MONTHS[unit]
    column = date if isinstance(date, Column) else F.col(date)
    return F.last_day(F.add_months(F.trunc(column, unit), step - 1))


# Days between the first and last listed bucket date up to which the day list may be broadcast.
MAX_BROADCAST_DAYS = 200_000


def assign_bucket(df: DataFrame, date: str, bounds: Sequence[Date], to_end: bool = True, into: str = "bucket") -> DataFrame:
    """Put each date into one of the listed buckets; dates without a bucket get null.

    Days are discrete, so the as-of lookup becomes an equality join with one row per day between the
    first and last bound (its size is the length of the calendar, checked before it is broadcast).
    Dates beyond the open end are settled by a comparison.
    """
    bounds = sorted(set(bounds))
    spark = df.sparkSession
    first, last = F.lit(bounds[0]), F.lit(bounds[-1])
    pairs = zip(bounds, bounds[1:])
    if to_end:
        rows = [(a, b, b) for a, b in pairs]  # days a+1 .. b belong to b
        span = F.sequence(F.date_add("lo", 1), "hi")
        open_end = F.when(F.col(date) <= first, first)
    else:
        rows = [(a, b, a) for a, b in pairs]  # days a .. b-1 belong to a
        span = F.sequence("lo", F.date_sub("hi", 1))
        open_end = F.when(F.col(date) >= last, last)
    days = spark.createDataFrame(rows, "lo date, hi date, label date").select(
        F.explode(span).alias("_day"), F.col("label").alias("_label")
    )
    if (bounds[-1] - bounds[0]).days <= MAX_BROADCAST_DAYS:
        days = F.broadcast(days)
    joined = df.join(days, F.col(date) == F.col("_day"), "left")
    return joined.withColumn(into, F.coalesce(open_end, F.col("_label"))).drop("_day", "_label")


def assign_bucket_by_key(
    df: DataFrame, date: str, buckets: DataFrame, keys: Sequence[str], into: str = "bucket",
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """The same with a bucket array per key: one row per key is joined, then picked from in the row."""
    listed = buckets.select(*keys, F.col("buckets").alias("_buckets"), F.col("buckets.lo").alias("_starts"))
    joined = lookup_join(df, listed, keys, "left", spread=spread)
    # buckets of a key are in order and do not overlap: the last one that starts at or before the date
    place = count_below(F.col("_starts"), F.col(date), or_equal=True)
    found = F.get("_buckets", place - 1)
    return joined.withColumn(into, F.when(F.col(date) <= found["hi"], found["label"])).drop("_buckets", "_starts")
