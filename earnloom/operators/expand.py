"""From patterns to daily factors, and straight to bucket sums without daily rows.

Input: one row per pattern instance with key columns, a start date and the ``elements`` array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from .joins import spread_rows
from .patterns import ZERO, whole_days


def scheduled_elements(start: Column, calendar: Column | bool = True, clamp: str = "calendar") -> Column:
    """The row's elements with start dates and lengths in days, as one array.

    An element starts where the one before it stops. That length depends on the date, so the starts are
    folded over the (short) element array of the row. Without the calendar all lengths are nominal
    30/360 days; ``calendar`` may be a boolean column.
    """

    def either(by_calendar: Column, nominal: Column) -> Column:
        if isinstance(calendar, Column):
            return F.when(calendar, by_calendar).otherwise(nominal)
        return by_calendar if calendar else nominal

    def add(acc: Column, e: Column) -> Column:
        at = acc["at"]
        following = either(cal.advance(at, e["unit"], True, clamp), cal.advance(at, e["unit"], False))

        def length(name: str) -> Column:
            nominal = whole_days(e[name])
            return either(cal.once(nominal, lambda days: cal.normalised_days(at, days, clamp)), nominal)

        def added(following: Column) -> Column:
            row = F.struct(
                e["ord"].alias("ord"),
                e["unit"].alias("unit"),
                at.alias("element_start"),
                F.datediff(following, at).alias("element_days"),
                e["up_front"].alias("up_front"),
                length("up_front_days").alias("up_days"),
                e["distribution"].alias("distribution"),
                length("distribution_days").alias("dist_days"),
            )
            return F.struct(following.alias("at"), F.array_append(acc["rows"], row).alias("rows"))

        return cal.once(following, added)

    empty = F.struct(start.alias("at"), F.array().cast(SCHEDULE_TYPE).alias("rows"))
    return F.aggregate("elements", empty, add, lambda acc: acc["rows"])


SCHEDULE_TYPE = (
    "array<struct<ord:int,unit:string,element_start:date,element_days:int,up_front:double,up_days:int,"
    "distribution:double,dist_days:int>>"
)


def element_schedule(
    instances: DataFrame,
    keys: Sequence[str],
    start: str = "start_date",
    calendar: bool | str = True,
    clamp: str = "calendar",
) -> DataFrame:
    """One row per element with its start date and its lengths in days; no shuffle.

    The array is built inside the generator, so it is worked out once per pattern instance.
    """
    carried = list(dict.fromkeys([*keys, start]))
    switch = F.col(calendar) if isinstance(calendar, str) else calendar
    return instances.select(*carried, F.inline(scheduled_elements(F.col(start), switch, clamp)))


def merged_elements(
    rows: DataFrame,
    keys: Sequence[str] = (),
    start: str = "element_start",
    lengths: Sequence[str] = ("element_days", "up_days", "dist_days"),
    significant_only: bool = False,
    together: bool = False,
    count: int = 0,
) -> DataFrame:
    """Elements of the same keys, start and lengths as one: their shares add up, ``merged`` is their number.

    ``rows`` is a schedule, or element rows before it (``start`` and ``lengths`` name what settles the days).
    Daily factors are proportional to the shares, so their sums per day stay as they are; counts of factors
    are sums of ``merged``. Without keys there are at most as many rows as there are days and lengths.
    With ``significant_only`` (schedules) shares whose daily weight is about zero are left out element by
    element, and ``edges_shown`` tells whether half a daily weight still counts (see ``daily_factors``).

    The rows come spread for expansion. With keys they lie by key and quarter of the start: what a task expands
    meets in few sums there, and a key with most rows goes over as many parts as it has quarters. With ``together``
    the merged elements of a key go on to one task, so that its daily sums need no other shuffle: at most as many
    as there are days and lengths, however many rows the key has. ``count``, the number of rows, makes
    the tasks more as the rows do.
    """
    keys, shape = list(keys), [start, *lengths]
    if significant_only:
        runs = (F.col("dist_days") > 0) & (F.col("element_days") > 0)
        rate = F.when(runs, F.abs(F.col("distribution") / F.col("dist_days") / F.col("element_days")))
        up_rate = F.when(F.col("up_days") > 0, F.abs(F.col("up_front") / F.col("up_days")))
        rows = rows.withColumns(
            {
                "up_days": F.when(up_rate > ZERO, F.col("up_days")).otherwise(0),
                "dist_days": F.when(rate > ZERO, F.col("dist_days")).otherwise(0),
                "edges_shown": F.coalesce(rate / 2 > ZERO, F.lit(False)),
            }
        )
        shape.append("edges_shown")
    if keys:
        rows = spread_rows(rows.select("*", F.trunc(start, "QUARTER").alias("_quarter")), [*keys, "_quarter"], count)
        shape.append("_quarter")
    merged = rows.groupBy(*keys, *shape).agg(
        F.sum("up_front").alias("up_front"),
        F.sum("distribution").alias("distribution"),
        F.count(F.lit(1)).alias("merged"),
    )
    if not keys:
        return spread_rows(merged, shape)
    merged = merged.drop("_quarter")
    # sorted, the sums of a key stay close to each other while its days are added up
    return spread_rows(merged, keys, count).sortWithinPartitions(*keys) if together else merged


# --- daily factors -------------------------------------------------------------------------------


def _days(n: Column) -> Column:
    """0 .. n-1 as rows, none for n = 0. Call only behind a filter n > 0."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def daily_factors(
    schedule: DataFrame,
    keys: Sequence[str],
    linear: bool = False,
    significant_only: bool = False,
    detailed_types: bool = True,
) -> DataFrame:
    """The daily form: (incurred_date, exposed_date, value, factor_type) rows of every element.

    Up-front shares are spread evenly over their days, all incurred on the element's first day.
    Distributed shares start on each day of the element and run for their days, first and last day at
    half weight. In linear mode everything is incurred on the element's first day, with run-in and
    run-out rates (these rows do not add up to the share in general).

    This multiplies each element by up to element_days x dist_days rows, without a shuffle. For sums by
    bucket use ``bucket_cells``, which gives the same sums from a few rows per element. Where the rows are
    only added up, pass ``merged_elements``; their column ``merged`` can be one of the keys.
    """
    keys = list(keys)
    merged = significant_only and "edges_shown" in schedule.columns
    if merged and linear:
        raise ValueError("the weights of linear factors differ by day: merge them without significant_only")
    up = (
        schedule.filter(F.col("up_days") > 0)
        .select(
            *keys,
            F.col("element_start").alias("incurred_date"),
            "element_start",
            (F.col("up_front") / F.col("up_days")).alias("value"),
            _days(F.col("up_days")).alias("_i"),
        )
        .select(
            *keys,
            "incurred_date",
            F.date_add("element_start", F.col("_i")).alias("exposed_date"),
            "value",
            F.lit("UPFRONT").alias("factor_type"),
        )
    )
    spread = schedule.filter((F.col("dist_days") > 0) & (F.col("element_days") > 0))
    n, ne = F.col("dist_days"), F.col("element_days")
    rate = F.col("distribution") / n / ne
    if linear:
        left = ne - F.col("_day")
        run = F.col("distribution") / n / 2 / left
        run_in = F.col("_i") < left
        run_out = F.col("_i") > n - F.col("_day")
        dist = (
            spread.select(*keys, "element_start", "distribution", "dist_days", "element_days", _days(ne).alias("_day"))
            .select("*", _days(n).alias("_i"))
            .select(
                *keys,
                F.col("element_start").alias("incurred_date"),
                F.date_add("element_start", F.col("_i")).alias("exposed_date"),
                F.when(run_in | run_out, run).otherwise(rate).alias("value"),
                F.when(run_in, "START").when(run_out, "END").otherwise("DIST").alias("factor_type"),
            )
        )
    else:
        edge = (F.col("_i") == 0) | (F.col("_i") == n)
        kind = (
            F.when(F.col("_i") == 0, "FIRST_DISTRIBUTED")
            .when(F.col("_i") == n, "LAST_DISTRIBUTED")
            .otherwise("DISTRIBUTED")
            if detailed_types
            else F.lit("DIST")
        )
        dist = (
            spread.select(
                *keys, "dist_days", "element_start", rate.alias("_rate"), _days(ne).alias("_day"),
                *(["edges_shown"] if merged else []),
            )
            .select(
                *keys,
                "dist_days",
                "_rate",
                F.date_add("element_start", F.col("_day")).alias("incurred_date"),
                F.explode(F.sequence(F.lit(0), n)).alias("_i"),
                *(["edges_shown"] if merged else []),
            )
            .filter(F.col("edges_shown") | ~edge if merged else F.lit(True))
            .select(
                *keys,
                "incurred_date",
                F.date_add("incurred_date", F.col("_i")).alias("exposed_date"),
                F.when(edge, F.col("_rate") / 2).otherwise(F.col("_rate")).alias("value"),
                kind.alias("factor_type"),
            )
        )
    rows = up.unionByName(dist)
    return rows.filter(F.abs("value") > ZERO) if significant_only and not merged else rows


def _factor_facts(e, significant_only: bool, linear: bool) -> dict[str, Column]:
    """Number of daily factors of an element and its date ranges; ``e`` looks up a field of the element."""
    up_days, dist_days, element_days, start = e("up_days"), e("dist_days"), e("element_days"), e("element_start")
    has_up = up_days > 0
    has_dist = (dist_days > 0) & (element_days > 0)
    if significant_only:
        has_up = has_up & (F.abs(e("up_front") / up_days) > ZERO)
        has_dist = has_dist & (F.abs(e("distribution") / dist_days / element_days) > ZERO)
    last_start = F.lit(0) if linear else element_days - 1
    exposed_days = dist_days - 1 if linear else dist_days
    count = F.when(has_up, up_days).otherwise(0).cast("long") + F.when(
        has_dist, element_days.cast("long") * (exposed_days + 1)
    ).otherwise(0)
    return {
        "factors_count": count,
        "first": F.when(has_up | has_dist, start),
        "max_incurred": F.greatest(F.when(has_up, start), F.when(has_dist, F.date_add(start, last_start))),
        "max_exposed": F.greatest(
            F.when(has_up, F.date_add(start, up_days - 1)),
            F.when(has_dist, F.date_add(start, last_start + exposed_days)),
        ),
    }


def factor_summary(
    schedule: DataFrame, keys: Sequence[str], significant_only: bool = False, linear: bool = False
) -> DataFrame:
    """Number of daily factors and their date ranges, worked out per element instead of per day.

    With ``significant_only`` elements whose daily weight is about zero do not count. Linear factors
    are all incurred on the element's first day and have no extra last day.
    """
    facts = _factor_facts(F.col, significant_only, linear)
    return schedule.groupBy(*keys).agg(
        F.sum(facts["factors_count"]).alias("factors_count"),
        F.min(facts["first"]).alias("min_incurred"),
        F.max(facts["max_incurred"]).alias("max_incurred"),
        F.min(facts["first"]).alias("min_exposed"),
        F.max(facts["max_exposed"]).alias("max_exposed"),
    )


def row_factor_summary(schedule: str, significant_only: bool = False, linear: bool = False) -> dict[str, Column]:
    """The same from a schedule array inside the row: no grouping, no shuffle."""

    def of(name: str) -> Column:
        return F.transform(schedule, lambda e: _factor_facts(lambda f: e[f], significant_only, linear)[name])

    first = F.array_min(of("first"))
    return {
        "factors_count": F.aggregate(of("factors_count"), F.lit(0).cast("long"), lambda acc, n: acc + n),
        "min_incurred": first,
        "max_incurred": F.array_max(of("max_incurred")),
        "min_exposed": first,
        "max_exposed": F.array_max(of("max_exposed")),
    }


# --- bucket sums without daily rows --------------------------------------------------------------


def _ramp(x: Column) -> Column:
    """Sum over y <= x of the part of one day's curve that is exposed by its day y, in days.

    The curve gives half a day on day 0 and on day n and a whole day in between, so the sum is
    quadratic up to day n and linear after it. No branches: the compiled expression stays small.
    """
    n = F.col("_n")
    reached = F.greatest(x + 1.0, F.lit(0.0))
    bent = F.least(reached, n)
    return bent * bent * 0.5 + n * (reached - bent)


def _rates(schedule: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Daily rates and the number of further incurred days of each element."""
    runs = (F.col("dist_days") > 0) & (F.col("element_days") > 0)
    return schedule.select(
        *carried,
        "element_start",
        F.when(runs, F.col("dist_days")).otherwise(0).cast("double").alias("_n"),
        F.when(runs, F.col("element_days") - 1).otherwise(0).alias("_more"),
        F.when(runs, F.col("distribution") / F.col("dist_days") / F.col("element_days")).otherwise(0.0).alias("_rate"),
        F.col("up_days").alias("_nu"),
        F.when(F.col("up_days") > 0, F.col("up_front") / F.col("up_days")).otherwise(0.0).alias("_up_rate"),
    )


def _cell_value() -> Column:
    """Sum of an element's daily factors in one cell.

    ``_a.._b`` are the incurred days and ``_c.._d`` the exposed days of the cell, counted from the
    element's start; the up-front share is incurred on day 0.
    """
    a, b, c, d = (F.col(x).cast("double") for x in ("_a", "_b", "_c", "_d"))
    exposed = (_ramp(d - a) - _ramp(d - b - 1.0)) - (_ramp(c - 1.0 - a) - _ramp(c - 2.0 - b))
    up_days = F.greatest(F.least(F.col("_d"), F.col("_nu") - 1) - F.greatest(F.col("_c"), F.lit(0)) + 1, F.lit(0))
    first = (F.col("_a") == 0).cast("int")
    return F.col("_rate") * exposed + F.col("_up_rate") * (up_days * first)


_CELL_FIELDS = ("element_start", "_n", "_rate", "_nu", "_up_rate", "_a", "_b")


def financial_cells(schedule: DataFrame, keys: Sequence[str], unit: str = "QUARTER") -> DataFrame:
    """Sums per calendar period (month, quarter or year) on both axes, keyed by the period's last day.

    Each element yields one row per pair of periods it touches; those rows are added up per cell with a
    partial sum in front of the shuffle. Periods are counted from the one the element starts in.
    """
    keys = list(keys)
    step = cal.UNIT_MONTHS[unit]
    first = F.trunc("element_start", unit)

    def periods_from_first(offset: Column) -> Column:
        day = F.date_add("element_start", offset.cast("int"))
        months = (F.year(day) - F.year("_first")) * 12 + F.month(day) - F.month("_first")
        return F.floor(months / step).cast("int")

    def start_of(k: Column) -> Column:
        return F.add_months("_first", k * step)

    by_incurred = (
        _rates(schedule, keys)
        .withColumn("_first", first)
        .select("*", F.explode(F.sequence(F.lit(0), periods_from_first(F.col("_more")))).alias("_i"))
        .withColumns({"_inc_lo": start_of(F.col("_i")), "incurred_bucket": F.date_sub(start_of(F.col("_i") + 1), 1)})
        .select(
            *keys, "_first", "_i", "incurred_bucket", "element_start", "_n", "_rate", "_nu", "_up_rate",
            F.greatest(F.datediff("_inc_lo", "element_start"), F.lit(0)).alias("_a"),
            F.least(F.datediff("incurred_bucket", "element_start"), F.col("_more")).alias("_b"),
        )
    )
    last_day = F.greatest(F.col("_nu") - 1, F.col("_b") + F.col("_n"))
    cells = (
        by_incurred.select(
            *keys, "_first", "incurred_bucket", *_CELL_FIELDS,
            F.explode(F.sequence(F.col("_i"), F.greatest(F.col("_i"), periods_from_first(last_day)))).alias("_e"),
        )
        .withColumns({"_exp_lo": start_of(F.col("_e")), "exposure_bucket": F.date_sub(start_of(F.col("_e") + 1), 1)})
        .select(
            *keys, "incurred_bucket", "exposure_bucket", *_CELL_FIELDS,
            F.datediff("_exp_lo", "element_start").alias("_c"),
            F.datediff("exposure_bucket", "element_start").alias("_d"),
        )
        .select(*keys, "incurred_bucket", "exposure_bucket", _cell_value().alias("value"))
    )
    return sum_cells(cells, keys)


def _each_bucket(rows: DataFrame, buckets: str, into: str) -> DataFrame:
    """A row per bucket of the array in place of the array; those touched are picked by a plain filter on the rows.

    A filter on the array would be interpreted entry by entry; the rows are compiled. Outer: the plain form
    would test the arrays beforehand and work them out twice for that.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns if c != buckets]
    return rows.select(*rest, F.inline_outer(buckets).alias(f"{into}_lo", f"{into}_hi", f"{into}_label"))


def bucket_cells(
    schedule: DataFrame,
    keys: Sequence[str],
    incurred: str = "incurred_buckets",
    exposure: str = "exposure_buckets",
) -> DataFrame:
    """Sums per pair of arbitrary buckets.

    The schedule rows carry two array<struct<lo,hi,label>> columns (see ``buckets``); each element is
    matched only with the buckets it touches. Days outside all buckets are dropped.
    """
    keys = list(keys)
    start = F.col("element_start")
    by_incurred = (
        _each_bucket(_rates(schedule, [*keys, incurred, exposure]), incurred, "_inc")
        .filter((F.col("_inc_hi") >= start) & (F.col("_inc_lo") <= F.date_add(start, F.col("_more"))))
        .select(
            *keys, exposure, F.col("_inc_label").alias("incurred_bucket"), "element_start", "_n", "_rate", "_nu", "_up_rate",
            F.greatest(F.datediff("_inc_lo", start), F.lit(0)).alias("_a"),
            F.least(F.datediff("_inc_hi", start), F.col("_more")).alias("_b"),
        )
    )
    first_day = F.date_add(start, F.col("_a"))
    last_day = F.date_add(start, F.greatest(F.col("_nu") - 1, F.col("_b") + F.col("_n").cast("int")))
    cells = (
        _each_bucket(by_incurred, exposure, "_exp")
        .filter((F.col("_exp_hi") >= first_day) & (F.col("_exp_lo") <= last_day))
        .select(
            *keys, "incurred_bucket", F.col("_exp_label").alias("exposure_bucket"), *_CELL_FIELDS,
            F.datediff("_exp_lo", start).alias("_c"),
            F.datediff("_exp_hi", start).alias("_d"),
        )
        .select(*keys, "incurred_bucket", "exposure_bucket", _cell_value().alias("value"))
    )
    return sum_cells(cells, keys)


# Days up to which sums of 1/j come from a table; the longest unit has 366.
_HARMONIC_DAYS = 400


def _harmonic(m: Column, table: Column) -> Column:
    """1 + 1/2 + .. + 1/m; 0 for m <= 0. Beyond the table by its expansion, whose error is below 1e-12 there."""
    x = m.cast("double")
    far = F.log(x) + 0.5772156649015329 + 0.5 / x - 1.0 / (12.0 * x * x)
    return F.when(m <= _HARMONIC_DAYS, F.get(table, F.greatest(m, F.lit(0)))).otherwise(far)


def _with_linear_value(rows: DataFrame, into: str) -> DataFrame:
    """Add the sum of a linear element's factors over all its days in one exposure bucket.

    With j days of the element left, days 0 .. j-1 run in and days j+s .. n-1 run out, s = max(n - ne + 1, 0), at
    distribution / n / 2 / j; those between have the even rate. ``_c.._d`` are the bucket's days, cut to 0 .. n-1:
    c .. e-1. The run-in days inside are j - c from c to e and all of them from there on, the run-out days all up to
    j = c - s and e - s - j from there to e - s; so the sums over j = 1 .. ne need sums of 1/j and of j only.
    The steps are columns of their own: as one expression they are too long to be compiled well.
    """
    sums = [0.0]
    for j in range(1, _HARMONIC_DAYS + 1):
        sums.append(sums[-1] + 1.0 / j)
    table = F.expr("array(" + ", ".join(f"{x!r}D" for x in sums) + ")")
    n, ne, c, e, s = (F.col(x) for x in ("dist_days", "element_days", "_c", "_e", "_s"))
    cut, bent, flat, last = (F.col(x) for x in ("_cut", "_bent", "_flat", "_last"))  # the j where slopes begin and end

    def within(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0)), ne)

    def whole(x: Column) -> Column:  # 1 + .. + x
        return x.cast("double") * (x + 1) / 2

    placed = rows.withColumns({"_e": F.least(F.col("_d"), n - 1) + 1, "_s": F.greatest(n - ne + 1, F.lit(0))})
    bounds = placed.withColumns({"_cut": within(c), "_flat": within(c - s), "_last": within(e - s), "_days": e - c}).withColumn(
        "_bent", F.greatest(F.least(e, ne), cut)
    ).withColumn("_last", F.greatest(last, flat))
    days = F.col("_days")
    harmonic = bounds.withColumns({f"_h{x}": _harmonic(F.col(x), table) for x in ("_cut", "_bent", "_flat", "_last")} | {"_hend": _harmonic(ne, table)})
    summed = harmonic.withColumns(
        {
            "_run": (bent - cut) - c * (F.col("_h_bent") - F.col("_h_cut")) + days * (F.col("_hend") - F.col("_h_bent"))
            + days * F.col("_h_flat") + (e - s) * (F.col("_h_last") - F.col("_h_flat")) - (last - flat),
            "_running": whole(bent) - whole(cut) - c * (bent - cut) + days * (ne - bent)
            + days * flat + (e - s) * (last - flat) - (whole(last) - whole(flat)),
        }
    )
    each = F.col("distribution") / n
    value = each / ne * (days * ne - F.col("_running")) + each / 2 * F.col("_run")
    return summed.withColumn(into, F.when((n > 0) & (ne > 0) & (days > 0), value).otherwise(0.0))


def linear_bucket_cells(
    schedule: DataFrame,
    keys: Sequence[str],
    incurred: str = "incurred_buckets",
    exposure: str = "exposure_buckets",
) -> DataFrame:
    """``bucket_cells`` for linear mode: one row per element and touched exposure bucket.

    For one element day the run-in, even and run-out stretches are three adjacent ranges of exposure
    days, so a bucket's share is a count of days per range times its rate; over the element's days these add up
    in closed form.
    """
    keys = list(keys)
    start = F.col("element_start")
    runs = (F.col("dist_days") > 0) & (F.col("element_days") > 0)
    home = F.filter(incurred, lambda b: (b["lo"] <= start) & (start <= b["hi"]))
    base = schedule.filter((F.col("up_days") > 0) | runs).select(
        *keys,
        "element_start", "element_days", "up_front", "up_days", "distribution", "dist_days",
        exposure,
        F.explode(home).alias("_inc"),
    )
    last = F.date_add(start, F.greatest(F.col("up_days"), F.col("dist_days")) - 1)
    touched = F.filter(exposure, lambda b: (b["hi"] >= start) & (b["lo"] <= last))
    paired = base.select(
        *keys,
        "element_days", "up_front", "up_days", "distribution", "dist_days",
        F.col("_inc.label").alias("incurred_bucket"),
        F.explode(touched).alias("_exp"),
        start.alias("element_start"),
    ).select(
        *keys, "element_days", "up_front", "up_days", "distribution", "dist_days", "incurred_bucket",
        F.col("_exp.label").alias("exposure_bucket"),
        F.greatest(F.datediff(F.col("_exp.lo"), start), F.lit(0)).alias("_c"),
        F.datediff(F.col("_exp.hi"), start).alias("_d"),
    )
    nu = F.col("up_days")
    up_days = F.greatest(F.least(nu - 1, F.col("_d")) - F.col("_c") + 1, F.lit(0))
    up = F.when(nu > 0, F.col("up_front") / nu * up_days).otherwise(0.0)
    value = F.coalesce(up, F.lit(0.0)) + F.coalesce("_linear", F.lit(0.0))  # a share may be null
    cells = _with_linear_value(paired, "_linear").select(*keys, "incurred_bucket", "exposure_bucket", value.alias("value"))
    return sum_cells(cells, keys)


def sum_cells(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Add up cells and drop those of about zero."""
    return (
        cells.groupBy(*keys, "incurred_bucket", "exposure_bucket")
        .agg(F.sum(value).alias("value"))
        .filter(F.abs("value") > ZERO)
    )
