"""Calendar arithmetic as Column expressions (30/360 durations, period ends, date series)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Nominal length of a unit in a 30/360 year.
UNIT_DAYS = {"DAY": 1, "WEEK": 7, "MONTH": 30, "QUARTER": 90, "YEAR": 360}
# Units that are whole calendar months.
UNIT_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}

FIRST_DAY = "0001-01-01"
LAST_DAY = "9999-12-31"

# How a day 29-31 that does not exist in the target month is moved back:
#   "calendar": to the last day of that month
#   "feb28":    the same, but a month step that lands on 29 February from day 30 or 31 goes to the 28th
CLAMPS = ("calendar", "feb28")


def _date(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def unit_days(unit) -> Column:
    """Nominal days of a unit given as a name or a string column."""
    if not isinstance(unit, Column):
        return F.lit(UNIT_DAYS[unit])
    return _by_unit(unit, UNIT_DAYS)


def _by_unit(unit: Column, values: dict, default=None) -> Column:
    names = list(values)
    chain = F.when(unit == names[0], F.lit(values[names[0]]))
    for name in names[1:]:
        chain = chain.when(unit == name, F.lit(values[name]))
    return chain if default is None else chain.otherwise(_number(default))


def known_unit(unit: Column) -> Column:
    """The unit; an unknown or missing one is an error."""
    return F.when(unit.isin(*UNIT_DAYS), unit).otherwise(unknown_unit(unit).cast("string"))


def unknown_unit(unit: Column) -> Column:
    return F.raise_error(F.concat(F.lit("unknown time unit "), F.coalesce(unit, F.lit("null"))))


def _counted(n) -> Column:
    """0, 1 .. n-1; empty for n <= 0 (a plain sequence would count down) and for no n."""
    n = _number(n).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for a row; named inside a lambda it would be for every entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def month_end(date) -> Column:
    return F.last_day(_date(date))


def split_360(duration) -> tuple[Column, Column, Column]:
    """Years, months and days of a duration in a 30/360 year."""
    days = _number(duration).cast("int")
    return (
        F.floor(days / 360).cast("int"),
        F.floor((days % 360) / 30).cast("int"),
        (days % 30).cast("int"),
    )


def add_months_clamped(date: Column, months: Column, clamp: str = "calendar") -> Column:
    moved = F.add_months(date, months)
    if clamp == "calendar":
        return moved
    lost = (F.month(moved) == 2) & (F.dayofmonth(moved) == 29) & (F.dayofmonth(date) > 29)
    return F.when(lost, F.date_sub(moved, 1)).otherwise(moved)


def add_duration_360(date, duration) -> Column:
    """Years and months in one step, then the left-over days."""
    years, months, days = split_360(duration)
    return F.date_add(F.add_months(_date(date), years * 12 + months), days)


def normalised_days(date, duration, clamp: str = "calendar") -> Column:
    """Calendar days covered by a 30/360 duration: years first, then months, then days."""
    start = _date(date)
    years, months, days = split_360(duration)
    moved = add_months_clamped(F.add_months(start, years * 12), months, clamp)
    return F.datediff(F.date_add(moved, days), start)


def advance(date: Column, unit, calendar: bool = True, clamp: str = "calendar") -> Column:
    """Start of the next element, given the start and the unit of this one; an unknown or missing unit is an error."""
    if not isinstance(unit, Column) and unit not in UNIT_DAYS:
        raise ValueError(f"unknown time unit {unit}")
    if not calendar:
        return F.date_add(date, unit_days(known_unit(unit) if isinstance(unit, Column) else unit))
    if isinstance(unit, Column):
        # a step of a year never lands on 29 February from day 30 or 31, so one step of months does for all units
        months = _by_unit(unit, {"MONTH": 1, "QUARTER": 3, "YEAR": 12, "DAY": 0, "WEEK": 0}, unknown_unit(unit).cast("int"))
        days = _by_unit(unit, {"DAY": 1, "WEEK": 7}, 0)
        return F.date_add(add_months_clamped(date, months, clamp), days)
    if unit in UNIT_MONTHS:
        return add_months_clamped(date, F.lit(UNIT_MONTHS[unit]), clamp if unit != "YEAR" else "calendar")
    return F.date_add(date, UNIT_DAYS[unit])


# --- date series ---------------------------------------------------------------------------------


def _stepped(start: Column, unit: str, k: Column) -> Column:
    if unit in ("DAY", "WEEK"):
        return F.date_add(start, k * UNIT_DAYS[unit])
    if unit == "YEAR":
        leap_day = (F.month(start) == 2) & (F.dayofmonth(start) == 29)
        return F.when(
            leap_day & (k > 0), F.make_date(F.year(start) + k, F.lit(2), F.lit(28))
        ).otherwise(F.add_months(start, k * 12))
    moved = F.add_months(start, k * UNIT_MONTHS[unit])
    return F.when(start == F.last_day(start), F.last_day(moved)).otherwise(moved)


def relative_dates(start, unit: str, n) -> Column:
    """n dates, one unit apart; a month-end start stays on month-ends, day 29/30 comes back after February."""
    start = _date(start)
    return F.transform(_counted(n), lambda k: _stepped(start, unit, k))


def _steps_between(start: Column, end: Column, unit: str) -> Column:
    """An upper bound on the whole units from start to end."""
    if unit in ("DAY", "WEEK"):
        return F.floor(F.datediff(end, start) / UNIT_DAYS[unit]).cast("int") + 1
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.floor(months / UNIT_MONTHS[unit]).cast("int") + 2


def relative_dates_until(start, unit: str, end) -> Column:
    start, end = _date(start), _date(end)
    series = relative_dates(start, unit, _steps_between(start, end, unit))
    return F.filter(series, lambda d: d <= end)


def _month_series(first: Column, step: int, n, ends: bool) -> Column:
    def place(k):
        day = F.add_months(first, k * step)
        return F.last_day(day) if ends else day

    return F.transform(_counted(n), place)


def _month_series_until(first: Column, step: int, end: Column, ends: bool, include_final: bool) -> Column:
    months = (F.year(end) - F.year(first)) * 12 + F.month(end) - F.month(first)
    whole = F.greatest(F.floor(months / step).cast("int"), F.lit(-1)) + 2
    series = _month_series(first, step, whole, ends)
    kept = F.filter(series, lambda d: d <= end)
    return F.slice(series, 1, F.size(kept) + 1) if include_final else kept


def _next_quarter(start: Column) -> Column:
    """First of the last month of the quarter whose end lies strictly after the start."""
    return F.add_months(F.trunc(F.date_add(start, 1), "QUARTER"), 2)


def quarter_ends(start, n, include_final: bool = False) -> Column:
    return _month_series(_next_quarter(_date(start)), 3, _number(n) + int(include_final), True)


def quarter_ends_until(start, end, include_final: bool = False) -> Column:
    return _month_series_until(_next_quarter(_date(start)), 3, _date(end), True, include_final)


def month_ends(start, n, include_final: bool = False) -> Column:
    return _month_series(F.trunc(_date(start), "MM"), 1, _number(n) + int(include_final), True)


def month_ends_until(start, end, include_final: bool = False) -> Column:
    return _month_series_until(F.trunc(_date(start), "MM"), 1, _date(end), True, include_final)


def quarter_starts(start, n) -> Column:
    return _month_series(F.trunc(_date(start), "QUARTER"), 3, n, False)


def quarter_starts_until(start, end) -> Column:
    return _month_series_until(F.trunc(_date(start), "QUARTER"), 3, _date(end), False, False)


def month_starts(start, n) -> Column:
    return _month_series(F.trunc(_date(start), "MM"), 1, n, False)


def month_starts_until(start, end) -> Column:
    return _month_series_until(F.trunc(_date(start), "MM"), 1, _date(end), False, False)


def combined_dates(first: Column, second: Column) -> Column:
    """Sorted union of two date lists without repeats."""
    return F.array_sort(F.array_union(first, second))


def year_start(date) -> Column:
    return F.trunc(_date(date), "YEAR")


def year_end(date) -> Column:
    return F.date_sub(F.add_months(year_start(date), 12), 1)


def financial_quarter_ends(first, last) -> Column:
    """Every quarter end from January of the first year to December of the last."""
    return quarter_ends_until(year_start(first), year_end(last))


def development_dates(start, last, unit: str = "QUARTER") -> Column:
    """One date per unit from the start to 31 December of the last year."""
    return relative_dates_until(start, unit, year_end(last))


def period_ends(start, limit, unit: str) -> Column:
    """Ends of consecutive units from the start, none after the limit.

    Each unit starts where the previous one stopped, so a day 31 that was once moved back stays
    moved back (31 Jan, 30 Apr, 30 Jul). Starts up to day 28 cannot move and skip the fold.
    """
    start, limit = _date(start), _date(limit)
    if unit in ("DAY", "WEEK"):
        length = UNIT_DAYS[unit]
        n = F.floor((F.datediff(limit, start) + 1) / length)
        return F.transform(_counted(n), lambda k: F.date_add(start, (k + 1) * length - 1))
    step = UNIT_MONTHS[unit]

    def listed(row: Column) -> Column:
        start, limit = row["start"], row["limit"]
        counted = _counted(_steps_between(start, limit, unit))
        plain = F.transform(counted, lambda k: F.date_sub(F.add_months(start, (k + 1) * step), 1))
        chained = F.aggregate(
            counted,
            F.struct(start.alias("at"), F.array().cast("array<date>").alias("ends")),
            lambda acc, k: F.struct(
                F.add_months(acc["at"], step).alias("at"),
                F.concat(acc["ends"], F.array(F.date_sub(F.add_months(acc["at"], step), 1))).alias("ends"),
            ),
            lambda acc: acc["ends"],
        )
        ends = F.when(F.dayofmonth(start) <= 28, plain).otherwise(chained)
        return F.filter(ends, lambda d: d <= limit)

    return once(F.struct(start.alias("start"), limit.alias("limit")), listed)
