"""Plain Python loops, written apart from the library, that the Spark results are compared with."""

from __future__ import annotations

import calendar
import datetime as dt


def days_in(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


def plus_months(day: dt.date, months: int, feb28: bool = False) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    month += 1
    limit = days_in(year, month)
    if day.day <= limit:
        return day.replace(year=year, month=month)
    return dt.date(year, month, 28 if feb28 and month == 2 else limit)


def duration_days(day: dt.date, duration: int, feb28: bool = False) -> int:
    years, rest = divmod(duration, 360)
    months, days = divmod(rest, 30)
    moved = plus_months(plus_months(day, 12 * years, feb28), months, feb28)
    return (moved + dt.timedelta(days) - day).days


UNIT = {"DAY": 1, "WEEK": 7, "MONTH": 30, "QUARTER": 90, "YEAR": 360}


def daily(elements, start: dt.date, use_calendar: bool = True, feb28: bool = False):
    """(incurred, exposed, value) of every day; elements are (unit, up, up_days, dist, dist_days)."""
    rows, at = [], start
    for unit, up, up_days, dist, dist_days in elements:
        def length(d, at=at):
            return duration_days(at, d, feb28) if use_calendar else d

        ne, nu, n = length(UNIT[unit]), length(up_days), length(dist_days)
        for i in range(nu):
            rows.append((at, at + dt.timedelta(i), up / nu))
        for j in range(ne if n > 0 else 0):
            incurred = at + dt.timedelta(j)
            for i in range(n + 1):
                weight = 0.5 if i in (0, n) else 1.0
                rows.append((incurred, incurred + dt.timedelta(i), dist / n / ne * weight))
        at = at + dt.timedelta(ne)
    return rows


def linear(elements, start: dt.date):
    rows, at = [], start
    for unit, up, up_days, dist, dist_days in elements:
        ne, nu, n = (duration_days(at, d) for d in (UNIT[unit], up_days, dist_days))
        for i in range(nu):
            rows.append((at, at + dt.timedelta(i), up / nu, "UPFRONT"))
        for e in range(ne if n > 0 else 0):
            for i in range(n):
                if i + e < ne:
                    kind, value = "START", dist / n / 2 / (ne - e)
                elif i > n - e:
                    kind, value = "END", dist / n / 2 / (ne - e)
                else:
                    kind, value = "DIST", dist / n / ne
                rows.append((at, at + dt.timedelta(i), value, kind))
        at = at + dt.timedelta(ne)
    return rows


def quarter_end(day: dt.date) -> dt.date:
    month = (day.month - 1) // 3 * 3 + 3
    return dt.date(day.year, month, days_in(day.year, month))


def bucketed(rows, incurred, exposed):
    """Cell sums; the two functions give a label or None."""
    cells = {}
    for row in rows:
        key = (incurred(row[0]), exposed(row[1]))
        if None not in key:
            cells[key] = cells.get(key, 0.0) + row[2]
    return {k: v for k, v in cells.items() if abs(v) > 1e-10}
