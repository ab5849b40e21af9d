"""Interpolation on cumulative curves: cubic (not-a-knot, extrapolating) and linear.

A curve is one row with its knots in order. The cubic's second derivatives solve a tridiagonal system; its
two sweeps are folds over the knots in that row, so no row leaves the JVM. Requested points find their
piece by binary search.

Knots of a null point or value do not count, a knot given twice counts once, two values at one point
are an error. A cubic needs four knots, a line two: curves with fewer give null, or an error with ``few="error"``.
Null points, points of null keys and points of keys without a curve give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .joins import lookup_join
from .sorted_arrays import count_below

KINDS = {"cubic": 4, "linear": 2}
_LIST = "array<struct<p:double,q:double>>"


def _at(values: str, place) -> Column:
    return F.get(F.col(values), place if isinstance(place, Column) else F.lit(place))


def _steps(values: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(values, 2, F.size(values) - 1), F.slice(values, 1, F.size(values) - 1), lambda b, a: b - a)


def _curvatures(packed: DataFrame) -> DataFrame:
    """``_m``, the second derivative at every knot: a spline whose third derivative is even at the second and
    the second-last knot.

    Row j of the system (inner knots 1 .. n - 2) is low * m[j - 1] + mid * m[j] + high * m[j + 1] = right; the end
    conditions are already put in for m[0] and m[n - 1]. ``_sweep`` holds (high', right') after elimination.
    """
    n = F.size("_x")
    last = n - 2
    first_ratio = _at("_h", 0) / _at("_h", 1)
    last_ratio = F.get("_h", n - 2) / F.get("_h", n - 3)

    def forward(state: Column, j: Column) -> Column:
        before, after = _at("_h", j - 1), _at("_h", j)
        low = before - F.when(j == last, after * last_ratio).otherwise(0.0)
        high = after - F.when(j == 1, before * first_ratio).otherwise(0.0)
        mid = (
            2.0 * (before + after)
            + F.when(j == 1, before * (1.0 + first_ratio)).otherwise(0.0)
            + F.when(j == last, after * (1.0 + last_ratio)).otherwise(0.0)
        )
        right = 6.0 * (_at("_s", j) - _at("_s", j - 1))
        # nothing is left of the first inner knot
        below = F.when(j == 1, 0.0).otherwise(low)
        pivot = mid - below * state["p"]
        p, q = high / pivot, (right - below * state["q"]) / pivot
        return F.struct(
            p.alias("p"), q.alias("q"), F.concat(state["list"], F.array(F.struct(p.alias("p"), q.alias("q")))).alias("list")
        )

    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.array().cast(_LIST).alias("list"))
    swept = packed.withColumn(
        "_sweep", F.when(n >= KINDS["cubic"], F.aggregate(F.sequence(F.lit(1), last), start, forward, lambda s: s["list"]))
    )

    def backward(state: Column, j: Column) -> Column:
        row = F.get("_sweep", j - 1)
        m = row["q"] - F.when(j == last, 0.0).otherwise(row["p"]) * state["m"]
        return F.struct(m.alias("m"), F.concat(F.array(m), state["list"]).alias("list"))

    nothing = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<double>").alias("list"))
    inner = swept.withColumn(
        "_inner",
        F.when(F.col("_sweep").isNotNull(), F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), nothing, backward, lambda s: s["list"])),
    )
    k = F.size("_inner")
    left = _at("_inner", 0) * (1.0 + first_ratio) - _at("_inner", 1) * first_ratio
    right = F.get("_inner", k - 1) * (1.0 + last_ratio) - F.get("_inner", k - 2) * last_ratio
    return inner.withColumn("_m", F.when(F.col("_inner").isNotNull(), F.concat(F.array(left), F.col("_inner"), F.array(right))))


def curve_segments(
    curves: DataFrame, keys: Sequence[str], x: str, y: str, kind: str = "cubic", few: str = "null"
) -> DataFrame:
    """One row per curve: its polynomial pieces y = a + b t + c t^2 + d t^3, t from the piece's left knot ``x``."""
    if kind not in KINDS:
        raise ValueError("kind must be 'cubic' or 'linear'")
    if few not in ("null", "error"):
        raise ValueError("few must be 'null' or 'error'")
    knot = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    packed = (
        curves.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys).agg(F.array_distinct(F.sort_array(F.collect_list(knot))).alias("_k"))
        .withColumns({"_x": F.col("_k.x"), "_y": F.col("_k.y")})
        .withColumn("_h", _steps(F.col("_x")))
    )
    checked = F.when(F.exists("_h", lambda h: h == 0), F.raise_error(F.lit("a curve has two values at one point")).cast("array<double>"))
    if few == "error":
        checked = checked.when(
            F.size("_x") < KINDS[kind], F.raise_error(F.lit(f"a {kind} curve needs {KINDS[kind]} points")).cast("array<double>")
        )
    packed = packed.withColumn("_h", checked.otherwise(F.col("_h")))
    packed = packed.withColumn("_s", F.zip_with(_steps(F.col("_y")), "_h", lambda dy, h: dy / h))
    shaped = _curvatures(packed) if kind == "cubic" else packed

    def piece(i: Column) -> Column:
        if kind == "linear":
            b, c, d = _at("_s", i), F.lit(0.0), F.lit(0.0)
        else:
            h, m, following = _at("_h", i), _at("_m", i), _at("_m", i + 1)
            b, c, d = _at("_s", i) - h * (2.0 * m + following) / 6.0, m / 2.0, (following - m) / (6.0 * h)
        return F.struct(_at("_x", i).alias("x"), _at("_y", i).alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))

    pieces = F.transform(F.sequence(F.lit(0), F.size("_x") - 2), piece)
    return shaped.select(*keys, F.when(F.size("_x") >= KINDS[kind], pieces).alias("segments"))


def interpolate(
    curves: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    at: str,
    into: str = "interpolated",
    kind: str = "cubic",
    spread: Sequence[str] | None = None,
    few: str = "null",
) -> DataFrame:
    """Value of each key's curve at the requested points; the outer pieces extend beyond the ends.

    The points are joined to one row per curve. ``spread`` salts the keys with very many points (see
    ``lookup_join``); without it a skewed key is left to adaptive execution and the points are read once.
    """
    segments = curve_segments(curves, keys, x, y, kind, few).withColumn("_starts", F.col("segments.x"))
    joined = lookup_join(points, segments, keys, "left", spread=spread)
    reached = count_below(F.col("_starts"), F.col(at).cast("double"), or_equal=True)
    found = joined.withColumn("_s", F.get("segments", F.greatest(reached - 1, F.lit(0))))
    t = F.col(at) - F.col("_s.x")
    value = F.col("_s.a") + t * (F.col("_s.b") + t * (F.col("_s.c") + t * F.col("_s.d")))
    return found.withColumn(into, value).drop("segments", "_starts", "_s")
