"""Areas of parallelograms cut by lines, as columns over a table of shapes.

Cuts are a short plan-time list (each shape row is repeated per cut, nothing is joined), columns of the same
row, or a table with any number of cuts per shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _positive(column: Column, what: str) -> Column:
    return F.when(column > 0, column).otherwise(
        F.raise_error(F.lit(f"{what} must be a positive value")).cast("double")
    )


def shape_geometry(shapes: DataFrame) -> DataFrame:
    """Height, width and corner points of shapes given by (area, length, bottom_offset)."""
    length = _positive(F.col("length"), "length")
    height = _positive(F.col("area"), "area") / length
    offset = F.col("bottom_offset")
    return shapes.withColumns(
        {
            "height": height,
            "width": length + F.abs(offset),
            "bottom_left_x": offset.cast("double"),
            "bottom_right_x": (length + offset).cast("double"),
            "bottom_y": -height,
        }
    )


def strip_area(first, second, orientation: str) -> Column:
    """Area between two vertical or horizontal lines: the covered share of the width or height."""
    lo, hi = F.least(first, second), F.greatest(first, second)
    length, offset, area = F.col("length"), F.col("bottom_offset"), F.col("area")
    if orientation == "vertical":
        low, high = F.least(F.lit(0.0), offset.cast("double")), F.greatest(length, length + offset).cast("double")
    elif orientation == "horizontal":
        low, high = -(area / length), F.lit(0.0)
    else:
        raise ValueError("orientation must be 'vertical' or 'horizontal'")
    inside = F.greatest(F.least(hi, high) - F.greatest(lo, low), F.lit(0.0))
    return inside / (high - low) * area


def strip_areas(shapes: DataFrame, lines: Sequence[tuple[float, float, str]]) -> DataFrame:
    """Strip areas of every shape for a list of (line, line, orientation)."""
    listed = F.array(
        *[
            F.struct(
                F.lit(float(a)).alias("line_1"),
                F.lit(float(b)).alias("line_2"),
                F.lit(kind).alias("orientation"),
                strip_area(F.lit(float(a)), F.lit(float(b)), kind).alias("strip_area"),
            )
            for a, b, kind in lines
        ]
    )
    return shapes.select(*shapes.columns, F.inline(listed))


def _chosen(kind: Column, names: Sequence[str], area, what: str) -> Column:
    """The area for the name that a column gives; another name is an error."""
    chain = F.when(kind == names[0], area(names[0]))
    for name in names[1:]:
        chain = chain.when(kind == name, area(name))
    return chain.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(kind, F.lit("null")))).cast("double"))


ORIENTATIONS = ("vertical", "horizontal")


def strip_areas_from(shapes: DataFrame, cuts: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Strip areas of every (shape, cut) of a table of cuts: keys, line_1, line_2, orientation, and columns to keep.

    One equality join by shape, its lines as they are; a shape without cuts has no rows. A null line gives null.
    """
    lines = cuts.select(*keys, *kept, F.col("line_1").cast("double").alias("line_1"), F.col("line_2").cast("double").alias("line_2"), "orientation")
    joined = shapes.join(lines, list(keys))
    first, second = F.col("line_1"), F.col("line_2")
    area = _chosen(F.col("orientation"), ORIENTATIONS, lambda o: strip_area(first, second, o), "orientation")
    return joined.withColumn("strip_area", F.when(first.isNotNull() & second.isNotNull(), area))


def part_geometry(parts: DataFrame) -> DataFrame:
    """Area, width and corners of sheared parts given by (top_length, height): the shear equals the height."""
    top = _positive(F.col("top_length"), "top_length")
    height = _positive(F.col("height"), "height")
    return parts.withColumns(
        {
            "area": (top * height).cast("double"),
            "width": (top + height).cast("double"),
            "bottom_left_x": height.cast("double"),
            "bottom_right_x": (top + height).cast("double"),
        }
    )


PART_REGIONS = ("above", "below", "left", "right", "top_left", "top_right", "bottom_left", "bottom_right")


def part_cut_area(h_cut, v_cut, region: str) -> Column:
    """Exact area of a sheared part in a region of a horizontal and a vertical cut.

    The row at depth y covers x from y to y + top_length. "above"/"top" is the side with depth greater
    than the horizontal cut, "below"/"bottom" the side with smaller depth.
    """
    if region not in PART_REGIONS:
        raise ValueError(f"region must be one of {PART_REGIONS}")
    h, v = _column(h_cut), _column(v_cut)
    top, height = F.col("top_length").cast("double"), F.col("height").cast("double")
    cut = F.least(F.greatest(h, F.lit(0.0)), height)
    if region in ("above", "top_left", "top_right"):
        low, high = cut, height
    elif region in ("below", "bottom_left", "bottom_right"):
        low, high = F.lit(0.0), cut
    else:
        low, high = F.lit(0.0), height

    def primitive(x: Column) -> Column:
        """Area left of the cut in rows whose left edge is up to x away from it."""
        return (
            F.when(x <= 0, F.lit(0.0)).when(x <= top, x * x / 2).otherwise(top * top / 2 + top * (x - top))
        )

    whole = top * (high - low)
    left = primitive(v - low) - primitive(v - high)
    if region in ("above", "below"):
        return whole
    return left if region.endswith("left") else whole - left


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def part_cut_areas(parts: DataFrame, cuts: Sequence[tuple[float, float, str]]) -> DataFrame:
    """Cut areas of every part for a list of (h_cut, v_cut, region)."""
    listed = F.array(
        *[
            F.struct(
                F.lit(float(h)).alias("h_cut"),
                F.lit(float(v)).alias("v_cut"),
                F.lit(region).alias("region"),
                part_cut_area(h, v, region).alias("cut_area"),
            )
            for h, v, region in cuts
        ]
    )
    return parts.select(*parts.columns, F.inline(listed))


def part_cut_areas_from(parts: DataFrame, cuts: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Cut areas of every (part, cut) of a table of cuts: keys, h_cut, v_cut, region, and columns to keep.

    One equality join by part; a part without cuts has no rows.
    """
    lines = cuts.select(*keys, *kept, F.col("h_cut").cast("double").alias("h_cut"), F.col("v_cut").cast("double").alias("v_cut"), "region")
    joined = parts.join(lines, list(keys))
    area = _chosen(F.col("region"), PART_REGIONS, lambda r: part_cut_area(F.col("h_cut"), F.col("v_cut"), r), "region")
    return joined.withColumn("cut_area", F.when(F.col("h_cut").isNotNull() & F.col("v_cut").isNotNull(), area))
