"""Block model: pattern elements cut into development blocks, and written / LIC / LRC / UPR views.

Element frame: ``pattern, element_number, distribution, start_distribution, duration`` (numbers from 0).
Block frame: ``pattern, element_number, written_element, start_point, end_point, proportion,
ultimate_value, shape``.

A pattern of n elements has n elements times n blocks, so patterns are short and many. Everything that looks at a
whole pattern (counts, levels, cut points, running sums) is a window over it: the first one shuffles by
pattern, and all later windows and groupings of the pattern find their rows in place. So the elements should
come dealt out for what they become (``joins.spread_rows`` with their number): a task holds the blocks of its patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEYS = ("pattern",)


def _parts() -> Column:
    """Number of non-zero shares of an element: the levels its blocks take up."""
    start, spread = F.col("start_distribution"), F.col("distribution")
    return (F.coalesce(start, F.lit(0.0)) != 0).cast("int") + (F.coalesce(spread, F.lit(0.0)) != 0).cast("int")


def _pattern(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def _up_to(keys: Sequence[str], *order: str) -> WindowSpec:
    return _pattern(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _level(keys: Sequence[str]) -> Column:
    """One level per non-zero share of the elements before."""
    return (F.sum(_parts()).over(_up_to(keys, "element_number")) - _parts()).cast("int")


def align_elements(
    elements: DataFrame, keys: Sequence[str] = KEYS, periods: int | None = None, levels: bool = False
) -> DataFrame:
    """Spread the elements of a pattern evenly over its duration and give each the weight 1/n.

    With ``levels`` the display level (see ``display_levels``) is added in the same pass.
    """
    counted = elements.withColumns(
        {"_n": F.count(F.lit(1)).over(_pattern(keys)), **({"_level": _level(keys)} if levels else {})}
    )
    n = F.lit(periods) if periods else F.col("_n").cast("int")
    return counted.select(
        *elements.columns,
        n.alias("development_periods"),
        (F.col("duration") / n).alias("duration_offset"),
        (F.col("element_number") * (F.col("duration") / n)).alias("start_offset"),
        (F.lit(1.0) / F.col("_n")).alias("weight"),
        *([F.col("_level").alias("written_element")] if levels else []),
    )


def distribute_remaining(elements: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where the shares of a pattern stay below 1, add the rest evenly to its distributions."""
    whole = _pattern(keys)
    summed = elements.withColumns(
        {"_total": F.sum(F.col("distribution") + F.col("start_distribution")).over(whole), "_n": F.count(F.lit(1)).over(whole)}
    )
    rest = F.when(F.col("_total") < 1, (1 - F.col("_total")) / F.col("_n")).otherwise(0.0)
    return summed.withColumn("distribution", F.col("distribution") + rest).drop("_total", "_n")


def zero_out(elements: DataFrame, start: bool = True, distribution: bool = True) -> DataFrame:
    """Set start shares, distributions or both to 0."""
    cleared = {}
    if start:
        cleared["start_distribution"] = F.lit(0.0)
    if distribution:
        cleared["distribution"] = F.lit(0.0)
    return elements.withColumns(cleared)


def check_elements(elements: DataFrame, keys: Sequence[str] = KEYS, duration=360) -> DataFrame:
    """Share total, exact and tolerant check for 1, and whether all durations equal the pattern's."""
    wanted = duration if isinstance(duration, Column) else F.lit(duration)
    total = F.sum(F.col("distribution") + F.col("start_distribution"))
    return elements.groupBy(*keys).agg(
        total.alias("share_total"),
        (total == 1).alias("exactly_one"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.col("duration") == wanted).alias("durations_equal"),
    )


def display_levels(elements: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Level at which an element's first block is shown: one level per non-zero share before it."""
    return elements.withColumn("written_element", _level(keys))


def pattern_blocks(elements: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Blocks of aligned elements.

    A start share gives one FIRST block per period. A distribution gives one block more than there are
    periods, the first rising and the last falling at half weight.
    """
    keys = list(keys)
    levelled = elements if "written_element" in elements.columns else display_levels(elements, keys)
    n = F.col("development_periods")
    has_start = F.coalesce(F.col("start_distribution"), F.lit(0.0)) != 0
    has_dist = F.coalesce(F.col("distribution"), F.lit(0.0)) != 0
    none = F.array().cast("array<struct<index:int,share:double,shape:string,step:int>>")

    def part(index, share, shape, step):
        return F.struct(
            index.alias("index"), share.alias("share"), shape.alias("shape"), F.lit(step).cast("int").alias("step")
        )

    firsts = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: part(i, F.col("start_distribution") / n, F.lit("FIRST"), 0),
    )
    after_start = F.when(has_start, 1).otherwise(0)

    def spread(i):
        edge = (i == 0) | (i == n)
        shape = F.when(i == 0, "INC_PROP").when(i == n, "DEC_PROP").otherwise("LINEAR")
        return part(i, F.col("distribution") / F.when(edge, n * 2).otherwise(n), shape, 1)

    runs = F.transform(F.sequence(F.lit(0), n), spread)
    every = F.concat(F.when(has_start & (n > 0), firsts).otherwise(none), F.when(has_dist & (n > 0), runs).otherwise(none))
    rows = levelled.select(
        *keys, "element_number", "written_element", "start_offset", "duration_offset",
        after_start.alias("_after"), F.explode(every).alias("_b"),
    )
    at = F.col("start_offset") + F.col("_b.index") * F.col("duration_offset")
    end = F.col("start_offset") + (F.col("_b.index") + 1) * F.col("duration_offset") - 1
    return rows.select(
        *keys,
        "element_number",
        (F.col("written_element") + F.col("_b.step") * F.col("_after")).alias("written_element"),
        at.cast("double").alias("start_point"),
        end.cast("double").alias("end_point"),
        F.col("_b.share").alias("proportion"),
        F.lit(0.0).alias("ultimate_value"),
        F.col("_b.shape").alias("shape"),
    )


def apply_ultimate(blocks: DataFrame, ultimate) -> DataFrame:
    amount = ultimate if isinstance(ultimate, Column) else F.lit(float(ultimate))
    return blocks.withColumn("ultimate_value", F.col("proportion") * amount)


def starts_before(point) -> Column:
    return F.col("start_point") < point


def starts_after(point) -> Column:
    return F.col("start_point") > point


def starts_between(start, end) -> Column:
    """From ``start`` on and before ``end``."""
    return (F.col("start_point") >= start) & (F.col("start_point") < end)


def blocks_before(blocks: DataFrame, point) -> DataFrame:
    return blocks.filter(starts_before(point))


def blocks_after(blocks: DataFrame, point) -> DataFrame:
    return blocks.filter(starts_after(point))


def blocks_between(blocks: DataFrame, start, end) -> DataFrame:
    return blocks.filter(starts_between(start, end))


def element_bounds(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Earliest and latest start and end point of each element."""
    return blocks.groupBy(*keys, "element_number").agg(
        F.min("start_point").alias("earliest_start"),
        F.max("start_point").alias("latest_start"),
        F.min("end_point").alias("earliest_end"),
        F.max("end_point").alias("latest_end"),
    )


def point_bounds(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return blocks.groupBy(*keys).agg(
        F.min("start_point").alias("min_point"), F.max("end_point").alias("max_point")
    )


def largest_proportions(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return blocks.groupBy(*keys, "written_element").agg(F.max("proportion").alias("largest_proportion"))


def level_summary(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest proportion of each level, next to the earliest and latest point of its pattern."""
    levels = blocks.groupBy(*keys, "written_element").agg(
        F.max("proportion").alias("largest_proportion"), F.min("start_point").alias("_from"), F.max("end_point").alias("_to")
    )
    whole = _pattern(keys)
    return levels.withColumns({"min_point": F.min("_from").over(whole), "max_point": F.max("_to").over(whole)}).drop("_from", "_to")


def block_totals(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return blocks.groupBy(*keys).agg(
        F.sum("ultimate_value").alias("ultimate_total"), F.sum("proportion").alias("proportion_total")
    )


def _cut_parts(latest_written: Column) -> dict:
    """What the cut point of a pattern follows from; each part is a plain minimum or maximum."""
    number = F.col("element_number")
    return {
        "_max": (F.max, number),
        "_latest": (F.max, latest_written),
        "_last_end": (F.min, F.struct((-number).alias("k"), F.col("end_point").alias("end"))),
        "_start": (F.min, F.when(number == latest_written, F.col("start_point"))),
    }


def _cut_point() -> Column:
    beyond = F.col("_max") < F.col("_latest")
    return F.when(beyond, F.col("_last_end.end") + 1).otherwise(F.col("_start"))


def cut_points(blocks: DataFrame, latest_written, keys: Sequence[str] = KEYS) -> DataFrame:
    """Earliest start point of the latest written element, per pattern.

    Beyond the last element: the earliest end point of the last element plus one. Null when the
    element lies in between but has no blocks.
    """
    parts = _cut_parts(latest_written if isinstance(latest_written, Column) else F.lit(latest_written))
    grouped = blocks.groupBy(*keys).agg(*[function(source).alias(name) for name, (function, source) in parts.items()])
    return grouped.select(*keys, _cut_point().alias("cut_point"))


def liabilities(blocks: DataFrame, latest_written, keys: Sequence[str] = KEYS, value: str = "ultimate_value") -> DataFrame:
    """Written, unwritten, LIC, LRC and UPR per pattern.

    LRC is the written part that ends at or after the cut point; ``lrc_unwritten`` is the other reading
    in use, the unwritten part that ends there.
    """
    latest = latest_written if isinstance(latest_written, Column) else F.lit(latest_written)
    whole = _pattern(keys)
    joined = blocks.withColumns({name: function(source).over(whole) for name, (function, source) in _cut_parts(latest).items()})
    written = F.col("element_number") < latest
    ended = F.col("end_point") < _cut_point()
    running = F.col("end_point") >= _cut_point()

    def part(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))

    return joined.groupBy(*keys).agg(
        part(written).alias("written"),
        part(~written).alias("unwritten"),
        part(written & ended).alias("lic"),
        part(written & running).alias("lrc"),
        part(~written & running).alias("lrc_unwritten"),
        part(running).alias("upr"),
    )


REGIONS = ("t", "b", "l", "r", "tl", "tr", "bl", "br")


def region_flag(region: str, latest_written, day_cut) -> Column:
    """Whether a block lies above/below the latest written element and left/right of the day cut."""
    if region not in REGIONS:
        raise ValueError(f"region must be one of {REGIONS}")
    above = F.col("element_number") < latest_written
    left = F.col("start_point") < day_cut
    tests = []
    if "t" in region or "b" in region:
        tests.append(above if "t" in region else ~above)
    if "l" in region or "r" in region:
        tests.append(left if "l" in region else ~left)
    flag = tests[0]
    for test in tests[1:]:
        flag = flag & test
    return F.coalesce(flag, F.lit(False))


def values_by_point(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ultimate values by whole end point, with the running total over the points."""
    sums = blocks.groupBy(*keys, F.col("end_point").cast("int").alias("end_point")).agg(
        F.sum("ultimate_value").alias("value")
    )
    return sums.withColumn("cumulative_value", F.sum("value").over(_up_to(keys, "end_point")))


def scaled_levels(
    levels: DataFrame, keys: Sequence[str], level: str, value: str, target: Column
) -> DataFrame:
    """Scale the values of a key to whole numbers that aim at a target sum, with their running total.

    Halves round to the even neighbour. A zero sum is an error.
    """
    whole = _pattern(keys)
    joined = levels.withColumns({"_sum": F.sum(value).over(whole), "_target": F.max(target).over(whole)})
    factor = F.when(
        F.col("_sum") == 0, F.raise_error(F.lit("the values of a key add up to zero, cannot scale")).cast("double")
    ).otherwise(F.col("_target") / F.col("_sum"))
    scaled = joined.withColumn("scaled", F.rint(F.col(value) * factor).cast("long")).drop("_sum", "_target")
    return scaled.withColumn("cumulative", F.sum("scaled").over(_up_to(keys, level)))
