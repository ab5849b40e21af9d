"""Block model, shapes, curves and wildcard rules over the given tables (B, A15-A19, G, F13)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from earnloom.operators import blocks as bl, curves, rules, shapes
from earnloom.operators.joins import running_sum, spread_rows
from earnloom.session import scratch_path
from earnloom.sources import documents

from . import inputs
from .registry import query

ULTIMATE = 1000.0


def elements(spark, sf_dir):
    """Every order as a pattern, every line number as an element numbered from 0."""
    price = F.col("l_extendedprice") / 700001
    # an element becomes some five blocks: they are made and grouped where the lines of the pattern are dealt to
    table = inputs.table(spark, sf_dir, "lineitem")
    dealt = spread_rows(table.select("*", F.col("l_orderkey").alias("pattern")), ["pattern"], rows=table.count())
    lines = dealt.groupBy("pattern", "l_linenumber").agg(
        F.sum(F.when(F.col("l_returnflag") != "R", price).otherwise(0.0)).alias("distribution"),
        F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0)).alias("start_distribution"),
        F.max(F.when(F.col("l_quantity") > 48, 180).otherwise(360)).alias("duration"),
    )
    number = F.row_number().over(Window.partitionBy("pattern").orderBy("l_linenumber")) - 1
    return lines.select("pattern", number.alias("element_number"), "distribution", "start_distribution", "duration")


_ELEMENTS = """
el AS (
  SELECT pattern, CAST(row_number() OVER (PARTITION BY pattern ORDER BY ln) - 1 AS INTEGER) AS element_number,
    distribution, start_distribution, duration
  FROM (SELECT l_orderkey AS pattern, l_linenumber AS ln,
          sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 700001 ELSE 0.0 END) AS distribution,
          sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 700001 ELSE 0.0 END) AS start_distribution,
          max(CASE WHEN l_quantity > 48 THEN 180 ELSE 360 END) AS duration
        FROM lineitem GROUP BY ALL))"""

_BLOCKS = _ELEMENTS + """,
al AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY pattern) AS INTEGER) AS n, duration / (count(*) OVER (PARTITION BY pattern)) AS off,
    CAST(coalesce(sum((distribution <> 0)::INT + (start_distribution <> 0)::INT)
      OVER (PARTITION BY pattern ORDER BY element_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS lvl
  FROM el),
raw AS (
  SELECT *, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS i, 'S' AS part FROM al WHERE start_distribution <> 0
  UNION ALL
  SELECT *, CAST(unnest(generate_series(0, n)) AS INTEGER), 'D' FROM al WHERE distribution <> 0),
block AS (
  SELECT pattern, element_number, CASE WHEN part = 'D' AND start_distribution <> 0 THEN lvl + 1 ELSE lvl END AS written_element,
    element_number * off + i * off AS start_point, element_number * off + (i + 1) * off - 1 AS end_point,
    CASE WHEN part = 'S' THEN start_distribution / n WHEN i = 0 OR i = n THEN distribution / (2 * n) ELSE distribution / n END AS proportion,
    CASE WHEN part = 'S' THEN 'FIRST' WHEN i = 0 THEN 'INC_PROP' WHEN i = n THEN 'DEC_PROP' ELSE 'LINEAR' END AS shape
  FROM raw)"""


def blocks(spark, sf_dir):
    aligned = bl.align_elements(elements(spark, sf_dir), levels=True)
    return bl.apply_ultimate(bl.pattern_blocks(aligned), ULTIMATE)


def _r(*names):
    return {n: F.round(n, 6) for n in names}


@query("b1_align_elements", f"""
WITH {_BLOCKS} SELECT pattern, element_number, n AS development_periods, round(off, 6) AS duration_offset,
  round(element_number * off, 6) AS start_offset, round(1.0::DOUBLE / n, 6) AS weight FROM al""")
def b1(spark, sf_dir):
    aligned = bl.align_elements(elements(spark, sf_dir)).withColumns(_r("duration_offset", "start_offset", "weight"))
    return aligned.drop("distribution", "start_distribution", "duration")


@query("b2_distribute_remaining", f"""
WITH {_ELEMENTS}, t AS (SELECT pattern, sum(distribution + start_distribution) AS s, count(*) AS n FROM el GROUP BY 1)
SELECT pattern, element_number, round(distribution + CASE WHEN s < 1 THEN (1 - s) / n ELSE 0 END, 6) AS distribution
FROM el JOIN t USING (pattern)""")
def b2(spark, sf_dir):
    spread = bl.distribute_remaining(elements(spark, sf_dir))
    return spread.select("pattern", "element_number", F.round("distribution", 6).alias("distribution"))


@query("b3_zero_out", f"""
WITH {_ELEMENTS} SELECT pattern, element_number, round(distribution, 6) AS distribution, 0.0::DOUBLE AS start_distribution FROM el""")
def b3(spark, sf_dir):
    cleared = bl.zero_out(elements(spark, sf_dir), distribution=False)
    return cleared.select("pattern", "element_number", F.round("distribution", 6).alias("distribution"), "start_distribution")


@query("b4_duration_check", f"""
WITH {_ELEMENTS} SELECT pattern, round(sum(distribution + start_distribution), 6) AS share_total,
  abs(sum(distribution + start_distribution) - 1) < 1e-9 AS sums_to_one, bool_and(duration = 360) AS durations_equal
FROM el GROUP BY 1""")
def b4(spark, sf_dir):
    checked = bl.check_elements(elements(spark, sf_dir))
    return checked.drop("exactly_one").withColumns(_r("share_total"))


@query("b5_b6_pattern_blocks", f"""
WITH {_BLOCKS} SELECT pattern, element_number, written_element, round(start_point, 6) AS start_point,
  round(end_point, 6) AS end_point, round(proportion, 6) AS proportion, shape FROM block""")
def b5(spark, sf_dir):
    found = bl.pattern_blocks(bl.align_elements(elements(spark, sf_dir)))
    return found.drop("ultimate_value").withColumns(_r("start_point", "end_point", "proportion"))


@query("b7_ultimate_by_shape", f"""
WITH {_BLOCKS} SELECT shape, count(*) AS blocks, round(sum(proportion * {ULTIMATE}), 2) AS value FROM block GROUP BY 1""")
def b7(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("shape").agg(
        F.count(F.lit(1)).alias("blocks"), F.round(F.sum("ultimate_value"), 2).alias("value")
    )


@query("b8_blocks_by_position", f"""
WITH {_BLOCKS} SELECT pattern, count(*) FILTER (start_point < 100) AS before, count(*) FILTER (start_point > 100) AS after,
  count(*) FILTER (start_point >= 50 AND start_point < 200) AS between FROM block GROUP BY 1""")
def b8(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("pattern").agg(
        F.count_if(bl.starts_before(100)).alias("before"),
        F.count_if(bl.starts_after(100)).alias("after"),
        F.count_if(bl.starts_between(50, 200)).alias("between"),
    )


@query("b9_b12_liabilities", f"""
WITH {_BLOCKS}, cut AS (
  SELECT pattern, CASE WHEN max(element_number) < 2
    THEN min(end_point) FILTER (element_number = (SELECT max(element_number) FROM al WHERE al.pattern = block.pattern)) + 1
    ELSE min(start_point) FILTER (element_number = 2) END AS esp
  FROM block GROUP BY pattern),
v AS (SELECT pattern, element_number, end_point, esp, proportion * {ULTIMATE} AS u FROM block JOIN cut USING (pattern))
SELECT pattern, round(coalesce(sum(u) FILTER (element_number < 2), 0.0), 4) AS written,
  round(coalesce(sum(u) FILTER (element_number >= 2), 0.0), 4) AS unwritten,
  round(coalesce(sum(u) FILTER (element_number < 2 AND end_point < esp), 0.0), 4) AS lic,
  round(coalesce(sum(u) FILTER (element_number < 2 AND end_point >= esp), 0.0), 4) AS lrc,
  round(coalesce(sum(u) FILTER (element_number >= 2 AND end_point >= esp), 0.0), 4) AS lrc_unwritten,
  round(coalesce(sum(u) FILTER (end_point >= esp), 0.0), 4) AS upr
FROM v GROUP BY 1""")
def b9(spark, sf_dir):
    found = bl.liabilities(blocks(spark, sf_dir), 2)
    names = ("written", "unwritten", "lic", "lrc", "lrc_unwritten", "upr")
    return found.withColumns({n: F.round(n, 4) for n in names})


@query("b13_cut_points", f"""
WITH {_BLOCKS}
SELECT pattern, round(CASE WHEN max(element_number) < 3
    THEN min(end_point) FILTER (element_number = (SELECT max(element_number) FROM al WHERE al.pattern = block.pattern)) + 1
    ELSE min(start_point) FILTER (element_number = 3) END, 6) AS cut_point
FROM block GROUP BY pattern""")
def b13(spark, sf_dir):
    return bl.cut_points(blocks(spark, sf_dir), F.lit(3)).withColumns(_r("cut_point"))


_REGION_SQL = {
    "t": "element_number < 2", "b": "element_number >= 2", "l": "start_point < 150", "r": "start_point >= 150",
    "tl": "element_number < 2 AND start_point < 150", "tr": "element_number < 2 AND start_point >= 150",
    "bl": "element_number >= 2 AND start_point < 150", "br": "element_number >= 2 AND start_point >= 150",
}


@query("b14_regions", f"WITH {_BLOCKS} SELECT pattern, " + ", ".join(
    f"round(coalesce(sum(proportion) FILTER ({t}), 0.0), 6) AS {n}" for n, t in _REGION_SQL.items()
) + " FROM block GROUP BY 1")
def b14(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("pattern").agg(*[
        F.round(F.coalesce(F.sum(F.when(bl.region_flag(n, F.lit(2), F.lit(150)), F.col("proportion"))), F.lit(0.0)), 6).alias(n)
        for n in bl.REGIONS
    ])


@query("b15_block_documents", f"""
WITH {_BLOCKS} SELECT CAST(pattern AS VARCHAR) AS pattern, count(*) AS blocks, max(written_element) AS top_level,
  round(sum(proportion), 6) AS proportion, round(sum(proportion) * {ULTIMATE}, 3) AS value FROM block GROUP BY 1""")
def b15(spark, sf_dir):
    path = scratch_path(spark, "blocks")
    documents.write_blocks(blocks(spark, sf_dir), path)
    return documents.read_blocks(spark, path).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.max("written_element").alias("top_level"),
        F.round(F.sum("proportion"), 6).alias("proportion"),
        F.round(F.sum("ultimate_value"), 3).alias("value"),
    )


@query("b15_pattern_documents", f"""
WITH {_BLOCKS} SELECT CAST(pattern AS VARCHAR) AS pattern, element_number, round(distribution, 6) AS distribution,
  round(start_distribution, 6) AS start_distribution, duration, n AS development_periods, round(off, 6) AS duration_offset FROM al""")
def b15_patterns(spark, sf_dir):
    path = scratch_path(spark, "patterns")
    documents.write_patterns(bl.align_elements(elements(spark, sf_dir)), path)
    read = documents.read_patterns(spark, path)
    return read.withColumns(_r("distribution", "start_distribution", "duration_offset")).drop("weight", "start_offset")


@query("a15_values_by_point", f"""
WITH {_BLOCKS}, s AS (
  SELECT pattern, CAST(trunc(end_point) AS INTEGER) AS end_point, sum(proportion * {ULTIMATE}) AS v FROM block GROUP BY ALL)
SELECT pattern, end_point, round(v, 4) AS value, round(sum(v) OVER (PARTITION BY pattern ORDER BY end_point), 4) AS cumulative_value FROM s""")
def a15(spark, sf_dir):
    found = bl.values_by_point(blocks(spark, sf_dir))
    return found.withColumns({n: F.round(n, 4) for n in ("value", "cumulative_value")})


@query("a16_block_totals", f"""
WITH {_BLOCKS} SELECT pattern, round(sum(proportion * {ULTIMATE}), 4) AS ultimate_total, round(sum(proportion), 6) AS proportion_total
FROM block GROUP BY 1""")
def a16(spark, sf_dir):
    return bl.block_totals(blocks(spark, sf_dir)).withColumns(
        {"ultimate_total": F.round("ultimate_total", 4), "proportion_total": F.round("proportion_total", 6)}
    )


@query("a17_element_bounds", f"""
WITH {_BLOCKS} SELECT pattern, element_number, round(min(start_point), 6) AS earliest_start, round(max(start_point), 6) AS latest_start,
  round(min(end_point), 6) AS earliest_end, round(max(end_point), 6) AS latest_end FROM block GROUP BY ALL""")
def a17(spark, sf_dir):
    return bl.element_bounds(blocks(spark, sf_dir)).withColumns(
        _r("earliest_start", "latest_start", "earliest_end", "latest_end")
    )


@query("a18_point_bounds", f"""
WITH {_BLOCKS} SELECT pattern, round(min(start_point), 6) AS min_point, round(max(end_point), 6) AS max_point FROM block GROUP BY 1""")
def a18(spark, sf_dir):
    return bl.point_bounds(blocks(spark, sf_dir)).withColumns(_r("min_point", "max_point"))


@query("a18_largest_proportions", f"""
WITH {_BLOCKS} SELECT pattern, written_element, round(max(proportion), 6) AS largest_proportion FROM block GROUP BY ALL""")
def a18_levels(spark, sf_dir):
    return bl.largest_proportions(blocks(spark, sf_dir)).withColumns(_r("largest_proportion"))


@query("a19_scaled_levels", f"""
WITH {_BLOCKS}, p AS (SELECT pattern, (max(end_point) - min(start_point)) * 0.7::DOUBLE AS target FROM block GROUP BY 1),
l AS (SELECT pattern, written_element, max(proportion) AS m FROM block GROUP BY ALL),
s AS (
  SELECT pattern, written_element, CAST(round_even(m * (target / sum(m) OVER (PARTITION BY pattern)), 0) AS BIGINT) AS scaled
  FROM l JOIN p USING (pattern))
SELECT pattern, written_element, scaled, CAST(sum(scaled) OVER (PARTITION BY pattern ORDER BY written_element) AS BIGINT) AS cumulative FROM s""")
def a19(spark, sf_dir):
    levels = bl.level_summary(blocks(spark, sf_dir))
    target = (F.col("max_point") - F.col("min_point")) * 0.7
    return bl.scaled_levels(levels, ["pattern"], "written_element", "largest_proportion", target).select(
        "pattern", "written_element", "scaled", "cumulative"
    )


# --- shapes --------------------------------------------------------------------------------------

_SHAPE = "shape AS (SELECT p_partkey, p_retailprice / 1.0007::DOUBLE AS area, p_size AS length, CAST(p_partkey % 11 - 5 AS INTEGER) AS off FROM part)"


def shape_table(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_retailprice") / 1.0007).alias("area"), F.col("p_size").alias("length"),
        (F.col("p_partkey") % 11 - 5).cast("int").alias("bottom_offset"),
    )


@query("g1_shape_geometry", f"""
WITH {_SHAPE} SELECT p_partkey, round(area / length, 6) AS height, CAST(length + abs(off) AS INTEGER) AS width,
  CAST(off AS DOUBLE) AS bottom_left_x, CAST(length + off AS DOUBLE) AS bottom_right_x, round(-(area / length), 6) AS bottom_y FROM shape""")
def g1_geometry(spark, sf_dir):
    found = shapes.shape_geometry(shape_table(spark, sf_dir)).drop("area", "length", "bottom_offset")
    return found.withColumns(_r("height", "bottom_y"))


_STRIPS = [(2.0, 9.5, "vertical"), (12.0, 1.0, "vertical"), (-30.5, -4.0, "horizontal"), (5.0, -90.0, "horizontal")]


def _strip_sql() -> str:
    parts = []
    for a, b, kind in _STRIPS:
        lo, hi = min(a, b), max(a, b)
        low, high = ("least(0, off)", "greatest(length, length + off)") if kind == "vertical" else ("-(area / length)", "0.0")
        inside = f"greatest(least({hi}::DOUBLE, {high}) - greatest({lo}::DOUBLE, {low}), 0.0)"
        parts.append(
            f"SELECT p_partkey, {a}::DOUBLE AS line_1, {b}::DOUBLE AS line_2, '{kind}' AS orientation, "
            f"round({inside} / ({high} - ({low})) * area, 5) AS strip_area FROM shape"
        )
    return f"WITH {_SHAPE} " + " UNION ALL ".join(parts)


@query("g1_strip_areas", _strip_sql())
def g1(spark, sf_dir):
    found = shapes.strip_areas(shape_table(spark, sf_dir), _STRIPS)
    return found.select("p_partkey", "line_1", "line_2", "orientation", F.round("strip_area", 5).alias("strip_area"))


_CUTS = [(h, v, region) for h, v in ((7.0, 12.0), (30.0, 25.0)) for region in shapes.PART_REGIONS]


def _cut_sql() -> str:
    """Widths summed by trapezoids of unit height: exact, as all corners lie on whole numbers."""
    parts = []
    for h, v, region in _CUTS:
        cut = f"greatest(least({int(h)}, height), 0)"
        low, high = {"a": (cut, "height"), "t": (cut, "height"), "b": ("0", cut)}.get(region[0], ("0", "height"))
        if region in ("above", "below"):
            width = "top_length"
        elif region.endswith("left"):
            width = f"least(greatest({int(v)} - {{y}}, 0), top_length)"
        else:
            width = f"(top_length - least(greatest({int(v)} - {{y}}, 0), top_length))"
        mean = f"({width.format(y='y')} + {width.format(y='(y + 1)')}) / 2"
        parts.append(
            f"SELECT p_partkey, {h}::DOUBLE AS h_cut, {v}::DOUBLE AS v_cut, '{region}' AS region, "
            f"coalesce(sum({mean}) FILTER (y >= {low} AND y < {high}), 0.0)::DOUBLE AS cut_area FROM grid GROUP BY p_partkey"
        )
    grid = "grid AS (SELECT p_partkey, p_size AS top_length, CAST(1 + p_partkey % 50 AS INTEGER) AS height, y FROM part, generate_series(0, 49) g(y))"
    return f"WITH {grid} " + " UNION ALL ".join(parts)


@query("g2_part_cut_areas", _cut_sql())
def g2(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("top_length"), (F.col("p_partkey") % 50 + 1).cast("int").alias("height")
    )
    return shapes.part_cut_areas(parts, _CUTS).drop("top_length", "height")


# every line item cuts the shape of its part
_LINE_CUTS = """cut AS (
  SELECT l_partkey AS p_partkey, l_orderkey, l_linenumber, (l_quantity - 20)::DOUBLE AS line_1, (100 * l_discount + l_tax)::DOUBLE AS line_2,
    CASE WHEN l_linenumber % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation FROM lineitem)"""


def _strip_table_sql() -> str:
    lo, hi = "least(line_1, line_2)", "greatest(line_1, line_2)"
    low = "CASE WHEN orientation = 'vertical' THEN least(0, off) ELSE -(area / length) END"
    high = "CASE WHEN orientation = 'vertical' THEN greatest(length, length + off) ELSE 0.0 END"
    return (
        f"WITH {_SHAPE}, {_LINE_CUTS}, edge AS (SELECT *, ({low})::DOUBLE AS low, ({high})::DOUBLE AS high FROM shape JOIN cut USING (p_partkey)) "
        f"SELECT l_orderkey, l_linenumber, p_partkey, round(greatest(least({hi}, high) - greatest({lo}, low), 0.0) / (high - low) * area, 5) AS strip_area FROM edge"
    )


@query("g1_strip_areas_from_table", _strip_table_sql())
def g1_from_table(spark, sf_dir):
    cuts = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", (F.col("l_quantity") - 20).alias("line_1"),
        (100 * F.col("l_discount") + F.col("l_tax")).alias("line_2"),
        F.when(F.col("l_linenumber") % 2 == 0, "vertical").otherwise("horizontal").alias("orientation"),
    )
    found = shapes.strip_areas_from(shape_table(spark, sf_dir), cuts, ["p_partkey"], ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", "p_partkey", F.round("strip_area", 5).alias("strip_area"))


def _region_number(count: str) -> str:
    return "CASE " + " ".join(f"WHEN {count} = {i} THEN '{r}'" for i, r in enumerate(shapes.PART_REGIONS)) + " END"


_PART_CUT_TABLE = f"""
WITH cut AS (
  SELECT l_partkey AS p_partkey, l_orderkey, l_linenumber, CAST(l_quantity - 5 AS INTEGER) AS h, CAST(l_suppkey % 60 AS INTEGER) AS v,
    {_region_number('l_orderkey % 8')} AS region FROM lineitem),
part_cut AS (
  SELECT l_orderkey, l_linenumber, p_partkey, region, v, p_size AS top, CAST(1 + p_partkey % 50 AS INTEGER) AS height,
    CAST(greatest(least(h, 1 + p_partkey % 50), 0) AS INTEGER) AS depth
  FROM cut JOIN part USING (p_partkey)),
strips AS (
  SELECT *, CASE WHEN region IN ('above', 'top_left', 'top_right') THEN y >= depth WHEN region IN ('below', 'bottom_left', 'bottom_right') THEN y < depth ELSE true END AS inside,
    (least(greatest(v - y, 0), top) + least(greatest(v - y - 1, 0), top)) / 2.0 AS left_part
  FROM part_cut, generate_series(0, 49) g(y) WHERE y < height)
SELECT l_orderkey, l_linenumber, p_partkey, region, round(coalesce(sum(CASE WHEN region IN ('above', 'below') THEN top WHEN region LIKE '%left' THEN left_part ELSE top - left_part END)
  FILTER (inside), 0.0)::DOUBLE, 6) AS cut_area FROM strips GROUP BY l_orderkey, l_linenumber, p_partkey, region"""


@query("g2_part_cuts_from_table", _PART_CUT_TABLE)
def g2_from_table(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("top_length"), (F.col("p_partkey") % 50 + 1).cast("int").alias("height")
    )
    region = F.element_at(F.array(*[F.lit(r) for r in shapes.PART_REGIONS]), (F.col("l_orderkey") % 8 + 1).cast("int"))
    cuts = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).cast("int").alias("h_cut"),
        (F.col("l_suppkey") % 60).alias("v_cut"), region.alias("region"),
    )
    found = shapes.part_cut_areas_from(parts, cuts, ["p_partkey"], ["l_orderkey", "l_linenumber"])
    # a line number may repeat in an order: equal cuts of one part are one row in the statement
    return found.groupBy("l_orderkey", "l_linenumber", "p_partkey", "region").agg(F.round(F.sum("cut_area"), 6).alias("cut_area"))


@query("g2_part_geometry", """
SELECT p_partkey, p_size * (1 + p_partkey % 50)::DOUBLE AS area, (p_size + 1 + p_partkey % 50)::DOUBLE AS width,
  (1 + p_partkey % 50)::DOUBLE AS bottom_left_x, (p_size + 1 + p_partkey % 50)::DOUBLE AS bottom_right_x FROM part""")
def g2_geometry(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("top_length"), (F.col("p_partkey") % 50 + 1).cast("int").alias("height")
    )
    return shapes.part_geometry(parts).drop("top_length", "height")


# --- curves --------------------------------------------------------------------------------------


def _month_curves(spark, sf_dir):
    """Cumulative revenue of each supplier by ship month (months since 1995)."""
    lines = inputs.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_extendedprice",
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("month"),
    )
    sums = lines.groupBy("l_suppkey", "month").agg((F.sum("l_extendedprice") / 700001).alias("value"))
    return running_sum(sums, ["l_suppkey"], "month", {"cumulative": "value"})


def _curve_points(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        (F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 30.0).alias("position"),
    ).distinct()


@query("g3_linear_interpolation", """
WITH s AS (
  SELECT l_suppkey, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS x, sum(l_extendedprice) / 700001 AS v FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, x, sum(v) OVER (PARTITION BY l_suppkey ORDER BY x) AS y FROM s),
seg AS (
  SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY x)),
p AS (SELECT DISTINCT l_suppkey, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 30.0::DOUBLE AS position FROM lineitem)
SELECT p.l_suppkey, p.position, round(y + (position - x) * (y1 - y) / (x1 - x), 6) AS interpolated
FROM p JOIN seg ON seg.l_suppkey = p.l_suppkey AND x1 IS NOT NULL
  AND (position >= x OR k = 1) AND (position < x1 OR k = n - 1)""")
def g3_linear(spark, sf_dir):
    found = curves.interpolate(
        _month_curves(spark, sf_dir), _curve_points(spark, sf_dir), ["l_suppkey"], "month", "cumulative", "position", kind="linear"
    )
    return found.withColumn("interpolated", F.round("interpolated", 6))


# The two sweeps of the spline's system as recursions over the knots of a curve.
_CUBIC = """
WITH RECURSIVE s AS (
  SELECT l_suppkey AS key, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS x, sum(l_extendedprice) / 700001 AS v FROM lineitem GROUP BY ALL),
c AS (SELECT key, x::DOUBLE AS x, sum(v) OVER (PARTITION BY key ORDER BY x) AS y FROM s),
k AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY key) AS n, lead(x) OVER w - x AS h,
    (lead(y) OVER w - y) / (lead(x) OVER w - x) AS g
  FROM c WINDOW w AS (PARTITION BY key ORDER BY x)),
ends AS (
  SELECT key, n, max(CASE WHEN i = 0 THEN h END) / max(CASE WHEN i = 1 THEN h END) AS p,
    max(CASE WHEN i = n - 2 THEN h END) / max(CASE WHEN i = n - 3 THEN h END) AS q
  FROM k GROUP BY key, n HAVING n >= 4),
line AS (
  SELECT key, b.i AS j, n, ends.p, ends.q, a.h - CASE WHEN b.i = n - 2 THEN b.h * ends.q ELSE 0.0 END AS low,
    b.h - CASE WHEN b.i = 1 THEN a.h * ends.p ELSE 0.0 END AS high,
    2.0 * (a.h + b.h) + CASE WHEN b.i = 1 THEN a.h * (1.0 + ends.p) ELSE 0.0 END + CASE WHEN b.i = n - 2 THEN b.h * (1.0 + ends.q) ELSE 0.0 END AS mid,
    6.0 * (b.g - a.g) AS side
  FROM ends JOIN k b USING (key, n) JOIN k a USING (key, n) WHERE b.i BETWEEN 1 AND n - 2 AND a.i = b.i - 1),
down AS (
  SELECT key, j, n, high / mid AS c, side / mid AS d FROM line WHERE j = 1
  UNION ALL
  SELECT line.key, line.j, line.n, high / (mid - low * c), (side - low * d) / (mid - low * c)
  FROM down JOIN line ON line.key = down.key AND line.j = down.j + 1),
up AS (
  SELECT key, j, d AS m FROM down WHERE j = n - 2
  UNION ALL
  SELECT down.key, down.j, down.d - down.c * up.m FROM up JOIN down ON down.key = up.key AND down.j = up.j - 1),
curv AS (
  SELECT key, j, m FROM up
  UNION ALL
  SELECT key, 0, max(CASE WHEN j = 1 THEN m END) * (1.0 + any_value(p)) - max(CASE WHEN j = 2 THEN m END) * any_value(p) FROM up JOIN ends USING (key) GROUP BY key
  UNION ALL
  SELECT key, any_value(n) - 1, max(CASE WHEN j = n - 2 THEN m END) * (1.0 + any_value(q)) - max(CASE WHEN j = n - 3 THEN m END) * any_value(q)
  FROM up JOIN ends USING (key) GROUP BY key),
seg AS (
  SELECT k.key, k.i, k.n, k.x, k.x + k.h AS x1, k.y, k.g - k.h * (2.0 * a.m + b.m) / 6.0 AS b1, a.m / 2.0 AS c1, (b.m - a.m) / (6.0 * k.h) AS d1
  FROM k JOIN curv a ON a.key = k.key AND a.j = k.i JOIN curv b ON b.key = k.key AND b.j = k.i + 1),
p AS (SELECT DISTINCT l_suppkey, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 30.0::DOUBLE AS position FROM lineitem)
SELECT l_suppkey, position, round(y + (position - x) * (b1 + (position - x) * (c1 + (position - x) * d1)), 4) AS interpolated
FROM p LEFT JOIN seg ON key = l_suppkey AND (position >= x OR i = 0) AND (position < x1 OR i = n - 2)"""


@query("g3_cubic_interpolation", _CUBIC)
def g3_cubic(spark, sf_dir):
    found = curves.interpolate(
        _month_curves(spark, sf_dir), _curve_points(spark, sf_dir), ["l_suppkey"], "month", "cumulative", "position"
    )
    return found.withColumn("interpolated", F.round("interpolated", 4))


# --- rules ---------------------------------------------------------------------------------------

RULES = {
    "columns": ["c_mktsegment", "n_name", "r_name", "balance", "volume"],
    "target_column": "desk",
    "default": "general",
    "rule_separator": "|",
    "rules": [
        {"pattern": "FURNITURE|*|*|owing|*", "value": "collections east"},
        {"pattern": "*|*|AFRICA|*|bulk", "value": "freight"},
        {"pattern": "*|*|*|owing|*", "value": "collections"},
        {"pattern": "*|NATION_11|*|*|*", "value": "partner"},
        {"pattern": "*|NATION_11|*|paid|bulk", "value": "partner freight"},
        {"pattern": "HOUSEHOLD|*|*|*|*", "value": "retail"},
        {"pattern": "*|*|AMERICA|paid|*", "value": "west"},
    ],
}

_CUSTOMERS = """
c AS (
  SELECT c_custkey, c_mktsegment, n_name, r_name, CASE WHEN c_acctbal < 500 THEN 'owing' ELSE 'paid' END AS balance,
    CASE WHEN c_custkey % 3 = 0 THEN 'bulk' ELSE 'parcel' END AS volume, CAST(floor(c_acctbal / 10) AS BIGINT) AS grade
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _customers(spark, sf_dir):
    return (
        inputs.table(spark, sf_dir, "customer")
        .join(inputs.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(inputs.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey", "c_mktsegment", "n_name", "r_name",
            F.when(F.col("c_acctbal") < 500, "owing").otherwise("paid").alias("balance"),
            F.when(F.col("c_custkey") % 3 == 0, "bulk").otherwise("parcel").alias("volume"),
            F.floor(F.col("c_acctbal") / 10).alias("grade"),
        )
    )


@query("f13_wildcard_rules", f"""
WITH {_CUSTOMERS}
SELECT c_custkey, CASE
  WHEN n_name = 'NATION_11' AND balance = 'paid' AND volume = 'bulk' THEN 'partner freight'
  WHEN c_mktsegment = 'FURNITURE' AND balance = 'owing' THEN 'collections east'
  WHEN r_name = 'AFRICA' AND volume = 'bulk' THEN 'freight'
  WHEN r_name = 'AMERICA' AND balance = 'paid' THEN 'west'
  WHEN balance = 'owing' THEN 'collections'
  WHEN n_name = 'NATION_11' THEN 'partner'
  WHEN c_mktsegment = 'HOUSEHOLD' THEN 'retail'
  ELSE 'general' END AS desk
FROM c""")
def f13(spark, sf_dir):
    return rules.classify(_customers(spark, sf_dir), RULES).select("c_custkey", "desk")


# A rule per customer, in six of the ways wildcards can be placed; later and less fixed ones lose.
_RULE_FORMS = [
    (("*", "n_name", "*", "*", "grade"), "grade of nation"),
    (("c_mktsegment", "*", "*", "*", "grade"), "grade of segment"),
    (("c_mktsegment", "n_name", "*", "balance", "*"), "standing"),
    (("*", "*", "*", "balance", "grade"), "grade of balance"),
    (("*", "*", "r_name", "*", "*"), "region"),
    (("*", "*", "*", "*", "*"), "any"),
]
_RULE_COLUMNS = ("c_mktsegment", "n_name", "r_name", "balance", "grade")


def _rule_sql() -> str:
    """Per form the look-up of the first rule, then the most specific of them."""
    parts, joins, picks = [], [], []
    for k, (form, label) in enumerate(_RULE_FORMS):
        places = [(c, f) for c, f in zip(_RULE_COLUMNS, form) if f != "*"]
        fixed = [f"CAST({f} AS VARCHAR) AS k{i}" for i, (_, f) in enumerate(places)]
        parts.append(
            f"m{k} AS (SELECT {', '.join([*fixed, 'min(c_custkey) AS pos'])} FROM c WHERE c_custkey % 6 = {k} "
            f"{'GROUP BY ALL' if fixed else ''})"
        )
        on = " AND ".join(f"m{k}.k{i} = CAST(c.{c} AS VARCHAR)" for i, (c, _) in enumerate(places)) or "true"
        joins.append(f"LEFT JOIN m{k} ON {on}")
        picks.append(f"CASE WHEN m{k}.pos IS NOT NULL THEN {{'f': {-len(places)}, 'p': m{k}.pos, 'v': '{label} ' || m{k}.pos}} END")
    return (
        f"WITH {_CUSTOMERS}, {', '.join(parts)} SELECT c_custkey, list_min(list_filter([{', '.join(picks)}], lambda x: x IS NOT NULL)).v AS ruling "
        f"FROM c {' '.join(joins)}"
    )


@query("f13_rules_from_table", _rule_sql())
def f13_table(spark, sf_dir):
    """Every customer gives a rule, so the rules grow with the table; the plan does not."""
    customers = _customers(spark, sf_dir)
    form, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (places, text) in enumerate(_RULE_FORMS):
        own = F.concat_ws("/", *[F.lit("*") if p == "*" else F.col(p).cast("string") for p in places])
        form = F.when(F.col("c_custkey") % 6 == k, own).otherwise(form)
        label = F.when(F.col("c_custkey") % 6 == k, F.concat(F.lit(f"{text} "), F.col("c_custkey"))).otherwise(label)
    listed = customers.select(F.col("c_custkey").alias("position"), form.alias("pattern"), label.alias("value"))
    found = rules.classify_from(customers, listed, _RULE_COLUMNS, "ruling")
    return found.select("c_custkey", "ruling")
