import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earnloom.operators import blocks as bl, curves, rules, shapes


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [("p", 0, 0.4, 0.2, 360), ("p", 1, 0.2, 0.0, 360), ("p", 2, 0.0, 0.2, 360), ("p", 3, 0.0, 0.0, 360)]
    df = spark.createDataFrame(rows, "pattern string, element_number int, distribution double, start_distribution double, duration int")
    return bl.pattern_blocks(bl.align_elements(df))


def test_blocks_of_elements(blocks):
    rows = [tuple(r) for r in blocks.select("element_number", "written_element", "start_point", "end_point", "proportion", "shape").collect()]
    first = [r for r in rows if r[0] == 0]
    assert sum(r[5] == "FIRST" for r in first) == 4 and all(r[4] == pytest.approx(0.05) for r in first if r[5] == "FIRST")
    spread = sorted(r for r in first if r[5] != "FIRST")
    assert [r[5] for r in sorted(spread, key=lambda r: r[2])] == ["INC_PROP", "LINEAR", "LINEAR", "LINEAR", "DEC_PROP"]
    assert {r[1] for r in first} == {0, 1}
    assert {r[1] for r in rows if r[0] == 1} == {2} and {r[1] for r in rows if r[0] == 2} == {3}
    assert min(r[2] for r in rows if r[0] == 1) == 90 and min(r[3] for r in rows if r[0] == 1) == 179
    assert not [r for r in rows if r[0] == 3]
    assert math.fsum(r[4] for r in rows) == pytest.approx(1.0)


def test_liabilities_against_loops(blocks):
    valued = bl.apply_ultimate(blocks, 1000.0)
    rows = valued.collect()
    for latest in (0, 1, 2, 3, 9):
        last = max(r["element_number"] for r in rows)
        if latest > last:
            cut = min(r["end_point"] for r in rows if r["element_number"] == last) + 1
        else:
            cut = min((r["start_point"] for r in rows if r["element_number"] == latest), default=None)
        found = bl.liabilities(valued, latest).first()

        def total(test):
            return math.fsum(r["ultimate_value"] for r in rows if test(r))

        assert found["written"] == pytest.approx(total(lambda r: r["element_number"] < latest))
        assert found["unwritten"] == pytest.approx(total(lambda r: r["element_number"] >= latest))
        assert found["upr"] == pytest.approx(total(lambda r: r["end_point"] >= cut))
        assert found["lic"] == pytest.approx(total(lambda r: r["element_number"] < latest and r["end_point"] < cut))
        assert found["lrc"] == pytest.approx(total(lambda r: r["element_number"] < latest and r["end_point"] >= cut))
        assert found["lrc_unwritten"] == pytest.approx(total(lambda r: r["element_number"] >= latest and r["end_point"] >= cut))


def test_element_without_blocks_has_no_cut(spark):
    rows = [("p", 0, 0.0, 89.0, 1.0), ("p", 2, 180.0, 269.0, 1.0)]
    df = spark.createDataFrame(rows, "pattern string, element_number int, start_point double, end_point double, ultimate_value double")
    found = bl.liabilities(df, 1).first()
    assert (found["written"], found["unwritten"], found["lic"], found["upr"]) == (1.0, 1.0, 0.0, 0.0)


def test_points_and_scaling(spark, blocks):
    valued = bl.apply_ultimate(blocks, 100.0)
    curve = bl.values_by_point(valued).orderBy("end_point").collect()
    assert curve[-1]["cumulative_value"] == pytest.approx(100.0)
    assert [r["end_point"] for r in curve] == [89, 179, 269, 359, 449, 539, 629][: len(curve)]
    levels = spark.createDataFrame([("p", i, v) for i, v in enumerate((1.0, 1.0, 2.0, 1.0))], "pattern string, level int, v double")
    done = bl.scaled_levels(levels, ["pattern"], "level", "v", F.lit(12.5)).orderBy("level").collect()
    # 2.5 rounds to the even 2
    assert [(r["scaled"], r["cumulative"]) for r in done] == [(2, 2), (2, 4), (5, 9), (2, 11)]
    with pytest.raises(Exception, match="cannot scale"):
        bl.scaled_levels(levels.withColumn("v", F.lit(0.0)), ["pattern"], "level", "v", F.lit(1.0)).collect()


def test_distribution_helpers(spark):
    rows = [("p", 0, 0.2, 0.2, 360), ("p", 1, 0.2, 0.0, 180), ("q", 0, 1.5, 0.0, 360)]
    df = spark.createDataFrame(rows, "pattern string, element_number int, distribution double, start_distribution double, duration int")
    spread = {(r["pattern"], r["element_number"]): r["distribution"] for r in bl.distribute_remaining(df).collect()}
    assert spread == pytest.approx({("p", 0): 0.4, ("p", 1): 0.4, ("q", 0): 1.5})
    checks = {r["pattern"]: r for r in bl.check_elements(df).collect()}
    assert not checks["p"]["durations_equal"] and checks["q"]["durations_equal"]
    assert bl.zero_out(df).agg(F.sum(F.col("distribution") + F.col("start_distribution"))).first()[0] == 0
    with pytest.raises(ValueError):
        bl.region_flag("x", 1, 1)


def test_shape_strips(spark):
    df = spark.createDataFrame([(1, 20.0, 5, 2), (2, 12.0, 4, 0), (3, 15.0, 3, -1)], "k int, area double, length int, bottom_offset int")
    geometry = {r["k"]: r for r in shapes.shape_geometry(df).collect()}
    assert (geometry[1]["height"], geometry[1]["width"]) == (4.0, 7) and geometry[2]["width"] == 4
    assert (geometry[1]["bottom_left_x"], geometry[1]["bottom_right_x"], geometry[1]["bottom_y"]) == (2.0, 7.0, -4.0)
    lines = [(0, 7, "vertical"), (0, 3.5, "vertical"), (-5, -1, "vertical"), (-4, 0, "horizontal"), (-2, 0, "horizontal"), (1, 5, "horizontal"), (3, 1, "vertical")]
    found = [r["strip_area"] for r in shapes.strip_areas(df.filter("k = 1"), lines).collect()]
    assert found == pytest.approx([20, 10, 0, 20, 10, 0, 20 * 2 / 7])
    with pytest.raises(ValueError):
        shapes.strip_areas(df, [(0, 1, "diagonal")])
    with pytest.raises(Exception, match="positive"):
        shapes.shape_geometry(df.withColumn("area", F.lit(-1.0))).collect()


def test_part_cuts_close_to_fine_sums(spark):
    rnd = random.Random(2)
    parts = [(i, rnd.uniform(1, 400), rnd.uniform(1, 100)) for i in range(12)]
    df = spark.createDataFrame(parts, "k int, top_length double, height double")
    cuts = [(rnd.uniform(-5, 110), rnd.uniform(-10, 500), region) for region in shapes.PART_REGIONS for _ in range(4)]
    steps = 20_000
    for r in shapes.part_cut_areas(df, cuts).collect():
        top, height, h, v = r["top_length"], r["height"], r["h_cut"], r["v_cut"]
        y = (np.arange(steps) + 0.5) * height / steps
        rows = np.ones(steps, bool)
        if r["region"] in ("above", "top_left", "top_right"):
            rows = y > h
        elif r["region"] in ("below", "bottom_left", "bottom_right"):
            rows = y < h
        left = np.clip(v - y, 0, top)
        width = {"left": left, "right": top - left}.get(r["region"].split("_")[-1], np.full(steps, top))
        assert r["cut_area"] == pytest.approx(float((width * rows).sum() * height / steps), abs=top * height * 2e-4)


def test_cuts_from_a_table_equal_the_list(spark):
    shape = spark.createDataFrame([(1, 20.0, 5, 2), (2, 12.0, 4, 0), (3, 9.0, 3, 1)], "k int, area double, length int, bottom_offset int")
    lines = [(1.0, 3.5, "vertical"), (-3.0, -0.5, "horizontal")]
    cuts = [(k, a, b, o, f"c{i}") for k in (1, 2) for i, (a, b, o) in enumerate(lines)] + [(9, 1.0, 2.0, "vertical", "lost"), (1, None, 2.0, "vertical", "null")]
    table = spark.createDataFrame(cuts, "k int, line_1 double, line_2 double, orientation string, name string")
    found = shapes.strip_areas_from(shape, table, ["k"], ["name"])
    listed = {(r["k"], r["line_1"], r["orientation"]): r["strip_area"] for r in shapes.strip_areas(shape, lines).collect() if r["k"] < 3}
    made = found.collect()
    assert {(r["k"], r["line_1"], r["orientation"]): r["strip_area"] for r in made if r["name"] != "null"} == listed
    assert [r["strip_area"] for r in made if r["name"] == "null"] == [None]
    with pytest.raises(Exception, match="unknown orientation"):
        shapes.strip_areas_from(shape, table.withColumn("orientation", F.lit("slanted")), ["k"]).collect()
    parts = spark.createDataFrame([(1, 7.0, 4.0), (2, 3.0, 9.0)], "k int, top_length double, height double")
    places = [(h, v, region) for h in (1.5, 6.0) for v in (2.0, 8.0) for region in shapes.PART_REGIONS]
    table = spark.createDataFrame([(k, *p) for k in (1, 2, 3) for p in places], "k int, h_cut double, v_cut double, region string")
    keyed = lambda rows: {(r["k"], r["h_cut"], r["v_cut"], r["region"]): r["cut_area"] for r in rows}
    assert keyed(shapes.part_cut_areas_from(parts, table, ["k"]).collect()) == keyed(shapes.part_cut_areas(parts, places).collect())


def dense_cubic(x, y, at):
    """All spline conditions in one dense system: values, slopes, curvatures, and no jump of the third derivative."""
    n = len(x) - 1
    system, right = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        h = x[i + 1] - x[i]
        system[row, 4 * i] = 1; right[row] = y[i]; row += 1
        system[row, 4 * i: 4 * i + 4] = [1, h, h**2, h**3]; right[row] = y[i + 1]; row += 1
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        system[row, 4 * i: 4 * i + 4] = [0, 1, 2 * h, 3 * h**2]; system[row, 4 * i + 5] = -1; row += 1
        system[row, 4 * i: 4 * i + 4] = [0, 0, 2, 6 * h]; system[row, 4 * i + 6] = -2; row += 1
    for i in (0, n - 2):
        system[row, 4 * i + 3], system[row, 4 * i + 7] = 1, -1; row += 1
    c = np.linalg.solve(system, right).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    t = at - x[k]
    return c[k, 0] + t * (c[k, 1] + t * (c[k, 2] + t * c[k, 3]))


def test_cubic_interpolation_against_dense_solution(spark):
    rnd = random.Random(4)
    knots, points, expected = [], [], {}
    for key, size in enumerate((4, 5, 6, 12, 30)):
        x = np.array(sorted(rnd.sample(range(0, 200), size)), float)
        y = np.cumsum([rnd.uniform(0, 3) for _ in range(size)])
        at = np.array([x[0] - 3.5, x[0], x[1], (x[-2] + x[-1]) / 2, x[-1], x[-1] + 4.0])
        knots += [(key, float(a), float(b)) for a, b in zip(x, y)]
        points += [(key, float(a)) for a in at]
        expected.update({(key, float(a)): float(v) for a, v in zip(at, dense_cubic(x, y, at))})
    curve = spark.createDataFrame(knots, "k int, x double, y double")
    asked = spark.createDataFrame(points, "k int, at double")
    found = curves.interpolate(curve, asked, ["k"], "x", "y", "at", spread=["at"]).collect()
    assert {(r["k"], r["at"]): r["interpolated"] for r in found} == pytest.approx(expected, rel=1e-8, abs=1e-8)


def test_interpolation_edges(spark):
    curve = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0), (1, 4.0, 4.0)], "k int, x double, y double")
    asked = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 3.0), (1, 6.0), (2, 1.0)], "k int, at double")
    linear = curves.interpolate(curve, asked, ["k"], "x", "y", "at", kind="linear").orderBy("k", "at").collect()
    assert [r["interpolated"] for r in linear] == [-2.0, 2.0, 4.0, 4.0, None]
    cubic = curves.interpolate(curve, asked, ["k"], "x", "y", "at").collect()
    assert {r["interpolated"] for r in cubic} == {None}


def test_repeated_and_missing_knots(spark):
    rows = [(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 1.0, 1.0), (1, 2.0, 8.0), (1, 3.0, 27.0), (1, None, 5.0), (1, 4.0, None), (None, 0.0, 1.0)]
    curve = spark.createDataFrame(rows, "k int, x double, y double")
    asked = spark.createDataFrame([(1, 1.5), (1, 5.0), (1, None), (None, 1.0)], "k int, at double")
    found = curves.interpolate(curve, asked, ["k"], "x", "y", "at").collect()
    assert [(r["k"], r["at"], r["interpolated"] and round(r["interpolated"], 9)) for r in sorted(found, key=str)] == sorted(
        [(1, 1.5, 3.375), (1, 5.0, 125.0), (1, None, None), (None, 1.0, None)], key=lambda r: str(spark.createDataFrame([r], "k int, at double, interpolated double").first())
    )
    with pytest.raises(Exception, match="two values at one point"):
        curves.interpolate(curve.union(spark.createDataFrame([(1, 2.0, 9.0)], curve.schema)), asked, ["k"], "x", "y", "at").collect()
    with pytest.raises(Exception, match="needs 4 points"):
        curves.interpolate(curve.filter("x < 2"), asked, ["k"], "x", "y", "at", few="error").collect()
    with pytest.raises(ValueError):
        curves.interpolate(curve, asked, ["k"], "x", "y", "at", kind="square")


def test_long_curve(spark):
    n = 700
    curve = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id") * F.col("id") / 1000.0).alias("y"))
    asked = spark.range(-5, 2 * n).select(F.lit(1).alias("k"), (F.col("id") / 2.0).alias("at"))
    for row in curves.interpolate(curve, asked, ["k"], "x", "y", "at").collect():
        assert row["interpolated"] == pytest.approx(row["at"] ** 3 / 1000.0, rel=1e-9, abs=1e-6)


def test_rules_by_table(spark):
    rnd = random.Random(6)
    columns, letters = ["a", "b", "c"], ["x", "y", "z.", "*"]
    rules_list = [("|".join(rnd.choice(letters) for _ in columns), f"v{i}", i) for i in range(300)]
    rows = [tuple(rnd.choice(["x", "y", "z.", "q", None]) for _ in columns) for _ in range(150)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string, c string")

    def wanted(row, listed):
        fits = []
        for pattern, value, position in listed:
            parts = pattern.split("|")
            if all(p == "*" or p == v for p, v in zip(parts, row)):
                fits.append((-sum(p != "*" for p in parts), position, value))
        return min(fits)[2] if fits else "none"

    for listed in (rules_list, [r for r in rules_list if r[0] != "*|*|*"][:40], []):
        table = spark.createDataFrame(listed, "pattern string, value string, position int")
        found = rules.classify_from(df, table, columns, "class", "none", "|")
        assert found.columns == ["id", "a", "b", "c", "class"]
        assert {r["id"]: r["class"] for r in found.collect()} == {i: wanted(r, listed) for i, r in enumerate(rows)}
        document = {"columns": columns, "target_column": "class", "default": "none", "rule_separator": "|",
                    "rules": [{"pattern": p, "value": v} for p, v, _ in listed]}
        assert sorted(map(str, rules.classify(df, document).collect())) == sorted(map(str, found.collect()))
    with pytest.raises(Exception, match="a rule needs 3 parts"):
        rules.classify_from(df, spark.createDataFrame([("x|y", "v", 0)], "pattern string, value string, position int"), columns, "class", separator="|").collect()


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"))

    def plan(n):
        table = spark.range(n).select(
            F.concat_ws("/", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("*"), (F.col("id") % 5).cast("string")).alias("pattern"),
            F.concat(F.lit("v"), F.col("id")).alias("value"), F.col("id").alias("position"),
        )
        found = rules.classify_from(df, table, ["a", "b"], "class")
        return found, len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())

    few, many = plan(50), plan(50_000)
    assert few[1] == many[1]
    assert many[0].filter("class IS NOT NULL").count() == sum(1 for i in range(2000) if i % 7 < 5)


def test_wildcard_rules(spark):
    rule_set = {"columns": ["City", "Country"], "target_column": "Class", "default": "Unknown", "rule_separator": "/", "rules": [
        {"pattern": "*/USA", "value": "High"}, {"pattern": "Birdtown/USA", "value": "Medium"}, {"pattern": "Birdtown/*", "value": "Low"}]}
    df = spark.createDataFrame([("X", "USA"), ("Birdtown", "USA"), ("Birdtown", "CH"), ("Y", "CH"), (None, "USA")], "City string, Country string")
    found = {(r["City"], r["Country"]): r["Class"] for r in rules.classify(df, rule_set).collect()}
    assert found == {("X", "USA"): "High", ("Birdtown", "USA"): "Medium", ("Birdtown", "CH"): "Low", ("Y", "CH"): "Unknown", (None, "USA"): "High"}
    tie = {**rule_set, "rules": [{"pattern": "*/USA", "value": "first"}, {"pattern": "X/*", "value": "second"}]}
    assert rules.classify(df.filter("City = 'X'"), tie).first()["Class"] == "first"
    with pytest.raises(ValueError):
        rules.classify(df, {**rule_set, "rules": [{"pattern": "a/b/c", "value": "x"}]})
