"""As-of and interval look-ups against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from earnloom.operators.asof import asof_join, assign_bucket_from, interval_join
from earnloom.operators.sorted_arrays import count_below

ROWS, BOUNDS = "id int, key string, at {0}, extra string", "key string, at {0}, value int, note string"


def stamp(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=250_000 * n)


def make(spark, seed, n_rows, n_bounds, kind="int", hot=0.6, spread=40):
    draw = random.Random(seed)
    names = {"int": int, "timestamp": stamp, "string": "p{:04d}".format, "double": float}

    def position():
        return None if draw.random() < 0.04 else names[kind](draw.randrange(spread))

    def key():
        return "hot" if draw.random() < hot else draw.choice(["a", "b", "c", None])

    rows = [(i, key(), position(), draw.choice("xyz")) for i in range(n_rows)]
    bounds = [(key(), position(), draw.randrange(9), draw.choice("pqr")) for _ in range(n_bounds)]
    return rows, bounds, spark.createDataFrame(rows, ROWS.format(kind)), spark.createDataFrame(bounds, BOUNDS.format(kind))


def nearest(row, bounds, backward, strict):
    _, key, at, _ = row
    if key is None or at is None:
        return (None, None, None)
    fits = [b for b in bounds if b[0] == key and b[1] is not None and (b[1] <= at if backward else b[1] >= at) and not (strict and b[1] == at)]
    if not fits:
        return (None, None, None)
    edge = (max if backward else min)(b[1] for b in fits)
    value, note = max((b[2], b[3]) for b in fits if b[1] == edge)
    return (edge, value, note)


@pytest.mark.parametrize(
    "kind,backward,strict",
    [("timestamp", True, False), ("timestamp", True, True), ("timestamp", False, False), ("timestamp", False, True), ("int", True, False), ("string", False, False), ("double", True, True)],
)
def test_nearest_bound_over_many_blocks(spark, kind, backward, strict):
    rows, bounds, left, right = make(spark, 5, 400, 120, kind)
    joined = asof_join(
        left, right, ["key"], "at", "at", {"value": "value", "note": "note", "bound": "at"}, backward, strict, block_rows=25
    )
    assert joined.columns == ["id", "key", "at", "extra", "value", "note", "bound"]
    made = {r["id"]: (r["bound"], r["value"], r["note"]) for r in joined.collect()}
    assert made == {r[0]: nearest(r, bounds, backward, strict) for r in rows}


def test_one_position_holds_most_rows(spark):
    rows, bounds, left, right = make(spark, 8, 600, 30, spread=3, hot=0.9)
    made = {r["id"]: r["value"] for r in asof_join(left, right, ["key"], "at", "at", {"value": "value"}, block_rows=40).collect()}
    assert made == {r[0]: nearest(r, bounds, True, False)[1] for r in rows}


def test_blocks_change_nothing(spark):
    _, _, left, right = make(spark, 3, 300, 300)
    names = {"value": "value", "note": "note"}
    few, many = (asof_join(left, right, ["key"], "at", "at", names, block_rows=n).collect() for n in (10_000, 7))
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_without_keys_and_with_several(spark):
    rows, bounds, left, right = make(spark, 4, 150, 40)
    named = [("k", *b[1:]) for b in bounds]
    made = {r["id"]: r["value"] for r in asof_join(left, right, [], "at", "at", {"value": "value"}, block_rows=20).collect()}
    assert made == {r[0]: nearest(("", "k", *r[2:]), named, True, False)[1] for r in rows}
    two = asof_join(left, right.withColumnRenamed("note", "extra"), ["key", "extra"], "at", "at", {"value": "value"}, block_rows=20)
    assert two.filter("value IS NOT NULL").count() == 0


def test_empty_sides_and_clashing_names(spark):
    _, _, left, right = make(spark, 2, 20, 5)
    none = asof_join(left, right.limit(0), ["key"], "at", "at", {"value": "value"})
    assert none.count() == 20 and none.filter("value IS NOT NULL").count() == 0
    assert asof_join(left.limit(0), right, ["key"], "at", "at", {"value": "value"}).count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, ["key"], "at", "at", {"extra": "value"})
    with pytest.raises(ValueError):
        asof_join(left.withColumn("at", F.col("at").cast("string")), right, ["key"], "at", "at", {"value": "value"})
    odd = left.withColumn("_row", F.lit(1)).withColumn("_at", F.lit("x")).withColumn("_block", F.create_map(F.lit(1), F.lit(2)))
    assert asof_join(odd, right, ["key"], "at", "at", {"_load": "value"}).columns == [*odd.columns, "_load"]


def test_intervals(spark):
    rows, _, left, _ = make(spark, 6, 300, 0)
    spans = [("hot", None, 4, "low"), ("hot", 6, 12, "mid"), ("hot", 20, None, "top"), ("a", 0, 39, "all"), ("b", 9, 3, "void"), (None, 0, 39, "lost")]
    table = spark.createDataFrame(spans, "key string, lo int, hi int, name string")
    made = {r["id"]: r["found"] for r in interval_join(left, table, ["key"], "at", "lo", "hi", {"found": "name"}, block_rows=30).collect()}

    def held(row):
        hits = [n for k, lo, hi, n in spans if row[1] is not None and k == row[1] and row[2] is not None and (lo is None or lo <= row[2]) and (hi is None or row[2] <= hi)]
        return hits[-1] if hits else None

    assert made == {r[0]: held(r) for r in rows}


def test_overlapping_intervals_use_the_last_start(spark):
    table = spark.createDataFrame([(0, 100, "long"), (10, 20, "short")], "lo int, hi int, name string")
    rows = spark.createDataFrame([(5,), (15,), (50,)], "at int")
    assert [r["name"] for r in interval_join(rows, table, [], "at", "lo", "hi", {"name": "name"}).orderBy("at").collect()] == ["long", "short", None]


def test_bucket_from_table(spark):
    ends = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 6, 30),)], "end date")
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),), (dt.date(2024, 7, 1),), (None,)], "day date")
    late = assign_bucket_from(days, "day", ends, "end").orderBy("day").collect()
    assert [r["bucket"] and r["bucket"].month for r in late] == [None, 3, 3, 6, None]
    early = assign_bucket_from(days, "day", ends, "end", to_end=False).orderBy("day").collect()
    assert [r["bucket"] and r["bucket"].month for r in early] == [None, None, 3, 3, 6]


def test_count_below(spark):
    row = spark.createDataFrame([([1, 3, 3, 7], 3), ([], 3), (None, 3), ([5], None)], "a array<int>, v int")
    made = row.select(count_below(F.col("a"), F.col("v"), bits=3).alias("below"), count_below(F.col("a"), F.col("v"), True).alias("upto")).collect()
    assert [tuple(r) for r in made] == [(1, 3), (0, 0), (0, 0), (0, 0)]
