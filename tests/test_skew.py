"""The balanced joins and sums give the same rows as the plain ones, hot keys included."""

import pytest
from pyspark.sql import Window, functions as F

from earnloom.operators.joins import hot_keys, lookup_join, pairing_join, running_sum, spread_rows, with_key_totals
from workload import block_queries, pattern_queries


def skewed(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(n).select("id", key.cast("int").alias("k"), (F.col("id") % 11).cast("double").alias("v"))


def test_lookup_join_salts_only_hot_keys(spark):
    left = skewed(spark)
    right = spark.range(60).filter("id <> 7").select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    assert [tuple(r) for r in hot_keys(left, ["k"], 500).collect()] == [(0, 3)]
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(right, ["k"], how).select("id", "k", "v", "w").collect()))
        salted = lookup_join(left, right, ["k"], how, spread=["id"], hot_rows=500).select("id", "k", "v", "w")
        assert sorted(map(str, salted.collect())) == plain


def test_a_key_with_nine_tenths_of_the_rows_goes_over_many_tasks(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 40).otherwise(-1).cast("int").alias("k"))
    right = spark.range(-1, 40).select(F.col("id").cast("int").alias("k"), (F.col("id") + 1).alias("w"))
    joined = lookup_join(left, right.hint("shuffle_hash"), ["k"], spread=["id"], hot_rows=1_000)
    assert joined.columns == ["k", "id", "w"] and joined.count() == 20_000
    assert joined.filter("w <> k + 1").count() == 0
    parts = hot_keys(left, ["k"], 1_000).collect()
    assert [tuple(r) for r in parts] == [(-1, 18)]


def test_pairing_join_equals_the_plain_left_join(spark):
    # key 0 is on most rows of both sides, key 1 often on the left without a match, some keys are null or met once
    key = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 != 0, F.col("id") % 20).cast("int")
    left = spark.range(600).select("id", key.alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m")).unionByName(
        spark.range(3).select(F.lit(-1).cast("long").alias("id"), F.lit(0).alias("k"), F.create_map(F.lit("a"), F.lit(0).cast("long")).alias("m"))
    )
    right = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 11 != 0, F.col("id") % 10 + 2).cast("int").alias("k"),
        F.when(F.col("id") % 6 != 0, F.col("id") % 140).alias("w"),
    )
    plain = sorted(map(str, left.join(right, ["k"], "left").select("id", "k", "m", "w").collect()))
    for rows in (1, 3, 16, 1024):
        paired = pairing_join(left, right, ["k"], rows)
        assert paired.columns == ["id", "k", "m", "w"]
        assert sorted(map(str, paired.collect())) == plain


def test_a_map_that_repeats_a_value_deals_its_pairs_out(spark, tmp_path):
    from earnloom.operators.steps import map_values
    from earnloom.plans.mapping import MappingRun

    path = str(tmp_path / "map.parquet")
    spark.range(9_000).select((F.col("id") % 3).alias("from"), F.concat(F.lit("n"), F.col("id")).alias("to")).write.parquet(path)
    rows = spark.range(3_000).select("id", (F.col("id") % 4).alias("k")).coalesce(1)
    mapped = map_values(rows, {"columns": ["k"], "mapping_file": path}, MappingRun(spark, {}, environment={}))
    tasks = [r["count"] for r in mapped.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3 * 750 * 3_000 + 750
    assert len(tasks) >= 4 and max(tasks) < sum(tasks) / 2
    assert mapped.distinct().count() == sum(tasks)
    assert mapped.filter("k = '3'").count() == 750


def test_coverages_of_one_pair_and_the_scans_they_take(spark):
    from earnloom.operators.coverage import CoveragePatterns

    allocations = spark.range(3_000).select(
        F.col("id").alias("coverage_id"), F.when(F.col("id") % 10 == 0, F.lit(2)).otherwise(F.lit(1)).alias("writing_premium_pattern_id"),
        F.lit("2023-01-01").cast("date").alias("pattern_start_date"),
    )
    factors = spark.createDataFrame(
        [(1, "QS", 1, 0.2, 360), (1, "Q", 1, 0.8, 360), (2, "Q", 1, 1.0, 90)], "pattern_id int, period_frequency string, period int, factor_value double, duration int"
    )
    names = spark.createDataFrame([(1, "one"), (2, "two")], "pattern_id int, pattern_name string")
    plain, salted = (CoveragePatterns(allocations, factors, names, unique_coverages=True, hot_rows=n) for n in (10**9, 100))
    for make in ("coverage_vector", "loss_patterns", "analysis", "complete_analysis"):
        rows = [sorted(map(str, getattr(book, make)().collect())) for book in (plain, salted)]
        assert rows[0] == rows[1] and rows[0]


def test_running_sum_equals_window(spark):
    df = skewed(spark)
    window = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r["id"]: r["s"] for r in df.withColumn("s", F.sum("v").over(window)).collect()}
    for block in (1, 7, 64, 10_000):
        blocked = running_sum(df, ["k"], "id", {"s": "v"}, block=block)
        assert {r["id"]: r["s"] for r in blocked.collect()} == plain


def test_key_totals_equal_window(spark):
    df = skewed(spark)
    whole = Window.partitionBy("k")
    plain = {r["id"]: (r["s"], r["m"]) for r in df.withColumns({"s": F.sum("v").over(whole), "m": F.max("v").over(whole)}).collect()}
    found = with_key_totals(df, ["k"], "id", {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}, block=100)
    assert {r["id"]: (r["s"], r["m"]) for r in found.collect()} == plain


def test_spread_rows_grows_with_the_rows(spark):
    """What a task is dealt does not grow with the table; few rows keep the session's number of partitions."""
    rows = spark.range(40_000).withColumn("key", F.col("id") % 9_000)
    few = spread_rows(rows, ["key"], rows=40_000)
    many = spread_rows(rows, ["key"], rows=40_000, spread=1_000)
    assert few.rdd.getNumPartitions() == spread_rows(rows, ["key"]).rdd.getNumPartitions() == 8
    assert many.rdd.getNumPartitions() == 40
    held = many.groupBy(F.spark_partition_id().alias("p")).count()
    assert held.agg(F.max("count")).first()[0] < 2_000 and held.agg(F.sum("count")).first()[0] == 40_000


@pytest.mark.parametrize("build", [block_queries.elements, pattern_queries.book_b_instances])
def test_patterns_are_dealt_out_by_their_rows(spark, tmp_path, monkeypatch, build):
    monkeypatch.setattr(spread_rows, "__defaults__", (0, 100))
    lines = spark.range(2_400).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"),
        F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(10.0).alias("l_quantity"),
        F.lit(100.0).alias("l_extendedprice"), F.lit("N").alias("l_returnflag"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.range(600).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert build(spark, str(tmp_path)).rdd.getNumPartitions() == 24
