import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from earnloom.operators import steps
from earnloom.operators.counter import add_counter
from earnloom.plans.mapping import MappingRun, load_config, run_mapping


def apply(df, kind, **spec):
    return steps.apply_step(df, {"transform_type": kind, **spec}, MappingRun(df.sparkSession, {}, environment={}))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def people(spark):
    data = [("Ann", 20, "F"), ("Bob", 35, "C"), (None, 50, "X")]
    return spark.createDataFrame(data, "name string, age int, status string")


def test_casts_bad_text_becomes_null(spark):
    df = spark.createDataFrame([("1", "1.5", "2023-01-02", "2023-01-02 03:04:05"), ("x", "y", "no", "no")], "a string, b string, c string, d string")
    done = apply(df, "set_column_type", columns=[
        {"column": "a", "type": "int"}, {"column": "b", "type": "float"}, {"column": "c", "type": "date"}, {"column": "d", "type": "timestamp"}])
    assert [t for _, t in done.dtypes] == ["int", "float", "date", "timestamp"]
    good, bad = done.orderBy(F.col("a").asc_nulls_last()).collect()
    assert (good["a"], good["b"], good["c"]) == (1, 1.5, dt.date(2023, 1, 2))
    assert list(bad) == [None] * 4


def test_simplemap_chains_and_single_pass(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "col1 string")
    assert rows(apply(df, "simplemap", columns=["col1"], mapping={"A": "X", "B": "Y"})) == [("C",), ("X",), ("Y",)]
    pairs = {"A": "B", "B": "C"}
    assert rows(apply(df, "simplemap", columns=["col1"], mapping=pairs)) == [("C",)] * 3
    assert rows(apply(df, "simplemap", columns=["col1"], mapping=pairs, chained=False)) == [("B",), ("C",), ("C",)]


def test_map_number_keys_and_default(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert rows(apply(df, "map", columns=["n"], mapping={"1": "one", "x": "no"})) == [("2",), ("one",)]
    assert rows(apply(df, "map", columns=["n"], mapping={"1": "one"}, default_value="")) == [("",), ("one",)]


def test_update_without_conditions_changes_nothing(people):
    same = apply(people, "update_columns", columns=[{"source_column": "age", "target_value": 0}])
    assert rows(same) == rows(people)


def test_updates_see_earlier_updates(people):
    done = apply(people, "update_columns", columns=[
        {"source_column": "status", "target_value": "N", "conditions": [{"column": "name", "operator": "is_null"}]},
        {"source_column": "age", "target_value": -1, "conditions": [{"column": "status", "operator": "==", "value": "N"}]}])
    assert (None, -1, "N") in rows(done)


def test_duplicate_row_widens_type(people):
    done = apply(people, "duplicate_row", update_columns=[{"source_column": "age", "target_value": "old"}],
                 conditions=[{"column": "age", "operator": ">=", "value": 35}])
    assert done.count() == 5
    assert dict(done.dtypes)["age"] == "string"
    with pytest.raises(ValueError):
        apply(people, "duplicate_row", update_columns=[{"source_column": "none", "target_value": 1}],
              conditions=[{"column": "age", "operator": ">", "value": 1}])


def test_unknown_names_raise(people):
    with pytest.raises(ValueError, match="unknown transform_type"):
        apply(people, "no_such_step")
    with pytest.raises(ValueError, match="unknown operator"):
        apply(people, "select", columns=["age"], conditions=[{"column": "age", "operator": "~", "value": 1}])
    with pytest.raises(ValueError, match="unknown aggregate"):
        apply(people, "group_by", columns=["status"], aggregations=[{"function": "upper", "source_column": "age", "target_column": "x"}])


def test_template_keeps_dollar_signs(spark):
    df = spark.createDataFrame([("a$1\\b",)], "v string")
    done = apply(df, "set_columns", columns=[{"source_column": "v", "pattern_value": "<_this_>"}])
    assert rows(done) == [("<a$1\\b>",)]


def test_split_gives_null_for_missing_parts(spark):
    df = spark.createDataFrame([("x_y",), ("z",)], "p string")
    done = apply(df, "split_column", source_column="p", delimiter="_", target_columns=["a", "b"])
    assert rows(done.select("a", "b")) == [("x", "y"), ("z", None)]


def test_nano_keeps_short_text(spark):
    df = spark.createDataFrame([("xx2023",), ("ab",)], "t string")
    done = apply(df, "set_column_type", columns=[{"column": "t", "type": "timestamp", "format": "nano"}])
    assert rows(done) == [("2023",), ("ab",)]


def test_transpose_both_forms(spark):
    df = spark.createDataFrame([(1, 10, 20)], "k int, a int, b int")
    assert rows(apply(df, "transpose_columns", id_column="what", value_columns=["a", "b"])) == [(1, 10, 20, "a", 10), (1, 10, 20, "b", 20)]
    assert rows(apply(df, "transpose_columns", id_column="what", value_columns=["a", "b"], keep_sources=False)) == [(1, "a", 10), (1, "b", 20)]


def test_counter_with_ties_nulls_and_repeated_rows(spark):
    rows = [(k, v) for k in ("b", None, "a", "a") for v in (2, None, 2, 1)] * 30
    df = spark.createDataFrame(rows, "key string, v int").withColumn("_row", F.lit("x")).repartition(7)
    for names in (["key"], ["v", "key"], ["key", "v"]):
        numbered = add_counter(df, "n", names)
        assert numbered.columns == ["key", "v", "_row", "n"]
        found = sorted(numbered.collect(), key=lambda r: r["n"])
        assert [r["n"] for r in found] == list(range(1, len(rows) + 1))
        order = [tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in names) for r in found]
        assert order == sorted(order)
        assert sorted((r["key"], r["v"]) for r in found if r["key"] and r["v"]) == sorted(r for r in rows if r[0] and r[1])
    again = add_counter(df.repartition(3), "n", ["key"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, add_counter(df, "n", ["key"]).collect()))
    assert add_counter(df.limit(0), "n", ["key"]).collect() == []
    falling = add_counter(df, "n", [F.col("v").desc()]).orderBy("n").collect()
    assert [r["v"] for r in falling[:2]] == [2, 2] and falling[-1]["v"] is None
    over = add_counter(df.withColumn("n", F.lit("old")), "n", ["key"])
    assert over.columns == ["key", "v", "_row", "n"] and dict(over.dtypes)["n"] == "bigint"


def test_counter_numbers_every_row_once(spark):
    df = spark.range(10_000).withColumn("key", F.col("id") % 7)
    ordered = add_counter(df, "n", ["key", "id"]).collect()
    expected = {(r["key"], r["id"]): i + 1 for i, r in enumerate(sorted(ordered, key=lambda r: (r["key"], r["id"])))}
    assert all(expected[(r["key"], r["id"])] == r["n"] for r in ordered)
    plain = add_counter(df.repartition(5), "n")
    assert [r["n"] for r in plain.orderBy("n").collect()] == list(range(1, 10_001))


def test_append_checks_schema(spark, tmp_path):
    base = spark.createDataFrame([(1, "x")], "a long, b string")
    path = str(tmp_path / "more.csv")
    spark.createDataFrame([(2, "y"), (3, "z")], "a int, b string").write.option("header", True).csv(path)
    run = MappingRun(spark, {}, environment={})
    spec = {"transform_type": "append", "data_file": path}
    assert steps.apply_step(base, spec, run).count() == 1 and "append skipped" in run.notes[0]
    assert rows(steps.apply_step(base, {**spec, "use_schema": True}, run)) == [(1, "x"), (2, "y"), (3, "z")]


def test_side_input_of_unknown_kind(spark, people):
    with pytest.raises(ValueError, match="unsupported side input"):
        apply(people, "join", join_file="x.orc", on_rules=[{"source_column": "age", "target_column": "a"}])


def test_tokens(spark):
    run = MappingRun(spark, {"a": "1", "n": None}, run_uuid="U", cob="C", time="T", version="V", environment={"FM_Layer": "gold"})
    assert run.expand("{{uuid}}-{{cob}}-{{time}}-{{version}}-{{a}}-{{none}}-{{n}}-{{FM_Layer}}-{{Layer}}-{{layer}}") == "U-C-T-V-1---gold-gold-gold"
    assert run.expand("{{open") == "{{open" and run.expand(5) == 5


def _write(path, document):
    path.write_text(json.dumps(document))


def test_includes_and_cycles(spark, people, tmp_path):
    _write(tmp_path / "inner.json", {"transforms": [{"transform_type": "drop_columns", "columns": ["age"]}]})
    _write(tmp_path / "loop.json", {"transforms": [{"transform_type": "include", "transform_rule_path": "loop"}]})
    config = {"mapper_directory": str(tmp_path)}
    run = MappingRun(spark, {"transforms": [{"transform_type": "include", "transform_rule_path": "inner"}]}, config, environment={})
    assert run.transform(people).columns == ["name", "status"]
    absolute = {"transforms": [{"transform_type": "include", "transform_rule_path": f"${tmp_path}/inner.json"}]}
    assert MappingRun(spark, absolute, environment={}).transform(people).columns == ["name", "status"]
    looped = MappingRun(spark, {"transforms": [{"transform_type": "include", "transform_rule_path": "loop"}]}, config, environment={})
    with pytest.raises(ValueError, match="include each other"):
        looped.transform(people)


def test_follow_up_mappings(spark, people, tmp_path):
    source, first, second, rescue = (str(tmp_path / n) for n in ("in.parquet", "one.parquet", "two.parquet", "rescue.parquet"))
    people.write.parquet(source)
    _write(tmp_path / "next.json", {"name": "next", "from_asset_path": first, "to_asset_path": second,
                                    "transforms": [{"transform_type": "drop_columns", "columns": ["age"]}]})
    _write(tmp_path / "rescue.json", {"name": "rescue", "from_asset_path": source, "to_asset_path": rescue, "transforms": []})
    _write(tmp_path / "config.yaml", {})
    (tmp_path / "config.yaml").write_text(f"compression: snappy\nmapper_directory: {tmp_path}\n")
    config = load_config(spark, str(tmp_path))
    assert config == {"compression": "snappy", "mapper_directory": str(tmp_path)}
    good = {"name": "good", "from_asset_path": source, "to_asset_path": first, "transforms": [], "on_success": "next"}
    assert run_mapping(spark, good, config, environment={}).columns == ["name", "status"]
    bad = {"name": "bad", "from_asset_path": source, "transforms": [{"transform_type": "nothing"}], "on_error": "rescue"}
    assert run_mapping(spark, bad, config, environment={}).count() == 3
    with pytest.raises(ValueError, match="unknown transform_type"):
        run_mapping(spark, {**bad, "on_error": None}, config, environment={})
    with pytest.raises(ValueError, match="loop"):
        _write(tmp_path / "self.json", {"name": "self", "from_asset_path": source, "transforms": [], "on_success": "self"})
        run_mapping(spark, "self", config, environment={})


def test_session_settings_hold_for_the_run_only(spark, tmp_path):
    name, unset = "spark.sql.debug.maxToStringFields", "spark.sql.earnloom.example"
    before = spark.conf.get(name)
    spark.range(3).write.parquet(str(tmp_path / "in.parquet"))
    document = {
        "arch_config": {name: "99", unset: "1"}, "from_asset_path": str(tmp_path / "in.parquet"),
        "to_asset_path": str(tmp_path / "out.parquet"), "transforms": [],
    }
    seen = []
    made = MappingRun(spark, document, environment={}).run(after=lambda df: seen.append((spark.conf.get(name), spark.conf.get(unset))) or df)
    assert made.count() == 3 and seen == [("99", "1")]
    assert spark.conf.get(name) == before and spark.conf.get(unset, None) is None
    broken = {**document, "transforms": [{"transform_type": "nothing"}]}
    with pytest.raises(ValueError):
        MappingRun(spark, broken, environment={}).run()
    assert spark.conf.get(name) == before


def test_mixed_text_and_numbers(spark, tmp_path):
    """Text in a numeric place gives text or null, never an error."""
    df = spark.createDataFrame([("5", 1), ("x", 2)], "level string, n int")
    assert rows(apply(df, "select", columns=["level", "n"], conditions=[{"column": "level", "operator": ">", "value": 3}])) == [("5", 1)]
    assert rows(apply(df, "select", columns=["level"], conditions=[{"column": "n", "operator": "==", "value": "two"}])) == []
    assert rows(apply(df, "select", columns=["n"], conditions=[{"column": "level", "operator": ">=", "value_column": "n"}])) == [(1,)]
    done = apply(df, "update_columns", columns=[
        {"source_column": "n", "target_value": "many", "conditions": [{"column": "n", "operator": ">", "value": 1}]}])
    assert rows(done) == [("5", "1"), ("x", "many")]
    taken = apply(df, "update_columns", columns=[
        {"source_column": "level", "target_column": "n", "conditions": [{"column": "n", "operator": ">", "value": 1}]}])
    assert rows(taken) == [("5", "1"), ("x", "x")]
    assert rows(apply(df, "map", columns=["level"], mapping={"x": 7})) == [("5", 1), ("7", 2)]
    assert rows(apply(df, "map", columns=["n"], mapping={"1": 7}, default_value="other")) == [("5", "7"), ("x", "other")]
    path = str(tmp_path / "numbers.parquet")
    spark.createDataFrame([("x", 9)], "`from` string, `to` int").write.parquet(path)
    assert rows(apply(df, "map", columns=["level"], mapping_file=path)) == [("5", 1), ("9", 2)]
    assert rows(apply(df, "map", columns=["level"], mapping_file=path, default_value="none")) == [("9", 2), ("none", 1)]


def test_all_listed_aggregates_exist(spark):
    assert [name for name in steps.AGGREGATES if not hasattr(F, name)] == []
