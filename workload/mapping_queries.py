"""Mapping steps and whole mapping documents over the given tables (P, F, J1-J5, A1, A2, U, W, M, S4)."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from earnloom.operators import steps
from earnloom.plans.mapping import MappingRun, run_mapping
from earnloom.session import scratch_path

from . import inputs
from .registry import query


class Paths:
    """Stands in for a run where a step only needs its side input read."""

    def __init__(self, spark):
        self.run = MappingRun(spark, {}, environment={})

    def __getattr__(self, name):
        return getattr(self.run, name)


def step(spark, df, **spec):
    return steps.apply_step(df, spec, Paths(spark))


def table(spark, sf_dir, name):
    return inputs.table(spark, sf_dir, name)


# --- projections and columns ---------------------------------------------------------------------


@query("p1_rename_columns", "SELECT c_custkey AS id, c_name AS label, c_nationkey FROM customer")
def p1(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return step(spark, df, transform_type="rename_columns", columns=[
        {"source_column": "c_custkey", "target_column": "key"},
        {"source_column": "key", "target_column": "id"},
        {"source_column": "c_name", "target_column": "label"},
        {"source_column": "no_such_column", "target_column": "other"},
    ])


@query("p2_drop_columns", "SELECT s_suppkey, s_name FROM supplier")
def p2(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    return step(spark, df, transform_type="drop_columns", columns=["s_nationkey", "s_acctbal", "no_such_column"])


@query("p3_copy_columns", "SELECT p_partkey, p_brand, p_brand AS brand_copy, p_brand AS brand_again FROM part")
def p3(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return step(spark, df, transform_type="copy_columns", columns=[
        {"source_column": "p_brand", "target_column": "brand_copy"},
        {"source_column": "brand_copy", "target_column": "brand_again"},
    ])


@query("p4_p6_set_columns", """
SELECT p_partkey, 'X-' || p_brand || '/' || p_brand AS p_brand, 'fixed' AS p_type, 7 AS level, CAST(NULL AS VARCHAR) AS empty,
  trim(p_name || ' ') AS p_name FROM part""")
def p4(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    done = step(spark, df, transform_type="set_columns", columns=[
        {"source_column": "p_brand", "pattern_value": "X-_this_/_this_"},
        {"source_column": "p_type", "target_value": "  fixed ", "trim": True},
        {"source_column": "level", "target_value": 7},
        {"source_column": "empty", "default_value": 1},
        {"source_column": "p_name", "pattern_value": "_this_  ", "trim": True},
    ])
    return done.withColumn("empty", F.col("empty").cast("string"))


@query("p5_template_tokens", """
SELECT o_orderkey, '20240131/v1.0.0/bronze/' || o_orderstatus || '/' AS o_orderstatus FROM orders""")
def p5(spark, sf_dir):
    document = {"layer": "bronze", "transforms": [
        {"transform_type": "select", "columns": ["o_orderkey", "o_orderstatus"]},
        {"transform_type": "set_columns", "columns": [
            {"source_column": "o_orderstatus", "pattern_value": "{{cob}}/{{version}}/{{layer}}/_this_/{{no_such_key}}"},
        ]},
    ]}
    run = MappingRun(spark, document, cob="20240131", environment={})
    return run.transform(table(spark, sf_dir, "orders"))


@query("p7_trim_columns", "SELECT doc_id, trim(source) AS source, n_chars FROM documents")
def p7(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("  "), "source", F.lit(" ")).alias("source"), "n_chars"
    )
    return step(spark, df, transform_type="trim_columns", columns=["source", "n_chars"])


@query("p8_split_column", """
SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, string_split(p_name, ' ')[2] AS second_word,
  string_split(p_name, ' ')[3] AS third_word FROM part""")
def p8(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    done = step(spark, df, transform_type="split_column", source_column="p_name", delimiter=" ",
                target_columns=["first_word", "second_word", "third_word"])
    return done.drop("p_name")


@query("p9_merge_columns", """
SELECT o_orderkey, concat_ws('>>', CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, o_orderpriority, CAST(o_custkey AS VARCHAR)) AS merged
FROM orders""")
def p9(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), "o_orderpriority", "o_custkey"
    )
    done = step(spark, df, transform_type="merge_columns", target_column="merged", delimiter=">>",
                source_columns=["status", "o_orderpriority", "o_custkey"])
    return done.select("o_orderkey", "merged")


@query("p10_cast_columns", """
SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS as_int, TRY_CAST(l_returnflag AS BIGINT) AS as_long,
  CAST(l_linenumber AS SMALLINT) AS as_short, CAST(l_linenumber AS TINYINT) AS as_byte, CAST(l_linenumber AS DOUBLE) AS as_double,
  l_linenumber <> 0 AS as_boolean, CAST(l_orderkey AS VARCHAR) AS as_string, CAST(l_shipdate AS DATE) AS as_date, l_tax AS untouched
FROM lineitem""")
def p10(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("as_int"), F.col("l_returnflag").alias("as_long"),
        F.col("l_linenumber").alias("as_short"), F.col("l_linenumber").alias("as_byte"),
        F.col("l_linenumber").alias("as_double"), F.col("l_linenumber").alias("as_boolean"),
        F.col("l_orderkey").alias("as_string"), F.col("l_shipdate").alias("as_date"), F.col("l_tax").alias("untouched"),
    )
    kinds = ("int", "long", "short", "byte", "double", "boolean", "string", "date")
    return step(spark, df, transform_type="set_column_type", columns=[
        *[{"column": f"as_{k}", "type": k} for k in kinds], {"column": "untouched", "type": "no_such_type"},
    ])


@query("p11_p12_parse_dates", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS moment,
  CAST(l_shipdate AS DATE) AS plain_day FROM lineitem""")
def p11(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 7, "no date")
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        text.otherwise(F.date_format("l_shipdate", "dd.MM.yyyy")).alias("day"),
        text.otherwise(F.date_format("l_shipdate", "yyyy/MM/dd HH:mm")).alias("moment"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("plain_day"),
    )
    done = step(spark, df, transform_type="set_column_type", columns=[
        {"column": "day", "type": "date", "format": "dd.MM.yyyy"},
        {"column": "moment", "type": "timestamp", "format": "yyyy/MM/dd HH:mm"},
        {"column": "plain_day", "type": "date"},
    ])
    # shown as text, so the result does not depend on the session's time zone
    return done.withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))


@query("p13_nano_timestamps", """
SELECT event_id, CASE WHEN length(event_type) > 2 THEN substr(event_type, 3) ELSE event_type END AS event_type,
  CASE WHEN length(CAST(event_id AS VARCHAR)) > 2 THEN substr(CAST(event_id AS VARCHAR), 3) ELSE CAST(event_id AS VARCHAR) END AS id_text FROM events""")
def p13(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("id_text"))
    return step(spark, df, transform_type="set_column_type", columns=[
        {"column": "event_type", "type": "timestamp", "format": "nano"},
        {"column": "id_text", "type": "timestamp", "format": "nano"},
    ])


@query("p14_format_dates", """
SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS ts, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def p14(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return step(spark, df, transform_type="set_column_type", columns=[
        {"column": "ts", "type": "string", "format": "yyyy/MM/dd HH:mm"},
        {"column": "user_id", "type": "string", "format": "yyyy"},
    ])


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("p15_w1_ordered_counter", f"""
SELECT {', '.join(_LINE_KEY)}, row_number() OVER (ORDER BY {', '.join(_LINE_KEY)}) AS row_id FROM lineitem""")
def p15(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*_LINE_KEY)
    return step(spark, df, transform_type="set_column_type",
                columns=[{"column": "row_id", "type": "counter", "order_by": _LINE_KEY}])


@query("p15_counter", """
SELECT count(*) AS rows_seen, 1::BIGINT AS first_id, count(*) AS last_id, count(*) AS distinct_ids FROM lineitem""")
def p15_unordered(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    done = step(spark, df, transform_type="set_column_type", columns=[{"column": "row_id", "type": "counter"}])
    return done.agg(
        F.count("row_id").alias("rows_seen"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"),
        F.count_distinct("row_id").alias("distinct_ids"),
    )


@query("p16_select_distinct_filter", """
SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_linenumber > 3 AND l_returnflag <> 'A'""")
def p16(spark, sf_dir):
    return step(spark, table(spark, sf_dir, "lineitem"), transform_type="select", distinct=True,
                columns=["l_returnflag", "l_linestatus", "l_linenumber"], conditions=[
                    {"column": "l_linenumber", "operator": ">", "value": 3},
                    {"column": "l_returnflag", "operator": "!=", "value": "A"},
                ])


@query("p17_select_expression", """
SELECT DISTINCT l_suppkey, upper(l_linestatus) AS status, l_linenumber + 20 AS shifted FROM lineitem WHERE l_linenumber + 20 >= 24""")
def p17(spark, sf_dir):
    return step(spark, table(spark, sf_dir, "lineitem"), transform_type="select_expression", distinct=True,
                columns=["l_suppkey", "upper(l_linestatus) as status", "l_linenumber + 20 as shifted"],
                conditions=[{"column": "shifted", "operator": ">=", "value": 24}])


@query("p18_transpose_columns", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax, u.measure, u.value
FROM lineitem, LATERAL (VALUES ('l_discount', l_discount), ('l_tax', l_tax)) u(measure, value)""")
def p18(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return step(spark, df, transform_type="transpose_columns", id_column="measure", value_columns=["l_discount", "l_tax"])


@query("p18_unpivot_columns", """
SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def p18_unpivot(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return step(spark, df, transform_type="transpose_columns", id_column="measure",
                value_columns=["l_discount", "l_tax"], keep_sources=False)


@query("p19_p20_derived_columns", """
SELECT c_custkey AS customerkey, 'REDACTED' AS name, round(c_acctbal * 12, 2) AS yearly FROM customer""")
def p19(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("CustomerKey"), F.lit("REDACTED").alias("Name"), F.round(F.col("c_acctbal") * 12, 2).alias("Yearly")
    )
    return steps.lower_names(df)


# --- conditions and updates ----------------------------------------------------------------------


@query("f1_f7_conditions", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_quantity > 10 AND l_quantity <= 45 AND l_discount >= 0.02 AND l_tax < 0.08 AND l_returnflag IN ('A', 'N')
  AND l_linenumber NOT IN (6, 7) AND l_linestatus = 'O' AND l_orderkey <> 5 AND l_partkey > l_suppkey AND l_shipdate IS NOT NULL""")
def f1(spark, sf_dir):
    return step(spark, table(spark, sf_dir, "lineitem"), transform_type="select", columns=[
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate",
    ], conditions=[
        {"column": "l_quantity", "operator": ">", "value": 10},
        {"column": "l_quantity", "operator": "<=", "value": 45},
        {"column": "l_discount", "operator": ">=", "value": 0.02},
        {"column": "l_tax", "operator": "<", "value": 0.08},
        {"column": "l_returnflag", "operator": "IN", "value": ["A", "N"]},
        {"column": "l_linenumber", "operator": "NOT IN", "value": [6, 7]},
        {"column": "l_linestatus", "operator": "==", "value": "O"},
        {"column": "l_orderkey", "operator": "!=", "value": 5},
        {"column": "l_partkey", "operator": ">", "value_column": "l_suppkey"},
        {"column": "l_shipdate", "operator": "is_not_null"},
    ]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f3_f4_like_and_nulls", """
SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END AS big FROM part
WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 'red%' AND p_size <= 25""")
def f3(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("big"))
    return step(spark, df, transform_type="select", columns=["p_partkey", "p_name", "big"], conditions=[
        {"column": "p_name", "operator": "like", "value": "%ring%"},
        {"column": "p_name", "operator": "not like", "value": "red%"},
        {"column": "big", "operator": "is_null"},
    ])


@query("f8_f9_update_columns", """
SELECT p_partkey, CASE WHEN p_size < 10 AND p_size > 2 THEN 'small part' ELSE p_name END AS p_name,
  CASE WHEN p_type LIKE 'S%' AND p_size <> 7 THEN 'house brand' ELSE p_brand END AS p_brand,
  CASE WHEN p_type LIKE 'S%' THEN p_name_2 ELSE p_type END AS p_type, p_size FROM (
  SELECT *, CASE WHEN p_size < 10 AND p_size > 2 THEN 'small part' ELSE p_name END AS p_name_2 FROM part)""")
def f8(spark, sf_dir):
    df = table(spark, sf_dir, "part").drop("p_retailprice")
    return step(spark, df, transform_type="update_columns", columns=[
        {"source_column": "p_name", "target_value": "small part", "conditions": [
            {"column": "p_size", "operator": "<", "value": 10}, {"column": "p_size", "operator": ">", "value": 2}]},
        {"source_column": "p_brand", "target_value": "house brand", "conditions": [
            {"column": "p_type", "operator": "like", "value": "S%"}, {"column": "p_size", "operator": "!=", "value": 7}]},
        {"source_column": "p_name", "target_column": "p_type", "conditions": [
            {"column": "p_type", "operator": "like", "value": "S%"}]},
        {"source_column": "p_size", "target_value": 0, "conditions": []},
    ])


@query("f10_u4_duplicate_row", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT o_orderkey, 'copied', o_totalprice FROM orders WHERE o_totalprice < 100000""")
def f10(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return step(spark, df, transform_type="duplicate_row",
                update_columns=[{"source_column": "o_orderstatus", "target_value": "copied"}],
                conditions=[{"column": "o_totalprice", "operator": "<", "value": 100000}])


@query("f11_simplemap", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Last' WHEN 'N' THEN 'Last' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS l_returnflag,
  CASE l_linestatus WHEN 'A' THEN 'Last' WHEN 'N' THEN 'Last' WHEN 'R' THEN 'Returned' ELSE l_linestatus END AS l_linestatus FROM lineitem""")
def f11(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return step(spark, df, transform_type="simplemap", columns=["l_returnflag", "l_linestatus"],
                mapping={"A": "N", "N": "Last", "R": "Returned"})


@query("f12_filter_and_replace", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def f12(spark, sf_dir):
    df = step(spark, table(spark, sf_dir, "customer"), transform_type="select",
              columns=["c_custkey", "c_acctbal", "c_mktsegment"],
              conditions=[{"column": "c_mktsegment", "operator": "!=", "value": "BUILDING"}])
    done = step(spark, df, transform_type="update_columns", columns=[
        {"source_column": "c_acctbal", "target_value": 0.0, "conditions": [{"column": "c_acctbal", "operator": "<", "value": 0}]}])
    return done.drop("c_mktsegment")


# --- joins and maps ------------------------------------------------------------------------------


@query("j1_join_inner", """
SELECT o_orderkey, c_custkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def j1(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = step(spark, df, transform_type="join", join_file=f"{sf_dir}/customer.parquet",
                on_rules=[{"source_column": "o_custkey", "target_column": "c_custkey"}])
    return done.select("o_orderkey", "c_custkey", "o_custkey", "c_mktsegment")


def _register_join_kinds():
    kinds = {
        "left": ("LEFT JOIN", True), "right": ("RIGHT JOIN", True), "full": ("FULL JOIN", True),
        "left_semi": ("SEMI JOIN", False), "left_anti": ("ANTI JOIN", False),
    }
    for how, (sql, both) in kinds.items():
        columns = ["s_suppkey", "s_nationkey"] + (["c_custkey", "c_nationkey"] if both else [])

        def build(spark, sf_dir, how=how, columns=columns):
            df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            done = step(spark, df, transform_type="join", join_file=f"{sf_dir}/customer.parquet", how=how, on_rules=[
                {"source_column": "s_nationkey", "target_column": "c_nationkey"},
                {"source_column": "s_suppkey", "target_column": "c_custkey"},
            ])
            return done.select(*columns)

        query(f"j1_join_{how}", f"""
SELECT {', '.join(columns)} FROM supplier {sql} customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey""")(build)


_register_join_kinds()


@query("j2_map_by_dictionary", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'P' THEN 'split' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def j2(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return step(spark, df, transform_type="map", columns=["o_orderstatus"], mapping={"O": "waiting", "P": "split"})


def _nation_map(spark, sf_dir) -> str:
    """A CSV side input ``from,to`` of nation keys and names, without the nations of region 0."""
    path = scratch_path(spark, "nation-map") + ".csv"
    table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 0).select(
        F.col("n_nationkey").alias("from"), F.col("n_name").alias("to")
    ).coalesce(1).write.option("header", True).csv(path)
    return path


@query("j3_s4_map_by_file", """
SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS c_nationkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 0""")
def j3(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return step(spark, df, transform_type="map", columns=["c_nationkey"], mapping_file=_nation_map(spark, sf_dir))


@query("j4_map_with_default", """
SELECT c_custkey, coalesce(n_name, 'elsewhere') AS c_nationkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 0""")
def j4(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return step(spark, df, transform_type="map", columns=["c_nationkey"], mapping_file=_nation_map(spark, sf_dir),
                default_value="elsewhere", duplicates="first", spread=["c_custkey"])


@query("j3_map_with_repeated_keys", """
SELECT s_suppkey, coalesce(c_name, CAST(s_nationkey AS VARCHAR)) AS s_nationkey
FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey""")
def j3_repeated(spark, sf_dir):
    path = scratch_path(spark, "customer-map") + ".parquet"
    table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("from"), F.col("c_name").alias("to")).write.parquet(path)
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return step(spark, df, transform_type="map", columns=["s_nationkey"], mapping_file=path)


@query("j5_join_on_two_keys", """
SELECT l_orderkey, l_suppkey, count(*) AS pairs
FROM (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') a
JOIN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R') b USING (l_orderkey, l_suppkey) GROUP BY ALL""")
def j5(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    returned = lines.filter(F.col("l_returnflag") == "R").drop("l_returnflag")
    kept = lines.filter(F.col("l_returnflag") != "R").drop("l_returnflag")
    # counts per key on both sides first: the pairs of a frequent key are multiplied, not listed
    a = returned.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("_a"))
    b = kept.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_suppkey", (F.col("_a") * F.col("_b")).alias("pairs"))


# --- groups, unions, order -----------------------------------------------------------------------


@query("a1_group_by", """
SELECT l_returnflag, l_linestatus, count(l_quantity) AS count_quantity, round(sum(l_extendedprice), 2) AS sum_price,
  round(avg(l_discount), 6) AS avg_discount, min(l_shipdate) AS first_ship, max(l_tax) AS top_tax, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY ALL""")
def a1(spark, sf_dir):
    done = step(spark, table(spark, sf_dir, "lineitem"), transform_type="group_by", columns=["l_returnflag", "l_linestatus"],
                aggregations=[
                    {"function": "count", "source_column": "l_quantity", "target_column": "count_quantity"},
                    {"function": "sum", "source_column": "l_extendedprice", "target_column": "sum_price"},
                    {"function": "avg", "source_column": "l_discount", "target_column": "avg_discount"},
                    {"function": "min", "source_column": "l_shipdate", "target_column": "first_ship"},
                    {"function": "max", "source_column": "l_tax", "target_column": "top_tax"},
                    {"function": "count_distinct", "source_column": "l_suppkey", "target_column": "suppliers"},
                ])
    return done.withColumns({"sum_price": F.round("sum_price", 2), "avg_discount": F.round("avg_discount", 6)})


@query("a2_w6_grouped_and_sorted", """
SELECT p_brand, round(avg(p_retailprice), 4) AS mean_price, max(p_size) AS top_size, min(p_size) AS low_size FROM part GROUP BY 1""")
def a2(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.max("p_size").alias("top_size"), F.min("p_size").alias("low_size")
    ).orderBy(F.desc("mean_price"))


@query("u1_append", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def u1(spark, sf_dir):
    return step(spark, table(spark, sf_dir, "customer"), transform_type="append", data_file=f"{sf_dir}/customer.parquet")


@query("u1_append_mismatch", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def u1_mismatch(spark, sf_dir):
    return step(spark, table(spark, sf_dir, "customer"), transform_type="append", data_file=f"{sf_dir}/supplier.parquet")


@query("u1_append_csv_with_schema", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def u1_csv(spark, sf_dir):
    path = scratch_path(spark, "supplier") + ".csv"
    supplier = table(spark, sf_dir, "supplier")
    supplier.write.option("header", True).csv(path)
    return step(spark, supplier, transform_type="append", data_file=path, use_schema=True)


@query("u2_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u2(spark, sf_dir):
    return step(spark, table(spark, sf_dir, "lineitem"), transform_type="select", columns=["l_suppkey", "l_returnflag"], distinct=True)


# --- whole documents -----------------------------------------------------------------------------


def _document(sf_dir: str, target: str) -> dict:
    return {
        "name": "BrandTurnover",
        "from_asset_path": "{{tables}}/lineitem.parquet",
        "to_asset_path": "{{results}}/turnover-{{cob}}.parquet",
        "tables": sf_dir,
        "results": target,
        "transforms": [
            {"transform_type": "select_expression", "columns": [
                "l_partkey", "l_returnflag as fate", "l_extendedprice * (1 - l_discount) as net"],
             "conditions": [{"column": "l_quantity", "operator": ">=", "value": 10}]},
            {"transform_type": "map", "columns": ["fate"], "default_value": "kept", "mapping": {"R": "sent back"}},
            {"transform_type": "join", "join_file": "{{tables}}/part.parquet",
             "on_rules": [{"source_column": "l_partkey", "target_column": "p_partkey"}]},
            {"transform_type": "include", "transform_rule_path": "$" + target + "/shared"},
            {"transform_type": "group_by", "columns": ["line", "fate"], "aggregations": [
                {"function": "sum", "source_column": "net", "target_column": "net"},
                {"function": "count", "source_column": "l_partkey", "target_column": "lines"}]},
            {"transform_type": "update_columns", "columns": [
                {"source_column": "fate", "target_value": "thin", "conditions": [
                    {"column": "lines", "operator": "<", "value": 300}]}]},
            {"transform_type": "rename_columns", "columns": [{"source_column": "net", "target_column": "turnover"}]},
        ],
    }


@query("m1_m2_mapping_document", """
WITH g AS (
  SELECT 'B-' || split_part(p_brand, '#', 2) AS line, CASE l_returnflag WHEN 'R' THEN 'sent back' ELSE 'kept' END AS fate,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS turnover, count(*) AS lines
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 10 GROUP BY ALL)
SELECT line, CASE WHEN lines < 300 THEN 'thin' ELSE fate END AS fate, turnover, lines FROM g""")
def m1(spark, sf_dir):
    """Source table to target table by a document with tokens and an included step list."""
    folder = scratch_path(spark, "mapping")
    shared = {"transforms": [
        {"transform_type": "split_column", "source_column": "p_brand", "delimiter": "#", "target_columns": ["word", "line"]},
        {"transform_type": "set_columns", "columns": [{"source_column": "line", "pattern_value": "B-_this_"}]},
    ]}
    spark.createDataFrame([(json.dumps(shared),)], "value string").coalesce(1).write.text(os.path.join(folder, "shared.json"))
    done = run_mapping(spark, _document(sf_dir, folder), {"compression": "snappy"}, cob="20240131", environment={})
    return done.withColumn("turnover", F.round("turnover", 2))


@query("m3_hooks", """
SELECT l_returnflag, count(*) AS lines, 3 AS steps_seen FROM lineitem WHERE l_quantity > 5 GROUP BY 1""")
def m3(spark, sf_dir):
    """A hook before, one at every step, and one after."""
    seen = []
    run = MappingRun(spark, {"transforms": [
        {"transform_type": "select", "columns": ["l_returnflag", "l_quantity"]},
        {"transform_type": "trim_columns", "columns": ["l_returnflag"]},
        {"transform_type": "group_by", "columns": ["l_returnflag"], "aggregations": [
            {"function": "count", "source_column": "l_quantity", "target_column": "lines"}]},
    ]}, environment={})
    return run.transform(
        table(spark, sf_dir, "lineitem"),
        before=lambda df: df.filter(F.col("l_quantity") > 5),
        each=lambda df, spec: seen.append(spec["transform_type"]),
        after=lambda df: df.withColumn("steps_seen", F.lit(len(seen))),
    )
