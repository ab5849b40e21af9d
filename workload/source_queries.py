"""Readers, writers, tables, catalogue queries and sequence files over the given tables (S, J7-J11, W7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earnloom.session import scratch_path
from earnloom.sources import documents, fasta, files, tables
from earnloom.sources.catalog import Catalogue

from . import inputs
from .registry import query


def table(spark, sf_dir, name):
    return inputs.table(spark, sf_dir, name)


@query("s1_s2_parquet_copy", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def s1(spark, sf_dir):
    path = scratch_path(spark, "orders")
    files.write_parquet(table(spark, sf_dir, "orders"), path, "snappy")
    return files.read_parquet(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("s3_s9_parquet_to_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s3(spark, sf_dir):
    path = scratch_path(spark, "customer")
    files.parquet_to_csv(spark, f"{sf_dir}/customer.parquet", path)
    return files.read_csv(spark, path, sep=";").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("s8_csv_to_parquet", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s8(spark, sf_dir):
    text, target = scratch_path(spark, "part-csv"), scratch_path(spark, "part")
    files.write_csv(table(spark, sf_dir, "part"), text, ",")
    files.csv_to_parquet(spark, text, target)
    return files.read_parquet(spark, target).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("s5_pattern_tables", f"""
WITH {inputs.BOOK_A}
SELECT coverage_id, pattern_id, start_date, count(*) AS factors, sum(duration)::BIGINT AS days, 'Brand#' || pattern_id AS pattern_name
FROM alloc JOIN factor USING (pattern_id) GROUP BY ALL""")
def s5(spark, sf_dir):
    """The three pattern tables as CSV files, read with declared types and joined."""
    folder = scratch_path(spark, "pattern-tables")
    plain = {
        documents.ALLOCATION_FILE: inputs.allocations(spark, sf_dir).drop("premium"),
        documents.FACTOR_FILE: inputs.brand_factors(spark, sf_dir),
        documents.PATTERN_FILE: inputs.brand_names(spark, sf_dir),
    }
    for name, df in plain.items():
        files.write_csv(df, f"{folder}/{name}", ",")
    allocations, factors, names = documents.read_pattern_tables(spark, folder)
    counts = factors.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("factors"), F.sum("duration").alias("days"))
    covers = allocations.select(
        "coverage_id", F.col("writing_premium_pattern_id").alias("pattern_id"), F.col("pattern_start_date").alias("start_date")
    )
    return covers.join(counts, "pattern_id").join(names, "pattern_id")


@query("s5_shuffled_columns", f"""
WITH {inputs.BOOK_A}
SELECT pattern_id, period_frequency, period, round(factor_value, 6) AS factor_value, duration FROM factor""")
def s5_shuffled(spark, sf_dir):
    """A factor file whose columns stand in another order, with one more in between: columns are found by name."""
    folder = scratch_path(spark, "shuffled-tables")
    factors = inputs.brand_factors(spark, sf_dir).select(
        "duration", "period", F.lit("x").alias("remark"), "pattern_id", "factor_value", "period_frequency"
    )
    plain = {
        documents.ALLOCATION_FILE: inputs.allocations(spark, sf_dir).drop("premium"),
        documents.FACTOR_FILE: factors,
        documents.PATTERN_FILE: inputs.brand_names(spark, sf_dir),
    }
    for name, df in plain.items():
        files.write_csv(df, f"{folder}/{name}", ",")
    found = documents.read_pattern_tables(spark, folder)[1]
    return found.select("pattern_id", "period_frequency", "period", F.round("factor_value", 6).alias("factor_value"), "duration")


def _fresh_schema(spark) -> str:
    name = f"earnloom_{uuid.uuid4().hex[:12]}"
    location = scratch_path(spark, name)
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{location}'")
    return name


def _drop_schema(spark, name: str) -> None:
    """Forget the tables; their files stay, so a frame that reads the files still works."""
    for entry in spark.catalog.listTables(name):
        if not entry.isTemporary:
            spark.sql(f"DROP TABLE {name}.{entry.name}")
    spark.sql(f"DROP SCHEMA {name}")


@query("s10_s17_checked_load", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s10(spark, sf_dir):
    """Create a table, then load the same file twice after the column check."""
    schema = _fresh_schema(spark)
    path = scratch_path(spark, "supplier")
    tables.create_table(spark, f"{schema}.supplier", table(spark, sf_dir, "supplier").schema, path=path)
    for _ in range(2):
        tables.load_parquet_to_table(spark, f"{sf_dir}/supplier.parquet", f"{schema}.supplier")
    _drop_schema(spark, schema)
    return files.read_parquet(spark, path)


@query("s17_partitioned_table", "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1")
def s17(spark, sf_dir):
    schema = _fresh_schema(spark)
    path = scratch_path(spark, "orders-by-status")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.create_table(spark, f"{schema}.orders", orders.schema, ["o_orderstatus"], path)
    orders.write.insertInto(f"{schema}.orders")
    _drop_schema(spark, schema)
    return files.read_parquet(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )


@query("s12_s13_dump_and_load", """
SELECT 'nation' AS name, n_nationkey AS key, n_name AS label FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region
UNION ALL SELECT 'supplier', CAST(s_suppkey AS INTEGER), s_name FROM supplier""")
def s12(spark, sf_dir):
    """Three tables dumped as CSV and loaded into a second schema, replacing what it held."""
    source, target = _fresh_schema(spark), _fresh_schema(spark)
    names = {"nation": ("n_nationkey", "n_name"), "region": ("r_regionkey", "r_name"), "supplier": ("s_suppkey", "s_name")}
    paths = {}
    for name in names:
        df = table(spark, sf_dir, name)
        tables.create_table(spark, f"{source}.{name}", df.schema, path=scratch_path(spark, name))
        tables.load_parquet_to_table(spark, f"{sf_dir}/{name}.parquet", f"{source}.{name}")
        paths[name] = scratch_path(spark, name)
        tables.create_table(spark, f"{target}.{name}", df.schema, path=paths[name])
        tables.load_parquet_to_table(spark, f"{sf_dir}/{name}.parquet", f"{target}.{name}")
    folder = scratch_path(spark, "dump")
    tables.dump_schema(spark, source, folder)
    tables.load_schema(spark, target, folder, truncate=True)
    _drop_schema(spark, source)
    _drop_schema(spark, target)
    parts = [
        files.read_parquet(spark, paths[name]).select(
            F.lit(name).alias("name"), F.col(key).cast("int").alias("key"), F.col(label).alias("label")
        )
        for name, (key, label) in names.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s11_extract_query", "SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1")
def s11(spark, sf_dir):
    view = f"lines_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(view)
    path = scratch_path(spark, "extract")
    tables.extract_query(spark, f"SELECT l_suppkey, count(*) AS lines FROM {view} GROUP BY l_suppkey", path)
    spark.catalog.dropTempView(view)
    return files.read_csv(spark, path, schema="l_suppkey long, lines long", sep=";")


@query("s14_describe", """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name,
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
    ELSE 'timestamp' END AS column_type
FROM (DESCRIBE SELECT * FROM lineitem)""")
def s14(spark, sf_dir):
    described, _ = files.describe_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return described.withColumn("column_type", F.regexp_replace("column_type", "timestamp_ntz", "timestamp"))


@query("s14_w7_first_rows", "SELECT count(*) AS rows_shown FROM (SELECT * FROM part LIMIT 5)")
def s14_rows(spark, sf_dir):
    return files.describe_parquet(spark, f"{sf_dir}/part.parquet", 5)[1].agg(F.count(F.lit(1)).alias("rows_shown"))


@query("s15_named_query", """
SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders WHERE o_totalprice > 250000.5""")
def s15(spark, sf_dir):
    """A query text kept in a file, with bound parameters, rows as JSON."""
    view = f"orders_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    folder = scratch_path(spark, "queries")
    text = f"SELECT o_orderkey, o_orderstatus FROM {view} WHERE o_totalprice > {{least}}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/big_orders.sql")
    return tables.as_json(tables.named_query(spark, "big_orders", folder, {"least": 250000.5}))


@query("s16_prepared_query", """
SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 100000.0 AND o_orderpriority <> '5-LOW' GROUP BY 1""")
def s16(spark, sf_dir):
    view = f"orders_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return tables.prepared_query(
        spark,
        f"SELECT o_orderstatus, count(*) AS orders FROM {view} WHERE o_totalprice > ? AND o_orderpriority <> ? GROUP BY o_orderstatus",
        [100000.0, "5-LOW"],
    )


@query("s22_script", "SELECT p_brand, count(*) AS parts FROM part WHERE p_size > 10 GROUP BY 1")
def s22(spark, sf_dir):
    base, big = (f"v_{uuid.uuid4().hex[:12]}" for _ in range(2))
    table(spark, sf_dir, "part").createOrReplaceTempView(base)
    tables.run_script(spark, f"""
CREATE OR REPLACE TEMPORARY VIEW {big} AS
  SELECT * FROM {base} WHERE p_size > 10;
CREATE OR REPLACE TEMPORARY VIEW {big}_brands AS
  SELECT p_brand, count(*) AS parts FROM {big} GROUP BY p_brand;
""")
    return spark.table(f"{big}_brands")


# --- sequence records ----------------------------------------------------------------------------


def _records(spark, sf_dir):
    """Every document as a sequence record: header from id and language, body wrapped over lines."""
    path = scratch_path(spark, "records") + ".fasta"
    body = F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z]", ""), "(.{60})", "$1\n")
    table(spark, sf_dir, "documents").select(
        F.concat(F.lit(">"), F.col("doc_id"), F.lit(" lang="), F.col("lang"), F.lit("\n"), body).alias("value")
    ).write.text(path)
    return fasta.read_fasta(spark, path)


@query("s18_fasta_records", """
SELECT doc_id || ' lang=' || lang AS header, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
  md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS digest FROM documents WHERE lang = 'en'""")
def s18(spark, sf_dir):
    found = fasta.filter_by_header(_records(spark, sf_dir), "lang=en$")
    return found.select("header", F.length("sequence").cast("long").alias("letters"), F.md5("sequence").alias("digest"))


@query("s18_fasta_chunks", """
SELECT doc_id || ' lang=' || lang AS header, ceil(length(letters) / 180.0)::BIGINT AS at_least, length(letters) AS letters, md5(letters) AS digest
FROM (SELECT *, regexp_replace(text, '[^A-Za-z]', '', 'g') AS letters FROM documents) WHERE length(letters) > 0""")
def s18_chunks(spark, sf_dir):
    """Records in pieces of three lines, put together again; a record may go over several file splits."""
    path = scratch_path(spark, "long-records") + ".fasta"
    body = F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z]", ""), "(.{60})", "$1\n")
    table(spark, sf_dir, "documents").select(
        F.concat(F.lit(">"), F.col("doc_id"), F.lit(" lang="), F.col("lang"), F.lit("\n"), body).alias("value")
    ).write.text(path)
    whole = fasta.read_fasta_chunks(spark, path, lines=3).groupBy("source", "record").agg(
        F.first("header").alias("header"),
        F.max("chunk").alias("chunks"),
        F.array_sort(F.collect_list(F.struct("chunk", "sequence"))).alias("pieces"),
    )
    joined = whole.withColumn("sequence", F.array_join("pieces.sequence", ""))
    # a split inside a record ends a piece, so there may be more pieces than full ones
    least = F.ceil(F.length("sequence") / 180)
    complete = (F.size("pieces") == F.col("chunks")) & (F.col("chunks") >= least)
    return joined.select(
        "header", F.when(complete, least).alias("at_least"), F.length("sequence").cast("long").alias("letters"), F.md5("sequence").alias("digest")
    )


@query("s19_first_header", """
SELECT CAST(min(doc_id) AS VARCHAR) || ' lang=' || 'de' AS header FROM documents WHERE lang = 'de'""")
def s19(spark, sf_dir):
    numbered = _records(spark, sf_dir).withColumn("number", F.split("header", " ")[0].cast("long"))
    return fasta.first_header(numbered, "lang=de$", "number")


# --- catalogue -----------------------------------------------------------------------------------


def catalogue(spark, sf_dir) -> Catalogue:
    """Assets are customers, attributes are parts, mappings are orders, rules are line items."""
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rule_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rules = lines.groupBy(rule_id.alias("rule_id")).agg(
        F.min("l_partkey").alias("target_attribute_id"), F.min("l_returnflag").alias("rule_type"),
        F.to_date(F.min("l_shipdate")).alias("valid_from"), F.to_date(F.max("l_shipdate")).alias("valid_to"),
    ).select(
        "rule_id", F.concat(F.lit("rule "), "rule_id").alias("rule_name"), F.lit("from a line").alias("rule_description"),
        "rule_type", "target_attribute_id", F.lit("x").alias("target_attribute_value"), "valid_from", "valid_to",
    )
    return Catalogue({
        "data_assets": customer.select(
            F.col("c_custkey").alias("data_asset_id"), F.col("c_mktsegment").alias("domain"), F.col("c_name").alias("asset_name"),
            F.lit("a customer").alias("asset_description"), F.lit("bronze").alias("medallion_layer"),
            F.lit("scratch").alias("container"), F.concat(F.lit("/feed/"), "c_custkey").alias("feed_path"),
        ),
        "data_attributes": part.select(
            F.col("p_partkey").alias("data_attribute_id"), F.col("p_name").alias("attribute_name"),
            F.col("p_brand").alias("attribute_description"), F.col("p_type").alias("attribute_type"),
            F.col("p_size").alias("attribute_length"), F.lit(None).cast("string").alias("external_source"),
        ),
        "data_asset_attributes": lines.select(
            F.col("l_orderkey").alias("data_asset_id"), F.col("l_partkey").alias("data_attribute_id")
        ).distinct(),
        "mappings": orders.select(
            F.col("o_orderkey").alias("map_id"), F.concat(F.lit("map "), "o_orderkey").alias("map_name"),
            F.col("o_orderpriority").alias("map_description"), F.col("o_custkey").alias("from_asset_id"),
            (F.col("o_custkey") + 1).alias("to_asset_id"), F.lit(0).alias("target_attr_value_id"),
        ),
        "mapping_rules": rules,
        "mapping_rule_assignments": lines.select(
            F.col("l_orderkey").alias("map_id"), rule_id.alias("rule_id"), F.col("l_linenumber").alias("step_number")
        ).distinct(),
        "mapping_rule_parts": lines.select(
            rule_id.alias("rule_id"), F.col("l_suppkey").alias("step_number"), F.lit("=").alias("comparison_operator"),
            F.col("l_partkey").alias("feed_attribute_id"), F.col("l_quantity").cast("string").alias("feed_attribute_value"),
        ),
    })


_CATALOGUE = """
WITH rule AS (
  SELECT l_orderkey * 10 + l_linenumber AS rule_id, min(l_partkey) AS target_attribute_id, min(l_returnflag) AS rule_type,
    CAST(min(l_shipdate) AS DATE) AS valid_from, CAST(max(l_shipdate) AS DATE) AS valid_to
  FROM lineitem GROUP BY 1),
assignment AS (SELECT DISTINCT l_orderkey AS map_id, l_orderkey * 10 + l_linenumber AS rule_id, l_linenumber AS step_number FROM lineitem)
"""


@query("j7_mapping_lineage", _CATALOGUE + """
SELECT 'map ' || o_orderkey AS map_name, o_custkey AS from_asset_id, f.c_name AS from_asset_name, o_custkey + 1 AS to_asset_id,
  t.c_name AS to_asset_name, step_number AS rule_priority, rule_id, 'rule ' || rule_id AS rule_name, rule_type,
  p_name AS target_attribute_name, p_type AS target_attribute_type
FROM orders JOIN customer f ON f.c_custkey = o_custkey JOIN customer t ON t.c_custkey = o_custkey + 1
JOIN assignment ON map_id = o_orderkey JOIN rule USING (rule_id) JOIN part ON p_partkey = target_attribute_id""")
def j7(spark, sf_dir):
    return catalogue(spark, sf_dir).lineage()


@query("j8_rule_parts", _CATALOGUE + """
SELECT rule_id, 'rule ' || rule_id AS rule_name, rule_type, l_suppkey AS rule_part_priority, '=' AS comparison_operator,
  t.p_name AS target_attribute_name, t.p_type AS target_attribute_type, s.p_name AS rule_part__attribute_name,
  s.p_type AS rule_part__attribute_type, CAST(l_quantity AS VARCHAR) AS feed_attribute_value
FROM lineitem JOIN rule ON rule_id = l_orderkey * 10 + l_linenumber
JOIN part s ON s.p_partkey = l_partkey JOIN part t ON t.p_partkey = target_attribute_id""")
def j8(spark, sf_dir):
    return catalogue(spark, sf_dir).rule_parts()


@query("j9_asset_attributes", """
SELECT data_asset_id, p_partkey AS data_attribute_id, p_name AS attribute_name, p_brand AS attribute_description,
  p_type AS attribute_type, p_size AS attribute_length, CAST(NULL AS VARCHAR) AS external_source
FROM (SELECT DISTINCT l_orderkey AS data_asset_id, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey""")
def j9(spark, sf_dir):
    return catalogue(spark, sf_dir).asset_attributes()


@query("j10_mapper_rules", _CATALOGUE + """
SELECT map_id, rule_id, 'rule ' || rule_id AS rule_name, 'from a line' AS rule_description, rule_type, target_attribute_id,
  'x' AS target_attribute_value, valid_from, valid_to FROM assignment JOIN rule USING (rule_id)""")
def j10(spark, sf_dir):
    return catalogue(spark, sf_dir).mapper_rules()


@query("j11_assets", """
SELECT c_custkey AS data_asset_id, c_mktsegment AS domain, c_name AS asset_name, 'a customer' AS asset_description,
  'bronze' AS medallion_layer, 'scratch' AS container, '/feed/' || c_custkey AS feed_path FROM customer""")
def j11_assets(spark, sf_dir):
    return catalogue(spark, sf_dir).assets()


@query("j11_attributes", """
SELECT p_partkey AS data_attribute_id, p_name AS attribute_name, p_brand AS attribute_description, p_type AS attribute_type,
  p_size AS attribute_length, CAST(NULL AS VARCHAR) AS external_source FROM part""")
def j11_attributes(spark, sf_dir):
    return catalogue(spark, sf_dir).attributes()


@query("j11_mappings", """
SELECT o_orderkey AS map_id, 'map ' || o_orderkey AS map_name, o_orderpriority AS map_description, o_custkey AS from_asset_id,
  o_custkey + 1 AS to_asset_id, 0 AS target_attr_value_id FROM orders""")
def j11_mappings(spark, sf_dir):
    return catalogue(spark, sf_dir).mappings()


@query("j11_rules", _CATALOGUE + """
SELECT rule_id, 'rule ' || rule_id AS rule_name, 'from a line' AS rule_description, rule_type, target_attribute_id,
  'x' AS target_attribute_value, valid_from, valid_to FROM rule""")
def j11_rules(spark, sf_dir):
    return catalogue(spark, sf_dir).rules()


@query("j11_parts", """
SELECT l_orderkey * 10 + l_linenumber AS rule_id, l_suppkey AS step_number, '=' AS comparison_operator,
  l_partkey AS feed_attribute_id, CAST(l_quantity AS VARCHAR) AS feed_attribute_value FROM lineitem""")
def j11_parts(spark, sf_dir):
    return catalogue(spark, sf_dir).parts()
