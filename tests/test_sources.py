import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from earnloom.operators import blocks as bl, patterns
from earnloom.plans import results
from earnloom.sources import catalog, documents, fasta, files, tables


def test_pattern_csv_tables(spark, tmp_path):
    (tmp_path / documents.ALLOCATION_FILE).write_text("coverage_id,writing_premium_pattern_id,pattern_start_date\n101,1001,2023-01-01 00:00:00\n")
    (tmp_path / documents.FACTOR_FILE).write_text("pattern_id,period_frequency,period,factor_value,duration\n1001,QS,1,0.1284,360.9\n")
    (tmp_path / documents.PATTERN_FILE).write_text("pattern_id,pattern_name\n1001,Classic 4 quarters\n")
    allocations, factors, names = documents.read_pattern_tables(spark, str(tmp_path))
    assert tuple(allocations.first()) == (101, 1001, dt.date(2023, 1, 1))
    assert tuple(factors.first()) == (1001, "QS", 1, 0.1284, 360)
    assert names.first()["pattern_name"] == "Classic 4 quarters"


def test_pattern_csv_columns_in_another_order(spark, tmp_path):
    (tmp_path / documents.ALLOCATION_FILE).write_text("pattern_start_date,coverage_id,note,writing_premium_pattern_id\n2023-01-01,101,x,1001\n")
    (tmp_path / documents.FACTOR_FILE).write_text("pattern_id,period,period_frequency,factor_value,duration\n1001,1,QS,0.1284,360\n")
    (tmp_path / documents.PATTERN_FILE).write_text("pattern_name,pattern_id\nClassic,1001\n")
    allocations, factors, names = documents.read_pattern_tables(spark, str(tmp_path))
    assert tuple(allocations.first()) == (101, 1001, dt.date(2023, 1, 1))
    assert tuple(factors.first()) == (1001, "QS", 1, 0.1284, 360) and tuple(names.first()) == (1001, "Classic")
    (tmp_path / documents.PATTERN_FILE).write_text("name,pattern_id\nClassic,1001\n")
    with pytest.raises(ValueError, match="pattern_name"):
        documents.read_pattern_tables(spark, str(tmp_path))


def test_shared_folder_is_needed_on_a_cluster():
    from earnloom import session

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_config_documents(spark, tmp_path):
    plain = {"insuredPeriodStartDate": "2024-08-02", "defaultDuration": 360, "incurredTimeUnit": "quarter", "exposedTimeUnit": "QUARTER",
             "unknown": 1, "endOfPeriod": True, "ultimateValues": [{"type": "premium", "value": 100.0}, {"type": "costs"}],
             "elements": [{"type": "quarter", "initial": 0.1284, "distribution": 0.2179}, {"type": "QUARTER", "distribution": 0.6537, "duration": 90}]}
    (tmp_path / "first.json").write_text(json.dumps(plain, indent=2))
    (tmp_path / "second.json").write_text(json.dumps({**plain, "precision": 3, "calendar": False, "linear": True}, indent=2))
    configs = patterns.config_elements(documents.read_configs(spark, str(tmp_path)))
    rows = {r["config_id"]: r for r in configs.collect()}
    assert (rows["first"]["precision"], rows["first"]["calendar"], rows["first"]["linear"]) == (6, True, False)
    assert (rows["second"]["precision"], rows["second"]["calendar"], rows["second"]["linear"]) == (3, False, True)
    assert [(e["ord"], e["unit"], e["up_front_days"], e["distribution_days"]) for e in rows["first"]["elements"]] == [
        (0, "QUARTER", 360, 360), (1, "QUARTER", 360, 90)]
    total = results.result(configs, "FFC").agg(F.sum("value")).first()[0]
    assert total == pytest.approx(1.0)
    assert results.result(configs, "FFM", linear=True).select("config_id").distinct().first()[0] == "second"
    assert results.book_result(configs, "FFM").select("config_id").distinct().count() == 2
    unknown = configs.withColumn("exposed_unit", F.lit("HALFYEAR")) if "exposed_unit" in configs.columns else None
    if unknown is not None:
        with pytest.raises(Exception, match="HALFYEAR"):
            results.result(unknown, "FFM").collect()
    cells = results.result(configs, "FFC").join(configs.select("config_id", "ultimates"), "config_id")
    amounts = patterns.apply_ultimates(cells, "ultimates").groupBy("ultimate_type").agg(F.sum("value").alias("v"))
    assert {r[0]: round(r[1], 6) for r in amounts.collect()} == {"PREMIUM": 100.0, "COSTS": 1.0}


def test_factor_listing_of_a_document(spark):
    rows = [("d", dt.date(2024, 1, 1), True, [(0, "WEEK", 0.5, 2, 0.5, 2)])]
    configs = spark.createDataFrame(rows, f"config_id string, start_date date, calendar boolean, elements {patterns.ELEMENTS_TYPE}")
    listed = results.factor_listing(results.config_factors(configs), ["config_id"]).collect()
    assert len(listed) == 2 + 7 * 3
    assert sorted(listed, key=lambda r: (r["incurred_date"], r["exposed_date"])) == listed
    assert {r["factor_type"] for r in listed} == {"UPFRONT", "DIST"}


def test_scenarios_keep_broken_documents_apart(spark, tmp_path):
    good = {"group": "g", "key": "eq", "name": "Quake", "releasable": True, "factors": [{"type": "Q", "distribution": 0.25}] * 4}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "bad.json").write_text('{"key": "fl", "factors": [ {"type": "Q", "distribution": 1 ]')
    scenarios = documents.read_scenarios(spark, str(tmp_path)).cache()
    assert scenarios.filter("corrupt is not null").count() == 1
    elements = patterns.scenario_elements(scenarios.filter("corrupt is null")).orderBy("ord").collect()
    assert [(e["ord"], e["distribution"], e["distribution_days"]) for e in elements] == [(i, 0.25, 360) for i in range(4)]


def test_pattern_and_block_documents(spark, tmp_path):
    rows = [("p", 0, 0.4, 0.2, 360), ("p", 1, 0.2, 0.2, 360)]
    df = spark.createDataFrame(rows, "pattern string, element_number int, distribution double, start_distribution double, duration int")
    aligned = bl.align_elements(df)
    documents.write_patterns(aligned, str(tmp_path / "patterns"))
    back = documents.read_patterns(spark, str(tmp_path / "patterns"))
    columns = sorted(aligned.columns)
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, aligned.select(columns).collect()))
    made = bl.apply_ultimate(bl.pattern_blocks(aligned), 10.0)
    documents.write_blocks(made, str(tmp_path / "blocks"))
    same = documents.read_blocks(spark, str(tmp_path / "blocks"))
    assert sorted(map(tuple, same.select(made.columns).collect())) == sorted(map(tuple, made.collect()))


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">one alpha >x\r\nACGT\r\nAC\r\n>two beta\nGG\n>three alpha\n\nTT\n")
    records = fasta.read_fasta(spark, str(path))
    assert {(r["header"], r["sequence"]) for r in records.collect()} == {("one alpha >x", "ACGTAC"), ("two beta", "GG"), ("three alpha", "TT")}
    assert fasta.filter_by_header(records, "alpha").count() == 2
    assert fasta.first_header(records, "alpha").first()["header"] == "one alpha >x"
    assert fasta.first_header(records, "none").first()["header"] is None


@pytest.mark.parametrize("split_bytes,lines", [(70, 2), (200, 3), (100_000, 1), (100_000, 1000)])
def test_fasta_records_over_several_splits(spark, tmp_path, split_bytes, lines):
    rnd = random.Random(split_bytes)
    records = [("long one", "".join(rnd.choice("ACGT") for _ in range(2300))), ("empty", ""), ("short", "ACG"), ("long two", "GATTACA" * 90), ("last", "T")]
    text = "lost line\n" + "".join(f">{name} \n" + "".join(body[i : i + 30] + "\n" for i in range(0, len(body), 30)) + "\n" for name, body in records)
    (tmp_path / "one.fasta").write_text(text)
    (tmp_path / "two.fasta").write_text(">other\r\nAC GT\r\n>more\r\n" + "TTTT\r\n" * 40)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], split_bytes)
        spark.conf.set(names[1], 1)
        rows = fasta.read_fasta_chunks(spark, str(tmp_path), lines).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    whole = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["record"], r["chunk"])):
        assert 0 < len(r["sequence"]) <= 30 * lines
        place = whole.setdefault((r["source"].rsplit("/", 1)[1], r["record"]), [r["header"], [], ""])
        place[1].append(r["chunk"])
        place[2] += r["sequence"]
    assert all(chunks == list(range(1, len(chunks) + 1)) for _, chunks, _ in whole.values())
    assert {k: (h, s) for k, (h, _, s) in whole.items()} == {
        **{("one.fasta", i): record for i, record in enumerate(records, 1) if record[1]},
        ("two.fasta", 1): ("other", "ACGT"), ("two.fasta", 2): ("more", "TTTT" * 40),
    }


def test_fasta_chunks_read_the_lines_once(spark, tmp_path):
    """What is left after the call reads the pieces; lines are not read, shuffled and sorted again for the splits' places."""
    (tmp_path / "one.fasta").write_text("".join(f">r{i}\nAC\n\nGT\n" for i in range(20)) + ">\n>last\nT\n")
    made = fasta.read_fasta_chunks(spark, str(tmp_path), 1)
    assert "] text" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r["record"], r["header"], r["chunk"], r["sequence"]) for r in made.collect())
    assert rows == [(i + 1, f"r{i}", k, s) for i in range(20) for k, s in ((1, "AC"), (2, "GT"))] + [(22, "last", 1, "T")]


def test_files(spark, tmp_path):
    source = str(tmp_path / "a.parquet")
    df = spark.createDataFrame([(1, "x;y"), (2, None)], "a int, b string")
    files.write_parquet(df, source, "snappy")
    files.parquet_to_csv(spark, str(tmp_path / "a.p*"), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), sep=";").collect())) == [(1, "x;y"), (2, None)]
    files.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "b"), sep=";")
    assert files.read_parquet(spark, str(tmp_path / "b")).count() == 2
    described, first = files.describe_parquet(spark, source, 1)
    assert [tuple(r) for r in described.collect()] == [(0, "a", "int"), (1, "b", "string")] and first.count() == 1


@pytest.fixture
def schema(spark, tmp_path):
    spark.sql(f"CREATE SCHEMA trial LOCATION '{tmp_path}/trial'")
    yield "trial"
    spark.sql("DROP SCHEMA trial CASCADE")


def test_checked_load_and_dump(spark, tmp_path, schema):
    tables.create_table(spark, "trial.t", "a int, b decimal(10,2), c struct<x:int>", overwrite=True)
    with pytest.raises(ValueError, match="does not exist"):
        tables.load_parquet_to_table(spark, "x", "trial.none")
    tables.create_table(spark, "trial.u", "a int, b string")
    spark.createDataFrame([(1, "x")], "b int, a string").write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(ValueError, match="do not match"):
        tables.load_parquet_to_table(spark, str(tmp_path / "wrong"), "trial.u")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "right"))
    tables.load_parquet_to_table(spark, str(tmp_path / "right"), "trial.u")
    tables.extract_table(spark, "trial.u", str(tmp_path / "dump" / "01_u.csv"))
    tables.load_schema(spark, "trial", str(tmp_path / "dump"))
    assert spark.table("trial.u").count() == 2
    tables.load_schema(spark, "trial", str(tmp_path / "dump"), truncate=True)
    assert spark.table("trial.u").count() == 1
    assert tables.table_of_file("01_u.csv") == "u" and tables.table_of_file("data_assets.csv") == "data_assets"
    with pytest.raises(ValueError):
        tables.extract_query(spark, "DELETE FROM trial.u", str(tmp_path / "no"))
    with pytest.raises(ValueError, match="expected 1"):
        tables.prepared_query(spark, "SELECT * FROM trial.u WHERE a = ?", [])


def test_a_bad_file_leaves_all_tables_as_they_were(spark, tmp_path, schema):
    for name in ("aa", "bb"):
        tables.create_table(spark, f"{schema}.{name}", "k int, v string, p int", partition_by=["p"])
        spark.createDataFrame([(1, "old", 1)], "k int, v string, p int").write.insertInto(f"{schema}.{name}")
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "1_aa.csv").write_text("k;v;p\n2;new;2\n")
    (folder / "2_bb.csv").write_text("k;v\n9;new\n")
    for truncate in (False, True):
        with pytest.raises(Exception):
            tables.load_schema(spark, schema, str(folder), truncate=truncate)
        for name in ("aa", "bb"):
            assert [tuple(r) for r in spark.table(f"{schema}.{name}").collect()] == [(1, "old", 1)]
    (folder / "2_bb.csv").write_text("p;k;v\n2;9;new\n")
    assert tables.load_schema(spark, schema, str(folder)) == [f"{schema}.aa", f"{schema}.bb"]
    assert sorted(tuple(r) for r in spark.table(f"{schema}.bb").collect()) == [(1, "old", 1), (9, "new", 2)]
    plan = spark.table(f"{schema}.bb").filter("p = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    assert tables.load_schema(spark, schema, str(folder), truncate=True) and spark.table(f"{schema}.bb").count() == 1


def test_named_query_binds_values(spark, tmp_path):
    spark.createDataFrame([(1, "it's"), (2, "b")], "k int, name string").createOrReplaceTempView("named")
    (tmp_path / "q.sql").write_text("SELECT k, name FROM named WHERE name = '{name}' OR k = {k}")
    found = tables.as_json(tables.named_query(spark, "q", str(tmp_path), {"name": "it's", "k": 5})).collect()
    assert [r["json"] for r in found] == ['{"k":1,"name":"it\'s"}']


def test_catalogue_tables_and_queries(spark, tmp_path):
    names = catalog.create_catalogue(spark, str(tmp_path), overwrite=True)
    assert len(names) == 13 and all(spark.catalog.tableExists(n) for n in names)

    def put(table, rows, columns):
        name = f"data_language.{table}"
        spark.createDataFrame(rows, columns).select(
            *[F.col(f.name).cast(f.dataType) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.table(name).schema]
        ).write.insertInto(name)

    put("data_assets", [(1, "in"), (2, "out")], ["data_asset_id", "asset_name"])
    put("data_attributes", [(7, "city", "STRING"), (8, "level", "INTEGER")], ["data_attribute_id", "attribute_name", "attribute_type"])
    put("data_asset_attributes", [(1, 7), (2, 8)], ["data_asset_id", "data_attribute_id"])
    put("mappings", [(3, "m", 1, 2), (4, "n", 2, 1)], ["map_id", "map_name", "from_asset_id", "to_asset_id"])
    put("mapping_rules", [(5, "r5", 8), (6, "r6", 8)], ["rule_id", "rule_name", "target_attribute_id"])
    put("mapping_rule_assignments", [(3, 6, 1), (3, 5, 2), (4, 5, 1)], ["map_id", "rule_id", "step_number"])
    put("mapping_rule_parts", [(5, 2, "=", 7, "a"), (5, 1, "!=", 8, "b")],
        ["rule_id", "step_number", "comparison_operator", "feed_attribute_id", "feed_attribute_value"])
    found = catalog.Catalogue.of(spark)
    assert [(r["rule_priority"], r["rule_name"], r["from_asset_name"]) for r in found.lineage("m").collect()] == [(1, "r6", "in"), (2, "r5", "in")]
    assert [(r["rule_part_priority"], r["rule_part__attribute_name"]) for r in found.rule_parts(5).collect()] == [(1, "level"), (2, "city")]
    assert [r["attribute_name"] for r in found.asset_attributes(1).collect()] == ["city"]
    assert sorted(r["rule_id"] for r in found.mapper_rules(3).collect()) == [5, 6]
    assert found.assets(2).first()["asset_name"] == "out" and found.mappings().count() == 2
    assert [r["step_number"] for r in found.parts(5).collect()] == [1, 2]
    spark.sql("DROP SCHEMA data_language CASCADE")
    spark.sql("DROP SCHEMA pattern CASCADE")


def test_script(spark):
    ran = tables.run_script(spark, "CREATE OR REPLACE TEMPORARY VIEW one AS SELECT 1 AS a;\nCREATE OR REPLACE TEMPORARY VIEW two AS\n SELECT a + 1 AS b FROM one;\n")
    assert ran == 2 and spark.table("two").first()["b"] == 2


def test_block_documents_are_compressed(spark, tmp_path):
    blocks = spark.range(2_000).select(
        F.lit("p").alias("pattern"), F.col("id").cast("int").alias("element_number"), F.lit(0).alias("written_element"),
        *[F.lit(0.5).alias(c) for c in ("start_point", "end_point", "proportion", "ultimate_value")], F.lit("FIRST").alias("shape"),
    )
    documents.write_blocks(blocks, str(tmp_path / "packed"))
    documents.write_blocks(blocks, str(tmp_path / "plain"), compression=None)
    packed, plain = (sum(f.stat().st_size for f in (tmp_path / p).glob("part-*")) for p in ("packed", "plain"))
    assert 10 * packed < plain
    assert documents.read_blocks(spark, str(tmp_path / "packed")).exceptAll(blocks).count() == 0
