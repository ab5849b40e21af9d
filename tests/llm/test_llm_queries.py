"""Registered queries of the subpackage next to their SQL, and the pipeline against plain loops."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare
from test_operators import BLANK, brute_components, brute_hits

SF_DIR = entry.SMALL
NO_SQL = {"op3_pairwise_quality", "op5_semi_markov", "op9_token_transducer", "op11_byte_pair_transducer", "pipeline"}


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return made


def test_names():
    assert {n.split("_")[0] for n in entry.LLM_QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(entry.LLM_QUERIES) - set(entry.LLM_SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(set(entry.LLM_QUERIES) - NO_SQL))
def test_query(spark, connection, name):
    verdict = compare(entry.LLM_QUERIES[name](spark, SF_DIR), connection, entry.LLM_SQL[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(NO_SQL - {"pipeline"}))
def test_rows(spark, name):
    assert entry.LLM_QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, next to plain loops over the same rows."""
    import corpus_pipeline
    from earnloom.llm import contamination, quality_rules
    from earnloom.session import pinned

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = pinned(stage(spark, docs, SF_DIR))
        seen[name] = (docs, made)
        if name != "sharding":
            assert made.columns == docs.columns
        docs = made
    before, after = seen["quality rules"]
    verdicts = {r["_row"]["doc_id"]: r["kept"] for r in quality_rules.judged(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, kept in verdicts.items() if kept}
    before, after = seen["minhash near-dedup"]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert {r["doc_id"] for r in after.collect()} == {top for _, top in groups.values()}
    before, after = seen["benchmark decontamination"]
    items = [(str(r["item_id"]), contamination.item_words(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = set()
    for r in before.collect():
        found = contamination.item_words(r["text"])
        hit, _ = brute_hits(found, items, contamination.WINDOW)
        if not hit or 20 * len(hit) < len(found):
            kept.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["mixing sources"]
    size = {r["doc_id"]: len(BLANK.findall(r["text"])) for r in before.collect()}
    taken = sum(size[r["doc_id"]] for r in after.collect())
    assert abs(taken - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    before, after = seen["sharding"]
    assert after.count() == before.count() and after.select("shard", "slot").distinct().count() == after.count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(r["doc_id"] for r in after.collect())
