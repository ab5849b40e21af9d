"""Documents to a sharded training mix.

Quality rules, near-duplicates, benchmark decontamination, mixing and sharding, one after the other over
all documents. Every stage reads what its predecessor wrote to the shared folder and decides on nothing
else. All stages but the last return the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earnloom.llm import contamination, mixture, near_dedup, quality_rules, shards
from earnloom.llm.words import read, ship
from earnloom.session import pinned


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with references learned from these documents."""
    return quality_rules.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates, five-word shingles at 0.8."""
    ship(spark)
    return near_dedup.deduplicated(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap the benchmark by 5 % or more; shorter overlaps are cut out."""
    ship(spark)
    return contamination.cleaned(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken."""
    return mixture.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it; copies of one document share a shard."""
    return shards.placed(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]
# MinHash buckets and suffix links have no short form in SQL; tests hold run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
