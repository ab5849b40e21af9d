"""Operator 10: weighted rendezvous hashing of record keys over shards.

Every shard draws a number from (key, shard); the shard with the smallest -ln(u) / weight gets the row.
The draw of a shard does not depend on the others, so a further shard takes rows only into itself and a
removed one gives away only its own.

Slots are gapless from 0 within a shard. A shard is cut into hash buckets of its keys; a window numbers
the rows of one bucket, and the counts of all earlier buckets (shards x buckets rows, a fixed bound) are
added. No task holds a whole shard.

Null keys count as an empty text, null texts have size 1 and checksum 0, repeated rows get slots of
their own, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read, sql_uniform, text_of, uniform

SHARDS = 16
BUCKETS = 256


def _draws(key: Column, weights: Sequence[float]) -> list[Column]:
    return [
        F.struct((-F.log(uniform(key, str(k))) / F.lit(float(w))).alias("draw"), F.lit(k).alias("shard"))
        for k, w in enumerate(weights)
    ]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key for shards of these weights (positive numbers)."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    if len(weights) == 1:
        return F.lit(0)
    return F.least(*_draws(key, weights))["shard"]


def with_slots(df: DataFrame, order: Sequence[str], key: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``slot``, the gapless position of a row in its ``shard``; ``order`` settles rows of one bucket.

    A row's bucket depends on its key; where more than a bucket's rows share one key, they stay in its
    bucket, as a key is meant to name a record.
    """
    placed = df.withColumn("_bucket", F.floor(uniform(F.col(key), "slot") * buckets).cast("int"))
    shard = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_bucket", F.coalesce(F.sum("_rows").over(shard), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy(*order)
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(F.broadcast(before), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long"))
        .drop("_bucket", "_at", "_before")
    )


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", grown_weight: float = 1.0) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (its shard were there one more of ``grown_weight``)."""
    more = list(weights) + [grown_weight]
    return docs.withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), more)})


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """Digest rows: key, size, checksum, shard, slot, shard after growth."""
    keyed = docs.select(
        key,
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(assign(keyed, [1.0] * shards, key), [key, "size", "text_crc32"], key)
    return placed.withColumn("law", F.lit("key"))


def placed(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` put over columns of these names."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col(f"`{key}`").alias("_key"),
        F.xxhash64(text_of()).alias("_order"),
    )
    assigned = packed.withColumn("shard", rendezvous(F.col("_key"), [1.0] * shards))
    return with_slots(assigned, ["_key", "_order"], "_key").select("_row.*", "shard", "slot")


def _sql() -> str:
    def draws(n: int) -> str:
        one = [f"{{'draw': -ln({sql_uniform(f"k || ':{i}'")}), 'shard': {i}}}" for i in range(n)]
        return f"list_min([{', '.join(one)}]).shard"

    return f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
doc AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, strlen(coalesce(text, '')) + 1 AS size,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents),
summed AS (
  SELECT doc_id, k, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(1, len(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
             lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295) AS text_crc32
  FROM doc, crc),
placed AS (
  SELECT *, {draws(SHARDS)} AS shard, {draws(SHARDS + 1)} AS grown_shard,
         floor({sql_uniform("k || ':slot'")} * {BUCKETS}) AS bucket
  FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""


@query("op10_rendezvous_shards", _sql())
def rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
