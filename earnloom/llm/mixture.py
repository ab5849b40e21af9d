"""Operator 8: mixing sources to target weights by Pareto order sampling.

Sources get a share of the words; a target stops at ``most`` times the source's own size and the rest is
shared again by weight. With r = target / size, every document of a source is taken floor(r) times for
certain. The rest of the target is a sample of fixed size in words: a document's inclusion chance is the
missing share, damped for documents longer than the source's mean, and documents are ranked by

    (u / (1 - u)) / (p / (1 - p)),   u from a digest of seed and document id, p the inclusion chance.

The lowest ranks are taken as long as they fit; the last place goes to the one remaining document whose
size comes nearest to the words still missing. So a source's taken words miss the target by less than
half of one document. Equal ranks are settled by id, size, source; reruns agree.

Running sums of a source are kept in bins of its ranks, so a source that holds most rows is spread over
tasks; only one row per (source, bin) and one per source are gathered. Sources are joined by broadcast
while they are at most BROADCAST_SOURCES, else by a shuffle that adaptive execution may split.

Null and empty texts have size 0 and are never taken; a null source is a source; repeated rows are ranked
each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read, sql_uniform, text_of, uniform, word_count
from earnloom.session import pinned

BROADCAST_SOURCES = 100_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BINS = 256
SEED = "mix"


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``n_docs``, ``target``.

    The level L of the shares solves sum(min(most * size, L * weight)) = share * total. Sources are put
    in order of most * size / weight; L is the largest of the levels that come out when all sources
    before one are capped. The table of sources is small, so its windows run in one task.
    """
    per_source = sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per_source.withColumn(
        "_weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumns(
        {
            "_cap": F.col("source_size") * F.lit(most),
            "_all": F.sum("source_size").over(everything) * F.lit(share),
        }
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    return (
        weighed.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .select(
            "source",
            "source_size",
            "n_docs",
            F.least(F.col("_cap"), F.col("_level") * F.col("_weight")).alias("target"),
        )
    )


def _keyed(df: DataFrame) -> DataFrame:
    """Null-safe join key of the source: no source text equals the key of null."""
    return df.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")))


def _ranked(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """Rows with what their source fixes (whole copies, words still to come) and their Pareto rank."""
    chance = F.least(
        F.lit(0.99),
        F.col("_share") * F.least(F.lit(1.0), F.sqrt(F.col("_mean") / F.greatest(F.col("size"), F.lit(1)))),
    )
    some = F.col("source_size") > 0
    return (
        _keyed(sized)
        .join(sources, "_source")
        .withColumn("_whole", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_mean", F.col("source_size") / F.col("n_docs"))
        .withColumn("_share", F.when(some, F.col("_rest") / F.col("source_size")).otherwise(0.0))
        .withColumn("_p", chance)
        .withColumn("_u", uniform(F.col("doc_id"), seed))
        # q / (1 + q) for the odds ratio q: the same order, between 0 and 1
        .withColumn("_low", F.col("_u") * (F.lit(1.0) - F.col("_p")))
        .withColumn("_rank", F.col("_low") / (F.col("_low") + (F.lit(1.0) - F.col("_u")) * F.col("_p")))
        .withColumn("_place", F.struct("_rank", "doc_id", "size"))
        .drop("_low", "_u", "_p", "_mean", "_share")
    )


def _side(frame: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(frame) if n_sources <= BROADCAST_SOURCES else frame


def cuts(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    bins: int = BINS,
) -> tuple[DataFrame, int]:
    """One row per source: its target, the last place taken (``_cut``), the document that fits the gap
    (``_fit``); and the number of sources. ``sized`` has doc_id, source, size.

    Rows that repeat id, source and size are one unit: taken or left together.
    """
    targets = pinned(_keyed(source_targets(sized, weights, share, most)).drop("source"))
    n_sources = targets.count()
    units = sized.filter(F.col("size") > 0).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = (
        _ranked(units, _side(targets, n_sources), seed)
        .withColumn("_words", F.col("size") * F.col("_rows"))
        .withColumn("_bin", F.floor(F.col("_rank") * bins).cast("int"))
        .select("_source", "_bin", "_place", "_words", "_rest")
    )
    inside = Window.partitionBy("_source", "_bin").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    inner = pinned(ranked.withColumn("_upto", F.sum("_words").over(inside)))
    earlier = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        inner.groupBy("_source", "_bin")
        .agg(F.max("_upto").alias("_all"))
        .select("_source", "_bin", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    )
    running = (
        inner.join(_side(offsets, n_sources * bins // 8), ["_source", "_bin"])
        .withColumn("_upto", F.col("_upto") + F.col("_before"))
        .withColumn("_in", F.col("_upto") <= F.col("_rest"))
    )
    taken = (
        running.groupBy("_source", "_rest")
        .agg(F.max(F.when(F.col("_in"), F.col("_upto"))).alias("_got"), F.max(F.when(F.col("_in"), F.col("_place"))).alias("_cut"))
        .select("_source", (F.col("_rest") - F.coalesce("_got", F.lit(0))).alias("_missing"), "_cut")
    )
    off = F.abs(F.col("_missing") - F.col("_words"))
    fit = (
        running.filter(~F.col("_in"))
        .join(_side(taken, n_sources), "_source")
        .filter(F.col("_words") < 2 * F.col("_missing"))
        .groupBy("_source")
        .agg(F.min(F.struct(off.alias("off"), "_place"))["_place"].alias("_fit"))
    )
    per_source = targets.join(taken, "_source", "left").join(fit, "_source", "left").drop("_missing")
    return pinned(per_source), n_sources


def sampled(sized: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """``sized`` (doc_id, source, size and any others) with ``source_size``, ``target``, ``copies``.

    The cuts are found over narrow rows; the documents themselves are compared with them where they are
    read, without a shuffle.
    """
    keys = sized.select("doc_id", "source", "size")
    per_source, n_sources = cuts(keys, seed=seed, **options)
    extra = F.coalesce(F.col("_place") <= F.col("_cut"), F.lit(False)) | F.coalesce(
        F.col("_place") == F.col("_fit"), F.lit(False)
    )
    copies = F.when(F.col("size") > 0, F.col("_whole") + extra.cast("int")).otherwise(0).cast("int")
    return _ranked(sized, _side(per_source, n_sources), seed).select(
        *[F.col(c) for c in sized.columns], "source_size", "target", copies.alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns; one row per copy.

    The columns go through as one struct, so names of their own never clash with those used here.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        "doc_id",
        "source",
        word_count(text_of()).alias("size"),
    )
    taken = sampled(packed, **options).filter(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


_SQL = f"""
WITH doc AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM doc GROUP BY source),
levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (
            ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
            ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
targets AS (SELECT source, source_size, n_docs, least(cap, max(level) OVER () * weight) AS target FROM levels),
drawn AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         CAST(t.source_size AS DOUBLE) / t.n_docs AS mean, {sql_uniform("coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'")} AS u
  FROM doc d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
chances AS (
  SELECT *, target - whole * source_size AS rest,
         least(0.99::DOUBLE, (CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END)
               * least(1.0::DOUBLE, sqrt(mean / greatest(size, 1)))) AS p
  FROM drawn),
ranks AS (SELECT *, u * (1.0::DOUBLE - p) / (u * (1.0::DOUBLE - p) + (1.0::DOUBLE - u) * p) AS rank FROM chances),
running AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS nth,
         sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM ranks),
gaps AS (
  SELECT *, rest - max(CASE WHEN upto <= rest THEN upto ELSE 0 END) OVER (PARTITION BY source) AS missing FROM running),
fits AS (
  SELECT *, row_number() OVER (
           PARTITION BY source
           ORDER BY CASE WHEN upto > rest AND size > 0 AND size < 2 * missing THEN 0 ELSE 1 END, abs(missing - size), rank, doc_id, size) AS best
  FROM gaps)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
            ELSE size * (whole + CASE WHEN upto <= rest OR (best = 1 AND size < 2 * missing) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM fits
"""


@query("op8_pareto_mixture", _SQL)
def pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(text_of()).alias("size"))
    return sampled(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )
