"""FASTA sequence files: one row per record, or one per piece of a record where records may be long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import pinned

# Lines of a piece: some 600 KB at 60 letters a line.
CHUNK_LINES = 10_000


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``source, header, sequence``; records end before a ``>`` at a line start, so big files split."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("source"), "value")
    body = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r\n?", "\n")
    lines = F.split(body, "\n", 2)
    return raw.filter(F.trim("value") != "").select(
        "source",
        F.trim(F.get(lines, F.lit(0))).alias("header"),
        F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"),
    )


def read_fasta_chunks(spark: SparkSession, path: str, lines: int = CHUNK_LINES) -> DataFrame:
    """``source, record, header, chunk, sequence``: the sequence in pieces of at most ``lines`` lines.

    ``record`` and ``chunk`` count from 1 within a file and a record. Files are read by lines, so a record
    of any length goes over as many file splits as it has, and no row holds more than a piece. Inside a split
    windows of one order number its headers and lines, so lines are shuffled and sorted once; the pieces are
    written to the shared folder when this is called; which record a split begins in, and how many pieces that record had before,
    follows from one row per split by a running sum that starts again at each header. Lines before the first
    header of a file belong to no record and are left out, empty lines and blanks count for nothing; pieces end with a split too.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),  # lines of a split are in order in one task
        F.regexp_replace("value", r"\s+$", "").alias("_line"),
    )
    # one order for all: running numbers of headers and lines, and the header a line stands under
    inside = Window.partitionBy("source", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("_line").startswith(">")
    numbered = (
        raw.withColumns({"_head": head, "_text": F.regexp_replace("_line", r"\s", "")})
        .filter("_head OR _text <> ''")
        .withColumns({
            "_part": F.sum(F.col("_head").cast("int")).over(inside),
            "_row": F.row_number().over(inside),
            "_header": F.last(F.when(F.col("_head"), F.trim(F.substr("_line", F.lit(2)))), ignorenulls=True).over(inside),
        })
        .withColumn("_no", F.col("_row") - F.coalesce(F.max(F.when(F.col("_head"), F.col("_row"))).over(inside), F.lit(0)))
        .withColumn("_chunk", F.when(F.col("_head"), 0).otherwise(F.floor((F.col("_no") - 1) / lines) + 1).cast("long"))
    )
    # pieces, and a row of chunk 0 per header; written once, as the places of the splits are read from them too
    pieces = pinned(
        numbered.groupBy("source", "_split", "_part", "_chunk")
        .agg(
            F.max("_header").alias("_header"),
            F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("_at", "_text")))).alias("_texts"),
        )
        .select("source", "_split", "_part", "_chunk", "_header", F.array_join("_texts._text", "").alias("sequence"))
    )
    place = F.struct("_part", "_chunk")
    splits = pieces.groupBy("source", "_split").agg(
        F.max("_part").cast("long").alias("_heads"),
        F.max_by("_chunk", place).alias("_tail"),
        F.max_by("_header", place).alias("_last"),
    )
    earlier = Window.partitionBy("source").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    entered = F.col("_heads") > 0
    summed = splits.withColumn("_sum", F.coalesce(F.sum("_tail").over(earlier), F.lit(0)))
    carried = summed.select(
        "source",
        "_split",
        F.coalesce(F.sum("_heads").over(earlier), F.lit(0)).alias("_records"),
        F.last(F.when(entered, F.col("_last")), ignorenulls=True).over(earlier).alias("_open"),
        # pieces since the split in which the open record began
        (F.col("_sum") - F.coalesce(F.last(F.when(entered, F.col("_sum")), ignorenulls=True).over(earlier), F.lit(0))).alias("_before"),
    )
    first = F.col("_part") == 0
    placed = pieces.filter("_chunk > 0").join(F.broadcast(carried), ["source", "_split"])  # a row per split
    return placed.select(
        "source",
        (F.col("_records") + F.col("_part")).alias("record"),
        F.when(first, F.col("_open")).otherwise(F.col("_header")).alias("header"),
        (F.col("_chunk") + F.when(first, F.col("_before")).otherwise(0)).alias("chunk"),
        "sequence",
    ).filter("record > 0")


def filter_by_header(records: DataFrame, pattern: str) -> DataFrame:
    return records.filter(F.col("header").rlike(pattern))


def first_header(records: DataFrame, pattern: str, position: str | None = None) -> DataFrame:
    """One row: the first matching header, null without a match.

    ``position`` names the column that gives the record order; without it the record's place in the
    scan is used.
    """
    placed = records.withColumn("_at", F.col(position) if position else F.monotonically_increasing_id())
    return filter_by_header(placed, pattern).agg(F.min_by("header", "_at").alias("header"))
