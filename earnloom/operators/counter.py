"""Running row numbers over a whole frame without putting the frame into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import pinned

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def add_counter(df: DataFrame, column: str, order_by: Sequence | None = None) -> DataFrame:
    """Number the rows 1..n, in the frame's current order or by ``order_by``.

    By columns, only the distinct (order columns, row hash) are ranked: these narrow rows are sorted, pinned and counted
    up, and each row finds the number of its own by a join; rows that are equal in all columns take the numbers
    from there on in any order. A frame without an order, or one ordered by expressions, is pinned as a whole,
    since its order is not in its rows. Rows that tie are numbered by their hash, so repeated runs agree.
    """
    if order_by and all(isinstance(c, str) for c in order_by):
        return _by_rank(df, column, list(order_by))
    return _by_place(df, column, order_by)


def _plain(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def _numbers(placed: DataFrame, weight: Column) -> DataFrame:
    """``_part`` and ``_before``: the weight of all partitions before one, by a window over one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy("_part").agg(F.sum(weight).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )


def _by_rank(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    # a struct compares its nulls as equal, so null order values join as well
    key = F.struct(*[F.col(f"`{n}`").alias(f"o{i}") for i, n in enumerate(names)], F.xxhash64(*_plain(df)).alias("h"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    keyed = df.select(row, key.alias("_key"), F.hash(*_plain(df)).alias("_tie"))
    ranked = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).repartitionByRange("_key").sortWithinPartitions("_key")
    placed = pinned(ranked.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition is broadcast: a bound that does not depend on the number of rows
    first = (
        placed.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(F.broadcast(_numbers(placed, F.col("_rows"))), "_part")
        .select("_key", (F.col("_before") + F.col("_inside")).alias("_first"))
    )
    equal = Window.partitionBy("_key").orderBy("_tie")
    numbered = keyed.join(first, "_key").withColumn("_number", (F.col("_first") + F.row_number().over(equal)).cast("long"))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != column]
    return numbered.select(*kept, F.col("_number").alias(column))


def _by_place(df: DataFrame, column: str, order_by: Sequence | None) -> DataFrame:
    if order_by:
        # rows that tie are told apart by a hash, so that a frequent value is spread over tasks
        df = df.repartitionByRange(*order_by, F.xxhash64(*_plain(df))).sortWithinPartitions(*order_by)
    placed = pinned(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int"))
    numbered = placed.join(F.broadcast(_numbers(placed, F.lit(1))), "_part")
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    kept = [c for c in df.columns if c != column]
    return numbered.select(*kept, (F.col("_before") + within + 1).cast("long").alias(column))
