"""As-of and interval look-ups: each row with the nearest bound of its key, for any type that has an order.

Bounds and rows become one series in order of key (by its hash), position and, at one position, row hash. The
series is cut into blocks of about equal size at sampled places. A block is one task's share, whatever keys it holds: a
key, or a position, with most of the rows goes over many blocks (only equal rows stay together). Inside a block
a window carries the last bound on. What a key brings into a block is worked out from the bounds alone, for the keys that a
cut falls into, and joined to the block's rows: at most one such key a block. So all rows are
shuffled once, and nothing has a row per day or per tick.

Blocks are a function of the row, so a repeated task gives the same rows; the places only balance
the blocks. The driver sees some 2 * SAMPLES positions a block (MAX_BLOCKS at most), never rows.

Rows of a null key or position, and rows with no bound on that side, get nulls; bounds of a null key or
position are left out. Of several bounds at one position the one with the greatest columns, in the
order given, counts. Repeated rows stay repeated; either side may be empty. Columns of bounds need an order (no maps).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sorted_arrays import count_below

BLOCK_ROWS = 500_000
SAMPLES = 20
MAX_BLOCKS = 4096
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))


def _given(names: Sequence[str]) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & F.col(f"`{name}`").isNotNull()
    return test


def _tie(df: DataFrame) -> Column:
    """Spreads the rows of one position; always between the two marks that bounds have."""
    named = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.shiftright(F.xxhash64(*named), 1) if named else F.lit(0).cast("long")


def _cuts(series: DataFrame, block_rows: int) -> list[tuple]:
    """Places (hash, position, tie) that cut the series into blocks of about ``block_rows`` rows."""
    rows = series.count()
    blocks = min(-(-rows // block_rows), MAX_BLOCKS)
    if blocks < 2:
        return []
    share = min(1.0, 2.0 * SAMPLES * blocks / rows)
    sample = sorted(tuple(r) for r in series.filter("_at IS NOT NULL").select("_hash", "_at", "_tie").sample(share, seed=11).collect())
    return [sample[i * len(sample) // blocks] for i in range(1, blocks)] if len(sample) >= blocks else []


def _carried(marks: DataFrame, cuts: list[tuple], backward: bool) -> DataFrame:
    """(_key, _block, _before): the bound that a key cut in two brings into a block from the others before it."""
    spark = marks.sparkSession
    # going forward a block continues its key from the block below, going backward from the one above
    entered = [(i + 1 if backward else i, h) for i, (h, _, _) in enumerate(cuts)]
    wanted = F.broadcast(spark.createDataFrame(entered, "_block int, _hash long"))
    own = marks.join(wanted.select("_hash").distinct(), "_hash", "left_semi")
    per_place = own.groupBy("_key", "_hash", "_block", "_at").agg(F.max("_load").alias("_load"))
    edge = F.max if backward else F.min
    ends = per_place.groupBy("_key", "_hash", "_block").agg(edge(F.struct("_at", "_load")).alias("_end"))
    asked = ends.select("_key", "_hash").distinct().join(wanted, "_hash").select("_key", "_block", F.lit(True).alias("_asked"))
    every = ends.select("_key", "_block", F.lit(False).alias("_asked"), "_end").unionByName(asked, allowMissingColumns=True)
    place = F.col("_block") if backward else -F.col("_block")
    earlier = Window.partitionBy("_key").orderBy(place, F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        every.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier))
        .filter("_asked AND _before IS NOT NULL")
        .select("_key", "_block", F.col("_before._load").alias("_before"))
    )


def _nearest(
    rows: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str],
    at: str,
    bound_at: str,
    columns: Sequence[str],
    backward: bool,
    strict: bool,
    block_rows: int,
    open_below: bool = False,
) -> DataFrame:
    """``_row``, all columns of a row, and ``_load``, the columns c0, c1, ... of its bound."""
    own = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), _key(keys).alias("_key"),
        F.col(f"`{at}`").alias("_at"), _tie(rows).alias("_tie"), _given([*keys, at]).alias("_given"),
    )
    # at one position bounds come before the rows that may see them, in the direction of the search
    mark = _FIRST if backward != strict else _LAST
    marks = bounds.filter(_given(keys if open_below else [*keys, bound_at])).select(
        F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), _key(keys).alias("_key"),
        F.col(f"`{bound_at}`").alias("_at"), F.lit(mark).cast("long").alias("_tie"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("_load"),
    )
    nothing = F.lit(None).cast(marks.schema["_load"].dataType)
    seen = own.filter("_given").select("_row", "_key", "_at", "_tie", nothing.alias("_load"))
    if own.schema["_at"].dataType != marks.schema["_at"].dataType:
        raise ValueError(f"{at!r} and {bound_at!r} are of different types")
    series = marks.unionByName(seen).withColumn("_hash", F.xxhash64("_key"))
    cuts = _cuts(series, block_rows)
    kind = own.schema["_at"].dataType
    if cuts:
        places = F.array(*[
            F.struct(F.lit(h).cast("long").alias("h"), F.lit(p).cast(kind).alias("p"), F.lit(t).cast("long").alias("t")) for h, p, t in cuts
        ])
        here = F.struct(F.col("_hash").alias("h"), F.col("_at").alias("p"), F.col("_tie").alias("t"))
        series = series.withColumn("_block", count_below(places, here, or_equal=True, bits=len(cuts).bit_length()))
    else:
        series = series.withColumn("_block", F.lit(0))
    near = [F.col("_at").asc(), F.col("_tie").asc()] if backward else [F.col("_at").desc(), F.col("_tie").desc()]
    inside = Window.partitionBy("_block", "_key").orderBy(*near, "_load").rowsBetween(Window.unboundedPreceding, 0)
    found = series.withColumn("_here", F.last("_load", ignorenulls=True).over(inside)).filter("_row IS NOT NULL")
    if cuts:
        carried = F.broadcast(_carried(series.filter("_row IS NULL"), cuts, backward))
        found = found.join(carried, ["_key", "_block"], "left").withColumn("_here", F.coalesce("_here", "_before"))
    lost = own.filter(~F.col("_given")).select("_row", nothing.alias("_load"))
    return found.select("_row", F.col("_here").alias("_load")).unionByName(lost)


def _columns(rows: DataFrame, columns: Mapping[str, str]) -> list[str]:
    clash = set(columns) & set(rows.columns)
    if clash:
        raise ValueError(f"rows have columns of these names already: {sorted(clash)}")
    return list(columns.values())


def asof_join(
    rows: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str],
    at: str,
    bound_at: str,
    columns: Mapping[str, str],
    backward: bool = True,
    strict: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with columns of the last bound at or before their position (``backward=False``: first at or after).

    ``keys`` name the columns that both sides share (none: one series); ``columns`` maps new names to columns of
    ``bounds``. ``strict`` leaves out bounds at the row's own position.
    """
    taken = _columns(rows, columns)
    found = _nearest(rows, bounds, keys, at, bound_at, taken, backward, strict, block_rows)
    return found.select("_row.*", *[F.col(f"_load.c{i}").alias(n) for i, n in enumerate(columns)])


def interval_join(
    rows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    low: str,
    high: str,
    columns: Mapping[str, str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with columns of the interval of their key that holds their position, both ends included.

    A null ``low`` is open below, a null ``high`` open above. Intervals of a key should not overlap: where
    they do, only the one that starts last is looked at.
    """
    taken = _columns(rows, columns)
    found = _nearest(rows, intervals, keys, at, low, [high, *taken], True, False, block_rows, open_below=True)
    held = F.col("_load").isNotNull() & (F.col("_load.c0").isNull() | (F.col(f"_row.`{at}`") <= F.col("_load.c0")))
    return found.select("_row.*", *[F.when(held, F.col(f"_load.c{i + 1}")).alias(n) for i, n in enumerate(columns)])


def assign_bucket_from(
    df: DataFrame,
    position: str,
    bounds: DataFrame,
    bound: str,
    keys: Sequence[str] = (),
    to_end: bool = True,
    into: str = "bucket",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Bucket of each position from a table of ends (first at or after it) or starts (last at or before it)."""
    return asof_join(df, bounds, keys, position, bound, {into: bound}, backward=not to_end, block_rows=block_rows)
