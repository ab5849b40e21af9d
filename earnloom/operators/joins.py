"""Joins and running sums that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# A key with more rows than this is split into parts of about this size. N input rows have fewer than N / HOT_ROWS
# such keys (200,000 at a trillion rows), which bounds the list of them that is broadcast, and as many parts.
HOT_ROWS = 5_000_000


def hot_keys(left: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than hot_rows rows, and the number of parts each is split into."""
    return (
        counted_keys(left, keys)
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))
    )


def counted_keys(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its number of rows ``_rows`` (partial counts before the shuffle)."""
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large frame to a frame that has one row per key.

    With ``spread`` (columns whose hash places a row of a hot key) only the hot keys are salted, each into
    ceil(rows / hot_rows) parts: their right-hand row is repeated once per part, every other row is joined as
    it is. Where ``counted_keys`` of the same frame is used as well, Spark counts once. Without ``spread``
    the join is left to Spark, which broadcasts a side below its size threshold and splits skewed
    partitions at run time.
    """
    keys = list(keys)
    if not spread:
        return left.join(right, keys, how)
    hot = F.broadcast(hot_keys(left, keys, hot_rows))
    part = F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")
    salted_left = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(part, F.lit(0))).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(parts)).drop("_parts")
    return salted_left.join(salted_right, keys + ["_salt"], how).drop("_salt")


# Where keys repeat on both sides, rows of a key are paired in pieces: about this many rows of each side.
PAIRED_ROWS = 1_024


def has_repeated_keys(df: DataFrame, keys: Sequence[str], rows: int = PAIRED_ROWS) -> bool:
    """Whether some key has more than so many rows; looks at the frame right away."""
    return not counted_keys(df.dropna(subset=list(keys)), keys).filter(F.col("_rows") > rows).isEmpty()


def pairing_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int = PAIRED_ROWS) -> DataFrame:
    """Left join of frames whose keys repeat on both sides, so that a key makes very many pairs.

    A key of more than rows x rows pairs is cut into parts of its right-hand and slices of its left-hand rows, by
    the hash of their columns; a left row is repeated once per part and a right row once per slice, some rows x rows
    pairs meet in one piece, and pieces go over all tasks. Fewer than (rows of both sides) / (2 x rows) keys
    are cut, which bounds the list that is broadcast. Keys without a right-hand row are sliced too. Each
    pair is made once; equal rows of one side stay in one piece.
    """
    keys = list(keys)
    cell = rows * rows
    here = counted_keys(left.dropna(subset=keys), keys).withColumnRenamed("_rows", "_l")
    there = counted_keys(right.dropna(subset=keys), keys).withColumnRenamed("_rows", "_r")
    count = F.coalesce("_r", F.lit(1))
    cut = F.broadcast(
        here.join(there, keys, "left")
        .filter(F.col("_l") * count > cell)
        .select(
            *keys,
            F.ceil(count / rows).cast("int").alias("_parts"),
            F.ceil(F.col("_l") * F.least(count, F.lit(rows)) / cell).cast("int").alias("_slices"),
            F.col("_r").isNotNull().alias("_known"),
        )
    )

    def place(df: DataFrame, n: Column) -> Column:
        hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]  # those have no hash
        return F.pmod(F.xxhash64(*hashed), F.coalesce(n, F.lit(1))).cast("int")

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))

    # rows without a key meet nothing: they are dealt out by their hash
    keyless = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    cells = [*keys, "_part", "_slice"]
    many = left.join(cut, keys, "left").select(
        *left.columns,
        F.coalesce("_known", F.lit(False)).alias("_known"),
        place(left, F.when(keyless, F.lit(rows)).otherwise(F.col("_slices"))).alias("_slice"),
        numbers("_parts").alias("_part"),
    )
    found = right.join(cut, keys, "left").select(
        *right.columns, F.lit(True).alias("_met"), place(right, F.col("_parts")).alias("_part"), numbers("_slices").alias("_slice")
    )
    # few rows that make many: the number of tasks must not be judged by their bytes
    joined = spread_rows(many, cells).join(spread_rows(found, cells), cells, "left")
    # a part may have got no row; the key has some in the others
    paired = joined.filter(~F.col("_known") | F.col("_met"))
    return paired.select(*left.columns, *[c for c in right.columns if c not in keys])


# Where the number of rows is known, a task is given about this many of those that ``spread_rows`` deals out.
SPREAD_ROWS = 150_000


def spread_rows(df: DataFrame, keys: Sequence[str], rows: int = 0, spread: int = SPREAD_ROWS) -> DataFrame:
    """Hash-partition rows that are few and small but expand to very many.

    Partition sizes are judged by bytes, so such rows would end up in one task and be expanded there.
    A given number of partitions is kept as it is; later groupings by these keys need no other shuffle.
    With ``rows``, the number of rows that are dealt out, partitions become more as the rows do, so that
    what a task holds of them does not grow with the table.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // spread))
    return df.repartition(n, *keys)


def _blocked(df: DataFrame, position: str, block: int) -> DataFrame:
    number = F.unix_date(F.col(position)) if dict(df.dtypes)[position] == "date" else F.col(position)
    return df.withColumn("_block", F.floor(number / block).cast("long"))


def with_key_frames(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    totals: dict[str, tuple[Callable[[Column], Column], Column]] | None = None,
    sums: dict[str, Column] | None = None,
    block: int = 4096,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add aggregates over all rows of a key, and running sums within it, to each of its rows.

    Positions (integers or dates) are cut into blocks. ``totals`` maps a name to (function, input); the
    function (sum, min, max, bool_and) is applied per block and again over the blocks of the key.
    ``sums`` maps a name to an input: a window runs inside one block and the sum of all earlier blocks
    is added. ``order`` settles rows of the same position. What belongs to the key comes back by one
    join per block, so no task holds more than a block of a key, or one row per block of a key,
    however many rows the key has.
    """
    keys, totals, sums = list(keys), totals or {}, sums or {}
    blocked = _blocked(df, position, block)
    per_block = blocked.groupBy(*keys, "_block").agg(
        *[function(source).alias(f"_part_{name}") for name, (function, source) in totals.items()],
        *[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()],
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_key = per_block.select(
        *keys,
        "_block",
        *[function(F.col(f"_part_{name}")).over(whole).alias(name) for name, (function, _) in totals.items()],
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    if sums:
        inside = (
            Window.partitionBy(*keys, "_block")
            .orderBy(*(order or [position]))
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        blocked = blocked.withColumns({f"_inside_{name}": F.sum(source).over(inside) for name, source in sums.items()})
    return blocked.join(per_key, keys + ["_block"]).select(
        *df.columns,
        *totals,
        *[(F.col(f"_before_{name}") + F.col(f"_inside_{name}")).alias(name) for name in sums],
    )


def with_key_totals(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    totals: dict[str, tuple[Callable[[Column], Column], Column]],
    block: int = 4096,
) -> DataFrame:
    """Aggregates over all rows of a key on each of its rows (see ``with_key_frames``)."""
    return with_key_frames(df, keys, position, totals=totals, block=block)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    sums: dict[str, str],
    block: int = 4096,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Running sums of columns by position within a key (see ``with_key_frames``)."""
    return with_key_frames(
        df, keys, position, sums={name: F.col(source) for name, source in sums.items()}, block=block, order=order
    )
