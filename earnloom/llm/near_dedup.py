"""Operator 1: near-duplicate components by circulant MinHash.

A document's set is its distinct word shingles (``shingle`` words; a shorter text is one shingle of all its
words), words lower-cased over A-Z. The shingles' hashes go through one permutation S of the 32-bit
numbers; coordinate k of the signature is the smallest P(S(x) + k), P a second permutation shifted
circularly by k, so two permutations give all coordinates. BANDS bands of ROWS coordinates make bucket
keys: a pair of similarity 0.8 misses all of 32 bands of 4 rows once in 20 million.

1. Documents with the same set (128 bits of its hashes) are one class, stood for by its smallest id.
2. In every bucket each class is paired with the bucket's first class in a random order; the candidates
   are confirmed on their full sets of words, and links become components (alternating star contraction on
   tables). TURNS such turns, each on the buckets that still hold several components: a group of n copies
   gives a few times n pairs.
3. What is left in buckets of several components gives all pairs across components, not tried before,
   whose sizes fit, whose rarest shingles meet and whose bitmaps differ in few enough places (without which
   no pair is similar enough); these are confirmed too. So no candidate pair between different components
   stays open, and pairs inside a component need no trial. The join compares the cells of a bucket, so its
   time can grow with the square of a group of copies that all miss the similarity; the rows it makes do not,
   as long as the bitmaps tell the pairs apart.

All steps are joins and groupings with combining before the shuffle. One row per bucket or hub is written
to the shared folder before its members are joined to it: both sides of such a join are then plain
shuffles, and adaptive execution splits a bucket or hub with many members. The texts of candidates only are carried, compressed.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Ids name
documents; where one repeats with several texts, the smallest of these stands for it when links are
confirmed. A null id is a component of its own and is kept, also next to rows with the same text. When
documents are chosen, a row counts by its id and its own set: of rows that repeat both (blank texts: id and
text) one stays, and a text of a kept id that was itself rejected does not. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read
from earnloom.session import pinned

SHINGLE, NEEDED = 2, 80
BANDS, ROWS = 32, 4
TURNS = 3
HELD = 500_000
SLOTS = 1 << 17
# Bits of a document's bitmap: a power of two of at least BITS for each of its shingles, within these limits.
BITS, LEAST_BITS, MOST_BITS = 8, 512, 1 << 17
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute32(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word of a text given as bytes: lengths and polynomial of the letters."""
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    longest = int(sizes.max())
    # letter by letter over all words that are long enough; rare giant words go alone
    out = np.full(len(starts), 7, np.uint64)
    plain = np.flatnonzero(sizes <= 64) if longest > 64 else np.arange(len(starts))
    order = plain[np.argsort(-sizes[plain], kind="stable")]
    counts = np.bincount(sizes[order], minlength=1)
    at_least = len(order) - np.concatenate(([0], np.cumsum(counts)))
    base = np.uint64(_BASE)
    head, acc = starts[order], out[order]
    for i in range(min(longest, 64)):
        n = at_least[i + 1] if i + 1 < len(at_least) else 0
        if n <= 0:
            break
        acc[:n] = (acc[:n] + data[head[:n] + i]) * base
        acc[:n] ^= acc[:n] >> np.uint64(29)
    out[order] = acc
    for k in np.flatnonzero(sizes > 64):
        word = data[starts[k] : ends[k]].tobytes()
        out[k] = np.uint64(zlib.crc32(word) | zlib.crc32(word[::-1]) << 32)
    return _mix64(out ^ sizes.astype(np.uint64) << np.uint64(48))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a lower-cased text."""
    words = _word_hashes(np.frombuffer(raw, np.uint8))
    if not len(words):
        return words
    n = max(1, len(words) - shingle + 1)
    made = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        made = _mix64(made * np.uint64(_BASE) + words[i : i + n] + np.uint64(i))
    return np.unique(made)


def shingles(text: bytes, shingle: int = SHINGLE) -> set:
    """The set itself, of a lower-cased text."""
    words = text.split()
    if not words:
        return set()
    n = max(1, len(words) - shingle + 1)
    return set(zip(*[words[i : i + n] for i in range(min(shingle, len(words)))]))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: ``size`` coordinates from two permutations."""
    first = _permute32((hashes >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None] * np.uint32(1)
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 2048):
        np.minimum(best, _permute32(first[None, at : at + 2048] + shifts).min(axis=1), out=best)
    return best


def _digests(bands: int, rows: int, shingle: int):
    places = np.arange(bands, dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(lowered(text), shingle)
                sizes.append(len(hashes))
                high.append(int(np.bitwise_xor.reduce(_mix64(hashes))) if len(hashes) else 0)
                low.append(int(_mix64(hashes + np.uint64(_BASE)).sum()) if len(hashes) else 0)
                if not len(hashes):
                    keys.append(np.empty(0, np.int64))
                    continue
                cells = signature(hashes, bands * rows).reshape(bands, rows).astype(np.uint64)
                key = places
                for r in range(rows):
                    key = _mix64(key * np.uint64(_BASE) + cells[:, r])
                keys.append(key.view(np.int64))
            lengths = np.cumsum([0] + [len(k) for k in keys], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("mark"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(high, np.uint64).view(np.int64)),
                    pa.array(np.array(low, np.uint64).view(np.int64)),
                    lists,
                ],
                ["id", "mark", "n", "high", "low", "keys"],
            )

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased texts, compressed."""
    for batch in batches:
        blobs = [zlib.compress(lowered(t), 1) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], ["id", "blob"])


def _confirmed(needed: int, shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        size = 0
        for batch in batches:
            keep = []
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            blobs = [batch.column(c) for c in ("a_blob", "b_blob")]
            for i, names in enumerate(zip(*ids)):
                sets = []
                for name, side in zip(names, blobs):
                    if name not in held:
                        if size > HELD:
                            held, size = {}, 0
                        held[name] = shingles(zlib.decompress(side[i].as_py()), shingle)
                        size += len(held[name])
                    sets.append(held[name])
                both = len(sets[0] & sets[1])
                keep.append(both > 0 and 100 * both >= needed * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fits(a: Column, b: Column, needed: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return (100 * F.least(a, b)) >= needed * F.greatest(a, b)


def _verified(pairs: DataFrame, blobs: DataFrame, needed: int, shingle: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left = blobs.select(F.col("id").alias("a"), F.col("blob").alias("a_blob"))
    right = blobs.select(F.col("id").alias("b"), F.col("blob").alias("b_blob"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirmed(needed, shingle), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id reachable.

    Large-star and small-star steps in turn until nothing changes; each is two groupings by vertex.
    """
    edges = pinned(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pinned(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (
            both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).filter("a <> b").distinct()
        large = pinned(large)
        lower = pinned(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        edges = pinned(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == before or now[0] == 0 or now[0] == now[2] and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def _star_pairs(placed: DataFrame, turn: int, needed: int) -> DataFrame:
    """Every cell with the first of its bucket, where they are of different components.

    The first is drawn by the id in the first turn, so that a group has few of them, and by id and bucket
    in later ones, so that a cell left over meets many others.
    """
    drawn = F.xxhash64("id", F.lit(turn)) if turn == 0 else F.xxhash64("id", "bucket", F.lit(turn))
    first = F.min(F.struct(drawn.alias("r"), "id", "n", "component")).alias("first")
    firsts = pinned(placed.groupBy("bucket").agg(first))
    return (
        placed.join(firsts, "bucket")
        .filter((F.col("component") != F.col("first.component")) & _fits(F.col("n"), F.col("first.n"), needed))
        .select(F.greatest("id", "first.id").alias("a"), F.least("id", "first.id").alias("b"))
        .distinct()
    )


def _slot_counts(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for blob in batch.column("blob"):
                hashes = shingle_hashes(zlib.decompress(blob.as_py()), shingle)
                counts += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["slot", "n"])

    return run


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles per slot, 64 to a long: every shingle that only one of two sets has
    changes one bit, so bitmaps differ in at most as many places as their sets."""
    size = min(max(LEAST_BITS, 1 << (BITS * len(hashes) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differences(a: Column, b: Column) -> Column:
    """Number of places in which two bitmaps differ; of lengths one to two, the longer one is folded."""
    short = F.least(F.size(a), F.size(b))

    def folded(bits: Column) -> Column:
        halves = F.zip_with(F.slice(bits, F.lit(1), short), F.slice(bits, short + 1, short), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > short, halves).otherwise(bits)

    places = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(places, F.lit(0), lambda n, k: n + k)


def _near(needed: int) -> Column:
    """The bitmaps allow the similarity: sets of a and b members with d in only one of them have (a + b - d) / 2 in common."""
    members = F.col("a_n") + F.col("b_n")
    return (100 + needed) * _differences(F.col("a_bits"), F.col("b_bits")) <= (100 - needed) * members


def _prefixes(shared, needed: int, shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare, fewer, bits = [], [], []
            for blob in batch.column("blob"):
                hashes = shingle_hashes(zlib.decompress(blob.as_py()), shingle)
                order = np.lexsort((hashes, shared.value[(hashes % np.uint64(SLOTS)).astype(np.int64)]))
                n = len(hashes)
                length = n - -(-needed * n // 100) + 1
                rare.append((hashes[order[:length]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                fewer.append(rare[-1][: n - -(-2 * needed * n // (100 + needed)) + 1])
                bits.append(bitmap(hashes))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rare, kind), pa.array(fewer, kind), pa.array(bits, pa.list_(pa.int64()))],
                ["id", "rare", "fewer", "bits"],
            )

    return run


def _with_rare(placed: DataFrame, blobs: DataFrame, needed: int, shingle: int) -> DataFrame:
    """Cells with the bitmap and the rarest shingles of their document: sets as similar as needed share one of these.

    Shingles are put in one order, by frequency and hash. Of the larger set its first n - ceil(t * n) + 1
    suffice (``rare``), of the smaller its first n - ceil(2 * t / (1 + t) * n) + 1 (``fewer``). The order
    may be any, so frequencies are those of SLOTS hash slots, a table of fixed size.
    """
    texts = pinned(blobs.join(placed.select("id").distinct(), "id"))
    counted = texts.mapInArrow(_slot_counts(shingle), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, np.int64)
    for row in counted.collect():
        counts[row["slot"]] = row["n"]
    shared = placed.sparkSession.sparkContext.broadcast(counts)
    kinds = "id long, rare array<int>, fewer array<int>, bits array<long>"
    return placed.join(texts.mapInArrow(_prefixes(shared, needed, shingle), kinds), "id")


def _pairs_across(placed: DataFrame, blobs: DataFrame, needed: int, shingle: int) -> DataFrame:
    """All pairs of cells of one bucket that are of different components, share a rare shingle and have near bitmaps."""
    cells = pinned(_with_rare(placed, blobs, needed, shingle))
    left = cells.select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "component", "rare", "fewer", "bits")])
    right = cells.select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "component", "rare", "fewer", "bits")])
    return (
        left.join(
            right,
            (left["bucket"] == right["bucket"])
            & (F.col("a_component") < F.col("b_component"))
            & _fits(F.col("a_n"), F.col("b_n"), needed)
            & F.when(F.col("a_n") <= F.col("b_n"), F.arrays_overlap("a_fewer", "b_rare")).otherwise(
                F.arrays_overlap("a_rare", "b_fewer")
            )
            & _near(needed),
        )
        .select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b"))
        .distinct()
    )


def _open_cells(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells, with their components, of the buckets that hold more than one component."""
    placed = shared.join(groups, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return pinned(placed.join(pinned(mixed.select("bucket")), "bucket"))


def _mark(text: str = "text") -> Column:
    """A text in short; null and empty texts differ."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))


def _grouped(docs: DataFrame, shingle: int, needed: int, bands: int, rows: int, key: str) -> DataFrame:
    """One row per document: ``id``, the text's ``mark``, its set's ``n``, ``high``, ``low``, ``component_id``, ``n_links``, ``kept``."""
    texts = docs.select(F.col(key).alias("id"), "text")
    seen = pinned(
        texts.withColumn("mark", _mark()).mapInArrow(
            _digests(bands, rows, shingle), "id long, mark string, n long, high long, low long, keys array<long>"
        )
    )
    sets = seen.filter("n > 0")
    classes = sets.groupBy("high", "low", "n").agg(F.min("id").alias("class_id"))
    # one row per class: the one of its smallest id; by id, so that a large class is not gathered
    own = sets.join(classes.withColumnRenamed("class_id", "id"), ["id", "high", "low", "n"]).dropDuplicates(["id", "high", "low"])
    cells = own.select("id", "n", F.explode("keys").alias("bucket"))
    several = pinned(cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket"))
    shared = pinned(cells.join(several, "bucket"))
    wanted = shared.select("id").distinct()
    blobs = pinned(texts.join(wanted, "id").mapInArrow(_packed, "id long, blob binary").groupBy("id").agg(F.min("blob").alias("blob")))
    links = tried = groups = None
    placed = shared.withColumn("component", F.col("id"))
    for turn in range(TURNS + 1):
        if turn < TURNS:
            pairs = _star_pairs(placed, turn, needed)
        else:
            pairs = _pairs_across(placed, blobs, needed, shingle)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pinned(pairs)
        found = pinned(_verified(pairs, blobs, needed, shingle))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if groups is None or found.take(1):
            groups = components(links)
        if turn < TURNS:
            placed = _open_cells(shared, groups)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    per_class = (
        classes.join(groups.withColumnRenamed("id", "class_id"), "class_id", "left")
        .join(ends, "class_id", "left")
        .select("high", "low", "n", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    found = seen.drop("keys").join(per_class, ["high", "low", "n"], "left")
    named = F.col("id").isNotNull()
    return found.select(
        "id",
        "mark",
        "n",
        "high",
        "low",
        F.when(named, F.coalesce("component_id", "id")).alias("component_id"),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("id")))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    needed: int = NEEDED,
    bands: int = BANDS,
    rows: int = ROWS,
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``n_links``.

    ``n_links`` counts the links confirmed for the document's class; copies and pairs inside a component
    that needed no trial are not among them.
    """
    return _grouped(docs, shingle, needed, bands, rows, key).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept", "n_links"
    )


def deduplicated(
    docs: DataFrame,
    shingle: int = SHINGLE,
    needed: int = NEEDED,
    bands: int = BANDS,
    rows: int = ROWS,
    key: str = "doc_id",
) -> DataFrame:
    """The documents that stand for their group, with their own columns.

    Rows are found again by id and text; rows of a null id are all taken. Where an id and a text repeat, the
    row of the smallest JSON form stays; only such rows are grouped.
    """
    kept = _grouped(docs, shingle, needed, bands, rows, key).filter("kept and id is not null")
    chosen = pinned(
        kept.groupBy("id", "n", "high", "low", "mark")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("id", "n", "high", "low", F.when(F.col("n") == 0, F.col("mark")).alias("blank"))
        .agg(F.min(F.struct("mark", "copies")).alias("first"))
        .select(F.col("id").alias("_id"), F.col("first.mark").alias("_mark"), F.col("first.copies").alias("_copies"))
    )
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    packed = docs.select(own, F.col(key).alias("_id"), _mark().alias("_mark"))
    made = packed.join(chosen.filter("_copies = 1"), ["_id", "_mark"], "left_semi").select("_row")
    several = chosen.filter("_copies > 1")
    if several.take(1):
        again = packed.join(several, ["_id", "_mark"], "left_semi").groupBy("_id", "_mark")
        made = made.unionByName(again.agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return made.unionByName(docs.filter(F.col(key).isNull()).select(own)).select("_row.*")


_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * n_both >= {NEEDED} * (p.n + q.n - n_both)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS c FROM doc UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.id WHERE r.c < e.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN reach ON reach.id = doc_id GROUP BY doc_id
"""


@query("op1_circulant_minhash", _SQL)
def circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
