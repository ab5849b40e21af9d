"""Operator 13: collocations from count streams in prefix and suffix order.

Texts are lower-cased over A-Z and cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces
and tabs. All runs of 1 to ``longest`` words inside pieces are counted per language.

Counting. A task numbers the words of what it holds (HELD words per language), packs the numbers of
a run of words into one integer, sorts these integers and counts equal neighbours; so a phrase leaves a task once per
portion, however frequent it is. Phrases travel in prefix order, as lines of one of BUCKETS texts by the hash of their first
two words, and are added up by language, bucket and phrase where they arrive. The empty phrase
carries the number of words. Phrases of fewer than ``least`` occurrences cannot be candidates, nor parts
or extensions of candidates that matter, as a part is at least as frequent as the whole; the others are
written to the shared folder, and one stream per number of words is read from there.

Merging. The stream of k words is put in prefix order (by its first k - 1 words) and in suffix order (by its
last k - 1 words) and merge-joined in lockstep with the finished stream of k - 1 words. The prefix order
brings the counts of all its beginnings, the suffix order those of all its endings, and in each order the
longer phrases give each shorter one the count of its most frequent extension. A longer phrase two or
more words longer has a part one word longer that is at least as frequent, so neighbouring streams are enough.
No table of counts is held by a task; a first word with very many phrases is split by adaptive execution.

Scores are exact: floor(10^6 * a * a / (l * r)) in decimals of 38 digits (counts up to 5 * 10^15), an error beyond.
Equal scores are settled by count and phrase (UTF-8 byte order).

Null and empty texts have no words; a null language is ``und``, and so is a language of that name. Repeated rows count each; an empty
table gives an empty result. Texts of any length: the numbers of one text's words are held at a time. Other
columns, of any names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read, ship
from earnloom.session import pinned

LONGEST, LEAST, TOP = 3, 10, 2000
SCALE, COVERED = 1_000_000, 50
NO_LANGUAGE = "und"
HELD = 1_000_000
BLOCK = 8_000_000
BUCKETS = 16_384
# Characters that end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"


def _letters() -> bytes:
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    for b in PIECE_ENDS:
        table[b] = ord("\n")
    table[ord("\t")] = ord(" ")
    return bytes(table)


_LETTERS = _letters()


def _blocks(raw: bytes) -> Iterator[bytes]:
    """The text in parts that end between words."""
    at = 0
    while at < len(raw):
        stop = min((x for x in (raw.find(b" ", at + BLOCK), raw.find(b"\n", at + BLOCK)) if x >= 0), default=len(raw))
        yield raw[at:stop]
        at = stop


class Portion:
    """Words of one language as numbers; 0 stands between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.size = 0

    def add(self, text: str) -> None:
        numbers = self.numbers
        for block in _blocks(text.encode("utf-8", "replace").translate(_LETTERS)):
            split = block.replace(b"\n", b" \n ").split(b" ")
            part = np.array([numbers.setdefault(w, len(numbers)) for w in split if w], np.int64)
            self.parts.append(part)
            self.size += len(part)
        self.parts.append(np.zeros(1, np.int64))

    def counts(self, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Phrases, their counts and buckets, by number of words; the empty phrase has the number of words."""
        ids = np.concatenate(self.parts)
        words = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        hashes = np.array([zlib.crc32(w) for w in self.numbers], np.int64)
        used = np.bincount(ids, minlength=len(words))
        yield pa.array([""]), np.array([used[1:].sum()]), np.zeros(1, np.int64)
        yield words[1:], used[1:], hashes[1:] % BUCKETS
        for k in range(2, longest + 1):
            # so many places that k numbers fit into 63 bits
            step = min(HELD, int(2 ** (62 / k)) - k)
            for at in range(0, len(ids), step):
                part = ids[at : at + step + k - 1]
                if len(part) >= k:
                    yield self._phrases(part, k, words, hashes)

    @staticmethod
    def _phrases(ids: np.ndarray, k: int, words: pa.Array, hashes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        own, base, local = None, len(words), ids
        if base**k >= 1 << 63:
            own, local = np.unique(ids, return_inverse=True)
            base = len(own)
        n = len(ids) - k + 1
        inside = np.ones(n, bool)
        packed = np.zeros(n, np.int64)
        for i in range(k):
            inside &= ids[i : i + n] > 0
            packed = packed * base + local[i : i + n]
        found, counts = np.unique(packed[inside], return_counts=True)
        places = []
        for _ in range(k):
            found, last = np.divmod(found, base)
            places.insert(0, last if own is None else own[last])
        columns = [words.take(pa.array(place)) for place in places]
        return pc.binary_join_element_wise(*columns, " "), counts, (hashes[places[0]] * 31 + hashes[places[1]]) % BUCKETS

    def texts(self, longest: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Buckets and their lines: a phrase, and behind a tab its count where that is not 1."""
        for phrases, counts, buckets in self.counts(longest):
            order = np.argsort(buckets, kind="stable")
            phrases, counts = phrases.take(pa.array(order)), pa.array(counts[order], pa.int64())
            lines = pc.if_else(pc.equal(counts, 1), phrases, pc.binary_join_element_wise(phrases, counts.cast(pa.string()), "\t"))
            used, starts = np.unique(buckets[order], return_index=True)
            ends = pa.array(np.append(starts, len(order)).astype(np.int32))
            yield used, pc.binary_join(pa.ListArray.from_arrays(ends, lines), "\n")


def _counted(longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Portion] = {}

        def emit(lang: str) -> Iterator[pa.RecordBatch]:
            for buckets, lines in held.pop(lang).texts(longest):
                names = pa.array([lang]).take(pa.array(np.zeros(len(lines), np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array(buckets, pa.int32()), lines], ["lang", "bucket", "lines"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                portion = held.setdefault(lang, Portion())
                portion.add(text.as_py() or "")
                if portion.size >= HELD:
                    yield from emit(lang)
                elif len(held) > 1 and sum(p.size for p in held.values()) >= 4 * HELD:
                    yield from emit(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield from emit(lang)

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``phrase`` (words joined by a space; empty: all words) and its count ``a``."""
    ship(docs.sparkSession)
    read_part = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text}`").alias("text"))
    portions = read_part.mapInArrow(_counted(longest), "lang string, bucket int, lines string").repartition("lang", "bucket")
    line = portions.select("lang", "bucket", F.explode(F.split("lines", "\n")).alias("line"))
    several = F.instr("line", "\t") > 0
    counted = line.select(
        "lang",
        "bucket",
        F.substring_index("line", "\t", 1).alias("phrase"),
        F.when(several, F.substring_index("line", "\t", -1).cast("long")).otherwise(1).alias("a"),
    )
    return counted.groupBy("lang", "bucket", "phrase").agg(F.sum("a").alias("a")).drop("bucket")


def _stream(counts: DataFrame, k: int) -> DataFrame:
    """The stream of k words with its words, ``head`` (all but the last) and ``tail`` (all but the first)."""
    split = F.split("phrase", " ")
    chosen = counts.filter(F.length("phrase") > 0).filter(F.size(split) == k)
    return chosen.select(
        "lang",
        "phrase",
        "a",
        F.array_join(F.slice(split, 1, k - 1), " ").alias("head") if k > 1 else F.lit("").alias("head"),
        F.array_join(F.slice(split, 2, k - 1), " ").alias("tail") if k > 1 else F.lit("").alias("tail"),
    )


def _merged(stream: DataFrame, shorter: DataFrame, part: str, columns: dict[str, Column]) -> DataFrame:
    """Both streams in the order of ``part``, merged in lockstep."""
    other = shorter.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), *[c.alias(n) for n, c in columns.items()])
    on = (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))
    return stream.hint("merge").join(other.hint("merge"), on).drop("_lang", "_part")


def _extended(stream: DataFrame, longer: DataFrame | None) -> DataFrame:
    """The stream with ``widest``, the count of the most frequent phrase that is one word longer and holds it."""
    if longer is None:
        return stream.withColumn("widest", F.lit(0).cast("long"))
    for part in ("head", "tail"):
        most = longer.groupBy(F.col("lang").alias("_lang"), F.col(part).alias("_part")).agg(F.max("a").alias(f"_{part}"))
        on = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part"))
        stream = stream.hint("merge").join(most.hint("merge"), on, "left").drop("_lang", "_part")
    zero = F.lit(0).cast("long")
    return stream.withColumn("widest", F.greatest(F.coalesce("_head", zero), F.coalesce("_tail", zero))).drop("_head", "_tail")


def exact_score(a: Column, l: Column, r: Column, scale: int = SCALE) -> Column:  # noqa: E741
    """floor(scale * a * a / (l * r)) without rounding."""
    a, l, r = (x.cast("decimal(19,0)") for x in (a, l, r))  # noqa: E741
    return F.call_function("div", F.lit(scale).cast("decimal(38,0)") * a * a, l * r).cast("long")


def scored(counts: DataFrame, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """Candidates of two words and more that no frequent longer phrase covers: lang, phrase, a, l, r, score.

    ``counts`` are those of phrases that are frequent enough, with all their parts.
    """
    streams = {k: _stream(counts, k) for k in range(1, longest + 1)}
    none = F.array().cast("array<bigint>")
    done = streams[1].select("lang", "phrase", "a", none.alias("lefts"), none.alias("rights"))
    made = None
    for k in range(2, longest + 1):
        prefix = _merged(streams[k], done, "head", {"lefts": F.concat("lefts", F.array("a"))})
        both = _merged(prefix, done, "tail", {"rights": F.concat(F.array("a"), "rights")})
        done = both.select("lang", "phrase", "a", "lefts", "rights")
        free = _extended(done, streams.get(k + 1)).filter(F.lit(100) * F.col("widest") < covered * F.col("a"))
        made = free if made is None else made.unionByName(free)
    def rated(i: Column) -> Column:
        left, right = F.get("lefts", i), F.get("rights", i)
        return F.struct(exact_score(F.col("a"), left, right).alias("score"), i.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(0), F.size("lefts") - 1), rated)
    return made.withColumn("least", F.array_min(cuts)).select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = pinned(phrase_counts(docs, longest, text, lang).filter((F.col("a") >= least) | (F.col("phrase") == "")))
    totals = counts.filter("phrase = ''").select(F.col("lang").alias("_lang"), F.col("a").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(counts, longest, covered).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


_SQL = f"""
WITH piece AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, string_split(g, ' ') AS w, count(*) AS a FROM gram GROUP BY lang, k, g),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cut AS (
  SELECT lang, k, g, a, c, array_to_string(w[1:c], ' ') AS left_part, array_to_string(w[c + 1:k], ' ') AS right_part
  FROM f, range(1, {LONGEST}) t(c) WHERE k > 1 AND c < k AND a >= {LEAST}),
rated AS (
  SELECT cut.*, x.a AS l, y.a AS r, (({SCALE}::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a)) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = left_part JOIN f y ON y.lang = cut.lang AND y.g = right_part),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
covered AS (
  SELECT DISTINCT lang, part FROM (
    SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS part
    FROM f, range(2, {LONGEST}) t(m), range(1, {LONGEST + 1}) u(s) WHERE a >= {LEAST} AND m < k AND s + m - 1 <= k) b
  WHERE EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.g = b.part AND 100 * b.a >= {COVERED} * f.a)),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS place
  FROM best WHERE NOT EXISTS (SELECT 1 FROM covered WHERE covered.lang = best.lang AND part = best.g))
SELECT lang, place::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE place <= {TOP}
"""


@query("op13_phrase_streams", _SQL)
def phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
