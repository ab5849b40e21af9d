"""Operator 12: periodic runs of words by an online sparse diagonal DP.

A run is a stretch of words with smallest period q that holds at least ``copies`` periods and ``least`` words
and that no neighbouring word goes on. On the diagonal of lag q (each word next to the one q before) a run
is an unbroken match, so the DP counts match lengths on diagonals while it reads the words, and a
diagonal whose match ends with enough words emits a run.

It is sparse twice. Only earlier occurrences open a diagonal, and instead of every earlier occurrence of
every word (the square of a frequent word's count) those of blocks count: for the lags from L to 2L - 1,
L = 1, 2, 4, ..., the blocks of L words, and of these the NEAREST earlier occurrences. No run is lost: q
neighbouring blocks of a run cannot all have a period of L / 2 or less, or the run would have a smaller period
than q. One that has none occurs at most three times within the last 2L - 1 words, and one of
these is q back. With ``copies`` of 3 or more a run holds q such blocks next to each other. A block size
without repeated blocks is the last. An opened diagonal takes in the matches before it opened; while it
matches, further occurrences on it only go on with it. A stretch that several lags emit has the least of
them as its smallest period (by Fine and Wilf's theorem it divides the others).

So the work per text is near its number of words times the number of block sizes that repeat, whatever repeats. A text is
worked on as a whole, with some arrays of one number per word; rows are independent of each other.

Null, empty and blank texts have no words and no runs. Repeated rows give repeated results, an empty table
an empty one. Ties of occurrences do not matter, as all runs are found. Columns of any names stay in ``_row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read, ship, words

LEAST, COPIES = 6, 4
NEAREST = 3
STRIDE = 64


def _end(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """First place from ``at`` on, going by ``step`` (1 or -1), that does not match the word ``lag`` before it."""
    size = STRIDE
    while True:
        if step > 0:
            stop = min(at + size, len(ids))
            unlike = ids[at:stop] != ids[at - lag : stop - lag]
        else:
            stop = max(at - size, lag - 1)
            unlike = (ids[stop + 1 : at + 1] != ids[stop + 1 - lag : at + 1 - lag])[::-1]
        if unlike.any():
            return at + step * int(unlike.argmax())
        if stop in (len(ids), lag - 1):
            return stop
        at, size = stop, 4 * size


def _openings(ids: np.ndarray, copies: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags where an earlier occurrence of the block that starts there opens a diagonal."""
    names, size, longest = ids, 1, len(ids) // copies
    while size <= longest:
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        again = ranked[1:] == ranked[:-1]
        if not again.any():
            return
        earlier = np.full(len(names) + 1, -1)  # the last stands for "none before"
        earlier[order[1:][again]] = order[:-1][again]
        place = np.flatnonzero(earlier[:-1] >= 0)
        before = earlier[place]
        for _ in range(NEAREST):
            lag = place - before
            fits = (before >= 0) & (lag >= size) & (lag < 2 * size) & (lag <= longest)
            if fits.any():
                yield place[fits], lag[fits]
            before = earlier[before]
        # a block of twice the size is a pair of blocks; equal pairs get equal names
        classes = np.empty(len(names), np.int64)
        classes[order] = np.concatenate(([0], np.cumsum(~again)))
        if len(names) <= size:
            return
        names = classes[:-size] * (int(classes.max()) + 1) + classes[size:]
        size *= 2


def runs_of(ids: np.ndarray, least: int = LEAST, copies: int = COPIES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``ids`` has a number for each word."""
    if copies < 3:
        raise ValueError("runs need three copies or more")
    opened = list(_openings(ids, copies))
    if not opened:
        return []
    place = np.concatenate([p for p, _ in opened])
    lag = np.concatenate([g for _, g in opened])
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    # of openings next to each other on one diagonal the first stands for all
    first = np.concatenate(([True], (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)))
    place, lag = place[first], lag[first]
    online = np.argsort(place, kind="stable")
    open_until: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    for at, d in zip(place[online].tolist(), lag[online].tolist()):
        if at < open_until.get(d, 0):
            continue
        start, end = _end(ids, at, d, -1) + 1, _end(ids, at, d, 1)
        open_until[d] = end
        length = end - start + d
        if length >= max(least, copies * d):
            key = (start - d, length)
            found[key] = min(d, found.get(key, d))
    return sorted((start, length, d) for (start, length), d in found.items())


def collapsed(raw_words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(raw_words)
    steps = np.zeros(len(raw_words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return b" ".join([w for w, k in zip(raw_words, kept.tolist()) if k])


KIND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def periodic(text: Column, least: int = LEAST, copies: int = COPIES) -> Column:
    """A struct of ``runs`` (start, length, period, by start and period) and ``collapsed``, the text without repeats."""
    if copies < 3:
        raise ValueError("runs need three copies or more")
    ship(SparkSession.active())

    @F.arrow_udf(KIND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            every, ends, left = [], [0], []
            for value in texts:
                split = (value.as_py() or "").encode("utf-8", "replace").split()
                seen: dict[bytes, int] = {}
                ids = np.array([seen.setdefault(w, len(seen)) for w in split], np.int64)
                runs = runs_of(ids, least, copies) if len(seen) < len(split) else []
                every += runs
                ends.append(len(every))
                left.append(collapsed(split, runs))
            table = np.array(every, np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(table[:, i].copy()) for i in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.StructArray.from_arrays([lists, pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return scan(text)


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """``_row`` with all columns of ``docs``, ``runs`` and ``collapsed``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, periodic(F.col(f"`{text}`"), least, copies).alias("_found")).select(
        "_row", F.col("_found.runs").alias("runs"), F.col("_found.collapsed").alias("collapsed")
    )


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, one text in ten (by its id's checksum) going round in circles from some word on."""
    split, number = words(F.col("text")), F.crc32(F.col("doc_id").cast("string"))
    n, rest = F.size(split), F.floor(number / 10)
    a = (rest % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + rest % 8))).cast("int")
    circle = F.flatten(F.array_repeat(F.slice(split, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(split, F.lit(1), a), F.slice(circle, F.lit(1), n - a)), " ")
    turned = F.when((number % 10 == 0) & (n > 0), made).otherwise(F.col("text"))
    return docs.select("doc_id", turned.alias("text"))


_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS x,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w
  FROM documents),
sums AS (
  SELECT rid, doc_id, w, len(w) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(1, len(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)),
             lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295)::BIGINT AS h
  FROM doc, crc),
parts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM sums),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM parts),
turned AS (
  SELECT rid, doc_id, n,
         CASE WHEN a IS NULL THEN w
              ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w
  FROM periods),
grams AS (
  SELECT rid, n, i, array_to_string(w[i + 1:i + 5], ' ') AS g
  FROM (SELECT rid, n, w, unnest(range(0, n - 4)) AS i FROM turned WHERE n >= {LEAST})),
met AS (
  SELECT x.rid, x.i - y.i AS d, x.i FROM grams x JOIN grams y ON x.rid = y.rid AND x.g = y.g AND x.i > y.i AND {COPIES} * (x.i - y.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM met),
stretches AS (
  SELECT rid, d, min(i) - d AS start, max(i) - min(i) + 5 + d AS length FROM islands GROUP BY rid, d, island
  HAVING max(i) - min(i) + 5 + d >= greatest({LEAST}, {COPIES} * d)),
run AS (SELECT rid, start, length, min(d) AS period FROM stretches GROUP BY ALL),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text,
         first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS best
  FROM run GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run),
placed AS (SELECT rid, unnest(w) AS word, unnest(range(0, n)) AS i FROM turned),
left_over AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM turned LEFT JOIN listed USING (rid) LEFT JOIN left_over USING (rid)
"""


@query("op12_periodic_runs", _SQL)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(looped(read(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(order)
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["length"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(1000 * best["length"] / -best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
