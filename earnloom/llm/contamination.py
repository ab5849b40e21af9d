"""Operator 6: benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (A-Z lowered; digits, a-z and everything beyond ASCII count as letters) and
put into one suffix automaton over word numbers. A document's words are streamed through it; the length
of the longest match tells at each word whether a window ends there: ``window`` item words in a row, or a
whole item that is shorter. The state's ancestor at window length knows the items. Words inside windows
are hit; a document is contaminated if at least 1 / ``part`` of its words are. ``cleaned`` drops such
documents and cuts the hit words out of the others.

The automaton holds the benchmark only, in parts of at most ITEM_WORDS words; every part is broadcast and
streamed through once, so memory is bounded whatever the benchmark's size. Documents are never shuffled.

Null and empty texts have no words; items without words are no windows; repeated items or ids count once
per id; an empty benchmark hits nothing. Spans are word positions, end exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from earnloom.llm.registry import query
from earnloom.llm.words import read

WINDOW, PART = 13, 20
ITEM_WORDS = 100_000
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_LETTER = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in found]) for name, found in items if found]
        for _, sequence in items:
            last = 0
            for number in sequence:
                last = self._extend(last, number)
        self._mark(items)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, above: int, number: int, old: int) -> int:
        """The state of the strings of ``old`` that end ``above`` + number, parted from the longer ones."""
        part = self._state(self.length[above] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = part
        while above >= 0 and self.next[above].get(number) == old:
            self.next[above][number] = part
            above = self.link[above]
        return part

    def _extend(self, last: int, number: int) -> int:
        known = self.next[last].get(number)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, number, known)
        made, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and number not in self.next[at]:
            self.next[at][number] = made
            at = self.link[at]
        if at >= 0:
            old = self.next[at][number]
            self.link[made] = old if self.length[old] == self.length[at] + 1 else self._split(at, number, old)
        return made

    def _mark(self, items: list[tuple[str, list[int]]]) -> None:
        """Per state: ``ancestor`` at window length, its ``items``; short whole items that end there."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.ancestor = [0] * len(self.next)
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.ancestor[v] = v if self.length[up] < self.window else self.ancestor[up]
        self.items: list[set[str]] = [set() for _ in self.next]
        own: dict[int, dict[int, set[str]]] = {}
        for name, sequence in items:
            v = 0
            for at, number in enumerate(sequence, 1):
                v = self.next[v][number]
                if at >= self.window:
                    self.items[self.ancestor[v]].add(name)
            if len(sequence) < self.window:
                own.setdefault(v, {}).setdefault(len(sequence), set()).add(name)
        self.short: list[tuple[tuple[int, set[str]], ...]] = [()] * len(self.next)
        for v in order:
            self.short[v] = tuple(sorted(own.get(v, {}).items(), reverse=True)) + self.short[self.link[v]]

    def stream(self, found: list[bytes], spans: list[list[int]], items: set[str]) -> None:
        """Add the hit spans of a word sequence, merged and in order, and the items they belong to."""
        follow, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        state = matched = 0
        for i, number in enumerate(map(self.numbers.get, found)):
            if number is None:
                state = matched = 0
                continue
            to = follow[state].get(number)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = follow[state].get(number)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                items |= self.items[self.ancestor[state]]
                _add(spans, i + 1 - window, i + 1)
            if short[state]:
                for n, names in short[state]:
                    if n <= matched:
                        items |= names
                        _add(spans, i + 1 - n, i + 1)


def _add(spans: list[list[int]], start: int, end: int) -> None:
    while spans and spans[-1][0] >= start:
        end = max(end, spans.pop()[1])
    if spans and spans[-1][1] >= start:
        spans[-1][1] = max(end, spans[-1][1])
    else:
        spans.append([start, end])


def _merged(spans: list[list[int]]) -> list[list[int]]:
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and joined[-1][1] >= start:
            joined[-1][1] = max(end, joined[-1][1])
        else:
            joined.append([start, end])
    return joined


_BUILT: dict = {}


def _automaton(shared, label: str, window: int) -> Automaton:
    """One automaton is kept per worker process; parts come one after the other."""
    key = (label, window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value, window)
    return _BUILT[key]


def _parts(items: DataFrame, size: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    part, held = [], 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        found = item_words(row[1])
        if held and held + len(found) > size:
            yield part
            part, held = [], 0
        part.append((row[0] or "", found))
        held += len(found)
    if part:
        yield part


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_words_held: int = ITEM_WORDS) -> DataFrame:
    """``docs`` with ``_words`` (number of words), ``_spans`` (start, end, start, end, ...) and ``_items``."""
    spark = docs.sparkSession
    wide = docs.withColumns(
        {
            "_words": F.lit(0).cast("long"),
            "_spans": F.array().cast("array<int>"),
            "_items": F.array().cast("array<string>"),
        }
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in wide.schema.fields])
    parts = list(_parts(items, item_words_held)) or [[]]
    for part in parts:
        wide = wide.mapInArrow(_streamed(spark.sparkContext.broadcast(part), window), schema)
    return wide


def _streamed(shared, window: int):
    label = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared, label, window)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, spans, items = [], [], []
            for text, old, names in zip(texts, batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()):
                found = item_words(text)
                new, ids = [], set(names)
                machine.stream(found, new, ids)
                if old:
                    new = _merged(new + [list(x) for x in zip(old[::2], old[1::2])])
                n_words.append(len(found))
                spans.append([x for span in new for x in span])
                items.append(sorted(ids))
            made = {
                "_words": pa.array(n_words, pa.int64()),
                "_spans": pa.array(spans, pa.list_(pa.int32())),
                "_items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return run


def counted(docs: DataFrame, items: DataFrame, part: int = PART, **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated; ``_spans`` and ``_items`` stay."""
    pairs = F.sequence(F.lit(0), F.size("_spans") - 2, F.lit(2))
    hit = F.aggregate(
        pairs, F.lit(0).cast("long"), lambda acc, i: acc + F.get("_spans", i + 1) - F.get("_spans", i)
    )
    return (
        matched(docs, items, **options)
        .withColumnRenamed("_words", "n_words")
        .withColumns(
            {
                "n_hit": F.when(F.size("_spans") > 0, hit).otherwise(0).cast("long"),
                "n_items": F.size("_items").cast("long"),
                "items_sha256": F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256),
            }
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words")))
    )


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([_without(t, s) for t, s in zip(texts, spans)])


def _without(text: str | None, spans) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or spans is None or not len(spans):
        return text
    found = [m.span() for m in _LETTER.finditer(text)]
    kept, at = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        kept.append(text[at : found[start][0]])
        at = found[end - 1][1]
    return "".join(kept) + text[at:]


def cleaned(docs: DataFrame, items: DataFrame, part: int = PART, **options) -> DataFrame:
    """Documents below the coverage limit, the hit words cut out; ``n_chars`` follows the text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    kept = counted(packed, items, part, **options).filter(~F.col("contaminated"))
    text = F.when(F.size("_spans") > 0, _cut("text", "_spans")).otherwise(F.col("text"))
    row = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    kept = kept.withColumn("_cut", text)
    row["text"] = F.col("_cut")
    if "n_chars" in row:
        row["n_chars"] = F.when(F.size("_spans") > 0, F.length("_cut").cast("long")).otherwise(row["n_chars"])
    return kept.select(*[c.alias(n) for n, c in row.items()])


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_W} AS w FROM benchmark),
size AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
doc AS (SELECT doc_id, {_W} AS w FROM documents),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, n, i FROM grams JOIN win USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND {PART} * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op6_suffix_automaton", _SQL)
def suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
