"""Operator 5: personal data by base patterns and a semi-Markov conditional random field.

Four kinds have base patterns (email, ip, card, phone; leftmost and not overlapping within a kind, matches
that fail a check dropped). The field adds spans the patterns leave out: text is read in runs of words that
hold a digit or an @. A run is cut into segments; each segment is an entity of up to MAX_WORDS words or one
word outside. Whole-span features (digit count, groups, check digit, shape, signs) give every candidate
segment a score per kind, and dynamic programming over the run chooses boundaries and kinds together.

Weights come from conditional likelihood: forward and backward sums over all segmentations of a run, on
runs of about TRAIN_DOCS documents (a share of the hashes, never over twice as many) with the base spans as given segmentation; base
spans that do not fill whole words leave their run out. An added entity needs a posterior of at least
CERTAIN and must not overlap a base span of its kind. The field is broadcast (a few hundred numbers);
documents are scanned whole where they are read, without a shuffle.

Null and empty texts have no spans; runs may be of any length (time grows with it times MAX_WORDS).
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from earnloom.llm.registry import query
from earnloom.llm.words import read

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_RUN_WORD = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = " \t.,;:!?\"'<>[]{}|#*$%&()"

TRAIN_DOCS = 3_000
MAX_WORDS = 4
EPOCHS, RATE, RIDGE = 12, 0.2, 1e-3
CERTAIN = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL in the order of a left-to-right scan, looked for around each @ only."""
    after = 0
    at = text.find("@")
    while at >= 0:
        if at >= after:
            start = at
            while start > after and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
                start -= 1
            found = EMAIL.match(text, start) if start < at else None
            if found:
                yield found.span()
                after = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base patterns that pass their checks."""
    ips = [m.span() for m in IP.finditer(text) if all(_small(p) for p in m.group().split("."))] if "." in text else []
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return {"email": list(_emails(text)), "ip": ips, "card": cards, "phone": phones}


def _number(part: str) -> bool:
    """Only 0 to 9; other scripts and raised figures have digits too."""
    return part.isascii() and part.isdigit()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


# --- runs and segments ---------------------------------------------------------------------------


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or an @, as spans of words."""
    run: list[tuple[int, int]] = []
    for found in _RUN_WORD.finditer(text):
        if run and not (found.start() - run[-1][1] <= 2 and text[run[-1][1] : found.start()].strip(" \t") == ""):
            yield run
            run = []
        run.append(found.span())
    if run:
        yield run


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without marks around it; a bracket that is closed inside stays."""
    while end > start and text[end - 1] in _EDGE and not (text[end - 1] == ")" and "(" in text[start : end - 1]):
        end -= 1
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start + 1 : end]):
        start += 1
    return start, end


FEATURES = 24


def features(span: str, n_words: int) -> list[int]:
    """Numbers of the features that hold for a whole span."""
    digits = _digits(span)
    d, letters = len(digits), sum(1 for c in span if c.isalpha())
    rest = span.strip("0123456789")
    parts = span.split(".")
    held = [
        True,
        "@" in span,
        span.count("@") == 1 and "." in span[span.find("@") :] and not span.startswith("@"),
        len(parts) == 4 and all(_number(p) and _small(p) for p in parts),
        len(parts) == 4 and all(_number(p) for p in parts),
        13 <= d <= 19 and not letters,
        13 <= d <= 19 and luhn(digits),
        13 <= d <= 19 and not luhn(digits),
        span.startswith("+"),
        9 <= d <= 12 and not letters,
        d < 7,
        7 <= d <= 8,
        d > 19,
        "(" in span and ")" in span,
        "-" in span,
        letters > 0,
        letters > d,
        rest == "" and n_words == 1,
        n_words == 1,
        n_words == 2,
        n_words == 3,
        n_words >= 4,
        any(c in span for c in "=\"'_/"),
        " " in span and not letters,
    ]
    return [i for i, x in enumerate(held) if x]


class Field:
    """Weights [kind, feature]; the last kind is outside (single words only)."""

    OUTSIDE = len(KINDS)

    def __init__(self):
        self.weights = np.zeros((len(KINDS) + 1, FEATURES))

    def lattice(self, text: str, run: list[tuple[int, int]]):
        """Per segment end: (words, trimmed span, features) of each candidate segment."""
        ends = []
        for j in range(1, len(run) + 1):
            here = []
            for n in range(1, min(MAX_WORDS, j) + 1):
                start, end = _trimmed(text, run[j - n][0], run[j - 1][1])
                here.append((n, (start, end), features(text[start:end], n)))
            ends.append(here)
        return ends

    def _scores(self, ends):
        kinds = range(len(KINDS) + 1)
        weights = self.weights
        return [
            [[float(weights[k, held].sum()) if k < self.OUTSIDE or n == 1 else None for k in kinds] for n, _, held in here]
            for here in ends
        ]

    def sums(self, ends):
        """Scores, forward and backward log sums over all segmentations."""
        scores = self._scores(ends)
        size = len(ends)
        forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
        for j in range(1, size + 1):
            forward[j] = _log_sum(
                [forward[j - n] + s for (n, _, _), row in zip(ends[j - 1], scores[j - 1]) for s in row if s is not None]
            )
        for j in range(size - 1, -1, -1):
            found = []
            for n in range(1, min(MAX_WORDS, size - j) + 1):
                found += [backward[j + n] + s for s in scores[j + n - 1][n - 1] if s is not None]
            backward[j] = _log_sum(found)
        return scores, forward, backward

    def learn(self, examples) -> None:
        """``examples``: lattices with their given segmentation, a set of (end, words, kind)."""
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch / 4)
            for ends, given in examples:
                scores, forward, backward = self.sums(ends)
                for j, (here, rows) in enumerate(zip(ends, scores), 1):
                    for (n, _, held), row in zip(here, rows):
                        for k, s in enumerate(row):
                            if s is None:
                                continue
                            chance = exp(min(0.0, forward[j - n] + s + backward[j] - forward[-1]))
                            step = rate * (((j, n, k) in given) - chance)
                            if abs(step) > 1e-6:
                                self.weights[k, held] += step
            self.weights *= 1 - RIDGE

    def entities(self, text: str, run: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """The best segmentation's entities that are certain enough."""
        ends = self.lattice(text, run)
        scores, forward, backward = self.sums(ends)
        best, back = [0.0], [None]
        for j, (here, rows) in enumerate(zip(ends, scores), 1):
            top = max(
                (best[j - n] + s, n, k, span) for (n, span, _), row in zip(here, rows) for k, s in enumerate(row) if s is not None
            )
            best.append(top[0])
            back.append(top)
        j = len(ends)
        while j:
            _, n, kind, (start, end) = back[j]
            if kind < self.OUTSIDE and end > start:
                if exp(forward[j - n] + scores[j - 1][n - 1][kind] + backward[j] - forward[-1]) >= CERTAIN:
                    yield KINDS[kind], start, end
            j -= n


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


def _given(text: str, run: list[tuple[int, int]], ends, spans: dict[str, list[tuple[int, int]]]):
    """The segmentation that the base spans fix, or None where one does not fill whole words."""
    first, last = run[0][0], run[-1][1]
    wanted = {(s, e): k for k, kind in enumerate(KINDS) for s, e in spans[kind] if s < last and e > first}
    given, covered, met = set(), set(), set()
    for j, here in enumerate(ends, 1):
        for n, span, _ in here:
            if span in wanted and not covered & set(range(j - n, j)):
                given.add((j, n, wanted[span]))
                covered |= set(range(j - n, j))
                met.add(span)
    if len(met) < len(wanted):
        return None
    return given | {(j, 1, Field.OUTSIDE) for j in range(1, len(run) + 1) if j - 1 not in covered}


def fitted(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """A field learned from the runs of a bounded sample of the texts that hold an @, four digits or a decimal.

    The sample is a share of the text hashes, so what reaches the driver does not grow with the input.
    """
    known = docs.filter(F.col("text").rlike("@|[0-9]{4}|[0-9][.][0-9]"))
    total = known.count()
    share = min(1.0, rows / total) if total else 0.0
    chosen = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * rows)
    found = chosen.select(F.regexp_extract_all("text", F.lit(_NEAR), F.lit(0)).alias("near"))
    field, examples = Field(), []
    for near in sorted(row["near"] for row in found.collect()):
        for text in near:
            spans = base_spans(text)
            for run in runs(text):
                ends = field.lattice(text, run[:64])
                given = _given(text, run[:64], ends, spans)
                if given is not None:
                    examples.append((ends, given))
    field.learn(examples[: 2 * rows])
    return field


# A stretch of words with a digit or an @: what training reads of a text.
_NEAR = r"(?:[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*[\x20]{0,2}){1,64}"


def spans_of(text: str | None, field: Field) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and base plus added spans, per kind and in order."""
    text = text or ""
    base = base_spans(text)
    whole = {kind: list(spans) for kind, spans in base.items()}
    taken = sorted(s for spans in base.values() for s in spans)
    for run in runs(text):
        if any(text.count(c, run[0][0], run[-1][1]) for c in "@.") or sum(c.isdigit() for c in text[run[0][0] : run[-1][1]]) >= 7:
            for kind, start, end in field.entities(text, run):
                if not any(s < end and start < e for s, e in taken):
                    whole[kind].append((start, end))
    return base, {kind: sorted(spans) for kind, spans in whole.items()}


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in spans[kind])


def _found(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans_of(text, shared.value) for text in batch.column("text").to_pylist()]
            made = {f"n_{k}": pa.array([len(b[k]) for b, _ in rows], pa.int64()) for k in KINDS}
            made["_base"] = pa.array([_listed(b) for b, _ in rows], pa.string())
            made["spans"] = pa.array([_listed(w) for _, w in rows], pa.string())
            columns = [made.get(n, batch.column(n)) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def with_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with n_email .. n_phone (base), ``_base`` and ``spans`` as kind:start:end lists."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fitted(docs))
    added = {f"n_{k}": F.lit(0).cast("long") for k in KINDS} | {"_base": F.lit(""), "spans": F.lit("")}
    wide = docs.withColumns(added)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in wide.schema.fields])
    return wide.mapInArrow(_found(shared), schema)


@query("op5_semi_markov")
def semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )
