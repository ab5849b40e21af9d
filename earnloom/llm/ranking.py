"""Operator 3: document quality by Bradley-Terry ranking.

Labelled documents give preference pairs (a document of label 1 over one of label 0). Each document has a
vector of measures of its whole text, cut into bins of about equal counts; the score w . x is learned by logistic loss
on the differences of a pair's vectors (Newton steps with a small ridge). The threshold is the quantile of
the training scores at the share of label 0; the score shown is a logistic of the distance to it, so that
the threshold lies at CUT.

All labelled rows teach. Every text is measured once, and the measures (not the texts) are pinned. Cuts and the threshold
come from counts of all rows in fine cells of a fixed scale. For the weights the rows are dealt into parts of
about PART rows; in its part each row of the more frequent label meets PAIRS of the other one (a rare label
goes to several parts, so that each has FEW of it if there are as many). A step adds up slope and curvature of all pairs
on the tasks; only their sums reach the driver, a table of the model's size.

Null and empty texts are scored by their (zero) measures. Labels that are null, or of unknown documents,
teach nothing; with labels of one kind only every score is 1 or 0. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from earnloom.llm.registry import query
from earnloom.llm.words import read
from earnloom.session import pinned

PAIRS, PART, FEW, CHUNK = 8, 100_000, 1_000, 8_192
BINS, RIDGE, STEPS = 10, 1.0, 25
FINE, GRID = 2_000, 4_096
CUT = 0.3
FOLDS = 5
_LINE = re.compile(r"[^\n]+")


def measures(text: str | None) -> list[float]:
    """Measures of a whole text."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(words)), max(1, len(text))
    raw = text.encode("utf-8", "replace")
    counts = Counter(words)
    common = counts.most_common(3)
    threes = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in _LINE.findall(text) if x.strip()]
    letters = sum(map(text.count, "|#*$%&<>!"))
    upper = sum(1 for c in text if c.isupper())
    short = sum(1 for w in words if len(w) <= 3)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n,
        upper / m,
        sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / m,
        letters / m,
        text.count("|") / n,
        text.count("!") / n,
        (text.count(".") + text.count(",")) / n,
        short / n,
        len(counts) / n,
        common[0][1] / n if common else 0.0,
        sum(c for _, c in common) / n,
        1 - len(threes) / max(1, len(words) - 2),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        sum(1 for w in words if w.islower()) / n,
        sum(1 for w in words if w.isalpha()) / n,
        max(map(len, words), default=0) / n,
    ]


N_MEASURES = len(measures(""))
_KIND = T.ArrayType(T.DoubleType())


@F.pandas_udf(_KIND)
def _measured(texts: pd.Series) -> pd.Series:
    return texts.map(measures)


class Ranking:
    """Bins per measure, a weight per bin, and the threshold of the raw score."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.offsets = np.cumsum([0] + [len(e) + 1 for e in edges])
        self.weights = np.zeros(self.offsets[-1])
        self.threshold = 0.0
        self.only: int | None = None

    def places(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self.offsets[k] + np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[self.places(rows)].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(rows), float(self.only))
        away = np.clip(self.raw(rows) - self.threshold, -30, 30)
        return 1 / (1 + (1 - CUT) / CUT * np.exp(-away))


def fold(key: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _matrix(rows) -> np.ndarray:
    return np.array(list(rows), float).reshape(len(rows), N_MEASURES)


def _cells_at(cells: DataFrame, shares: list[float]) -> dict[tuple[int, float], int]:
    """The cell (k, cell) up to which a share of the rows of k lies; there are as many cells as the scale has."""
    counted = cells.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("k")
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    found = placed.groupBy("k").agg(
        *[F.min(F.when(F.col("_upto") >= F.lit(share) * F.col("_all"), F.col("cell"))).alias(f"s{i}") for i, share in enumerate(shares)]
    )
    return {(r["k"], share): r[f"s{i}"] for r in found.collect() for i, share in enumerate(shares)}


def _steps(model: Ranking):
    """Sums over the pairs of a part: the slope and the curvature of the logistic loss at the model's weights."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "quality"], kind="stable")
        places, labels = model.places(_matrix(rows["x"])), rows["quality"].to_numpy()
        good, bad = places[labels == 1], places[labels == 0]
        draw, size = np.random.default_rng(1), len(model.weights)
        slope, curve = np.zeros(size), np.zeros((size, size))
        more = max(len(good), len(bad)) * PAIRS if len(good) and len(bad) else 0
        first = second = np.empty(0, int)
        if more:  # rows of the more frequent label in turn, those of the other one drawn
            turn, drawn = np.resize(draw.permutation(more // PAIRS), more), draw.integers(0, min(len(good), len(bad)), more)
            first, second = (turn, drawn) if len(good) >= len(bad) else (drawn, turn)
        for at in range(0, more, CHUNK):
            left = np.zeros((len(first[at : at + CHUNK]), size), np.float32)
            lines = np.arange(len(left))[:, None]
            left[lines, good[first[at : at + CHUNK]]] = 1.0  # a row has one place per measure
            left[lines, bad[second[at : at + CHUNK]]] -= 1.0
            chance = 1 / (1 + np.exp(-np.clip(left @ model.weights, -30, 30)))
            slope += left.T @ (1 - chance)
            curve += (left * (chance * (1 - chance))[:, None].astype(np.float32)).T @ left
        return pd.DataFrame({"at": np.arange(size * (size + 1)), "v": np.concatenate([slope, curve.ravel()])})

    return run


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``x``, the measures of their texts."""
    return docs.withColumn("x", _measured(F.col(text)))


def fitted(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking learned from all ``labels`` (doc_id, quality) of the folds other than 0; ``docs`` with ``x`` are not measured again."""
    known = labels.select("doc_id", "quality").filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)
    )
    rows = (docs if "x" in docs.columns else measured(docs)).select("doc_id", "x")
    train = pinned(rows.join(known, "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "x"))
    counts = {r["quality"]: r["n"] for r in train.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    cuts = [float(c) for c in np.linspace(0, 1, BINS + 1)[1:-1]]
    each = train.select(F.posexplode("x").alias("k", "v"))
    found = _cells_at(each.select("k", F.floor(F.log1p(F.col("v") * 1000) * FINE).alias("cell")), cuts)
    edges = [
        np.unique([np.expm1((found[k, c] + 1) / FINE) / 1000 for c in cuts]) if good + bad else np.empty(0) for k in range(N_MEASURES)
    ]
    model = Ranking(edges)
    if not good or not bad:
        model.only = int(good > 0)
        return model
    parts = -(-(good + bad) // PART)
    copies = min(parts, max(1, -(-parts * FEW // min(good, bad))))
    rare = F.col("quality") == (1 if good < bad else 0)
    number = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    several = F.sequence(F.lit(0), F.when(rare, copies - 1).otherwise(0))
    dealt = pinned(train.select("*", F.explode(F.transform(several, lambda i: F.pmod(number + i, F.lit(parts)))).alias("part")))
    size = len(model.weights)
    for _ in range(STEPS):
        sums = dealt.groupBy("part").applyInPandas(_steps(model), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        values = np.zeros(size * (size + 1))
        for row in sums.collect():
            values[row["at"]] = row["v"]
        slope, curve = values[:size] - RIDGE * model.weights, values[size:].reshape(size, size)
        step = np.linalg.solve(curve + RIDGE * np.eye(size), slope)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = np.round(model.weights, 9)
    raw = F.pandas_udf(lambda x: pd.Series(model.raw(_matrix(x))), T.DoubleType())
    # between the scores of the ranks around the share
    low, high = ((bad + side) / (good + bad) for side in (-0.5, 0.5))
    found = _cells_at(train.select(F.lit(0).alias("k"), F.floor(raw("x") * GRID).alias("cell")), [low, high])
    model.threshold = (found[0, low] + 1 + (found[0, high] - found[0, low]) * good / (good + bad)) / GRID
    return model


def scored(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(shared.value.score(_matrix(rows)), dtype=float)

    if "x" in docs.columns:
        return docs.withColumn("score", score("x"))
    return docs.withColumn("score", score(_measured(F.col(text))))


@query("op3_pairwise_quality")
def pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pinned(measured(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    ranking = fitted(docs, read(spark, sf_dir, "labels"))
    return scored(docs, ranking).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
