"""Periodic runs against all lags and all stretches."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from earnloom.llm import periodic_runs as R


def brute_runs(words, least=6, copies=4):
    found, n = set(), len(words)
    for lag in range(1, n // copies + 1):
        at = lag
        while at < n:
            end = at
            while end < n and words[end] == words[end - lag]:
                end += 1
            length = end - at + lag
            if end > at and length >= max(least, copies * lag):
                part = words[at - lag : end]
                if not any(part[k:] == part[:-k] for k in range(1, lag)):
                    found.add((at - lag, length, lag))
            at = max(end, at + 1)
    return sorted(found)


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def texts(seed, n):
    draw = random.Random(seed)
    for k in range(n):
        letters = draw.choice([1, 2, 3, 7])
        words = [draw.randrange(letters) for _ in range(draw.randint(0, 100))]
        if k % 2:
            period = [draw.randrange(letters) for _ in range(draw.randint(1, 40))]
            if k % 4 == 1:
                period = [w for w in period for _ in range(draw.randint(1, 5))]
            turns = period * draw.randint(3, 7)
            words = words[:30] + turns[: len(turns) - draw.randrange(len(period))] + words[30:]
            if k % 8 == 1:
                words = (words * 5)[:500]
        yield words


def test_runs_equal_all_lags():
    for words in texts(1, 3000):
        assert R.runs_of(numbers(words)) == brute_runs(words), words


@pytest.mark.parametrize("least,copies", [(1, 3), (4, 3), (20, 5), (3, 6)])
def test_other_lengths(least, copies):
    for words in texts(2, 400):
        assert R.runs_of(numbers(words), least, copies) == brute_runs(words, least, copies)


def test_two_copies_are_refused():
    with pytest.raises(ValueError):
        R.runs_of(numbers("a a a".split()), 3, 2)


def test_long_texts_with_few_words_are_quick():
    assert R.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert R.runs_of(np.arange(300_000, dtype=np.int64) % 97) == [(0, 300_000, 97)]
    a, b = "0", "01"
    while len(b) < 100_000:
        a, b = b, b + a
    assert R.runs_of(numbers(b)) == []  # no part of a Fibonacci word repeats four times
    nested = (["x"] * 8 + ["y"]) * 5_000
    found = R.runs_of(numbers(nested))
    assert len(found) == 5_001 and (0, 45_000, 9) in found and (9, 8, 1) in found


def test_collapsed_words():
    words = "s a b a b a b a b t t t t t t t u".split()
    runs = R.runs_of(numbers(words))
    assert runs == [(1, 8, 2), (9, 7, 1)]
    assert R.collapsed([w.encode() for w in words], runs) == b"s a b t u"


def brute_turned(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    number = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if number is None or number % 10 or not words:
        return words
    n, rest = len(words), number // 10
    a = rest % n
    p = 1 + (n - a) // (3 + rest % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_rewritten_texts(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(f"w{draw.randrange(30)}" for _ in range(draw.randint(0, 60)))) for i in range(400)] + [(None, "a b"), (30, None)]
    made = R.looped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["text"] or "").split() for r in made] == [brute_turned(*r) for r in rows]
    assert sum(brute_turned(*r) != (r[1] or "").split() for r in rows) > 20


def test_odd_rows(spark, odd, nothing):
    clash = odd.withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(1))
    rows = R.with_runs(clash).collect()
    assert len(rows) == odd.count()
    for row in rows:
        words = (row["_row"]["text"] or "").split()
        assert [tuple(r) for r in row["runs"]] == (brute_runs(words) if len(words) < 1000 else [(0, 40_000, 997)])  # the long text's words go round
        assert row["_row"]["runs"] == "x"
        if not row["runs"]:
            assert row["collapsed"] == " ".join(words)
    assert R.with_runs(nothing).collect() == []
