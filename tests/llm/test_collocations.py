"""Collocations against plain counting."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import Row, functions as F

from earnloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, a int"


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for end in ".,;:!?\n\x0b\x0c\r":
        lowered = lowered.replace(end, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in lowered.split("\n")]


def brute(rows, longest, least, covered, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    made = []
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        hidden = {
            g[s : s + m] for g, b in frequent.items() for m in range(2, len(g)) for s in range(len(g) - m + 1) if 100 * b >= covered * f[g[s : s + m]]
        }
        scored = []
        for g, a in frequent.items():
            if g not in hidden:
                cut = min((C.SCALE * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-cut[0], -a, " ".join(g).encode(), f[g[: cut[1]]], f[g[cut[1] :]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            made.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(made)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    words = ["a", "B", "c", "dé", "ee", "\x85f", "日本", "g-h"]
    out = []
    for _ in range(120):
        line = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ". ", "\n", " \r\n", "  ", "!"]) for _ in range(draw.randint(0, 60)))
        out.append((draw.choice(["en", "de", "und", None]), line))
    return out + [(None, None), ("fr", ""), ("fr", " .,; \n"), ("fr", "solo")]


@pytest.mark.parametrize("longest,least,covered,top", [(3, 10, 50, 2000), (2, 3, 50, 5), (4, 2, 30, 2000), (5, 2, 100, 7)])
def test_equal_to_plain_counts(spark, texts, longest, least, covered, top):
    df = spark.createDataFrame([Row(i, t, lang, "p", 1) for i, (lang, t) in enumerate(texts)], SCHEMA)
    assert rows_of(C.collocations(df, longest, least, covered, top)) == brute(texts, longest, least, covered, top)


def test_portions_change_nothing(spark, texts, monkeypatch):
    wanted = sorted(map(tuple, _counts(texts, 3)))
    for held, block in ((1, 10), (50, 3), (7, 1_000_000)):
        monkeypatch.setattr(C, "HELD", held)
        monkeypatch.setattr(C, "BLOCK", block)
        assert sorted(map(tuple, _counts(texts, 3))) == wanted


def _counts(texts, longest):
    portion = C.Portion()
    for _, text in texts:
        portion.add(text or "")
    summed = Counter()
    for phrases, counts, _ in portion.counts(longest):
        for p, n in zip(phrases.to_pylist(), counts.tolist()):
            summed[p] += n
    return summed.items()


def test_many_words_do_not_overflow():
    portion = C.Portion()
    portion.add(" ".join(f"w{i}" for i in range(3000)) + " . w1 w2 w3 w4 w5 w6")
    six = Counter()
    for phrases, counts, _ in portion.counts(6):
        six.update(dict(zip(phrases.to_pylist(), counts.tolist())))
    assert six["w1 w2 w3 w4 w5 w6"] == 2 and six["w2994 w2995 w2996 w2997 w2998 w2999"] == 1 and six[""] == 3006
    assert "w2999 w1" not in six


def test_scores_beyond_64_bits(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(200):
        a = draw.randrange(1, 10**15)
        rows.append((a, a + draw.randrange(10**15), a + draw.randrange(10**15)))
    made = spark.createDataFrame(rows, "a long, l long, r long").select("*", C.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    for r in made.collect():
        assert r["s"] == Fraction(C.SCALE * r["a"] ** 2, r["l"] * r["r"]) // 1


def test_odd_rows(spark, odd, nothing):
    clash = odd.withColumn("phrase", F.lit("x")).withColumn("_lang", F.lit("y"))
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert rows_of(C.collocations(clash, least=2)) == brute(rows, 3, 2, 50, 2000)
    assert C.collocations(nothing).collect() == []
