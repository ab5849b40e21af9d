"""Byte-pair transducer against the library, the plain merges, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from earnloom.llm import byte_pairs as B

VOCABULARIES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
ODD = ["", " ", "   ", "\n\n \t", "don't we'll I'M", "a" * 5000, "naïve façade — ½ ²³ ٣", "日本語 テスト 👩‍👩‍👧 \U0001f3f4", "x\x00y\x85z 　", "1234567890" * 30, "<|endoftext|>"]


@pytest.fixture(scope="module", params=VOCABULARIES)
def both(request):
    ranks = B.read_ranks(public_tokenizers.path(request.param))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, library, B.Encoder(ranks, B.last_merges(ranks))


def ids_of(encoder, text):
    return [i for p in B.regex.findall(public_tokenizers.PATTERN, text) for i in encoder.piece(p)]


def test_every_token_is_itself(both):
    ranks, _, encoder = both
    assert [t for t, r in ranks.items() if encoder._run(t) != [r]] == []


def test_pieces_of_random_tokens_and_letters(both):
    ranks, library, encoder = both
    draw, tokens = random.Random(7), list(ranks)
    for k in range(4000):
        if k % 2:
            piece = b"".join(draw.choice(tokens) for _ in range(draw.randint(2, 4)))
        else:
            piece = bytes(draw.choice(b"aabehnt \xc3\xa9\xe3\x81") for _ in range(draw.randint(1, 40)))
        wanted = [ranks[part] for part in B.merged(piece, ranks)]
        assert encoder._run(piece) in (wanted, [ranks.get(piece)])
        if piece.isascii():
            assert library._encode_bytes(piece) == encoder._run(piece)


def test_texts_equal_the_library(both):
    _, library, encoder = both
    for text in ODD:
        assert ids_of(encoder, text) == library.encode_ordinary(text)


def test_long_pieces_are_emitted_in_parts(both, monkeypatch):
    ranks, library, _ = both
    monkeypatch.setattr(B, "LOOKAHEAD", 150)
    encoder = B.Encoder(ranks, B.last_merges(ranks))
    draw = random.Random(3)
    for letters in ("ab", "the ion", "aaaaaaab"):
        piece = "".join(draw.choice(letters) for _ in range(3000)).replace(" ", "e")
        assert encoder._run(piece.encode()) == library._encode_bytes(piece.encode())


def test_forgotten_states_change_nothing(both, monkeypatch):
    ranks, library, _ = both
    monkeypatch.setattr(B, "STATES", 20)
    monkeypatch.setattr(B, "KEPT", 3)
    monkeypatch.setattr(B, "PAIRS", 5)
    encoder = B.Encoder(ranks, B.last_merges(ranks))
    for text in [*ODD, "a short line of words, and some more words of a line"]:
        assert ids_of(encoder, text) == library.encode_ordinary(text)


def test_tokens_that_nothing_merges_into():
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    encoder = B.Encoder(ranks, B.last_merges(ranks))
    assert set(encoder.whole) == {b"xyz"}
    assert encoder._run(b"xyz") == [257] and encoder._run(b"xyzab") == [120, 121, 122, 256]


def test_equal_ranks_and_late_parts():
    """Merges of a token by another cut than its own, and ties of overlapping pairs."""
    ranks = {bytes((b,)): b for b in range(256)}
    for token in (b"aa", b"ab", b"bc", b"abc", b"aab", b"ca", b"aaaa", b"bcab"):
        ranks[token] = len(ranks)
    encoder = B.Encoder(ranks, B.last_merges(ranks))
    draw = random.Random(1)
    for _ in range(3000):
        piece = "".join(draw.choice("aabc") for _ in range(draw.randint(1, 14)))
        raw = piece.encode()
        wanted = [ranks[raw]] if raw in ranks else [ranks[p] for p in B.merged(raw, ranks)]
        assert encoder.piece(piece) == wanted, piece


def test_streaming_decoder(both):
    ranks, library, _ = both
    tokens = {r: t for t, r in ranks.items()}
    decoder = B.Decoder(tokens)
    for text in ODD:
        ids = library.encode_ordinary(text)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == text
        assert decoder.feed(ids) + decoder.close() == text
    draw = random.Random(5)
    for _ in range(500):
        ids = [draw.choice(list(tokens)[:600]) for _ in range(8)]
        assert decoder.feed(ids) + decoder.close() == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
    assert decoder.feed([None, -5]) + decoder.close() == "��"


def test_bad_rank_files(tmp_path):
    path = tmp_path / "few"
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        B.read_ranks(str(path))


def test_odd_rows(spark, odd, nothing):
    ranks = public_tokenizers.path(VOCABULARIES[0])
    clash = odd.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = B.decoded(B.encoded(clash, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(rows) == odd.count()
    for row in rows:
        assert row["decoded"] == (row["_row"]["text"] or "") and row["_row"]["ids"] == "x"
        assert (row["_row"]["text"] in (None, "")) == (row["ids"] == [])
    assert [r["ids"] for r in B.verified(clash, ranks, public_tokenizers.PATTERN).collect()] == [r["ids"] for r in rows]
    assert B.decoded(B.encoded(nothing, ranks, public_tokenizers.PATTERN), ranks).collect() == []


def test_query(spark, both):
    ranks, library, _ = both
    if len(ranks) and ranks != B.read_ranks(public_tokenizers.path(VOCABULARIES[0])):
        pytest.skip("the query's vocabulary is the first")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{entry.SMALL}/documents.parquet").collect()}
    made = {r["doc_id"]: r for r in entry.LLM_QUERIES["op11_byte_pair_transducer"](spark, entry.SMALL).collect()}
    assert made.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert made[i]["n_tokens"] == len(ids)
        assert made[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert made[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
