"""Operator 11: byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Compiling. Every token of the vocabulary is merged from its bytes once, which gives its last merge (left and
right part). Two tokens may stand side by side if no merge joins them: the symbols on both sides of the border
are the right edge of one tree of merges and the left edge of the other, each there from its own merge to its
parent's, and a pair of them that are there together must have no merge that comes first. A sequence of
tokens whose neighbours all fit is the encoding, and every prefix of a text has exactly one.

Encoding. So a transducer guesses where tokens end. Its configurations are the bytes of an open token and what
the closed token before it allows the open one to become; a byte extends all open tokens, and exactly one
of them can close. Where only FEW tokens begin with the open bytes, "what it allows" is the list of those
that fit, so closed tokens with the same effect are one configuration, and one that allows none is dropped.
The sets of configurations are made states when a text first reaches them (STATES are held per process, then all are
forgotten and made again), and a transition says which token closes at its byte. A piece is emitted by
following the closed tokens back from its end. In a long piece that is done every LOOKAHEAD bytes up to the
place where all configurations agree; as an open token is at most as long as the longest of the
vocabulary, only a bounded part stays behind. Results of short pieces are kept, the last KEPT used at least
and twice as many at most.
Tokens that their own bytes never merge into stand only for a whole piece, as in the rank-file libraries.

Decoding is an automaton too: its state is the unfinished UTF-8 sequence (at most three bytes), its
transitions by token (at most the vocabulary for each of some thousand states) give the characters finished; wrong bytes, unfinished ends, null and unknown ids give
U+FFFD each.

A null or empty text has no tokens, and no tokens decode to an empty text. Rows are worked on one by one, so repeated
rows give repeated results and an empty table an empty one. Texts may be of any length: ids of one are
held at a time besides the Arrow batch. Columns of any names stay in ``_row``. Only the vocabulary
(a fixed size) is sent to the tasks.
"""

from __future__ import annotations

import base64
import binascii
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read, ship

STATES = 150_000
PAIRS = 150_000
FEW = 8
KEPT = 70_000
SHORT = 32
LOOKAHEAD = 4096
LONG = 1_000_000
UNKNOWN = "�"


# --- the vocabulary --------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from lines of base64 text and a number."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                try:
                    ranks[base64.b64decode(token, validate=True)] = int(rank)
                except binascii.Error as wrong:
                    raise ValueError(f"not a rank file: {path}") from wrong
    if any(bytes((b,)) not in ranks for b in range(256)):
        raise ValueError("a rank file needs all 256 single bytes")
    return ranks


def merged(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The piece's symbols after merging the lowest rank, leftmost first, down to ``until`` symbols at least."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """Left and right part of every token of two bytes or more that its bytes merge into."""
    splits = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merged(token, ranks, until=2)
            if len(parts) == 2:
                splits[rank] = (ranks[parts[0]], ranks[parts[1]])
    return splits


class _NoneFits(Exception):
    """No token or more than one may end here: the vocabulary does not come from merges."""


# A state is a dict from a byte to (token that closes, next state); at HELD it has its configurations: pairs of what
# the open token may be and its bytes, the one with nothing open last. It may be any token (None), any
# that fits a closed one (its id), or one of a few (their ids).
HELD = -1


class Encoder:
    """Ids of pieces; states, transitions and fitting pairs are worked out when first needed."""

    def __init__(self, ranks: dict[bytes, int], splits: dict[int, tuple[int, int]]):
        self.ranks = ranks
        self.splits = splits
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.whole = {token: rank for token, rank in ranks.items() if len(token) > 1 and rank not in splits}
        # beginnings of tokens: the token that ends here, and the longer ones, up to one more than FEW
        self.edges: dict[bytes, list] = {}
        for token, rank in ranks.items():
            if token not in self.whole:
                self.edges.setdefault(token, [None, ()])[0] = rank
                for i in range(1, len(token)):
                    edge = self.edges.setdefault(token[:i], [None, ()])
                    if len(edge[1]) <= FEW:
                        edge[1] += (rank,)
        self.made: dict[int, int] = {}
        self.ends: dict[tuple[int, int], list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.kept: dict[str, list[int]] = {}
        self.kept_before: dict[str, list[int]] = {}
        self.states: dict[tuple, dict] = {}
        self._forget()

    def _forget(self) -> None:
        """Begin anew; the old states point at each other, so only a collection frees them."""
        if self.states:
            self.states.clear()
            gc.collect()
        self.start: dict = {HELD: ((None, b""),)}
        self.states[self.start[HELD]] = self.start

    def _time(self, token: int) -> int:
        """When the token's last merge can happen: its rank, and not before its parts are there."""
        known = self.made.get(token)
        if known is None:
            parts = self.splits.get(token)
            known = self.made[token] = -1 if parts is None else max(token, *map(self._time, parts))
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, float]]:
        """Symbols that lie at one end of the token while it is merged: bytes, first and last time."""
        known = self.ends.get((token, side))
        if known is None:
            known, until, symbol = [], float("inf"), token
            while True:
                known.append((self.tokens[symbol], self._time(symbol), until))
                parts = self.splits.get(symbol)
                if parts is None:
                    break
                until, symbol = self._time(symbol), parts[side]
            self.ends[token, side] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """No merge joins the two tokens when they stand side by side."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        starts = self._edge(right, 0)
        for a, a_from, a_until in self._edge(left, 1):
            for b, b_from, b_until in starts:
                rank = self.ranks.get(a + b)
                if rank is not None:
                    at = max(rank, a_from, b_from)
                    # of equal ranks the leftmost merges first
                    if at < a_until and (at < b_until or rank == b_until):
                        return False
        return True

    def _allowed(self, before: int | tuple | None, opened: bytes, longer: tuple) -> int | tuple | None:
        """What an open token may be; an empty tuple: nothing."""
        if before is None or isinstance(before, int) and len(longer) > FEW:
            return before
        if isinstance(before, int):
            found = tuple(token for token in longer if self.fits(before, token))
        else:
            found = tuple(token for token in before if token in longer) if len(longer) <= FEW else before
        return None if len(found) == len(longer) else found

    def _step(self, state: dict, byte: int) -> tuple[int, dict]:
        live, ended = [], []
        for before, opened in state[HELD]:
            opened += bytes((byte,))
            edge = self.edges.get(opened)
            if edge is None:
                continue
            token, longer = edge
            if longer:
                allowed = self._allowed(before, opened, longer)
                if allowed != ():
                    live.append((allowed, opened))
            if token is None:
                continue
            if before is None or (token in before if isinstance(before, tuple) else self.fits(before, token)):
                ended.append((token, b""))
        if len(ended) != 1:
            raise _NoneFits
        key = (*live, ended[0])
        follow = self.states.get(key)
        if follow is None:
            if len(self.states) >= STATES:
                self._forget()
            follow = self.states[key] = {HELD: key}
        step = state[byte] = (ended[0][0], follow)
        return step

    def _back(self, closed: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, given the token that closes at every byte."""
        found = []
        while at:
            token = closed[at - 1]
            found.append(token)
            at -= self.sizes[token]
        found.reverse()
        return found

    def _agreed(self, closed: list[int], state: dict) -> int:
        """Number of bytes whose tokens all configurations share."""
        places = {len(closed) - len(opened) for _, opened in state[HELD]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.sizes[closed[last - 1]])
        return places.pop()

    def _run(self, piece: bytes) -> list[int]:
        if piece in self.whole:
            return [self.whole[piece]]
        state, closed, out = self.start, [], []
        for at in range(0, len(piece), LOOKAHEAD):
            if at:
                sure = self._agreed(closed, state)
                out += self._back(closed, sure)
                closed = closed[sure:]
            push = closed.append
            for byte in piece[at : at + LOOKAHEAD]:
                step = state.get(byte)
                if step is None:
                    step = self._step(state, byte)
                token, state = step
                push(token)
        return out + self._back(closed, len(closed))

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece."""
        found = self.kept.get(piece) or self.kept_before.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            try:
                found = self._run(raw)
            except _NoneFits:
                found = [self.ranks[part] for part in merged(raw, self.ranks)]
        if len(piece) <= SHORT:
            if len(self.kept) >= KEPT:
                self.kept_before, self.kept = self.kept, {}
            self.kept[piece] = found
        return found

    def pieces(self, pieces: Iterable[str]) -> list[int]:
        """Ids of all pieces of a text."""
        ids: list[int] = []
        for piece in pieces:
            ids += self.kept.get(piece) or self.piece(piece)
        return ids


# First bytes of UTF-8 sequences, their lengths, and the second bytes that may follow them.
_LENGTHS = {**dict.fromkeys(range(0xC2, 0xE0), 2), **dict.fromkeys(range(0xE0, 0xF0), 3), **dict.fromkeys(range(0xF0, 0xF5), 4)}
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def utf8_step(held: bytes, byte: int) -> tuple[bytes, str]:
    """The unfinished sequence after one more byte, and the characters that are finished."""
    if held:
        low, high = _SECOND.get(held[0], (0x80, 0xBF)) if len(held) == 1 else (0x80, 0xBF)
        if low <= byte <= high:
            held += bytes((byte,))
            return (b"", held.decode("utf-8")) if len(held) == _LENGTHS[held[0]] else (held, "")
        after, text = utf8_step(b"", byte)
        return after, UNKNOWN + text
    if byte < 0x80:
        return b"", chr(byte)
    return (bytes((byte,)), "") if byte in _LENGTHS else (b"", UNKNOWN)


class Decoder:
    """Text of ids, which may come in portions: ``feed`` gives what is finished, ``close`` the rest."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        # a state is a dict from a token to (next state, characters finished); at HELD its unfinished bytes
        self.states: dict[bytes, dict] = {b"": {HELD: b""}}
        self.state = self.states[b""]

    def _step(self, state: dict, token: int | None) -> tuple[dict, str]:
        held = state[HELD]
        raw = None if token is None or token < 0 else self.tokens.get(token)
        after, text = held, []
        if raw is None:
            after, text = b"", [UNKNOWN * (2 if held else 1)]
        for byte in raw or b"":
            after, done = utf8_step(after, byte)
            text.append(done)
        step = (self.states.setdefault(after, {HELD: after}), "".join(text))
        if raw is not None:
            state[token] = step
        return step

    def feed(self, ids: list) -> str:
        text, state = [], self.state
        for token in ids:
            step = state.get(token)
            if step is None or token == HELD:
                step = self._step(state, token)
            state, done = step
            text.append(done)
        self.state = state
        return "".join(text)

    def close(self) -> str:
        rest, self.state = (UNKNOWN if self.state[HELD] else ""), self.states[b""]
        return rest


# --- columns ---------------------------------------------------------------------------------------

_BUILT: dict[str, object] = {}


def _built(label: str, make):
    """One encoder and one decoder are kept per worker process."""
    if label not in _BUILT:
        for other in [k for k in _BUILT if k.split(":")[0] == label.split(":")[0]]:
            del _BUILT[other]
        _BUILT[label] = make()
    return _BUILT[label]


@contextmanager
def _without_gc():
    """The states stay, and looking through them for garbage again and again would take a quarter of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _encoder(spark: SparkSession, vocabulary: str, pattern: str):
    """A function from a text to its ids, made in the tasks from a broadcast vocabulary."""
    ship(spark)
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, last_merges(ranks)))
    label = "encoder:" + uuid.uuid4().hex

    def make():
        encoder = _built(label, lambda: Encoder(*shared.value))
        pieces = regex.compile(pattern)

        def ids_of(text: str | None) -> np.ndarray:
            text = text or ""
            found = pieces.findall(text) if len(text) < LONG else (m.group() for m in pieces.finditer(text))
            return np.array(encoder.pieces(found), np.int32)

        return ids_of

    return make


def _decoder(spark: SparkSession, vocabulary: str):
    """A function from ids to their text, made in the tasks from a broadcast vocabulary."""
    ship(spark)
    shared = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(vocabulary).items()})
    label = "decoder:" + uuid.uuid4().hex

    def make():
        decoder = _built(label, lambda: Decoder(shared.value))
        return lambda ids: decoder.feed(ids) + decoder.close()

    return make


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def token_ids(text: Column, vocabulary: str, pattern: str) -> Column:
    """The ids of a text, an ``array<int>``: each match of ``pattern`` is encoded separately."""
    make = _encoder(SparkSession.active(), vocabulary, pattern)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = make()
        for texts in batches:
            with _without_gc():
                found = [ids_of(value.as_py()) for value in texts]
            yield _lists(found)

    return encode(text)


def token_text(ids: Column, vocabulary: str) -> Column:
    """The text of an array of ids."""
    make = _decoder(SparkSession.active(), vocabulary)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text_of = make()
        for lists in batches:
            yield pa.array([text_of(each.as_py() or []) for each in lists], pa.string())

    return decode(ids)


def round_trip(text: Column, vocabulary: str, pattern: str) -> Column:
    """A struct of ``ids`` and ``decoded``, the text that the ids give back: both steps in one pass over the rows."""
    spark = SparkSession.active()
    make_encoder, make_decoder = _encoder(spark, vocabulary, pattern), _decoder(spark, vocabulary)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of, text_of = make_encoder(), make_decoder()
        for texts in batches:
            with _without_gc():
                found = [ids_of(value.as_py()) for value in texts]
                texts = pa.array([text_of(ids.tolist()) for ids in found], pa.string())
            yield pa.StructArray.from_arrays([_lists(found), texts], ["ids", "decoded"])

    return both(text)


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``_row`` with all columns of ``docs``, and ``ids``."""
    return docs.select(_row(docs), token_ids(F.col(f"`{text}`"), vocabulary, pattern).alias("ids"))


def decoded(found: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of ``encoded`` with ``decoded``, the text that the ids give."""
    return found.withColumn("decoded", token_text(F.col("ids"), vocabulary))


def verified(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``_row`` with all columns of ``docs``, ``ids`` and ``decoded``."""
    made = docs.select(_row(docs), round_trip(F.col(f"`{text}`"), vocabulary, pattern).alias("_made"))
    return made.select("_row", F.col("_made.ids").alias("ids"), F.col("_made.decoded").alias("decoded"))


@query("op11_byte_pair_transducer")
def byte_pair_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return verified(docs, ranks, public_tokenizers.PATTERN).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
