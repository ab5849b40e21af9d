"""Operator 9: token counts from a tokenizer compiled into finite-state transducers.

The tokenizer is byte-level BPE. Its first step, cutting a text into pieces, is compiled into one
deterministic transducer over character classes: states say what the open piece is, transitions are
annotated with the pieces they end. All texts of a batch form one stream that is cut into chunks of equal
length; every chunk's map from entry state to exit state is worked out side by side, the maps are composed
by a parallel prefix scan, and with the entry states known one more pass emits the piece ends. The second
step maps each piece to its number of tokens by the merge ranks; it runs once per distinct piece, and its
results extend the transducer lazily: an edge per piece, annotated with the tokens it emits.

Added tokens of the file (such as an end-of-text mark) that stand in a text are cut out first and count
one each, as the library's default does. A null text is empty and has no tokens. Only the vocabulary file
is sent to the tasks (a fixed size); at most PIECES edges are held per task.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from earnloom.llm.registry import query
from earnloom.llm.words import read

LIMIT = 512
CHUNK = 512
SETTLE = 24
PIECES = 400_000

# --- classes and states of the piece transducer ----------------------------------------------------

OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, S_T_M_D, R, V, E, L, END = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, SPACES, ONE_BLANK, BLANKS, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
# White space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        table[point] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[WHITE] = BLANK
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for letter in "stmd":
        table[ord(letter)] = S_T_M_D
    for letter, kind in zip("rvel", (R, V, E, L)):
        table[ord(letter)] = kind
    return table


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Tables [state, class]: the next state, and where pieces start (HERE, BEFORE)."""
    letters = (LETTER, S_T_M_D, R, V, E, L)
    target = {k: IN_LETTERS for k in letters} | {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK}
    opens = target | {QUOTE: AFTER_QUOTE, END: START}  # a new piece opens with this character
    joins = target | {QUOTE: IN_OTHERS, END: START}  # the character goes on with an open blank or run
    follow, starts = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)

    def rule(state: int, kind: int, to: int, mark: int) -> None:
        follow[state, kind], starts[state, kind] = to, 0 if kind == END and mark == HERE else mark

    for kind in range(12):
        for state in range(12):
            rule(state, kind, opens[kind], HERE)
        for state, mark in ((ONE_SPACE, 0), (SPACES, BEFORE)):  # the last space belongs to what follows
            rule(state, kind, joins[kind], mark)
        rule(BLANKS, kind, opens[kind], HERE | BEFORE)  # the last blank is a piece of its own
        for state in (QUOTE_R, QUOTE_V, QUOTE_L):  # no contraction: the letter opens a run
            rule(state, kind, opens[kind], HERE | BEFORE)
    for state in (ONE_SPACE, SPACES, ONE_BLANK, BLANKS):
        rule(state, SPACE, SPACES, 0)
        rule(state, BLANK, BLANKS, 0)
        rule(state, END, START, 0)
    for kind in letters:
        rule(IN_LETTERS, kind, IN_LETTERS, 0)
        for state in (QUOTE_R, QUOTE_V, QUOTE_L):
            rule(state, kind, IN_LETTERS, BEFORE)
    for state in (QUOTE_R, QUOTE_V, QUOTE_L):
        rule(state, END, START, BEFORE)
    rule(IN_NUMBERS, NUMBER, IN_NUMBERS, 0)
    for kind in (OTHER, QUOTE):
        rule(IN_OTHERS, kind, IN_OTHERS, 0)
        rule(AFTER_QUOTE, kind, IN_OTHERS, 0)
    rule(AFTER_QUOTE, S_T_M_D, START, 0)
    for kind, state in ((R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        rule(AFTER_QUOTE, kind, state, 0)
    for state, kind in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        rule(state, kind, START, 0)
    return follow, starts


FOLLOW, STARTS = _transducer()
_CLASS_TABLE: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _CLASS_TABLE:
        _CLASS_TABLE.append(_classes())
    return _CLASS_TABLE[0]


def entry_states(kinds: np.ndarray) -> np.ndarray:
    """State before each column of ``kinds`` [position, chunk]; chunk 0 is entered in START."""
    length, chunks = kinds.shape
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], chunks, axis=1)
    settled = 0
    while settled < length and settled < SETTLE:
        maps = FOLLOW[maps, kinds[settled][None, :]]
        settled += 1
    alike = (maps == maps[0]).all(axis=0)
    one = maps[0].copy()
    left = np.flatnonzero(~alike)
    rest = maps[:, left]
    for at in range(settled, length):
        one = FOLLOW[one, kinds[at]]
        if len(left):
            rest = FOLLOW[rest, kinds[at, left][None, :]]
    maps = np.repeat(one[None, :], 12, axis=0)
    maps[:, left] = rest
    step = 1
    while step < chunks:  # maps[:, i] becomes the map of chunks 0 .. i
        composed = maps.copy()
        composed[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
        maps, step = composed, 2 * step
    return np.concatenate(([START], maps[START, :-1])).astype(np.uint8)


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Flags of the characters that open a piece. ``points``: code points, 0x110000 closing each text."""
    size = len(points)
    chunks = -(-size // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:size] = np.append(_class_table(), np.uint8(END))[points]
    kinds = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = entry_states(kinds)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for at in range(CHUNK):
        marks[at] = STARTS[state, kinds[at]]
        state = FOLLOW[state, kinds[at]]
    marks = marks.T.reshape(-1)
    flags = (marks & HERE) > 0
    flags[:-1] |= (marks[1:] & BEFORE) > 0
    return flags[:size]


# --- tokens of a piece -----------------------------------------------------------------------------


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Counter:
    """Tokens per text for one vocabulary file."""

    def __init__(self, merges: list, added: list[str]):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.added = sorted(added, key=len, reverse=True)
        self.letters = _byte_letters()
        self.edges: dict[str, int] = {}

    def tokens_of(self, piece: str) -> int:
        """Merge the lowest-ranked neighbours, leftmost first, until no pair has a rank."""
        symbols = [self.letters[b] for b in piece.encode("utf-8", "replace")]
        n = len(symbols)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        queue = [(self.ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] is None or j >= n or self.ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j], after[i], left = None, after[j], left - 1
            if after[i] < n:
                before[after[i]] = i
                rank = self.ranks.get((symbols[i], symbols[after[i]]))
                if rank is not None:
                    heapq.heappush(queue, (rank, i))
            if before[i] >= 0:
                rank = self.ranks.get((symbols[before[i]], symbols[i]))
                if rank is not None:
                    heapq.heappush(queue, (rank, before[i]))
        return left

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The text without added tokens, in pieces between them, and their number."""
        for token in self.added:
            if token in text:
                parts, total = [], 0
                for i, part in enumerate(text.split(token)):
                    found, n = self._segments(part)
                    parts += found
                    total += n + (i > 0)
                return parts, total
        return [text], 0

    def counts(self, texts: list[str]) -> list[int]:
        segments, owners, totals = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            found, totals[i] = self._segments(text)
            segments += [s for s in found if s]
            owners += [i] * sum(1 for s in found if s)
        if not segments:
            return totals
        lengths = np.array([len(s) for s in segments])
        whole = "".join(segments)
        letters = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        points = np.full(len(letters) + len(segments), 0x110000, np.int64)
        places = np.arange(len(letters)) + np.repeat(np.arange(len(segments)), lengths)
        points[places] = letters
        opened = np.flatnonzero(piece_starts(points)[places])
        bounds = [*opened.tolist(), len(whole)]
        edges, at = self.edges, 0
        counted = np.empty(len(opened), np.int64)
        for k in range(len(opened)):
            piece = whole[bounds[k] : bounds[k + 1]]
            n = edges.get(piece)
            if n is None:
                n = self.tokens_of(piece)
                if len(edges) >= PIECES:
                    edges.clear()
                if len(piece) < 64:
                    edges[piece] = n
            counted[k] = n
        owner = np.searchsorted(ends, opened, side="right")
        for i, n in enumerate(np.bincount(owner, weights=counted, minlength=len(segments)).astype(int).tolist()):
            totals[owners[i]] += n
        return totals


_COUNTERS: dict[str, Counter] = {}
BATCH_CHARS = 2_000_000


def _counted(shared, label: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if label not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[label] = Counter(*shared.value)
        counter = _COUNTERS[label]
        for batch in batches:
            texts, tokens, held, size = batch.column("text").to_pylist(), [], [], 0
            for text in texts:
                held.append(text or "")
                size += len(held[-1])
                if size > BATCH_CHARS:
                    tokens += counter.counts(held)
                    held, size = [], 0
            tokens += counter.counts(held) if held else []
            made = pa.array(tokens, pa.int64())
            columns = [made if n == "n_tokens" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def with_token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``n_tokens`` (put over a column of that name); ``vocabulary``: path of a byte-level BPE .json file."""
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file)
    if found["model"]["type"] != "BPE" or (found.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        raise ValueError("not a byte-level BPE file")
    added = [t["content"] for t in found.get("added_tokens", [])]
    shared = docs.sparkSession.sparkContext.broadcast((found["model"]["merges"], added))
    wide = docs.withColumn("n_tokens", F.lit(0).cast("long"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in wide.schema.fields])
    return wide.mapInArrow(_counted(shared, vocabulary), schema)


@query("op9_token_transducer")
def token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
