"""Operator 2: quality rules by distribution divergence.

A document's character classes (lower, upper, digit, blank, other ASCII, beyond ASCII) and its counts of
the language's most common words are held against the language's references by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). References are learned from all documents: class sums
per language, and the COMMON most frequent words with their shares of all words (all others are one more
bin). A language with fewer than REFERENCE_WORDS words has no reference. Guards: texts below MIN_CHARS
characters or MIN_WORDS words are not held against the respective reference. Where a language has common
words of at most SHORT characters, a text of MIN_WORDS words none of which is so short is at distance 1. A
document fails if either
distance is above its limit, or if the base rules fail: fewer than 50 words, or more than half of the words
in repeated 3-word windows.

Everything is worked out in the row: 3-word windows are hashed (xxhash64 of their words' hashes); hashes that repeat are found by
sorting, and their windows by a look-up of the few repeated hashes or, where there are many, by sorting
(hash, position). Classes are counted by taking one class after the other out of the words. Only counts of
(language, word), combined before the shuffle, and sums of characters leave the tasks; class sums of a language
follow from its counts of words.
References are broadcast while they are at most BROADCAST_LANGUAGES.

A null or empty text has no words, fails the base rules and has null distances; null is a language of its
own; repeated rows are judged alike; an empty table gives an empty result. Columns of the documents go
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import BLANKS, read, text_of, words
from earnloom.session import pinned

COMMON, SHORT = 20, 4
FEW = 64
REFERENCE_WORDS = 1000
MIN_CHARS, MIN_WORDS = 200, 50
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.55
LEAST_WORDS, MOST_REPEATED = 50, 50
BROADCAST_LANGUAGES = 10_000
# Characters taken as symbols.
SYMBOLS = r"[#*$%&|<>]+"


def _covered(positions: Column) -> Column:
    """Words covered by windows of three at these sorted positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


# Classes of the characters of words; all others are beyond ASCII. Blanks are what words leave of a text.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[\x00-\x7F]+")


def _without_classes(frame: DataFrame, letters: str) -> DataFrame:
    """Add ``_rest1`` .. ``_rest4``: the letters of words less the first, the first two, ... classes."""
    before = letters
    for i, pattern in enumerate(CLASSES, 1):
        frame = frame.withColumn(f"_rest{i}", F.regexp_replace(before, pattern, ""))
        before = f"_rest{i}"
    return frame


def _class_counts(letters: str) -> list[Column]:
    lengths = [F.length(letters), *[F.length(f"_rest{i}") for i in range(1, len(CLASSES) + 1)]]
    return [(lengths[i] - lengths[i + 1]).cast("long") for i in range(len(CLASSES))] + [lengths[-1].cast("long")]


def _with_blanks(counts: list, blanks: Column) -> Column:
    """Counts of all classes in their order: the blanks come fourth."""
    return F.array(*counts[:3], blanks, *counts[3:])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` packed in ``_row``, with the language ``_lang``, the base counts, ``_words`` and ``_classes``."""
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("lang").alias("_lang"), text_of().alias("_text")
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # the words come first: their letters without the blanks between make long runs for the classes
    frame = frame.withColumn("_words", words(F.col("_text"))).withColumn("_letters", F.array_join("_words", ""))
    classes = _class_counts("_letters")
    frame = _without_classes(frame, "_letters").select(
        "_row",
        "_lang",
        "_words",
        _with_blanks(classes, (F.length("_text") - F.length("_letters")).cast("long")).alias("_classes"),
        F.length("_letters").cast("long").alias("word_chars"),
        (F.length("_rest3") - F.length(F.regexp_replace("_rest3", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    none = F.array().cast("array<int>")
    nothing = F.array().cast("array<bigint>")
    # a window's hash is chained from the hashes of its words: neighbours are paired, not looked up by place
    frame = frame.withColumn("_ones", F.when(n > 2, F.transform("_words", lambda w: F.xxhash64(w))).otherwise(nothing))
    chain = lambda a, b: F.xxhash64(a, b)
    pairs = F.zip_with(F.slice("_ones", F.lit(1), n - 2), F.slice("_ones", F.lit(2), n - 2), chain)
    frame = frame.withColumn("_hashes", F.when(n > 2, F.zip_with(pairs, F.slice("_ones", F.lit(3), n - 2), chain)).otherwise(nothing))
    frame = frame.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array("_hashes")))
    again = F.filter("_sorted", lambda h, k: F.coalesce(h == F.get("_sorted", k - 1), F.lit(False)))
    frame = frame.withColumn("_again", F.when(F.col("_sorted").isNotNull(), F.array_distinct(again)).otherwise(nothing))
    few = F.array_compact(F.transform("_hashes", lambda h, i: F.when(F.array_contains("_again", h), i)))
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("_placed", F.when(F.size("_again") > FEW, placed))
    same = lambda x, k: F.coalesce(x["h"] == F.get("_placed", k)["h"], F.lit(False))
    many = F.transform(F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    found = F.when(F.size("_again") == 0, none).when(F.size("_again") <= FEW, few).otherwise(F.sort_array(many))
    return (
        frame.withColumn("_found", found)
        .select(
            "_row",
            "_lang",
            "_words",
            "_classes",
            F.size("_words").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _covered(F.col("_found")).cast("long").alias("n_repeat_words"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
    )


def references(docs: DataFrame, common: int = COMMON, least: int = REFERENCE_WORDS) -> DataFrame:
    """One row per language: class counts, the most common words and the counts of these and of all others."""
    texts = docs.select(F.col("lang").alias("_lang"), text_of().alias("_text"))
    counts = (
        texts.select("_lang", F.explode(words(F.col("_text"))).alias("_word"))
        .groupBy("_lang", "_word")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    per_lang = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word")
    top = (
        counts.withColumn("_place", F.row_number().over(per_lang))
        .filter(F.col("_place") <= common)
        .groupBy("_lang")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_word"))).alias("_top"))
    )
    # every distinct word is taken apart once; blanks are the characters that belong to no word
    totals = (
        _without_classes(counts, "_word")
        .groupBy("_lang")
        .agg(
            F.sum("_n").alias("_all"),
            F.sum(F.col("_n") * F.length("_word")).alias("_letters"),
            *[F.sum(F.col("_n") * c).alias(f"_c{i}") for i, c in enumerate(_class_counts("_word"))],
        )
        .filter(F.col("_all") >= least)
    )
    sums = texts.groupBy("_lang").agg(F.sum(F.length("_text")).alias("_chars"))
    classes = [F.col(f"_c{i}") for i in range(len(CLASSES) + 1)]
    known = F.aggregate(F.transform("_top", lambda x: -x["m"]), F.lit(0).cast("long"), lambda a, b: a + b)
    keyed = [f.withColumnRenamed("_lang", f"_lang{i}") for i, f in enumerate((sums, top, totals))]
    return (
        keyed[0]
        .join(keyed[1], F.col("_lang0").eqNullSafe(F.col("_lang1")))
        .join(keyed[2], F.col("_lang0").eqNullSafe(F.col("_lang2")))
        .select(
            F.col("_lang0").alias("_ref_lang"),
            _with_blanks(classes, F.col("_chars") - F.col("_letters")).alias("_ref_classes"),
            F.transform("_top", lambda x: x["_word"]).alias("_ref_words"),
            F.concat(F.transform("_top", lambda x: -x["m"]), F.array(F.col("_all") - known)).alias("_ref_counts"),
        )
    )


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of the same length; null if either has no counts."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    p_all, q_all = total(left), total(right)
    parts = F.zip_with(
        F.transform(left, lambda n: n / p_all),
        F.transform(right, lambda n: n / q_all),
        lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2,
    )
    divergence = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.when((p_all > 0) & (q_all > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judged(docs: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Base counts, distances and verdict per document, its own columns in ``_row``."""
    known = pinned(references(docs))
    side = F.broadcast(known) if known.count() <= BROADCAST_LANGUAGES else known
    frame = measured(docs)
    frame = frame.join(side, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    frame = frame.withColumn("_known", F.filter("_words", lambda w: F.array_contains("_ref_words", w)))
    counts = [
        F.when(F.get("_ref_words", F.lit(k)).isNotNull(), F.size("_known") - F.size(F.array_remove("_known", F.get("_ref_words", F.lit(k)))))
        for k in range(COMMON)
    ]
    frame = frame.withColumn("_counts", F.array_compact(F.array(*[c.cast("long") for c in counts])))
    others = F.col("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, b: a + b)
    brief = lambda w: F.length(w) <= SHORT
    glued = F.exists("_ref_words", brief) & ~F.exists("_words", brief)
    chars = F.aggregate("_classes", F.lit(0).cast("long"), lambda a, b: a + b)
    frame = frame.withColumn("_counts", F.concat("_counts", F.array(others)))
    return frame.withColumns(
        {
            "class_distance": F.when(chars >= MIN_CHARS, js_distance(F.col("_classes"), F.col("_ref_classes"))),
            "word_distance": F.when(
                (F.col("n_words") >= MIN_WORDS) & F.col("_ref_counts").isNotNull(),
                F.when(glued, F.lit(1.0)).otherwise(js_distance(F.col("_counts"), F.col("_ref_counts"))),
            ),
        }
    ).withColumn(
        "kept",
        ~F.col("base_failed")
        & ~F.coalesce(F.col("class_distance") > class_limit, F.lit(False))
        & ~F.coalesce(F.col("word_distance") > word_limit, F.lit(False)),
    )


def passing(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The choice is made by exploding an array of one row or none: a filter would be pushed below the
    projections, and all measures worked out there again.
    """
    row = F.array("_row")
    chosen = F.when(F.col("kept"), row).otherwise(F.slice(row, 1, 0))
    return judged(docs, **limits).select(F.explode(chosen).alias("_row")).select("_row.*")


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _sql_js(left: str, right: str) -> str:
    p, q = f"({left}[i]::DOUBLE / list_sum({left}))", f"({right}[i]::DOUBLE / list_sum({right}))"
    half = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END)"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({left}) + 1), lambda i: ({half(p)} + {half(q)}) / 2))))"


def _sql_count(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _sql_brief(words: str) -> str:
    return f"list_filter({words}, lambda x: length(x) <= {SHORT})"


_CLASSES = ", ".join(_sql_count(c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[\\x20\\x09-\\x0D]"))
_ASCII = _sql_count("[\\x00-\\x7F]")

_SQL = f"""
WITH doc AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
base AS (
  SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, [{_CLASSES}, {_ASCII}, length(t)] AS c,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         ({_sql_count("[#*$%&|<>]")})::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM doc),
classes AS (
  SELECT *, [c[1], c[2], c[3], c[4], c[5] - c[1] - c[2] - c[3] - c[4], c[6] - c[5]]::BIGINT[] AS cls FROM base),
three AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
repeated AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM three) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM repeated GROUP BY doc_id),
counted AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM doc) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted),
top AS (
  SELECT lang, list(word ORDER BY place) AS rw, list(n ORDER BY place) AS rn FROM placed WHERE place <= {COMMON} GROUP BY lang),
ref AS (
  SELECT s.lang, rw, list_append(rn, n_all - list_sum(rn))::BIGINT[] AS rn, rc
  FROM (SELECT lang, sum(n_words) AS n_all,
               [sum(cls[1]), sum(cls[2]), sum(cls[3]), sum(cls[4]), sum(cls[5]), sum(cls[6])]::BIGINT[] AS rc
        FROM classes GROUP BY lang HAVING sum(n_words) >= {REFERENCE_WORDS}) s
  JOIN top ON s.lang IS NOT DISTINCT FROM top.lang),
met AS (
  SELECT b.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, ref.rc, ref.rn, ref.rw,
         list_transform(ref.rw, lambda x: len(list_filter(w, lambda y: y = x))) AS dn
  FROM classes b LEFT JOIN repeats r USING (doc_id) LEFT JOIN ref ON b.lang IS NOT DISTINCT FROM ref.lang),
shares AS (SELECT *, list_append(dn, n_words - list_sum(dn))::BIGINT[] AS d FROM met),
verdict AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         CASE WHEN list_sum(cls) >= {MIN_CHARS} THEN {_sql_js("cls", "rc")} END AS class_distance,
         CASE WHEN n_words >= {MIN_WORDS} THEN CASE WHEN len({_sql_brief("rw")}) > 0 AND len({_sql_brief("w")}) = 0 THEN 1 ELSE {_sql_js("d", "rn")} END END AS word_distance
  FROM shares)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(class_distance > {CLASS_LIMIT}, false) AND NOT coalesce(word_distance > {WORD_LIMIT}, false) AS kept
FROM verdict
"""


@query("op2_divergence_rules", _SQL)
def divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        F.col("_row.doc_id").alias("doc_id"), *RESULT
    )
