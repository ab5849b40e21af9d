"""Every operator on odd rows, on empty tables, and against plain loops."""

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter as Bag, defaultdict

import numpy as np
import pytest

from earnloom.llm import contamination, hosts, licenses, mixture, near_dedup, private_data, quality_rules, ranking, shards, tokens

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


# --- 1 ---------------------------------------------------------------------------------------------


def shingle_set(text, k):
    words = BLANK.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k=2):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_match_all_pairs(spark):
    draw = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(3, 90))]
        for _ in range(draw.randint(1, 14)):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        want = brute_components(rows, k)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, shingle=k).collect()}
        assert got == want


def test_near_duplicates_odd(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and by_id[3]["component_id"] == 1 and not by_id[3]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (4, 5, 6))
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and {1, 4, 5, 6, 7, 8, 9} <= {r["doc_id"] for r in kept.collect()}
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_deduplicated_rows_of_null_and_repeated_ids(spark, odd):
    """Exact multiset: null ids stay, repeated rows stay once, a rejected text of a kept id does not come back."""
    prose, other = (" ".join(f"{p}{i * i % 53}" for i in range(60)) for p in "ab")
    rows = [
        (None, "one two"),
        (None, "three four"),
        (None, None),
        (None, prose),
        (1, prose),
        (1, prose),
        (2, prose + " more"),
        (3, other),
        (3, other),
        (3, other),
        (3, prose.upper()),
        (4, None),
        (4, ""),
        (4, ""),
        (5, "quite another"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [r for r in rows if r[0] is None] + [(1, prose), (3, other), (4, None), (4, ""), (5, "quite another")]
    for k in (2, 5):
        assert Bag(map(tuple, near_dedup.deduplicated(docs, shingle=k).collect())) == Bag(want)
    got = near_dedup.near_duplicates(docs).filter("doc_id is null").collect()
    assert len(got) == 4 and all(r["kept"] and r["component_id"] is None for r in got)
    kept = Bag(r["doc_id"] for r in near_dedup.deduplicated(odd).collect())
    assert kept == Bag([None, 1, 4, 5, 6, 7, 8, 9])


def test_pairs_that_miss_the_similarity_are_refuted_in_the_join(spark, monkeypatch):
    """A group whose copies miss 0.8 among themselves: few of its pairs leave the join, and no link is lost."""
    draw = random.Random(5)
    words = lambda label, n: [f"{label}{draw.randrange(6)}" for _ in range(n)]
    base = [f"w{i}" for i in range(160)]
    rows = []
    for key in range(60):
        copy = list(base)
        for place in draw.sample(range(0, 160, 3), 16):
            copy[place] = words("x", 1)[0]
        rows.append((key, " ".join(copy)))
    rows += [(100 + key, text + " more") for key, text in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, across = [], near_dedup._pairs_across

    def counted(*given):
        pairs = across(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_pairs_across", counted)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_components(rows)
    assert len({c for _, c in found.values()}) > 50 and made[0] < 60


def test_bitmaps_differ_in_no_more_places_than_sets(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(3)
    rows, sizes = [], []
    for n, changed in ((5, 1), (60, 9), (64, 0), (500, 60), (512, 20), (20_000, 900)):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[changed:], draw.integers(0, 2**63, changed + 3).astype(np.uint64))))
        rows.append((near_dedup.bitmap(a).tolist(), near_dedup.bitmap(b).tolist()))
        sizes.append(len(np.setxor1d(a, b)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<long>, b array<long>")
    got = [r[0] for r in frame.orderBy("i").select(near_dedup._differences(F.col("a"), F.col("b"))).collect()]
    assert any(len(a) != len(b) for a, b in rows)
    assert all(0.8 * size <= n <= size for n, size in zip(got, sizes)), (got, sizes)


def test_signature_comes_from_two_permutations():
    hashes = near_dedup.shingle_hashes(b"the quick brown fox jumps over the lazy dog")
    first = near_dedup._permute32((hashes >> 32).astype("uint32"))
    by_hand = [int(near_dedup._permute32(first + k).min()) for k in near_dedup.np.arange(16, dtype="uint32")]
    assert near_dedup.signature(hashes, 16).tolist() == by_hand


# --- 2 ---------------------------------------------------------------------------------------------


def test_quality_counts(odd, nothing):
    rows = {r["_row"]["doc_id"]: r for r in quality_rules.judged(odd).collect()}
    for key, text in texts_of(odd):
        words = BLANK.findall(text or "")
        threes = Bag(zip(words, words[1:], words[2:]))
        again = {i + d for i in range(len(words) - 2) for d in range(3) if threes[tuple(words[i : i + 3])] > 1}
        r = rows[key]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(again))
    kept = quality_rules.passing(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (4, 5, 6, 7, 9)").count() == 0
    assert quality_rules.judged(nothing).count() == 0


def test_texts_without_short_words_fail_the_word_test(spark):
    """Next to the SQL, in whose order of numbers a distance without counts is above any limit."""
    import duckdb
    from check_queries import compare

    draw = random.Random(6)
    prose = [" ".join(draw.choice(["the", "of", "and", "to", "in", "house", "river", "stone"]) for _ in range(120)) for _ in range(40)]
    glued = " ".join(f"keyword{chr(97 + i % 26)}{chr(97 + i // 26)}s" for i in range(80))
    rows = [(i, text, "en") for i, text in enumerate(prose)] + [(100, glued, "en"), (101, glued, "xx"), (102, glued[:300], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["_row"]["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert got[100]["word_distance"] == 1 and not got[100]["base_failed"] and not got[100]["kept"]
    assert got[101]["word_distance"] is None and got[101]["kept"] and got[102]["word_distance"] is None
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    from pyspark.sql import functions as F

    made = quality_rules.judged(docs).select(F.col("_row.doc_id").alias("doc_id"), *quality_rules.RESULT)
    verdict = compare(made, connection, quality_rules._SQL)
    assert verdict.startswith("ok"), verdict


def test_long_words_count_in_the_word_test(spark):
    """A language of long words has a reference, and its texts are held against it."""
    draw = random.Random(7)
    own = ["keskiviikko", "toimitus", "kirjasto", "varmasti", "kokonaan"]
    prose = [" ".join(draw.choice(own) for _ in range(120)) for _ in range(20)]
    strange = " ".join(f"avainsana{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(i, text, "fi") for i, text in enumerate([*prose, strange])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["_row"]["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert got[20]["word_distance"] > quality_rules.WORD_LIMIT and not got[20]["kept"]
    assert all(got[i]["word_distance"] < 0.3 for i in range(20))


def test_reference_classes_follow_from_counts_of_words(spark):
    """Only distinct words are taken apart for a language's class sums, not every text once more."""
    texts = ["Ab1 é,\tab1\n" * 300, "  x#9 ", None, "", "\x0b\x0c Ab1 \u00a0z"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    made = quality_rules.references(docs, least=3)
    joined = "".join(t or "" for t in texts)
    parts = [re.findall(p, joined) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[\x00-\x7F]", r"[^\x00-\x7F]")]
    sums = [len(found) for found in parts]
    sums[4] -= sum(sums[:4])
    assert made.first()["_ref_classes"] == sums
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(_word#" in plan and "regexp_replace(coalesce(text#" not in plan


def test_js_distance(spark):
    from pyspark.sql import functions as F

    made = spark.range(1).select(
        quality_rules.js_distance(F.array(F.lit(4), F.lit(0)).cast("array<long>"), F.array(F.lit(0), F.lit(9)).cast("array<long>")).alias("far"),
        quality_rules.js_distance(F.array(F.lit(2), F.lit(6)).cast("array<long>"), F.array(F.lit(1), F.lit(3)).cast("array<long>")).alias("near"),
        quality_rules.js_distance(F.array(F.lit(0)).cast("array<long>"), F.array(F.lit(3)).cast("array<long>")).alias("none"),
    ).first()
    assert made["far"] == pytest.approx(1) and made["near"] == pytest.approx(0) and made["none"] is None


# --- 3 ---------------------------------------------------------------------------------------------


def test_ranking_on_held_out_rows(spark):
    from earnloom.llm.ranking import pairwise_quality

    sf_dir = "/root/testdata/sf0.01"
    scored = pairwise_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_ranking_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (77, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = ranking.fitted(odd, labels)
    got = ranking.scored(odd, model)
    assert got.columns == odd.columns + ["score"] and got.filter("score between 0 and 1").count() == odd.count()
    assert ranking.scored(nothing, model).count() == 0
    assert ranking.scored(odd, ranking.fitted(odd, labels.limit(0))).filter("score in (0, 1)").count() == odd.count()


# --- 4 ---------------------------------------------------------------------------------------------


def test_licences(spark, nothing):
    filler = "some words before it and then more of them again and again"
    rows = [
        (1, f"{filler}\nReleased under the MIT License.\n{filler}"),
        (2, "ALL RIGHTS RESERVED"),
        (3, f"released {filler} reserved licensed"),
        (4, None),
        (5, ""),
        (6, "x " + licenses.TEMPLATES["mit-permission"].replace("charge", "cost") + " " + filler),
        (6, "again"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["templates"] for r in licenses.scanned(docs).collect()}
    assert got == {1: "mit", 2: "all-rights-reserved", 3: "", 4: "", 5: "", 6: ""}
    assert licenses.scanned(nothing).count() == 0
    near = licenses.notices(docs, contained=60).filter("doc_id = 6").collect()
    assert near and near[0]["template"] == "mit-permission"


def test_pivots_are_needed():
    for text in licenses.TEMPLATES.values():
        words = licenses.template_words(text)
        chosen, k = set(licenses.pivots(words)), min(5, len(words))
        all_of = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        assert 100 * sum(not chosen & set(s) for s in all_of) < 80 * len(all_of)


# --- 5 ---------------------------------------------------------------------------------------------


def test_private_data_base_spans():
    draw = random.Random(2)
    parts = ["a.b@c.de", "@", ".", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (212) 555-0100", " ", "é", "12", "-", "a@b.c@d.e"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
        found = private_data.base_spans(text)
        assert found["email"] == [m.span() for m in private_data.EMAIL.finditer(text)], text
        assert found["ip"] == [m.span() for m in private_data.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_private_data_field(spark, odd, nothing):
    docs = spark.createDataFrame(
        [(i, f"mail me{i}@mail.example.com or call +1 (212) 555-{1000 + i} from 10.0.{i}.7 now, order {i}7 of 30") for i in range(60)]
        + [(99, "call +1 (212) 555-0199 4111111111111111 then")],
        "doc_id long, text string",
    )
    rows = {r["doc_id"]: r for r in private_data.with_spans(docs).collect()}
    assert (rows[3]["n_email"], rows[3]["n_ip"], rows[3]["n_phone"]) == (1, 1, 1)
    assert set(rows[3]["_base"].split(",")) <= set(rows[3]["spans"].split(","))
    field = private_data.fitted(docs)
    got = private_data.with_spans(odd, field)
    assert got.count() == odd.count() and got.filter("spans <> ''").count() == 0
    assert private_data.with_spans(nothing, field).count() == 0
    assert private_data.fitted(nothing).weights.sum() == 0


def test_field_sums_count_every_segmentation():
    field, text = private_data.Field(), "12 34 56 78 90"
    run = next(private_data.runs(text))
    _, forward, backward = field.sums(field.lattice(text, run))
    ways = [1]
    for j in range(1, len(run) + 1):
        ways.append(sum((5 if n == 1 else 4) * ways[j - n] for n in range(1, min(4, j) + 1)))
    assert forward[-1] == pytest.approx(private_data.log(ways[-1])) and backward[0] == pytest.approx(forward[-1])


# --- 6 ---------------------------------------------------------------------------------------------


def brute_hits(found, items, window):
    hit, names = set(), set()
    for name, item in items:
        n = min(window, len(item))
        grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(found) - n + 1):
            if n and tuple(found[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return hit, names


def test_automaton_matches_plain_search():
    draw = random.Random(8)
    for _ in range(300):
        letters = [b"a", b"b", b"c"]
        items = [(str(k), [draw.choice(letters) for _ in range(draw.randint(0, 9))]) for k in range(4)]
        found = [draw.choice(letters + [b"z"]) for _ in range(40)]
        spans, names = [], set()
        contamination.Automaton(items, 4).stream(found, spans, names)
        hit, wanted = brute_hits(found, items, 4)
        assert {i for s, e in spans for i in range(s, e)} == hit and names == wanted
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_contamination_odd(spark, odd, nothing):
    items = spark.createDataFrame([(1, " ".join(f"Q{i}" for i in range(20))), (2, "rare pair"), (3, None), (4, "")], "item_id long, text string")
    text = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, f"start {text} end", 9), (2, "start, " + "word " * 200 + "Rare, pair! end", 9), (3, None, None)], "doc_id long, text string, n_chars long"
    )
    for held in (100_000, 3):  # one automaton, and several parts
        rows = {r["doc_id"]: r for r in contamination.counted(docs, items, item_words_held=held).collect()}
        assert (rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"]) == (20, 1, True)
        assert (rows[2]["n_hit"], rows[2]["contaminated"]) == (2, False) and rows[3]["n_words"] == 0
        assert rows[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    left = {r["doc_id"]: r for r in contamination.cleaned(docs, items).collect()}
    assert set(left) == {2, 3} and left[2]["text"].endswith("word ! end") and left[2]["n_chars"] == len(left[2]["text"])
    assert contamination.cleaned(odd, items).columns == odd.columns
    assert contamination.counted(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert contamination.counted(nothing, items).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------


def test_hosts(spark):
    urls = ["https://A.Example.NET/en/1?x#y", "http://b.net/x", "ftp://q.example.com/de/", "x.org/fr/", None, "", "http://u.org/fr/a", "http://", "http://h.co.uk?p", "https://clean.example.com/en/\n1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in hosts.filtered(pages).collect()}
    assert (rows[0]["host"], rows[0]["path"], rows[0]["rule"], rows[0]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (rows[1]["verdict"], rows[2]["rule"], rows[6]["rule"]) == ("block", "example.com/de/", "org/fr/")
    assert rows[3]["host"] == rows[4]["host"] == rows[5]["path"] == "" and rows[3]["rule"] is None
    assert rows[8]["host"] == "h.co.uk" and rows[9]["path"] == "/en/\n1" and all(r["verdict"] in ("allow", "block") for r in rows.values())
    assert hosts.filtered(pages.limit(0)).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------


def test_mixture(spark, odd, nothing):
    draw = random.Random(3)
    rows = [(i, draw.choice("aabbbccccd"), draw.randint(0, 400)) for i in range(600)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixture.sampled(sized).collect()
    total, taken = sum(r[2] for r in rows), defaultdict(int)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 and abs(taken[k] - t) <= 200 for k, (t, s) in targets.items())
    again = {r["doc_id"]: r["copies"] for r in mixture.sampled(sized.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    mixed = mixture.mixed(odd)
    assert mixed.columns == odd.columns and mixed.filter("text is null or trim(text) = ''").count() == 0
    assert mixture.mixed(nothing).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------


def test_tokens_match_the_library(spark, odd, nothing):
    P = pytest.importorskip("public_tokenizers")
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    path = P.path("byte_bpe_50k.json")
    library, file = Tokenizer.from_file(path), json.load(open(path, encoding="utf-8"))
    counter = tokens.Counter(file["model"]["merges"], [t["content"] for t in file["added_tokens"]])
    draw = random.Random(1)
    letters = "'''sstmdrevll  \n\t\r　 abcXYé漢字12٣.,!?-\x1c\x85​😀"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(5000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b", "'r", "'re", "x'll", "a" * 3000, " " * 2000 + "x"]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = tokens.with_token_counts(odd, path)
    assert rows.columns == odd.columns + ["n_tokens"]
    for r in rows.collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert tokens.with_token_counts(nothing, path).count() == 0


# --- 10 --------------------------------------------------------------------------------------------


def test_shards(spark, odd, nothing):
    rows = shards.sharded(spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")).collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(by_shard) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 100 < sum(r["grown_shard"] == 16 for r in rows) < 260
    again = {r["doc_id"]: r for r in shards.sharded(odd).collect()}
    assert again[5]["size"] == 1 and again[5]["text_crc32"] == 0
    out = shards.placed(odd)
    assert out.columns == odd.columns + ["shard", "slot"] and out.count() == odd.count()
    assert shards.placed(nothing).count() == 0


def test_weighted_shards(spark):
    from pyspark.sql import functions as F

    counts = dict(spark.range(4000).select(shards.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect())
    assert 2850 < counts[1] < 3150
    with pytest.raises(ValueError):
        shards.rendezvous(F.col("id"), [1.0, 0.0])


def test_private_data_of_any_digits():
    """Digits of other scripts and raised figures are no digits of the patterns, and no error."""
    figures = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Nd", "No", "Nl")]
    draw = random.Random(3)
    field = private_data.Field()
    field.weights[:] = np.random.default_rng(1).normal(size=field.weights.shape)
    for _ in range(1500):
        text = "".join(draw.choice([*"0123456789.@+-() ", draw.choice(figures)]) for _ in range(draw.randint(1, 60)))
        base, whole = private_data.spans_of(text, field)
        for kind, spans in base.items():
            assert set(spans) <= set(whole[kind])
    base, _ = private_data.spans_of("see 10.0.0.4² for it, or 10.0.0.4", field)
    assert base["ip"] == [(4, 12), (25, 33)]


def test_ranking_learns_from_all_labelled_rows(spark, monkeypatch):
    """Whatever part of the rows shows the difference between the labels, the model knows it; so do rows dealt into parts."""
    from pyspark.sql import Window, functions as F

    monkeypatch.setattr(ranking, "PART", 3_000)
    ids = spark.range(9_000)
    order = F.row_number().over(Window.orderBy(F.xxhash64("id")))
    placed = ids.withColumn("late", order > 7_700)
    good = F.col("id") % 2 == 0
    mark = F.when(F.col("late"), F.when(good, F.lit(" !!!!")).otherwise(F.lit(" ||||"))).otherwise(F.lit(""))
    docs = placed.select(F.col("id").alias("doc_id"), F.concat(F.lit("some plain words here"), mark).alias("text"), "late", good.alias("good"))
    labels = docs.select("doc_id", F.col("good").cast("int").alias("quality"))
    got = ranking.scored(docs, ranking.fitted(docs, labels)).filter("late").groupBy("good").agg(F.min("score"), F.max("score")).collect()
    bounds = {r[0]: (r[1], r[2]) for r in got}
    assert bounds[True][0] > bounds[False][1]
