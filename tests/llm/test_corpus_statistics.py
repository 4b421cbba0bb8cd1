"""Spelling variants, language-model scores and collocations against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorecast.llm import automata, backoff, hash_filter, phrases, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_hash_filter_lets_every_member_through(spark):
    members = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3_000)
    bitmap = hash_filter.hash_filter(spark.createDataFrame([(int(h),) for h in members] + [(None,)], "h long"), "h", bits=1 << 16).value
    assert hash_filter.may_hold(bitmap, members).all()
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 3_000)
    assert hash_filter.may_hold(bitmap, others).mean() < 0.08


# 11 spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, mark=199):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % mark == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def brute_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=repr)


def spelled(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def variant_words(n=400):
    rng = np.random.default_rng(5)
    words = {"accommodate": 20_000, "accomodate": 3_000, "acomodate": 400, "acomodat": 80, "zzzzzz": 9, "zzzzzy": 9, "zzzzzx": 45, "élèves": 50, "eleves": 6, "élèvés": 7}
    letters = list("abcé×")
    while len(words) < n:
        words.setdefault("".join(rng.choice(letters, rng.integers(6, 9))), int(5 ** rng.integers(1, 6)))
    long = "".join(rng.choice(list("abcdefgh"), 30_000))
    return words | {long: 100, long[:-1]: 20, "x" + long[1:]: 5, long + "ab": 5}


def test_variants_match_brute_force(spark):
    words = variant_words()
    table = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("ROOT", F.lit(1)).withColumn("h", F.lit(2))
    found = spelling.group_variants(table)
    assert found.columns.count("h") == 1
    assert spelled(found) == brute_variants(words)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Small tables here: left to itself, Spark broadcasts a side of every join."""
    stored, plans = spelling.save, []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(spelling, "save", lambda df, name: (plans.append(plan(df)), stored(df, name))[1])
    words = {"accommodate": 20_000, "accomodate": 3_000, "acomodate": 400, "acomodat": 80}
    found = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert spelled(found) == brute_variants(words)
    found.collect()
    plans.append(plan(found))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("symbols", [2, 3])
def test_neighbourhood_is_full(symbols):
    row = spelling.reduced(["abcdef"], symbols)
    got = set(spelling.neighbourhood(row, symbols)[0].tolist())
    near = [c for n in (5, 6, 7) for c in itertools.product(range(1, symbols + 1), repeat=n) if c == tuple(row[0]) or one_edit(tuple(row[0].tolist()), c)]
    assert got == {int(spelling.own_hashes(np.array([c], dtype=np.uint64))[0]) for c in near}


def test_words_are_counted_whole_with_marked_letters_removed(spark, documents, wide, nothing):
    extra = documents.sparkSession.createDataFrame([(i, "Étranger étranger ÉTRANGER naïveté×2 ﬁnally Ωmega-words undersigned_words " * 3, "fr", "s", 0) for i in range(300, 700)], documents.schema)
    docs = documents.union(extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_words(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs.repartition(7)).collect()} == expected
    assert any(len(w) == 7 and w in "étranger" for w in expected) or len(expected) > 5
    assert spelled(spelling.variants(docs)) == brute_variants(expected)
    assert spelling.variants(wide).count() == len(brute_words([(r["doc_id"], r["text"]) for r in wide.collect()]))
    assert spelling.variants(nothing).count() == 0


# 12 language model


def brute_scores(rows, order, prior=backoff.PRIOR, addend=backoff.ADDEND):
    texts = []
    for doc_id, text in rows:
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0
        texts.append((doc_id, held, ["<s>", *re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), "</s> "]))
    counts = Counter()
    for _, held, words in texts:
        if not held:
            for k in range(1, order + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    ones = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(ones.values()), len(ones)

    def chance(context, word):
        if not context:
            return (ones.get(word, 0) + addend) / (n + addend * (v + 1))
        return (counts[(*context, word)] + prior * chance(context[1:], word)) / (counts[context] + prior)

    result = []
    for doc_id, held, words in texts:
        base = sum(math.log10(chance((), w)) for w in words[1:])
        score = sum(math.log10(chance(tuple(words[max(0, i - order + 1) : i]), words[i])) for i in range(1, len(words)))
        result.append((doc_id, held, len(words) - 1, sum(w in ones for w in words[1:]), n, round(base, 6), round(score, 6)))
    return sorted(result, key=repr)


def scored(df):
    rows = df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [2_000, 1 << 23])
def test_scores_match_brute_force(spark, documents, order, block_bytes):
    found = scored(backoff.score_texts(documents, order=order, block_bytes=block_bytes))
    expected = brute_scores([(r["doc_id"], r["text"]) for r in documents.collect()], order)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)


def test_model_beats_single_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = backoff.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.9 * held[1]


def test_score_edges(spark, wide, nothing):
    rows = backoff.score_texts(wide).collect()
    assert len(rows) == wide.count() and all(r["score"] <= 0 and math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    assert backoff.score_texts(nothing).count() == 0
    untrained = backoff.score_texts(spark.createDataFrame([(None, "never seen"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in untrained) == [(1, 0, 0), (3, 0, 0)]


# 13 collocations


def brute_collocations(rows, least, top, longest=4, cover=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    result = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= cover * counts[p[i : i + k]]}
        ranked = []
        for p, a in candidates.items():
            if p not in inner:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        ranked.sort()
        result += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(ranked[:top], 1)]
    return sorted(result)


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(9)
    words = ["a", "b", "c", "É", "é", "the", "of\xa0", "\x01", "日本", "New", "york", "city", "w" * 200]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(int(rng.integers(0, 120))))
        rows.append((k, text + " new york city hall" * (k % 3), ["en", "fr", None, "und", "en"][k % 5]))
    rows += [(200, None, "en"), (201, "", "xx"), (202, "...", "xx"), (203, "alone", "yy"), (204, "new york " * 3_000, "en")] + [rows[5]] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("shard_bytes", [300, 12 << 20])
def test_collocations_match_brute_force(spark, corpus, monkeypatch, shard_bytes):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)  # 300: many shards, and many ranges that cut within a first word
    rows = [(r["lang"], r["text"]) for r in corpus.collect()]
    assert mined(phrases.collocations(corpus, top=40, least=4)) == brute_collocations(rows, 4, 40)


def test_collocations_of_two_words(spark, corpus):
    rows = [(r["lang"], r["text"]) for r in corpus.collect()]
    assert mined(phrases.collocations(corpus, top=None, least=6, longest=2)) == brute_collocations(rows, 6, None, longest=2)


def test_collocation_edges(spark, documents, wide, nothing):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    assert mined(phrases.collocations(wide, least=5)) == brute_collocations(rows, 5, 2_000)
    assert phrases.collocations(nothing).count() == 0


def test_long_texts_are_cut_where_pieces_end():
    text = b"one two. three " * 500 + b"x" * 900 + b", four five" * 40
    parts = list(phrases._pieces(text, 200))
    assert b"".join(parts) == text and all(len(p) <= 200 or b"x" * 900 in p for p in parts)
    assert all(p[:1] in b".," for p in parts[1:])


def test_scores_beyond_64_bits(spark):
    value = spark.range(1).select(F.expr("(cast(8000000000000000000 as decimal(20, 0)) * 2000000) div (cast(9000000000000000000 as decimal(20, 0)) + 9000000000000000000L)")).first()[0]
    assert value == 2_000_000 * 8_000_000_000_000_000_000 // (2 * 9_000_000_000_000_000_000)


def test_automata_build_union_and_compose():
    rng = np.random.default_rng(3)
    words = pa.array(sorted(f"w{k}".encode() for k in range(30)), pa.large_binary())

    def random_counts():
        return Counter(tuple(int(x) for x in rng.integers(0, 6 + 4 * (rng.random() < 0.3), 3)) for _ in range(200))

    def automaton(counts):
        grams = sorted(counts)
        return automata.build(words, [np.array(c) for c in zip(*grams, strict=True)], np.array([counts[g] for g in grams]))

    def content(a):
        return dict(zip(a.texts(), a.phrases()[1].tolist(), strict=True))

    def named(counts):
        return {" ".join(words[k].as_py().decode() for k in g): n for g, n in counts.items()}

    several = [random_counts() for _ in range(4)]
    for counts in several:
        a = automata.Automaton.load(automaton(counts).dump())
        assert content(a) == named(counts) and a.texts() == sorted(a.texts(), key=lambda t: [w.encode() for w in t.split()])
    whole = automata.union([automaton(c) for c in several])
    assert content(whole) == named(sum(several, Counter()))
    found, weights = automata.compose(automaton(several[0]), automaton(several[1]))
    assert sorted(weights.tolist()) == sorted(several[1][g] for g in several[0] if g in several[1]) and len(found[0]) == len(weights)
    # States with equal arcs are one: all first words here are followed by the same.
    grid = Counter({(a, b): 1 for a in range(10) for b in range(10)})
    assert len(automaton(grid).labels[1]) == 10 and content(automaton(grid)) == named(grid)
