"""The training-data operators against brute force, the libraries they follow, or exact laws."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scorecast.llm import bpe, common, components, embedding_dedup, kd_shards, line_dedup, minhash, mixing, quality, queries, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


# shared


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (5, 4)]
    found = dict(ordered(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}}


def test_components_without_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_matches_brute_force():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    assert common.forest(60, a, b).tolist() == brute_components(60, list(zip(a.tolist(), b.tolist(), strict=True)))


# 1 quality


def test_trees_learn_and_flat_walk_agrees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.grow_trees(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    slow = np.full(20, model.base)
    for t in range(len(model.feature)):
        for i in range(20):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(x[i, model.feature[t, node]] > model.threshold[t, node])
            slow[i] += model.leaf[t, node - model.feature.shape[1]]
    assert np.allclose(slow, model.raw(x[:20]))


def test_quality_query_on_held_out(spark):
    rows = queries.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_quality_edges(spark, wide, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train_quality(nothing, labels)
    scored = wide.withColumn("quality_of", quality.quality_score(F.col("text"), model))
    assert scored.where("quality_of is null or quality_of < 0 or quality_of > 1").count() == 0 and scored.count() == wide.count()
    assert nothing.withColumn("q", quality.quality_score(F.col("text"), model)).count() == 0


# 2 sharding


def test_shards_are_even_keep_groups_and_number_without_gaps(spark):
    rows = queries.op2_kd_shards(spark, "/root/testdata/sf0.01").collect()
    sizes, slots = Counter(), defaultdict(list)
    shards = defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"]].add(r["shard"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.1 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())


def test_shards_split_a_group_beyond_a_leaf(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 700 else f"text {i}", None, "s") for i in range(1_000)], "doc_id long, text string, lang string, source string")
    sizes = Counter()
    for r in kd_shards.shard(docs, leaves=4).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.25 * min(sizes.values())


def plain_kd_tree(rows, leaves):
    """Shard by row: sorted, whole rows, the cut at the row where half of the bytes are reached."""
    dims = range(4)
    spread = [max(1e-9, max(r["dims"][d] for r in rows) - min(r["dims"][d] for r in rows)) for d in dims]
    found = {}

    def split(part, first, last):
        if last - first == 1 or not part:
            found.update({r["group"]: first for r in part})
            return
        low, high = ([f(r["dims"][d] for r in part) for d in dims] for f in (min, max))
        axis = max(dims, key=lambda d: ((high[d] - low[d]) / spread[d], -d))
        width = high[axis] - low[axis]
        place = lambda r: (int((r["dims"][axis] - low[axis]) / width * ((1 << 30) - 1)) if width else 0, r["hash"])
        middle, below = (first + last) // 2, 0.0
        part = sorted(part, key=place)
        want = sum(r["weight"] for r in part) * (middle - first) / (last - first)
        cut = 0
        while cut < len(part) and below + part[cut]["weight"] < want:
            below += part[cut]["weight"]
            cut += 1
        cut += cut < len(part) and want - below > part[cut]["weight"] / 2
        split(part[:cut], first, middle)
        split(part[cut:], middle, last)

    split(rows, 0, leaves)
    return found


@pytest.mark.parametrize("leaves", [2, 3, 4])
def test_shards_match_a_plain_kd_tree(spark, leaves):
    """Sizes, languages and sources that tie and that are null; no text weighs more than a hundredth of a leaf."""
    texts = [(i, "word " * (3 + i * 7 % 11) + str(i), ["en", "de", None][i * i % 3], ["a", "b", "web", None][i * 5 % 7 % 4]) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    hashed = kd_shards.metadata(docs).withColumn("hash", F.expr("pmod(xxhash64(group, 0), 1L << 31)")).collect()
    rows = [{"group": r["doc_id"], "weight": float(r["size"]), "hash": r["hash"], "dims": (float(r["size"]), float(r["doc_id"]), r["lang_at"], r["source_at"])} for r in hashed]
    rows = [r | {"dims": tuple(-1.0 if d is None else d for d in r["dims"])} for r in rows]
    got = {r["doc_id"]: r["shard"] for r in kd_shards.shard(docs, leaves=leaves).collect()}
    assert got == plain_kd_tree(rows, leaves)


def test_shards_start_no_python_worker(spark, documents):
    plan = kd_shards._table(spark, [(1, 2.5, "x")], "node long, want double, group string")
    assert [tuple(r) for r in plan.collect()] == [(1, 2.5, "x")]
    assert "Python" not in plan._jdf.queryExecution().toString() and "ExistingRDD" not in plan._jdf.queryExecution().toString()
    assert kd_shards._table(spark, [], "node long").count() == 0


def test_shard_edges(documents, wide, nothing):
    assert kd_shards.shard(nothing, leaves=8).count() == 0
    rows = kd_shards.shard(wide, target_bytes=100_000).collect()
    assert len(rows) == documents.count() and sum(r["size"] for r in rows) == sum(len((r["text"] or "").encode()) + 1 for r in documents.collect())


# 3 embeddings


def brute_embeddings(rows, threshold=0.9):
    sound = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[k] = np.array(v) / np.linalg.norm(v)
    linked = [(a, b) for a, b in itertools.combinations(sound, 2) if len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= threshold]
    counts = Counter(x for pair in linked for x in pair)
    roots = brute_components(len(rows), linked)
    smallest = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        smallest[roots[k]].append(i)
    return sorted((i, counts[k], min(smallest[roots[k]]), i == min(smallest[roots[k]])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embeddings_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)  # so that the hot bucket is cut into blocks
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 32))
    vectors = [b + 0.12 * rng.normal(size=32) for b in base for _ in range(6)] + [base[0] + 0.01 * rng.normal(size=32) for _ in range(150)]
    vectors += [rng.normal(size=32) for _ in range(80)] + [base[1] * 3] * 4
    given = np.float32 if kind == "float" else np.float64
    rows = [(k, [float(given(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(1_000, None), (1_001, [0.0] * 32), (1_002, [None] * 32), (1_003, [float("nan")] * 32), (1_004, [1.0, 0.0]), (1_005, [2.0, 0.0]), (1_006, [])]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"vec_id long, embedding array<{kind}>, node long")
    assert ordered(embedding_dedup.near_duplicates(df)) == sorted(brute_embeddings(rows), key=repr)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    unit = embedding_dedup.unit_rows(rng.normal(size=(400, 64)))
    codes, factors = embedding_dedup.binary_codes(unit)
    estimated, error = embedding_dedup.estimate(codes, factors, unit)
    true = unit @ unit.T
    off = ~np.eye(400, dtype=bool)
    assert abs((estimated - true)[off].mean()) < 0.01
    assert (np.abs(estimated - true) <= error[:, None] + 1e-6)[off].mean() > 0.999


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    a = embedding_dedup.unit_rows(rng.normal(size=(4_000, 64)))
    side = embedding_dedup.unit_rows(rng.normal(size=(4_000, 64)))
    side = embedding_dedup.unit_rows(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    bits, bands = embedding_dedup.band_plan(1_000_000)
    assert (embedding_dedup.band_keys(a, bits, bands) == embedding_dedup.band_keys(b, bits, bands)).any(axis=1).mean() > 0.99


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 4 lines


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else []:
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(documents, wide, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = line_dedup.dedup_lines(wide, n_lines="lines_of")
    assert ordered(got.select("doc_id", "kept_text", "lines_of", "n_dropped")) == brute_lines(rows)
    assert got.columns[: len(wide.columns)] == wide.columns
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_first_occurrences_across_tasks():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted((int(h), 0, int(d), 0, 9, p) for p, (h, d) in enumerate(zip(rng.integers(0, 6, 300), rng.integers(0, 40, 300), strict=True)))
    names = ["h1", "h2", "doc_id", "row_hash", "n_lines", "pos"]
    dropped, opened, firsts = set(), [], {}
    for task in np.array_split(np.arange(300), 7):
        batches = [pa.table(dict(zip(names, zip(*[rows[i] for i in part], strict=True), strict=True))).to_batches()[0] for part in np.array_split(task, 3)]
        for out in line_dedup.first_occurrences(iter(batches)):
            for r in out.to_pylist():
                if r["kind"] == 0:
                    dropped.add((r["doc_id"], r["pos"]))
                elif r["kind"] == 1:
                    opened.append(r)
                else:
                    firsts[r["h1"]] = min(r["doc_id"], firsts.get(r["h1"], 1 << 60))
    dropped |= {(r["doc_id"], r["pos"]) for r in opened if r["doc_id"] != firsts[r["h1"]]}
    least = {h: min(r[2] for r in rows if r[0] == h) for h in range(6)}
    assert dropped == {(r[2], r[5]) for r in rows if r[2] != least[r[0]]}


# 5 bpe


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoding_and_decoding_match_the_library(wide, nothing, tokens):
    tool = bpe.Encoder(tokens)
    for piece_chars in (512, 65_536):
        got = bpe.decode(bpe.encode(wide, tokens, ids="token_ids", piece_chars=piece_chars), tokens, ids="token_ids")
        rows = got.select("text", "token_ids", "decoded").collect()
        assert len(rows) == wide.count()
        for r in rows:
            ids = tool.whole.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["token_ids"] == ids and r["decoded"] == tool.whole.decode(ids, skip_special_tokens=False)
        at_once = bpe.encode(wide, tokens, ids="token_ids", piece_chars=piece_chars, decoded="decoded")
        assert ordered(at_once.select("text", "token_ids", "decoded")) == sorted((tuple(r) for r in rows), key=repr)
    assert bpe.encode(nothing, tokens).count() == 0


def test_pieces_join_to_the_whole(tokens):
    tool, rng = bpe.Encoder(tokens, cached_words=50), np.random.default_rng(4)
    alphabets = ["abcdeting", "éèàüßñthion", "!?.,;#$%'", "0123", "жияп", "日本語", "한글", "'sTMd ", " \n\t\x1c\x85", "ſŸÀ×÷ĳ", "e\u0301a\u0308"]
    for _ in range(300):
        kinds = rng.choice(len(alphabets), rng.integers(1, 4))
        text = "".join(rng.choice(list(alphabets[rng.choice(kinds)])) if rng.random() > 0.01 else "<|endoftext|>" for _ in range(rng.integers(1, 400)))
        cuts = bpe.cut_points(text, 40)
        at = [c for c, _ in cuts]
        parts = [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]
        got = bpe.join_pieces(tool, tool.encode_all(parts), [False, *(f for _, f in cuts)])
        assert got.tolist() == tool.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_keep_their_rows_after_a_shuffle(spark, tokens):
    tool = Tokenizer.from_file(tokens)
    rows = [(i, f"text number {i} " * 6_000, "w" * 200, [7], "old") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, filler string, ids array<int>, decoded string").repartition("doc_id")
    got = bpe.encode(docs, tokens, piece_chars=20_000, decoded="decoded")
    assert sorted(got.columns) == ["decoded", "doc_id", "filler", "ids", "text"]
    found = {r["doc_id"]: (r["ids"], r["decoded"]) for r in got.collect()}
    assert len(found) == 60 and got.count() == 60
    for i, text, *_ in rows[::7]:
        ids = tool.encode(text, add_special_tokens=False).ids
        assert found[i] == (ids, tool.decode(ids, skip_special_tokens=False))
    for i, (ids, _) in found.items():
        start = tool.encode(f"text number {i} text", add_special_tokens=False).ids
        assert ids[: len(start)] == start


# 6 mixing


def test_mix_keeps_near_targets_and_caps(documents, wide, nothing):
    rows = mixing.mix(wide).collect()
    assert len(rows) == documents.count() and all(0 <= r["passes"] <= 3 for r in rows)
    total, by_source = sum(r["size"] for r in rows), defaultdict(lambda: [0, 0.0, 0, 0])
    for r in rows:
        s = by_source[r["source"]]
        s[0], s[1], s[2], s[3] = s[0] + r["size"] * r["passes"], r["target"], r["source_size"], max(s[3], r["size"])
    assert abs(sum(s[1] for s in by_source.values()) - total) < 1e-6 * total
    assert all(s[1] <= 3 * s[2] + 1e-6 and abs(s[0] - s[1]) <= s[3] / 2 + 1 for s in by_source.values())
    assert ordered(mixing.mix(wide)) == sorted((tuple(r) for r in rows), key=repr)
    assert mixing.mix(nothing).count() == 0
    taken = mixing.take(wide, mixing.mix(wide))
    assert taken.columns == wide.columns and taken.count() == sum(r["passes"] for r in rows)


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1_000), ("c", 5), (None, 2_000)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 15
    assert got["b"] == pytest.approx(2970 * 2 / 7) and got[None] == pytest.approx(2970 * 5 / 7)


# 7 toxicity


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    start, step = np.array([[0.0, 0.4]] * 2), rng.normal(size=(2, 2))
    lengths = [1, 5, 7, 2]
    scores = rng.normal(size=sum(lengths))
    begins = np.zeros(len(scores), dtype=bool)
    begins[np.cumsum([0, *lengths[:-1]])] = True
    expected, at = [], 0
    for n in lengths:
        s, z, m = scores[at : at + n], 0.0, np.zeros(n)
        for y in itertools.product([0, 1], repeat=n):
            e = np.exp(start[0, y[0]] + s @ np.array(y) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            z, m = z + e, m + e * np.array(y)
        expected.extend(m / z)
        at += n
    assert np.allclose(toxicity.marginals(scores, begins, start, step)[0], expected)


def test_toxicity_query_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.8  # some documents are labelled toxic without any toxic word
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.02


def test_spans_and_edges(spark, wide, nothing):
    texts = [f"a calm text number {i} about nothing at all" for i in range(40)] + [f"you {'scum' if i % 2 else 'moron'} number {i}, go away" for i in range(40)]
    words = [t.split() for t in texts]
    toxic = np.array([0] * 40 + [1] * 40)
    entries = frozenset({"scum$", "moron$"})
    chain = toxicity.fit_chain(words, [toxicity.label_tokens(w, y, entries) for w, y in zip(words, toxic, strict=True)], toxic)
    df = spark.createDataFrame([("well, you  scum, indeed",), ("nothing at all",), (None,), ("",)], "text string")
    got = [r["t"] for r in df.select(toxicity.toxicity(F.col("text"), chain).alias("t")).collect()]
    assert got[0]["score"] > 0.5 and [(s["start"], s["end"]) for s in got[0]["spans"]] == [(11, 16)]
    assert all(g["score"] < 0.5 and not g["spans"] for g in got[1:])
    empty = toxicity.train_toxicity(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert wide.select(toxicity.toxicity(F.col("text"), empty)["score"].alias("s")).where("s > 0.5").count() == 0


# 8 simhash


def brute_fingerprint(text):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).translate({ord(c): " " for c in WHITE}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, documents, wide, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = brute_components(len(rows), linked)
    smallest = {root: min((rows[k][0] for k in range(len(rows)) if roots[k] == root and rows[k][0] is not None), default=None) for root in set(roots)}
    expected = sorted(((rows[k][0], f"{prints[k]:016x}", smallest[roots[k]]) for k in range(len(rows))), key=repr)
    got = simhash.near_duplicates(wide).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    assert ordered(got) == expected
    assert simhash.near_duplicates(nothing).count() == 0


def test_vantage_point_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 100)
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in [*seeds[:150].tolist(), *[int(seeds[0])] * 200]:
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        prints.add(int(s) ^ sum(1 << int(f) for f in flips))
    values = np.array(sorted(prints), dtype=np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    expected = common.forest(len(values), a, b)
    signed = values.view(np.int64)
    links = simhash.links(spark.createDataFrame([(int(v),) for v in signed], "fp long")).collect()
    place = {int(v): k for k, v in enumerate(signed)}
    got = common.forest(len(values), np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert got.tolist() == expected.tolist()
    home = np.ones(len(values), dtype=bool)
    assert simhash.linked_roots(values, home).tolist() == expected.tolist()


# 9 urls


def test_urls(spark):
    rows = [
        (1, "HTTP://News.Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "https://a.com/fr/#t"),
        (5, "https://com/de/"), (6, "https://notexample.net"), (7, None), (8, "no scheme/at/all"), (9, ""), (10, "x://"), (11, "http://org"),
    ]
    pages = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, learnt string, grams string")
    labels = spark.createDataFrame([(f"http://good{i}.net/en/{i}", "allow") for i in range(30)] + [(f"http://casino{i}.net/win/{i}", "block") for i in range(30)], "url string, verdict string")
    model = url_filter.train_url_model(labels)
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, queries.RULES, model).collect()}
    assert [got[k]["host"] for k in range(1, 12)] == ["news.example.org", "example.org", "example.org", "a.com", "com", "notexample.net", "", "", "", "", "org"]
    assert [got[k]["path"] for k in range(1, 12)] == ["/es/1", "/en/12", "/en/2", "/fr/", "/de/", "", "", "", "", "", ""]
    assert [got[k]["rule"] for k in range(1, 12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/"] + [None] * 6
    assert [got[k]["verdict"] for k in range(1, 6)] == ["block", "block", "allow", "allow", "block"]
    assert all(got[k]["verdict"] in ("allow", "block") for k in range(6, 12)) and got[1]["learnt"] == "w"
    new = spark.createDataFrame([("http://casino99.net/win/7",), ("http://good77.net/en/3",)], "url string")
    assert [r["v"] for r in model.verdict(new, "url", "v").collect()] == ["block", "allow"]
    assert url_filter.train_url_model(labels.limit(0)).verdict(new, "url", "v").collect()[0]["v"] == "allow"
    assert url_filter.filter_urls(pages.limit(0), queries.RULES, model).count() == 0


def plain_url(url):
    """(host, path) by cutting the text, without patterns."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path):
    found = [r for r in queries.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    return max(found, key=lambda r: len(r.name), default=None)


def test_url_query_matches_brute_force(spark):
    """Every page's host, path, rule and ruled verdict."""
    sf_dir = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op9_url_filter(spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = plain_url(urls[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_urls_with_clashing_names_repeated_rows_and_very_long_ones(spark):
    long = "http://a.org/" + "x" * 200_000
    rows = [(1, long, "h", "p", "r", "v"), (1, long, "h", "p", "r", "v"), (2, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Host string, path string, rule string, verdict string")
    model = url_filter.UrlModel(None, "block")
    found = url_filter.filter_urls(pages, queries.RULES, model)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    first, second, null = sorted(found.collect(), key=lambda r: r["page_id"])
    assert first == second and (first["host"], len(first["path"]), first["rule"], first["verdict"]) == ("a.org", 200_001, "org/", "allow")
    assert (null["host"], null["path"], null["rule"], null["verdict"]) == ("", "", None, "block")
    both = url_filter.filter_urls(pages, queries.RULES, model, suffix="_new").first()
    assert (both["Host"], both["host_new"], both["rule"], both["rule_new"]) == ("h", "a.org", "r", "org/")



# 10 minhash


def test_edits_match_brute_force(documents, nothing):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.where("doc_id <> 205").dropDuplicates(["doc_id"]).collect()))
    df = documents.where("doc_id <> 205").dropDuplicates(["doc_id"])
    for buckets in (1, 5):
        got = {r["doc_id"]: r for r in minhash.compare_edits(df, buckets).collect()}
        assert len(got) == len(rows)
        for k, (doc_id, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            mine, new, other = minhash.signature(text), minhash.signature(edited), minhash.signature(following)
            expected = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), minhash.to_hex(mine), minhash.to_hex(new), (mine == new).mean(), (mine == other).mean())
            assert tuple(got[doc_id]) == expected
    assert minhash.compare_edits(documents).count() == documents.count()
    assert minhash.compare_edits(nothing).count() == 0


def test_signature_matches_a_plain_loop():
    rng = np.random.default_rng(4)
    for n in (0, 1, 4, 5, 300):
        text = " ".join(f"w{i}" for i in rng.integers(0, 99, n))
        shingles = [int(x) for x in minhash.shingle_hashes(text)]
        expected = [min(((int(f) * (x >> 32) + int(c)) % 2**64 for x in shingles), default=2**64 - 1) >> 32 for f, c in zip(minhash._FACTORS, minhash._SHIFTS, strict=True)]
        assert minhash.signature(text).tolist() == expected and len(expected) == 128


def test_bands_follow_the_similarity():
    assert [minhash.band_rows(s) for s in (0.9, 0.8, 0.5, 0.3)] == [6, 4, 2, 1]
    for s in (0.3, 0.5, 0.8, 0.95):
        rows = minhash.band_rows(s)
        assert (1 - s**rows) ** (128 // rows) <= minhash.MISS or rows == 1


@pytest.mark.parametrize("similarity", [0.5, 0.3])
def test_recall_of_pairs_below_the_usual_similarity(spark, similarity):
    rng = np.random.default_rng(13)
    rows = []
    for k in range(60):
        words = [f"p{k}_{i}" for i in range(400)]
        # A run of other words at the end: Jaccard just above the threshold.
        kept = int(2 * similarity / (1 + similarity) * 396) + 6
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:kept] + [f"q{k}_{i}" for i in rng.permutation(400 - kept)]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity).select("doc_id", "component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i, _ in rows}


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 5_000, 2_000)]
    a, b = " ".join(words), " ".join(words[:1_700] + [f"z{i}" for i in range(300)])
    x, y = set(minhash.shingle_hashes(a).tolist()), set(minhash.shingle_hashes(b).tolist())
    assert minhash.likeness(minhash.signature(a), minhash.signature(b)) == pytest.approx(len(x & y) / len(x | y), abs=0.13)


def test_minhash_near_duplicates_match_brute_force(spark, documents):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    near = [(1_000 + k, " ".join([*base[:60], f"v{k}", *base[61:]])) for k in range(20)]
    far = [(2_000 + k, " ".join(f"q{i}" for i in rng.integers(0, 900, 80))) for k in range(20)]
    rows = [(r["doc_id"], r["text"]) for r in documents.where("doc_id is not null and doc_id <> 205").dropDuplicates(["doc_id"]).collect()] + near + far
    sets = [set(minhash.shingle_hashes(t).tolist()) for _, t in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    roots = brute_components(len(rows), linked)
    smallest = {root: min(rows[k][0] for k in range(len(rows)) if roots[k] == root) for root in set(roots)}
    got = dict(ordered(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id")))
    assert got == {rows[k][0]: smallest[roots[k]] for k in range(len(rows))}


def two_families(variants, seed):
    """Two texts at Jaccard 0.88, each with variants at 0.82 of it that are under 0.8 to all others: (texts, linked pairs)."""
    rng = np.random.default_rng(seed)
    x = [f"w{seed}_{i}" for i in range(400)]

    def changed(words, places, mark):
        return [f"{mark}_{i}" if i in places else w for i, w in enumerate(words)]

    y = changed(x, {20, 100, 180, 260, 340}, "y")
    texts = [x, y]
    for k in range(2 * variants):
        places = set((rng.choice(39, 8, replace=False) * 10 + rng.integers(5, 10)).tolist())
        texts.append(changed(texts[k % 2], places, f"v{k}"))
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block", [512, 16])
def test_two_families_joined_by_one_link_stay_one_group(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    rows = [(1_000 * seed + k, t) for seed in range(1, 4) for k, t in enumerate(two_families(60, seed))]
    sets = [set(minhash.shingle_hashes(t).tolist()) for _, t in rows]
    across = [
        (rows[a][0] % 1_000, rows[b][0] % 1_000)
        for a, b in itertools.combinations(range(len(rows)), 2)
        if (rows[a][0] - rows[b][0]) % 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    assert across == [(0, 1)] * 3
    got = dict(ordered(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id")))
    assert got == {doc_id: doc_id // 1_000 * 1_000 for doc_id, _ in rows}


def test_registered_query_reports_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = [set(minhash.shingle_hashes(r["text"]).tolist()) for r in docs]
    linked = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = brute_components(len(docs), linked)
    smallest = {root: min(docs[k]["doc_id"] for k in range(len(docs)) if roots[k] == root) for root in set(roots)}
    got = queries.QUERIES["op10_minhash"](spark, SF)
    assert got.columns[:-1] == minhash.compare_edits(spark.read.parquet(f"{SF}/documents.parquet")).columns
    assert dict(ordered(got.select("doc_id", "component_id"))) == {docs[k]["doc_id"]: smallest[roots[k]] for k in range(len(docs))}


def test_compare_and_group_agrees_with_its_parts(documents, nothing):
    got = minhash.compare_and_group(documents)
    assert ordered(got.drop("component_id")) == ordered(minhash.compare_edits(documents))
    assert ordered(got.select("doc_id", "fingerprint", "component_id")) == ordered(minhash.near_duplicates(documents))
    assert minhash.compare_and_group(nothing).count() == 0


# pipeline


def test_stages_keep_columns_and_stand_odd_rows(spark, wide, nothing):
    for docs in (wide, nothing):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert name == "mixing sources" or out.count() <= kept
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == kept


def test_one_row_of_each_group_stays(spark, documents):
    """Repeated ids with different texts, and rows without id."""
    docs = documents.union(spark.createDataFrame([(None, "no id here at all", "en", "hot", 17), (None, "twice the same row", "en", "b", 18)], documents.schema))
    rows = [tuple(r) for r in docs.collect()]
    prints = [brute_fingerprint(r[1] or "") for r in rows]
    root = brute_components(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    turns = [r[0] for r in docs.select(F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, turns[k])):
        first.setdefault(root[k], rows[k][:2])
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted(((i, t or "") for i, t in first.values()), key=repr)
    assert sum(i == 205 for i, _ in got) == 2


def test_pipeline_matches_stages_done_by_hand(spark, tokens):
    """From the toxicity stage's result on, every stage is done again in plain Python."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    safe = corpus_pipeline.drop_toxic(spark, documents, SF)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in safe.collect()]
    texts = {i: t for i, t, _, _ in brute_lines([(i, t) for i, t, _ in rows])}
    source = {i: s for i, _, s in rows}
    ids = sorted(texts)
    prints = {i: brute_fingerprint(texts[i]) for i in ids}
    roots = brute_components(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2])
    kept = [i for k, i in enumerate(ids) if roots[k] == k]
    frame = spark.createDataFrame([(i, texts[i], source[i]) for i in kept], "doc_id long, text string, source string")
    passes = {r["doc_id"]: r["passes"] for r in mixing.mix(frame).collect()}
    tool = bpe.Encoder(tokens)
    expected = sorted(
        (i, tool.whole.encode(texts[i], add_special_tokens=False).ids) for i in kept for _ in range(passes[i])
    )
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected and len(safe.columns) == len(documents.columns)


def test_oracle_queries_match(spark):
    from checks.compare import difference, duck

    connection = duck(SF)
    for name, sql in queries.ORACLE.items():
        assert difference(queries.QUERIES[name](spark, SF), connection, sql) is None, name
