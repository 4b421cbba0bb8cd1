"""Phrase collocation mining with weighted acyclic automata.

The n-grams of each shard of texts are sorted and become a count automaton,
which is cut at the borders of prefix ranges (of language and first two
words). The automata of a range meet in one task, whose union adds up their
weights. Words come first, then pairs, then phrases of three and four words;
in each round only n-grams whose parts may be frequent are counted, as told by
a filter of fixed size that lets every frequent part through. So all counts
of frequent phrases are exact, and rare ones hardly travel.

A candidate's parts are looked up by composing an acceptor of all parts wanted
in a range with the range's count automaton. The score of a cut is
floor(2,000,000 a / (l + r)), in decimals; a phrase has its lowest one.

Defined results: languages are counted apart, a missing one is ``und``; a null
text has no words; rows count as often as they are repeated. Very long texts
are cut into shards where pieces end, which no phrase spans. Ties follow the
order in ``collocations``. An empty table has no phrases. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecast.llm import automata
from scorecast.llm.automata import Automaton
from scorecast.llm.hash_filter import hash_filter, may_hold
from scorecast.sources.store import save

LONGEST = 4
LEAST_COUNT = 30
COVER = 80  # per cent of a phrase's occurrences that lie in a longer one
TOP = 2_000
SHARD_BYTES = 12 << 20
SAMPLE = 400
NO_LANG = "und"
PARTS = 32
_WORD_BYTES = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
# What ends a piece becomes a line end, a tab a space.
_TABLE = bytes(10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))

Border = tuple[bytes, bytes, bytes]


# Shards.


def shard_words(texts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The sorted words of UTF-8 texts, and their numbers in order of the texts with -1 where a piece ends."""
    marked = b"\n".join(texts).lower().translate(_TABLE).replace(b"\n", b" \n ")
    coded = pa.array(marked.split(b" "), pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    empty, end = (pc.index(words, pa.scalar(w, pa.large_binary())).as_py() for w in (b"", b"\n"))
    tokens = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
    tokens = tokens[tokens != empty] if empty >= 0 else tokens
    real = np.ones(len(words), dtype=bool)
    real[[k for k in (empty, end) if k >= 0]] = False
    number = np.where(real, np.cumsum(real) - 1, -1)
    return words.filter(pa.array(real)), number[tokens]


def word_hashes(lang: bytes, words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, xxhash.xxh64_intdigest(lang)) for w in words.to_pylist()], dtype=np.uint64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    x = left * _ODD + right
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shard_phrases(lang: bytes, texts: Sequence[bytes], lengths: Sequence[int], admitted: np.ndarray | None) -> Iterator[Automaton]:
    """One automaton for each of the consecutive ``lengths``, if there are such phrases.

    Counted are phrases all of whose parts, one word shorter than the first of ``lengths``, are ``admitted``.
    """
    parts = lengths[0] - 1
    words, tokens = shard_words(texts)
    own = word_hashes(lang, words) if parts else np.zeros(0, dtype=np.uint64)
    open_ = passing = tokens >= 0
    hashes, which, columns = own, np.where(open_, tokens, 0), [np.arange(len(words))]
    for length in range(1, lengths[-1] + 1):
        if length > 1:
            # The last part starts so many words later; while phrases are still parts, it is the last word.
            later = length - parts if length > parts else length - 1
            ahead = np.zeros(len(tokens), dtype=bool)
            ahead[: max(0, len(tokens) - later)] = passing[later:]
            open_ = open_ & ahead
            at = np.flatnonzero(open_)
            pair, last, _, number = automata.numbered(which[at], tokens[at + length - 1], len(words))
            hashes = joined(hashes[pair], own[last]) if length <= parts else hashes
            columns = [*(c[pair] for c in columns), last]
            which = np.zeros(len(tokens), dtype=np.int64)
            which[at] = number
        if not open_.any():
            return
        if length == parts:
            open_ = passing = open_ & may_hold(admitted, hashes.view(np.int64))[which]
        if length in lengths and open_.any():
            weights = np.bincount(which[open_], minlength=len(columns[0]))
            kept = weights > 0
            yield automata.build(words, [c[kept] for c in columns], weights[kept])


# Prefix ranges.


def stretch_of(borders: Sequence[Border], lang: bytes, words: Sequence[bytes]) -> int:
    """The range of a phrase: how many borders are not after its language and first two words."""
    return bisect_right(borders, (lang, words[0], words[1] if len(words) > 1 else b""))


def cut(automaton: Automaton, lang: bytes, borders: Sequence[Border]) -> Iterator[tuple[int, Automaton]]:
    """The parts of an automaton in each prefix range that has phrases of it."""
    columns, weights = automaton.phrases()
    words = automaton.words.to_pylist()

    def place(border: Border) -> int:
        """How many phrases come before ``border``."""
        _, one, two = border
        k = bisect_left(words, one)
        start = int(np.searchsorted(columns[0], k))
        if k == len(words) or words[k] != one:
            return start
        end = int(np.searchsorted(columns[0], k, "right"))
        if len(columns) == 1:
            return end if two else start
        return start + int(np.searchsorted(columns[1][start:end], bisect_left(words, two)))

    low, high = bisect_left(borders, (lang,)), bisect_left(borders, (lang + b"\0",))
    places = [0, *(place(b) for b in borders[low:high]), len(weights)]
    for k, (start, end) in enumerate(zip(places, places[1:], strict=False)):
        if end > start:
            yield low + k, automata.build(automaton.words, [c[start:end] for c in columns], weights[start:end])


def find_borders(docs: DataFrame, ranges: int) -> list[Border]:
    """At most ``ranges - 1`` borders, quantiles of the word pairs in the first part of ``SAMPLE`` documents.

    They only share out the work: results are the same with any borders.
    """
    turn = F.xxhash64("lang", "text")
    rows = docs.orderBy(turn).limit(SAMPLE).select("lang", F.substring("text", 1, 5_000).alias("text")).collect()
    pairs = set()
    for lang, text in rows:
        words, tokens = shard_words([text.encode()])
        known = words.to_pylist()
        for a, b in zip(tokens.tolist(), tokens[1:].tolist(), strict=False):
            if a >= 0 and b >= 0:
                pairs.add((lang.encode(), known[a][:_WORD_BYTES], known[b][:_WORD_BYTES]))
    ordered = sorted(pairs)
    return sorted({ordered[len(ordered) * k // ranges] for k in range(1, ranges)}) if ordered else []


# Rounds.


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts of about ``most`` bytes, cut where a piece ends."""
    if len(text) <= most:
        yield text
        return
    marked, start = text.translate(_TABLE), 0
    while len(text) - start > most:
        end = marked.rfind(b"\n", start + 1, start + most)
        end = end if end > 0 else marked.find(b"\n", start + most)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


_SHARD = "lang string, length int, stretch int, automaton binary"
_ROUND = "lang string, length int, stretch int, total long, automaton binary, phrases array<string>, counts array<long>, hashes array<long>"


def _count(docs: DataFrame, lengths: Sequence[int], admitted: Broadcast | None, borders: Broadcast, least: int) -> DataFrame:
    """A row for each language, length and range: its total, and the phrases that occur ``least`` times, with their automaton."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if admitted is None else admitted.value
        held: dict[str, list[bytes]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for automaton in shard_phrases(lang.encode(), texts, lengths, bitmap):
                    rows = [(lang, automaton.length, k, part.dump()) for k, part in cut(automaton, lang.encode(), borders.value)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                        names=["lang", "length", "stretch", "automaton"],
                    )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for piece in _pieces(text.as_py(), SHARD_BYTES):
                    held.setdefault(lang, []).append(piece)
                    size += len(piece)
                    if size >= SHARD_BYTES:
                        yield from sent()
                        held, size = {}, 0
        yield from sent()

    def together(rows: pa.Table) -> pa.Table:
        lang, length, stretch = (rows.column(c)[0].as_py() for c in ("lang", "length", "stretch"))
        whole = automata.union([Automaton.load(a) for a in rows.column("automaton").to_pylist()])
        kept = automata.frequent(whole, least)
        total = int(whole.phrases()[1].sum())
        row = {"lang": lang, "length": length, "stretch": stretch, "total": total, "automaton": None, "phrases": [], "counts": [], "hashes": []}
        if kept is not None:
            columns, weights = kept.phrases()
            own = word_hashes(lang.encode(), kept.words)
            hashes = own[columns[0]]
            for column in columns[1:]:
                hashes = joined(hashes, own[column])
            row |= {"automaton": kept.dump(), "phrases": kept.texts(), "counts": weights.tolist(), "hashes": hashes.view(np.int64).tolist()}
        return pa.Table.from_pylist([row], schema=_ARROW)

    parts = docs.mapInArrow(shards, _SHARD)
    return save(parts.groupBy("lang", "length", "stretch").applyInArrow(together, _ROUND), "phrases-counted")


_ARROW = pa.schema(
    [
        *((c, t) for c, t in (("lang", pa.string()), ("length", pa.int32()), ("stretch", pa.int32()), ("total", pa.int64()), ("automaton", pa.binary()))),
        ("phrases", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
        ("hashes", pa.list_(pa.int64())),
    ]
)


def look_up(parts: DataFrame, counted: DataFrame, borders: Broadcast) -> DataFrame:
    """(lang, part, f): counts of distinct ``parts`` (lang, part, length), by composing acceptors with the stored automata."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), strict=True)
            stretches = [stretch_of(borders.value, lang.encode(), part.encode().split(b" ", 2)) for lang, part in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "length", "part")), pa.array(stretches, pa.int32())], names=["lang", "length", "part", "stretch"])

    def composed(wanted: pa.Table, stored: pa.Table) -> pa.Table:
        automaton = next((a for a in stored.column("automaton").to_pylist() if a is not None), None) if stored.num_rows else None
        if not wanted.num_rows or automaton is None:
            return pa.table({"lang": pa.array([], pa.string()), "part": pa.array([], pa.string()), "f": pa.array([], pa.int64())})
        split = sorted(part.encode().split(b" ") for part in wanted.column("part").to_pylist())
        words = sorted({w for part in split for w in part})
        number = {w: k for k, w in enumerate(words)}
        columns = [np.array([number[w] for w in column]) for column in zip(*split, strict=True)]
        acceptor = automata.build(pa.array(words, pa.large_binary()), columns, np.ones(len(split), dtype=np.int64))
        found, weights = automata.compose(acceptor, Automaton.load(automaton))
        texts = [acceptor.words.cast(pa.large_string()).take(pa.array(c)) for c in found]
        text = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pa.table({"lang": pa.array([wanted.column("lang")[0].as_py()] * len(weights), pa.string()), "part": text, "f": weights})

    keys = ("lang", "length", "stretch")
    wanted = parts.select("lang", "part", "length").mapInArrow(place, "lang string, length int, part string, stretch int")
    stored = counted.select(*keys, "automaton")
    return save(wanted.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(composed, "lang string, part string, f long"), "phrases-parts")


# Scores.


def _phrases(counted: DataFrame) -> DataFrame:
    """(lang, phrase, length, a) of the frequent phrases in the rows of rounds."""
    pairs = counted.select("lang", "length", F.explode(F.arrays_zip("phrases", "counts")).alias("p"))
    return pairs.select("lang", F.col("p.phrases").alias("phrase"), "length", F.col("p.counts").alias("a"))


def _slice(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def collocations(docs: DataFrame, top: int | None = TOP, least: int = LEAST_COUNT, longest: int = LONGEST, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, a (both descending) and phrase.

    Phrases have 2 to ``longest`` words and occur ``least`` times. Those whose occurrences lie to
    ``cover`` per cent in a longer one are left out. ``top`` None returns all.
    """
    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    weight = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    context = docs.sparkSession.sparkContext
    borders = context.broadcast(find_borders(texts, max(1, ceil(weight / (2 * SHARD_BYTES)))))
    words = _count(texts, (1,), None, borders, least)
    pairs = _count(texts, (2,), hash_filter(words.select(F.explode("hashes").alias("h")), "h"), borders, least)
    rounds = [words, pairs]
    if longest > 2:
        admitted = hash_filter(pairs.select(F.explode("hashes").alias("h")), "h")
        rounds.append(_count(texts, tuple(range(3, longest + 1)), admitted, borders, least))
    counted = rounds[0]
    for further in rounds[1:]:
        counted = counted.union(further)
    known = save(_phrases(counted.where("length > 1")).withColumn("words", F.split("phrase", " ")), "phrases-known")

    cuts = known.select("lang", "phrase", "length", "a", "words", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(_slice("words", "1", "k")).alias("first"), F.expr(_slice("words", "k + 1", "length - k")).alias("rest"), "length")
    sides = F.explode(F.array(F.struct(F.col("first").alias("part"), F.col("k").alias("length")), F.struct(F.col("rest").alias("part"), (F.col("length") - F.col("k")).alias("length"))))
    parts = look_up(cuts.select("lang", sides.alias("s")).select("lang", "s.part", "s.length").distinct(), counted, borders)
    scored = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    scored = scored.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = known.where("length > 2").select("lang", F.col("a").alias("f"), "length", "words", F.explode(F.expr("sequence(2, length - 1)")).alias("size"))
    inner = longer.select("lang", "f", "words", "size", F.explode(F.expr("sequence(1, length - size + 1)")).alias("start"))
    holders = inner.select("lang", "f", F.expr(_slice("words", "start", "size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    covered = F.expr(f"cast(most as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(cover)}")
    left = worst.join(holders, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    # Sums of partial totals: one row for each language.
    totals = words.groupBy("lang").agg(F.sum("total").alias("n"))
    by_score = (F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    if top is not None:
        # First within parts of a language, so that the last ranking sees PARTS * top rows of each at most.
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        within = Window.partitionBy("lang", "part").orderBy(*by_score)
        left = left.withColumn("part", part).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
