"""Language-model scoring: a weighted backoff automaton over smoothed n-grams, traversed once per text.

Texts are dealt by a hash to blocks of about ``BLOCK_BYTES``. A block sends
its distinct n-grams (64-bit keys) with their counts in the training texts;
Spark adds up the counts of each key and answers the blocks that do not hold
all of them. So the model stays distributed, is complete, and every block
receives just the part that its own texts can reach.

A block turns its part into an automaton. States are the known n-grams of
fewer than ``order`` words, and the empty one, the root. An arc reads a word
after a state; its weight is the smoothed log-probability, and it leads to the
state of the longest known end of what was read. Where a state has no arc for
a word, its failure arc leads to the state without the first word, at the cost
of the context's backoff weight. The root has an arc for every word. Each text
is read once from left to right, carrying one state and adding up weights.

Smoothing: P(w | h) = (c(hw) + prior * P(w | shorter h)) / (c(h) + prior), and
(c(w) + addend) / (N + addend * (V + 1)) without a context, so that unseen
words together have the share of one more word. All counts are kept.

Defined results: A-Z in lower case; tokens are words ``[^\\x20\\x09-\\x0D]+`` and
one end. A null text is empty: its end alone is scored. Without training texts N
and V are 0. Rows count as often as they are repeated; rows without doc_id are
held out. Only the named columns are read and returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.sources.store import save

ORDER = 2
ADDEND = 0.1
PRIOR = 100.0
FOLDS = 10
BLOCK_BYTES = 6 << 20
START, END = 0, 1
NO_ARC = 1.0  # no log-probability
_LEVELS = 7  # the last three bits of a key hold the number of words of its n-gram; 0 is the start of a text
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ENDS = (xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b"", 2))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True where ``folds`` divides the crc32 of the id as text, and for rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


# The n-grams of a block.


@dataclass(frozen=True)
class Level:
    """The distinct n-grams of one length: keys, counts in training texts, and how they are made of shorter ones."""

    keys: np.ndarray
    counts: np.ndarray
    context: np.ndarray  # without the last word; an index in the level below
    ending: np.ndarray  # without the first word; an index in the level below
    word: np.ndarray


@dataclass(frozen=True)
class Block:
    """Tokens of texts one after the other, each text with ``START`` before it, and the n-grams among them.

    ``found`` holds for each length and place the n-gram that ends there, or -1 where the text is too short.
    """

    tokens: np.ndarray
    starts: np.ndarray
    levels: list[Level]
    found: list[np.ndarray]


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return ((x ^ (x >> np.uint64(32))) & ~np.uint64(_LEVELS)) | np.uint64(level)


def read_block(texts: list[bytes], training: list[bool], order: int) -> Block:
    """The tokens and n-grams of UTF-8 ``texts``; counts are of those for ``training``."""
    split = [text.lower().split() for text in texts]  # of bytes: A-Z only, and ASCII white space only
    lengths = np.array([len(words) + 2 for words in split], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    coded = pa.array(chain.from_iterable(split), pa.large_binary(), size=int(lengths.sum()) - 2 * len(split)).dictionary_encode()
    del split  # a Python object for each token
    tokens = np.full(int(starts[-1]), END, dtype=np.int64)
    tokens[starts[:-1]] = START
    inner = np.ones(len(tokens), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    tokens[inner] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], lengths)
    counted = np.repeat(np.array(training, dtype=bool), lengths)
    own = np.array([*_ENDS, *map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())], dtype=np.uint64)
    keys = _mixed(own, 1)
    keys[START] &= ~np.uint64(_LEVELS)
    nothing = np.zeros(len(own), dtype=np.int64)
    counts = np.bincount(tokens[counted], minlength=len(own))
    levels, found = [Level(keys.view(np.int64), counts, nothing, nothing, np.arange(len(own)))], [tokens]
    for level in range(2, order + 1):
        ends = np.flatnonzero(place >= level - 1)
        pair = found[-1][ends - 1] * len(own) + tokens[ends]
        distinct, first, which = np.unique(pair, return_index=True, return_inverse=True)
        context, word = distinct // len(own), distinct % len(own)
        below = levels[-1].keys.view(np.uint64)
        keys = _mixed(below[context] * _ODD + own[word], level)
        counts = np.bincount(which[counted[ends]], minlength=len(distinct))
        levels.append(Level(keys.view(np.int64), counts, context, found[-1][ends[first]], word))
        found.append(np.full(len(tokens), -1, dtype=np.int64))
        found[-1][ends] = which
    return Block(tokens, starts, levels, found)


# The automaton.


@dataclass(frozen=True)
class Automaton:
    """States are the known n-grams of fewer than ``order`` words; n-gram ``g`` of ``k + 1`` words is an arc after ``k`` words.

    ``weight[k][g]`` is that arc's log-probability, ``NO_ARC`` where the n-gram is unknown, and ``failure[k][g]``
    the weight of the failure arc that leaves the state of n-gram ``g`` of ``k`` words for its ending.
    """

    weight: list[np.ndarray]
    failure: list[np.ndarray]
    known: np.ndarray

    def scores(self, block: Block) -> list[float]:
        """For each text the sum of weights along its one path, read from left to right."""
        deepest = len(self.weight) - 1
        arcs = [np.append(w, NO_ARC)[at] for w, at in zip(self.weight, block.found, strict=True)]
        failures = [np.zeros(len(block.tokens)), *(np.append(f, 0.0)[np.roll(at, 1)] for f, at in zip(self.failure[1:], block.found, strict=False))]
        known = self.known[block.tokens]
        starts = block.starts.tolist()
        texts = (slice(a + 1, b) for a, b in zip(starts, starts[1:], strict=False))
        return [self._score([a[t].tolist() for a in arcs], [f[t].tolist() for f in failures], known[t].tolist(), deepest) for t in texts]

    def _score(self, arcs: list[list[float]], failures: list[list[float]], known: list[bool], deepest: int) -> float:
        total = 0.0
        words = min(1, deepest)  # of the state: a text begins in the state of START
        for place, word_known in enumerate(known):
            while words:
                arc = arcs[words][place]
                if arc != NO_ARC:
                    break
                total += failures[words][place]
                words -= 1
            else:
                arc = arcs[0][place]
            total += arc
            if words < deepest and (words or word_known):
                words += 1
        return total


def build(levels: list[Level], totals: list[np.ndarray], n: int, distinct: int, addend: float, prior: float) -> Automaton:
    """The automaton of a block's n-grams with their counts in the whole training part."""
    chance = (totals[0] + addend) / (n + addend * (distinct + 1))
    weight, failure = [np.log10(chance)], [np.zeros(0)]
    for level, total, context in zip(levels[1:], totals[1:], totals, strict=False):
        failure.append(np.log10(prior / (context + prior)))
        chance = (total + prior * chance[level.ending]) / (context[level.context] + prior)
        weight.append(np.where(total > 0, np.log10(chance), NO_ARC))
    return Automaton(weight, failure, totals[0] > 0)


# Blocks in Spark.


def _dealt(docs: DataFrame, held: Column, blocks: int) -> DataFrame:
    """(block, doc_id, held_out, packed): texts compressed on their own and dealt to blocks."""
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([squeeze(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "doc_id", "held_out")), packed], names=["block", "doc_id", "held_out", "packed"])

    return rows.mapInArrow(pack, f"block long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, packed binary")


def _texts(rows: pa.Table) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p) for p in rows.column("packed").to_pylist()]


def _training(rows: pa.Table) -> list[bool]:
    return [not h for h in rows.column("held_out").to_pylist()]


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal stretches of all 64-bit keys each key lies in."""
    return (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte: their high bytes are mostly equal and compress well."""
    return zstandard.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys (as unsigned numbers) as differences."""
    return _pack(np.diff(keys.view(np.uint64), prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64).view(np.int64)


def _numbers(packed: list[bytes]) -> np.ndarray:
    return np.concatenate([_unpack(p).view(np.int64) for p in packed])


_ANSWER = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("totals", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])


def _added(group: pa.Table) -> pa.Table:
    """One stretch of keys: totals for the blocks that hold a part of them, and without a block the counts of words."""
    lists = [_unpack_keys(k) for k in group.column("keys").to_pylist()]
    keys, counts = np.concatenate(lists), _numbers(group.column("counts").to_pylist())
    place = np.argsort(keys, kind="stable")
    ordered = keys[place]
    change = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(counts[place], np.flatnonzero(change))
    totals = np.empty_like(counts)
    totals[place] = sums[np.cumsum(change) - 1]
    words = ordered[change] & _LEVELS == 1
    rows = [{"tokens": int(sums[words].sum()), "words": int((sums[words] > 0).sum())}]
    start = 0
    for block, one in zip(group.column("block").to_pylist(), lists, strict=True):
        part = slice(start, start + len(one))
        sent = totals[part] > counts[part]
        if sent.any():
            rows.append({"block": block, "keys": _pack_keys(one[sent]), "totals": _pack(totals[part][sent])})
        start += len(one)
    return pa.Table.from_pylist(rows, schema=_ANSWER)


def _totals(dealt: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, keys, totals, tokens, words): counts over all blocks, for the blocks that do not hold all of them.

    Keys travel in packed lists, one of each block for each of ``parts`` stretches.
    Rows without a block hold the training tokens and distinct words of a stretch.
    """

    def count(rows: pa.Table) -> pa.Table:
        block = read_block(_texts(rows), _training(rows), order)
        keys = np.concatenate([level.keys for level in block.levels])
        counts = np.concatenate([level.counts for level in block.levels])
        counts[START] = sum(_training(rows))
        place = np.argsort(keys.view(np.uint64))
        keys, counts = keys[place], counts[place]
        stretch, first = np.unique(_ranges(keys, parts), return_index=True)
        cuts = [*first.tolist(), len(keys)]
        slices = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        name = rows.column("block")[0].as_py()
        return pa.table(
            {
                "stretch": stretch,
                "block": np.full(len(stretch), name),
                "keys": pa.array([_pack_keys(keys[x]) for x in slices], pa.binary()),
                "counts": pa.array([_pack(counts[x]) for x in slices], pa.binary()),
            }
        )

    grams = dealt.groupBy("block").applyInArrow(count, "stretch long, block long, keys binary, counts binary")
    return save(grams.groupBy("stretch").applyInArrow(_added, "block long, keys binary, totals binary, tokens long, words long"), "backoff-totals")


_SCORED = ("held_out boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double")


def score_texts(
    docs: DataFrame, held: Column | None = None, order: int = ORDER, addend: float = ADDEND, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text of ``docs``.

    The model learns from all rows where ``held`` is false. ``base_score``
    takes words alone, ``score`` is the automaton's log10 probability.
    """
    held = held_out(F.col("doc_id")) if held is None else held
    weight = docs.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = max(1, ceil(weight / block_bytes))
    dealt = _dealt(docs, held, blocks)
    totals = _totals(dealt, order, blocks)
    sums = totals.where("block is null").agg(F.sum("tokens"), F.sum("words")).first()
    n, distinct = sums[0] or 0, sums[1] or 0

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = read_block(_texts(rows), _training(rows), order)
        keys = np.concatenate([_unpack_keys(k) for k in answers.column("keys").to_pylist()] or [np.zeros(0, dtype=np.int64)])
        sums = _numbers(answers.column("totals").to_pylist()) if answers.num_rows else keys
        place = np.argsort(keys)
        keys, sums = keys[place], sums[place]
        block.levels[0].counts[START] = sum(_training(rows))
        complete = []
        for level in block.levels:
            at = np.searchsorted(keys, level.keys)
            at[at == len(keys)] = 0
            found = keys[at] == level.keys if len(keys) else np.zeros(len(level.keys), dtype=bool)
            complete.append(np.where(found, sums[at] if len(keys) else 0, level.counts))
        automaton = build(block.levels, complete, n, distinct, addend, prior)
        ends = block.starts[1:]
        token = block.tokens
        real = token != START
        base = np.where(real, np.log10((complete[0][token] + addend) / (n + addend * (distinct + 1))), 0.0)
        known = real & (complete[0][token] > 0)
        starts = block.starts[:-1]
        columns = {
            "doc_id": rows.column("doc_id"),
            "held_out": rows.column("held_out"),
            "n_tokens": ends - starts - 1,
            "n_known": np.add.reduceat(known.astype(np.int64), starts),
            "train_tokens": np.full(len(starts), n, dtype=np.int64),
            "base_score": np.add.reduceat(base, starts),
            "score": np.array(automaton.scores(block)),
        }
        return pa.table(columns)

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return score(rows, answers) if rows.num_rows else empty

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(_SCORED)
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c.split()[0]: pa.array([], pa.float64() if "double" in c else pa.int64()) for c in _SCORED[1:]}})
    return dealt.groupBy("block").cogroup(totals.where("block is not null").select("block", "keys", "totals").groupBy("block")).applyInArrow(scored, schema)
