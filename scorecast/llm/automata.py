"""Weighted acyclic automata over words: each accepts phrases of one length, and the weight of a path is a count.

States are numbered level by level; the arcs of a state are sorted by word and
weights stand on the arcs that end a phrase. An automaton is built from sorted
distinct phrases; states whose arcs are equal in words, weights and targets
are one state, registered level by level from the ends of the phrases to the
root. Union adds the weights of equal phrases. Composing an acceptor with a
count automaton walks both together and returns the count of each phrase that
both hold.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_MIX = np.uint64(0xD6E8FEB86659FD93)


def numbered(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order: their parts, where each first occurs, and the pair of every row."""
    distinct, first, which = np.unique(left * max(width, 1) + right, return_index=True, return_inverse=True)
    return distinct // max(width, 1), distinct % max(width, 1), first, which


def distinct_rows(columns: Sequence[np.ndarray], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of several columns of numbers below ``width`` in ascending order, and the number of each row."""
    kept, first = np.unique(columns[0], return_index=True)
    which = np.searchsorted(kept, columns[0])
    for column in columns[1:]:
        _, _, first, which = numbered(which, column, width)
    return [c[first] for c in columns], which


@dataclass(frozen=True)
class Automaton:
    """``starts[d]`` cuts the arcs of depth ``d`` into states; state 0 of depth 0 is the root."""

    words: pa.Array
    starts: list[np.ndarray]
    labels: list[np.ndarray]
    targets: list[np.ndarray]
    weights: np.ndarray

    @property
    def length(self) -> int:
        return len(self.labels)

    def dump(self) -> bytes:
        small = [[a.astype(np.uint32) for a in part] for part in (self.starts, self.labels, self.targets)]
        weights = self.weights if self.weights.max(initial=0) >> 32 else self.weights.astype(np.uint32)
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((b"\n".join(self.words.to_pylist()), *small, weights), protocol=5))

    @staticmethod
    def load(data: bytes) -> Automaton:
        words, *small, weights = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        return Automaton(pa.array(words.split(b"\n") if words else [], pa.large_binary()), *([a.astype(np.int64) for a in part] for part in small), weights.astype(np.int64))

    def phrases(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All phrases in ascending order as columns of word numbers, and their weights."""
        columns: list[np.ndarray] = []
        states = np.zeros(1, dtype=np.int64)
        for starts, labels, targets in zip(self.starts, self.labels, self.targets, strict=True):
            arcs, owner = _arcs_of(starts, states)
            columns = [c[owner] for c in columns] + [labels[arcs]]
            states = targets[arcs]
        return columns, self.weights[arcs]

    def texts(self) -> list[str]:
        """The phrases' words with a space between them."""
        words = self.words.cast(pa.large_string())
        parts = [words.take(pa.array(c)) for c in self.phrases()[0]]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).to_pylist()


def _arcs_of(starts: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs of each of ``states`` one after the other, and which of them each arc is from."""
    sizes = starts[states + 1] - starts[states]
    owner = np.repeat(np.arange(len(states)), sizes)
    before = np.cumsum(sizes) - sizes
    return starts[states][owner] + np.arange(len(owner)) - before[owner], owner


def _register(starts: np.ndarray, labels: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each state the first one with equal arcs, compared arc by arc, and the places of the arcs of such first ones."""
    sizes = np.diff(starts)
    arc = (labels.astype(np.uint64) * _MIX) ^ ((weights.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    arc = (arc ^ (arc >> np.uint64(31)) ^ (targets.astype(np.uint64) << np.uint64(17))) * _MIX
    signs = np.add.reduceat(arc ^ (arc >> np.uint64(29)), starts[:-1]) + sizes.astype(np.uint64)
    first, which = np.unique(signs, return_index=True, return_inverse=True)[1:]
    like = first[which]
    # Equal signs are only a hint: states that differ from the first one keep their own arcs.
    apart = sizes != sizes[like]
    twin = np.where(apart, np.arange(len(sizes)), like)
    mirrored, owner = _arcs_of(starts, twin)
    differs = (labels != labels[mirrored]) | (weights != weights[mirrored]) | (targets != targets[mirrored])
    apart[owner[differs]] = True
    like = np.where(apart, np.arange(len(sizes)), like)
    return like, np.unique(like)


def build(words: pa.Array, columns: Sequence[np.ndarray], weights: np.ndarray) -> Automaton:
    """The automaton of one or more sorted distinct phrases, given as columns of numbers of sorted ``words``; others are left out."""
    needed = np.unique(np.concatenate(columns))
    words, columns = words.take(pa.array(needed)), [np.searchsorted(needed, c) for c in columns]
    change = [np.zeros(len(weights), dtype=bool) for _ in range(len(columns) + 1)]
    change[0][:1] = True
    for k, column in enumerate(columns):
        change[k + 1][:1] = True
        change[k + 1][1:] = change[k][1:] | (column[1:] != column[:-1])
    starts, labels, targets = [], [], []
    target, weight = np.zeros(len(weights), dtype=np.int64), weights
    for depth in reversed(range(len(columns))):
        rows = np.flatnonzero(change[depth + 1])  # one arc for each distinct beginning
        label = columns[depth][rows]
        cuts = np.append(np.flatnonzero(change[depth][rows]), len(rows))
        like, kept = _register(cuts, label, weight, target)
        arcs, _ = _arcs_of(cuts, kept)
        starts.insert(0, np.concatenate([[0], np.cumsum(np.diff(cuts)[kept])]))
        labels.insert(0, label[arcs])
        targets.insert(0, target[arcs])
        if depth == len(columns) - 1:
            last = weight[arcs]
        target, weight = np.searchsorted(kept, like), np.zeros(len(like), dtype=np.int64)
    return Automaton(words, starts, labels, targets, last)


def _shared_words(parts: Sequence[Automaton]) -> tuple[pa.Array, list[np.ndarray]]:
    """All words of several automata, sorted, and the new number of each automaton's words."""
    every = pc.unique(pa.concat_arrays([p.words for p in parts]))
    words = every.take(pc.sort_indices(every))
    return words, [pc.index_in(p.words, words).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]


def union(parts: Sequence[Automaton]) -> Automaton:
    """One automaton with the phrases of all ``parts``; weights of equal phrases are added."""
    words, renumbered = _shared_words(parts)
    rows = [(*[new[c] for c in columns], weights) for new, (columns, weights) in zip(renumbered, (p.phrases() for p in parts), strict=True)]
    *columns, weights = (np.concatenate(c) for c in zip(*rows, strict=True))
    columns, which = distinct_rows(columns, len(words))
    order = np.argsort(which, kind="stable")
    sums = np.add.reduceat(weights[order], np.searchsorted(which[order], np.arange(len(columns[0]))))
    return build(words, columns, sums)


def frequent(automaton: Automaton, least: int) -> Automaton | None:
    """The phrases of weight ``least`` or more, None if there are none."""
    columns, weights = automaton.phrases()
    kept = weights >= least
    return build(automaton.words, [c[kept] for c in columns], weights[kept]) if kept.any() else None


def compose(wanted: Automaton, counts: Automaton) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases of ``wanted`` that ``counts`` holds, as columns of ``wanted``'s word numbers, and their weights there."""
    word = pc.index_in(wanted.words, counts.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(counts.words) + 1
    ours, theirs = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    columns: list[np.ndarray] = []
    for depth in range(wanted.length):
        arcs, owner = _arcs_of(wanted.starts[depth], ours)
        starts = counts.starts[depth]
        known = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * width + counts.labels[depth]
        asked = theirs[owner] * width + word[wanted.labels[depth][arcs]]
        place = np.searchsorted(known, asked)
        place[place == len(known)] = 0
        met = (known[place] == asked) & (word[wanted.labels[depth][arcs]] >= 0)
        columns = [c[owner[met]] for c in columns] + [wanted.labels[depth][arcs[met]]]
        ours, theirs, place = wanted.targets[depth][arcs[met]], counts.targets[depth][place[met]], place[met]
    return columns, counts.weights[place]
