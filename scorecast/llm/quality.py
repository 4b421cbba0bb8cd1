"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics (shares of character classes,
word and line lengths, repetition). Trees are grown on binned statistics of
a bounded sample of labelled rows and flattened into arrays; a batch of
documents walks all trees at once in numpy.

A null text counts as empty. An empty text has statistics of zero and gets a
score like any other. Equal texts get equal scores. Without any labelled row
every score is 0.5. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scorecast.llm.common import labelled, sigmoid

MAX_FIT_ROWS = 20_000
"""Labelled rows used to grow the trees, at most."""

STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "space", "comma_stop", "mark", "other_ascii", "high_bytes", "distinct_bytes",
    "top_byte", "log_words", "word_bytes", "distinct_words", "top_word", "short_words", "long_words", "upper_words",
    "marked_words", "lone_marks", "log_lines", "line_words", "distinct_lines", "stop_lines", "distinct_pairs", "repeated_ends",
)


def _byte_class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1.0
    return mask


_SPACE = b" \t\n\x0b\x0c\r"
_STOPS = b".,;:'\"-?()"
_MARKS = b"!#$%&*@^~|<>=+_/\\{}[]`"
_CLASSES = np.stack(
    [
        _byte_class(bytes(range(65, 91))),
        _byte_class(bytes(range(97, 123))),
        _byte_class(bytes(range(48, 58))),
        _byte_class(_SPACE),
        _byte_class(_STOPS),
        _byte_class(_MARKS),
        _byte_class(bytes(c for c in range(128) if not chr(c).isalnum() and c not in _SPACE + _STOPS + _MARKS)),
        _byte_class(bytes(range(128, 256))),
    ],
    axis=1,
)
_MARK_END = tuple(bytes([c]) for c in _MARKS)


def _one(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    if not data.strip():
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = len(data)
    shares = (counts @ _CLASSES) / size
    words = data.split()
    n = len(words)
    seen = Counter(words)
    kinds = list(seen.items())
    lines = data.split(b"\n")
    filled = [line for line in lines if line]
    ends = Counter(map(_last_byte, words))
    return [
        np.log1p(size),
        *shares,
        np.count_nonzero(counts),
        counts.max() / size,
        np.log1p(n),
        (size - counts[32] - counts[10]) / n,
        len(kinds) / n,
        max(seen.values()) / n,
        sum(c for w, c in kinds if len(w) <= 2) / n,
        sum(c for w, c in kinds if len(w) >= 12) / n,
        sum(c for w, c in kinds if w.isupper()) / n,
        sum(c for w, c in kinds if w.endswith(_MARK_END)) / n,
        sum(c for w, c in kinds if len(w) == 1 and not w.isalnum()) / n,
        np.log1p(len(lines)),
        n / len(lines),
        len(set(filled)) / max(1, len(filled)),
        sum(line.endswith((b".", b"!", b"?", b'"')) for line in filled) / max(1, len(filled)),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        max(ends.values()) / n,
    ]


def _last_byte(word: bytes) -> int:
    return word[-1]


def document_statistics(texts: Iterable[str | None]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    rows = [_one(text) for text in texts]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(STATISTICS))


@dataclass(frozen=True)
class FlatTrees:
    """Complete binary trees as arrays: node i has the children 2i + 1 and 2i + 2; a tree is a row."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches, all trees side by side."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        depth = int(np.log2(self.feature.shape[1] + 1)) if len(self.feature) else 0
        for start in range(0, len(x) if depth else 0, 2048):
            part = x[start : start + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(depth):
                right = part[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[start : start + 2048] += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def grow_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, min_rows: int = 10, l2: float = 1.0
) -> FlatTrees:
    """Boosted trees for labels 0 and 1, with splits sought in histograms of gradients.

    Ties between splits go to the first statistic and the lowest threshold,
    so the same rows in the same order give the same trees.
    """
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return FlatTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    cuts = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    raw, trees = np.full(n, base), []
    offsets = np.arange(width) * bins
    for _ in range(rounds):
        p = sigmoid(raw)
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + offsets + binned).ravel()
            shape = (many, width, bins)
            g, h, c = (
                np.bincount(cell, np.repeat(w, width) if w is not None else None, minlength=many * width * bins).reshape(shape).cumsum(axis=2)
                for w in (grad, hess, None)
            )
            total_g, total_h, total_c = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
            gain[(c < min_rows) | (total_c - c < min_rows) | ~np.isfinite(cuts)[None]] = 0.0
            best = gain.reshape(many, -1).argmax(axis=1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            feature[first : first + many] = np.where(split, best // bins, 0)
            threshold[first : first + many] = np.where(split, cuts[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        value = -rate * np.bincount(at, grad, minlength=leaves) / (np.bincount(at, hess, minlength=leaves) + l2)
        raw += value[at]
        trees.append((feature, threshold, value))
    f, t, v = (np.stack(part) for part in zip(*trees, strict=True))
    return FlatTrees(base, f, t, v)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> FlatTrees:
    """Trees grown on at most ``max_rows`` labelled documents outside the held-out fold.

    Statistics are computed on the executors; the driver gets these numbers
    (``max_rows`` times 26), sorted by id so that a rerun grows the same trees.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def statistics(text: pd.Series) -> pd.Series:
        return pd.Series(list(document_statistics(text)))

    chosen = labelled(docs, labels, label, max_rows)
    rows = chosen.select("doc_id", "y", statistics("text").alias("x")).limit(max_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return grow_trees(x, np.array([r.y for r in rows], dtype=np.float64))


def quality_score(text: Column, model: FlatTrees) -> Column:
    """Probability that a text is of label 1."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(document_statistics(texts)))

    return score(text)
