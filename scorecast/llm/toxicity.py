"""Toxicity: a linear-chain conditional random field over words.

Labelled documents give labelled tokens: words, and word stems, that are
found far more often in toxic documents than in clean ones mark their tokens
in toxic documents as toxic; all other tokens are clean. On these sequences a
two-label chain is fitted whose features are the hashed word, its prefixes,
endings and shape. Forward-backward marginals give each token's probability;
its largest value and the sum of squares over a document give the document's score,
calibrated on the fitted documents, and runs of likely tokens give the
offending offsets (in code points).

A null text counts as empty; a text without words has the score of a
document without any toxic token. Equal texts get equal scores. Without
labelled rows of both kinds every score is 0. Other columns are left alone.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from scorecast.llm.common import labelled, sigmoid

MAX_LEXICON_ROWS = 3_000
"""Labelled documents of each kind that token labels are derived from, at most."""
MAX_FIT_ROWS = 600
"""Documents of each kind that the chain is fitted on, at most; the first of those above."""
FEATURE_BITS = 18
STEMS = (4, 5, 6)
MIN_EVIDENCE, MIN_RATIO = 36.0, 12.0
"""A lexicon entry's likelihood ratio statistic, and how much likelier it is in a toxic document, at least."""
CACHED_WORDS = 200_000
SPAN_PROBABILITY = 0.5
_EDGES = ".,;:!?\"'()[]{}<>*#$%&-_|"


def normal(word: str) -> str:
    return word.lower().strip(_EDGES)


def stems(word: str) -> list[str]:
    """The word and its beginnings, as lexicon entries."""
    return [f"{word}$", *(word[:n] for n in STEMS if len(word) >= n)]


def features(word: str) -> list[int]:
    """Hashed features of a normalised word."""
    marks = [f"w={word}", *(f"p{n}={word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n), f"s={word[-3:]}", f"n={min(len(word), 12)}", "bias"]
    return [crc32(m.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1) for m in marks]


class Emissions(dict):
    """Score of label 1 over label 0 for each word as it stands in a text; frequent words are remembered."""

    def __init__(self, weights: array):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        weights = self.weights
        value = sum([weights[f] for f in features(normal(word))])
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


@dataclass
class Chain:
    """Weights of a two-label chain by hashed feature, and of the document score."""

    weights: array
    start: np.ndarray
    step: np.ndarray
    document: np.ndarray

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "start": self.start, "step": self.step, "document": self.document}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def __post_init__(self) -> None:
        self.emissions = Emissions(self.weights)

    def token_probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The marginal of label 1 for each word of each text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        known = self.emissions
        scores = np.array([known[w] for t in texts for w in t], dtype=np.float64)
        begins = np.zeros(len(scores), dtype=bool)
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return np.split(marginals(scores, begins, self.start, self.step)[0], np.cumsum(sizes)[:-1])

    def document_score(self, probabilities: np.ndarray) -> float:
        return float(sigmoid(self.document @ document_features(probabilities)))


def document_features(probabilities: np.ndarray) -> np.ndarray:
    if not len(probabilities):
        return np.array([1.0, 0.0, 0.0])
    return np.array([1.0, probabilities.max(), np.log1p((probabilities**2).sum())])


def marginals(scores: np.ndarray, begins: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of label 1 at each token, expected number of each label pair), for sequences laid end to end.

    A token is a 2 x 2 matrix: the potentials of its label given the one
    before, or at a sequence's beginning those of the start whatever came
    before. The tokens form lanes of equal length: first every lane's product
    is taken, all lanes side by side, then the lanes are chained, then each
    lane is walked from both ends. The result is exact.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    matrices = np.empty((n, 2, 2))
    matrices[:] = np.exp(step)
    matrices[begins] = np.exp(start)
    grow = np.exp(np.clip(scores, -30, 30))
    matrices[:, :, 1] *= grow[:, None]
    matrices /= matrices.max(axis=(1, 2), keepdims=True)
    length = int(np.ceil(np.sqrt(n)))
    lanes = -(-n // length)
    padded = np.empty((lanes * length, 2, 2))
    padded[:n], padded[n:] = matrices, np.eye(2)
    del matrices  # whole copies of the tokens are let go as soon as they are not needed
    steps = np.ascontiguousarray(padded.reshape(lanes, length, 2, 2).transpose(1, 2, 3, 0))  # position, from, to, lane
    del padded

    product = np.zeros((2, 2, lanes))
    product[0, 0] = product[1, 1] = 1.0
    for m in steps:
        product = product[:, 0, None] * m[None, 0] + product[:, 1, None] * m[None, 1]
        product /= product.max(axis=(0, 1))
    forward, backward = np.empty((2, lanes)), np.empty((2, lanes))
    v = np.array([1.0, 1.0])
    for lane in range(lanes):
        forward[:, lane] = v
        v = v @ product[:, :, lane]
        v /= v.sum()
    v = np.array([1.0, 1.0])
    for lane in range(lanes - 1, -1, -1):
        backward[:, lane] = v
        v = product[:, :, lane] @ v
        v /= v.sum()
    before = np.empty((length, 2, lanes))
    v = forward
    for k, m in enumerate(steps):
        before[k] = v
        v = v[0] * m[0] + v[1] * m[1]
        v /= v.sum(axis=0)
    behind = np.empty((length, 2, lanes))
    v = backward
    for k in range(length - 1, -1, -1):
        behind[k] = v
        v = steps[k][:, 0] * v[0] + steps[k][:, 1] * v[1]
        v /= v.sum(axis=0)
    pairs = steps
    pairs *= before[:, :, None]
    pairs *= behind[:, None]
    del before, behind
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    flat = pairs.transpose(3, 0, 1, 2).reshape(-1, 2, 2)[:n]
    return flat[:, :, 1].sum(axis=1), flat[~begins].sum(axis=0)


def fit_chain(texts: list[list[str]], token_labels: list[np.ndarray], toxic: np.ndarray, rounds: int = 40, l2: float = 1e-4) -> Chain:
    """Fit by gradient steps with a rate for each weight; then the document score on the marginals."""
    if not len(texts) or toxic.min() == toxic.max():
        return Chain(array("d", bytes(8 << FEATURE_BITS)), np.zeros((2, 2)), np.zeros((2, 2)), np.array([-60.0, 0.0, 0.0]))
    words: dict[str, int] = {}
    ids = np.array([words.setdefault(normal(w), len(words)) for t in texts for w in t], dtype=np.int64)
    marks = [features(w) for w in words]
    owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    flat = np.array([f for m in marks for f in m], dtype=np.int64)
    used, column = np.unique(flat, return_inverse=True)
    y = np.concatenate(token_labels).astype(np.float64)
    sizes = np.array([len(t) for t in texts])
    begins = np.zeros(len(ids), dtype=bool)
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    seen_pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~begins)
    np.add.at(seen_pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1.0)
    weights, start, step = np.zeros(len(used)), np.zeros((2, 2)), np.zeros((2, 2))
    weights[np.searchsorted(used, features("")[-1])] = -2.0  # bias
    squares, step_squares = np.full(len(used), 1e-8), np.full((2, 2), 1e-8)
    n = max(1.0, y.sum())
    for _ in range(rounds):
        word_scores = np.bincount(owner, weights[column], minlength=len(words))
        p, pairs = marginals(word_scores[ids], begins, start, step)
        by_word = np.bincount(ids, p - y, minlength=len(words))
        grad = np.bincount(column, by_word[owner], minlength=len(used)) / n + l2 * weights
        squares += grad**2
        weights -= 0.5 * grad / np.sqrt(squares)
        step_grad = (pairs - seen_pairs) / n + l2 * step
        step_squares += step_grad**2
        step -= 0.1 * step_grad / np.sqrt(step_squares)
    word_scores = np.bincount(owner, weights[column], minlength=len(words))
    p, _ = marginals(word_scores[ids], begins, start, step)
    x = np.stack([document_features(q) for q in np.split(p, np.cumsum(sizes)[:-1])])
    every = np.zeros(1 << FEATURE_BITS)
    every[used] = weights
    return Chain(array("d", every.tobytes()), start, step, _logistic(x, toxic.astype(np.float64)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Weights of a small logistic regression, by Newton steps; both labels weigh the same."""
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        grad = x.T @ (share * (p - y)) + l2 * w
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), grad)
    return w


def _telling(counted: DataFrame, toxic_docs: int, clean_docs: int) -> DataFrame:
    """Entries whose counts in toxic and clean documents differ by far more than chance."""
    toxic, clean = F.col("toxic"), F.col("clean")
    share, n = toxic_docs / (toxic_docs + clean_docs), toxic + clean
    surprise = toxic * F.log(toxic / (n * share)) + F.when(clean > 0, clean * F.log(clean / (n * (1 - share)))).otherwise(0.0)
    ratio = ((toxic + 0.5) / (toxic_docs + 1)) / ((clean + 0.5) / (clean_docs + 1))
    return counted.where((toxic > 0) & (ratio >= MIN_RATIO) & (2 * surprise >= MIN_EVIDENCE)).select("entry")


def lexicon(docs: DataFrame, toxic_docs: int, clean_docs: int) -> frozenset[str]:
    """Entries far more frequent in toxic documents, from rows of (text, y).

    Documents are counted once per entry first. What passes is counted again
    by context (the words before and behind), so that copies of one document,
    exact or near, do not vote for its chance words more than once.
    """
    if not toxic_docs or not clean_docs:
        return frozenset()

    @F.pandas_udf(ArrayType(StringType()))
    def entries(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for w in {normal(w) for w in (t or "").split()} if w for s in stems(w)}) for t in texts], dtype=object)

    votes = [F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")]
    counted = docs.select("y", F.explode(entries("text")).alias("entry")).groupBy("entry").agg(*votes)
    likely = frozenset(r["entry"] for r in _telling(counted, toxic_docs, clean_docs).collect())

    @F.pandas_udf(ArrayType(StringType()))
    def contexts(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = ["", *(normal(w) for w in (text or "").split()), ""]
            hits = ((k, s) for k in range(1, len(words) - 1) for s in stems(words[k]) if s in likely)
            out.append(sorted({f"{s}\n{words[k - 1]}\n{words[k + 1]}" for k, s in hits}))
        return pd.Series(out, dtype=object)

    seen = docs.select("y", F.explode(contexts("text")).alias("context")).distinct()
    by_context = seen.groupBy(F.substring_index("context", "\n", 1).alias("entry")).agg(*votes)
    return frozenset(r["entry"] for r in _telling(by_context, toxic_docs, clean_docs).collect())


def label_tokens(words: list[str], toxic: int, entries: frozenset[str]) -> np.ndarray:
    """1 for the tokens of a toxic document whose word or stem is an entry."""
    if not toxic:
        return np.zeros(len(words), dtype=np.int8)
    return np.array([any(s in entries for s in stems(normal(w))) if normal(w) else False for w in words], dtype=np.int8)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Chain:
    """A chain fitted on a bounded sample of labelled documents outside the held-out fold."""
    parts = [labelled(docs, labels, label, MAX_LEXICON_ROWS, wanted) for wanted in (1, 0)]
    sample = parts[0].union(parts[1]).select("doc_id", "y", "text").persist()
    try:
        sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        entries = lexicon(sample, sizes.get(1, 0), sizes.get(0, 0))
        order = ["y", F.xxhash64("doc_id"), "doc_id", "text"]
        rows = [r for y in (1, 0) for r in sample.where(F.col("y") == y).orderBy(*order).limit(MAX_FIT_ROWS).collect()]
    finally:
        sample.unpersist()
    texts = [(r["text"] or "").split() for r in rows]
    toxic = np.array([r["y"] for r in rows])
    return fit_chain(texts, [label_tokens(t, y, entries) for t, y in zip(texts, toxic, strict=True)], toxic)


_WORD = re.compile(r"\S+")


def spans(text: str, probabilities: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, largest probability) of each run of offending words."""
    out: list[tuple[int, int, float]] = []
    bad = np.flatnonzero(probabilities >= SPAN_PROBABILITY)
    if not len(bad):
        return out
    places = [m.span() for m in _WORD.finditer(text)]
    for run in np.split(bad, np.flatnonzero(np.diff(bad) > 1) + 1):
        out.append((places[run[0]][0], places[run[-1]][1], float(probabilities[run].max())))
    return out


_RESULT = StructType(
    [
        StructField("score", DoubleType()),
        StructField(
            "spans",
            ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("probability", DoubleType())])),
        ),
    ]
)


def toxicity(text: Column, chain: Chain) -> Column:
    """A struct of the score of a text and its offending spans."""

    @F.pandas_udf(_RESULT)
    def tagged(texts: pd.Series) -> pd.DataFrame:
        scores: list[float] = []
        found: list[list[dict]] = []
        values = ["" if t is None else t for t in texts]
        for part in _parts(values):
            words = [t.split() for t in part]
            for t, p in zip(part, chain.token_probabilities(words), strict=True):
                scores.append(chain.document_score(p))
                found.append([{"start": a, "end": b, "probability": q} for a, b, q in spans(t, p)])
        return pd.DataFrame({"score": np.array(scores, dtype=np.float64), "spans": pd.Series(found, dtype=object)})

    return tagged(text)


def _parts(texts: list[str], chars: int = 500_000) -> list[list[str]]:
    """Consecutive texts of about so many characters together, which bounds what the marginals hold."""
    out: list[list[str]] = [[]]
    held = 0
    for text in texts:
        if held and held + len(text) > chars:
            out.append([])
            held = 0
        out[-1].append(text)
        held += len(text)
    return out if texts else []
