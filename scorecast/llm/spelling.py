"""Spelling variants: words one edit apart, found through a reduced alphabet, and the form each one stands for.

Every letter is hashed to one of ``SYMBOLS`` symbols. A word's reduced word
has the same length over this small alphabet, so words one edit apart have
reduced words at most one edit apart. All reduced words within one edit
(replaced, removed and added symbols, and the word itself) are generated as
rolling hashes, joined with the reduced vocabulary, and the pairs found are
verified on the original words. A filter of fixed size over the reduced
vocabulary drops most generated hashes before they are shuffled.

Tables that grow with the vocabulary are merged and never broadcast: Spark
would size them by compressed files, and generated rows like those they come from.

The form of a word is its near word of largest count, if that is at least
``RATIO`` times the word's own count; counts grow by that factor along a
chain of forms, so that few doublings lead to its last word, the root.

Defined results: words are maximal runs of ``RUN``, A-Z in lower case; a null
text has none. A null doc_id counts as an empty one where marked letters are
removed. Rows count as often as they are repeated. Words of any length are
compared whole. Of near words with equal counts the smallest in code-point
order is the form. Other columns are left alone; an empty table has no words.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm.hash_filter import hash_filter, may_hold
from scorecast.sources.store import save

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
MARK = 199
SYMBOLS = 8
_HELD = 150_000
_CELLS = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
# Letters are the code points A-Z, a-z and U+00C0 to U+00FF; in Latin-1 each is one byte. All other bytes become spaces.
_LETTERS = bytes(b if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    """The maximal runs of letters in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def without_marked_letter(word: bytes, doc_id: str, mark: int) -> bytes:
    """``word`` without one letter, if ``mark`` divides the crc32 of id and word."""
    seen = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(seen, zlib.crc32(f"{doc_id}:".encode()))
    if h % mark:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, mark: int | None = MARK, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``least_letters`` code points that occur ``least_count`` times.

    With ``mark``, a letter of about one in ``mark`` words of a document is removed first. Each
    task adds up words and sends partial counts, which Spark sums once before and once after the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Counter(w for w in words_of(text.as_py() or "") if len(w) >= least_letters)
                if mark is None:
                    held.update(words)
                else:
                    for word, n in words.items():
                        kept = without_marked_letter(word, doc_id, mark)
                        if len(kept) >= least_letters:
                            held[kept] += n
                if len(held) >= _HELD:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# Reduced words.


def reduced(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols 1 to ``symbols`` of words of one length, a row each."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(len(words), -1)
    return (((letters + np.uint64(1)) * _BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    powers = np.ones(n + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=powers[1:])
    return powers


def _mixed(rolling: np.ndarray, length: int) -> np.ndarray:
    mixed = rolling + np.uint64(int(_LENGTH) * length & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _LENGTH
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def own_hashes(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of symbols: a polynomial in ``_BASE`` mod 2^64, mixed with the length."""
    length = rows.shape[1]
    return _mixed((rows * _powers(length)[:length][::-1]).sum(axis=1, dtype=np.uint64), length)


def neighbourhood(rows: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """For each row the hashes of all rows of symbols within one edit of it, itself included; repeats remain."""
    m, length = rows.shape
    powers = _powers(length + 1)
    low = powers[:length][::-1]  # the weight of each place
    before = np.zeros((m, length + 1), dtype=np.uint64)  # place by place: what stands before it, as if it ended there
    for i in range(length):
        before[:, i + 1] = before[:, i] * _BASE + rows[:, i]
    weighted = rows * low
    after = np.zeros((m, length + 1), dtype=np.uint64)
    after[:, :length] = np.cumsum(weighted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    places = np.arange(length)
    removed = before[:, :-1] * low + after[:, 1:]
    replaced = (before[:, :-1] * powers[length - places] + after[:, 1:])[:, :, None] + low[None, :, None] * every
    gaps = np.arange(length + 1)
    added = (before * powers[length + 1 - gaps] + after)[:, :, None] + powers[length - gaps][None, :, None] * every
    parts = [_mixed(removed, length - 1), _mixed(replaced.reshape(m, -1), length), _mixed(added.reshape(m, -1), length + 1)]
    return np.concatenate(parts, axis=1)  # replacing a symbol by itself gives the word itself


def _merged(side: DataFrame) -> DataFrame:
    """``side`` of a join that sorts and merges, whatever size Spark thinks it has."""
    return side.hint("merge")


def _by_length(batch: pa.RecordBatch, cells: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words of equal length, at most ``cells`` letters together or one word."""
    words = batch.column("word").to_pylist()
    groups = defaultdict(list)
    for k, word in enumerate(words):
        groups[len(word)].append(k)
    for length, places in groups.items():
        step = max(1, cells // max(length, 1))
        for start in range(0, len(places), step):
            part = places[start : start + step]
            yield np.array(part), [words[k] for k in part]


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words exactly one edit apart, from distinct words (word, n)."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, dtype=np.int64)
            for places, words in _by_length(batch, _CELLS):
                h[places] = own_hashes(reduced(words, symbols)) if words[0] else 0
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("word"), batch.column("n")], names=["h", "word", "n"])

    known = save(vocabulary.select("word", "n").mapInArrow(reduce, "h long, word string, n long"), "spelling-reduced")
    members = hash_filter(known, "h")

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = members.value
        for batch in batches:
            for places, words in _by_length(batch, _CELLS // (2 * symbols)):
                hashes = np.sort(neighbourhood(reduced(words, symbols), symbols), axis=1)
                kept = may_hold(bitmap, hashes)
                kept[:, 1:] &= hashes[:, 1:] != hashes[:, :-1]
                row, at = np.nonzero(kept)
                taken = batch.take(pa.array(places[row]))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[row, at]), taken.column("word"), taken.column("n")], names=["h", "word", "n"])

    generated = known.where("word <> ''").mapInArrow(generate, "h long, word string, n long")
    met = generated.join(_merged(known.select("h", F.col("word").alias("near"), F.col("n").alias("near_n"))), "h")
    one_edit = (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    return met.where(one_edit).select("word", "n", "near", "near_n")


# Forms and roots.


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the length of chain that is followed."""
    paths = save(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("last"))
        moved = paths.join(_merged(further), "root", "left")
        paths = save(moved.select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "spelling-roots")
        if paths.where("moved").isEmpty():
            return paths.select("word", "root")
        paths = paths.select("word", "root")


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n); other columns stay, renamed inside where they clash."""
    kept = [c for c in vocabulary.columns if c.lower() not in ("word", "n", "form", "root", "n_near", "form_n")]
    words = save(vocabulary.select("word", "n", *kept), "spelling-words")
    near = near_words(words, symbols)
    # The smallest of (-count, word) is the largest count, and of equal ones the smallest word.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = words.select("word", "n").join(_merged(best), "word").select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"), "n")
    reached = F.col("near_n") >= F.lit(ratio) * F.col("n")
    forms = save(chosen.select("word", "n_near", F.when(reached, F.col("near")).alias("form"), F.when(reached, F.col("near_n")).alias("form_n")), "spelling-forms")
    rooted = words.join(_merged(forms), "word", "left").join(_merged(_roots(forms.where("form is not null"))), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n", *kept)


def variants(docs: DataFrame) -> DataFrame:
    """``group_variants`` of the words of ``docs`` (doc_id, text)."""
    return group_variants(word_counts(docs))
