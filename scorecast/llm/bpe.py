"""BPE encoding and decoding with a given vocabulary; long texts are encoded in parallel pieces.

``encode`` gives the ids that the tokenizers library gives for the whole
text, ``decode`` its decoded text. The vocabulary's white space is a hard
border: words between blanks are encoded one by one, and a cache keeps the
ids of frequent words. Plain words (printable ASCII and precomposed Latin
letters, which normalisation leaves alone) are put in lower case and split
here, and only the merges are left to the library; other words go through all
of it.

A text longer than ``PIECE_CHARS`` is cut into pieces that different tasks
encode. A cut is made at a blank where there is one; then nothing needs to be
joined. Text without blanks is cut inside a run of letters or marks, and the
pieces are put together as a tree: of two halves the last and first tokens are
encoded again in a window around the join, which grows until its first token
is the left half's and its last token is the right half's. Every pair of
neighbouring tokens is then one that the merges give, so the ids are those of
the whole.

Defined results: a null text is empty and has no ids; null ids decode to an
empty text. Ids unknown to the vocabulary are skipped in decoding. Repeated
rows are encoded each. Other columns are kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scorecast.llm.common import fresh, key_runs
from scorecast.sources.store import save

if TYPE_CHECKING:
    from tokenizers import Tokenizer

PIECE_CHARS = 65_536
CACHED_WORDS = 250_000
CACHED_CHARS = 48
OUT_ROWS = 256
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
"""The vocabulary's own pattern for words of such characters in lower case (fixed)."""
_MARGIN = 8
WINDOW = 8


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies use for bytes that do not print."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """The library's tokenizer for words, and its merges alone for parts of words."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.path = path
        spec = self._spec()
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.specials = {t["content"] for t in spec["added_tokens"]}
        self.tokens = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())]
        self.special_ids = {t["id"] for t in spec["added_tokens"]}
        self.ends_word = np.array([t.endswith(self.suffix) for t in self.tokens])
        self.ends_word[list(self.special_ids)] = True
        self.many = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.cache: dict[str, bytes] = {}
        self.cached_words = cached_words

    def _spec(self) -> dict:
        with open(self.path, encoding="utf-8") as file:
            return json.load(file) | {"truncation": None, "padding": None}

    def _bare(self, suffix: str | None) -> Tokenizer:
        """The merges alone; built only where texts are joined, since each tokenizer takes memory."""
        from tokenizers import Tokenizer

        spec = self._spec() | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        return Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"end_of_word_suffix": suffix}}))

    @cached_property
    def outer(self) -> Tokenizer:
        return self._bare(self.suffix)

    @cached_property
    def inner(self) -> Tokenizer:
        return self._bare(None)

    def _merge_words(self, words: list[str]) -> None:
        """Cache the ids of parts of plain words, which need only the merges; one call for all of them."""
        letters = [w.encode().decode("latin-1").translate(_BYTE_LETTERS) for w in words]
        ids = np.array(self.many.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype=np.int32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        start = 0
        for word, stop in zip(words, stops.tolist(), strict=True):
            self.cache[word] = ids[start:stop].tobytes()
            start = stop

    def _learn(self, words: list[str]) -> None:
        cache, split, parts, other = self.cache, {}, {}, []
        for word in words:
            if _PLAIN.fullmatch(word) and "<|" not in word:
                split[word] = own = _PARTS.findall(word.lower())
                parts.update((p, None) for p in own if p not in cache)
            else:
                other.append(word)
        new = list(parts)
        for start in range(0, len(new), 4096):
            self._merge_words(new[start : start + 4096])
        for word, own in split.items():
            cache[word] = b"".join([cache[p] for p in own])
        for start in range(0, len(other), 1024):
            part = other[start : start + 1024]
            for word, encoding in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[word] = np.array(encoding.ids, dtype=np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words = [text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        cache = self.cache
        new = set().union(*words).difference(cache)
        self._learn(list(new))
        out = [np.frombuffer(b"".join(map(cache.__getitem__, doc)), dtype=np.int32) for doc in words]
        for word in new:
            if len(word) > CACHED_CHARS:
                del cache[word]
        if len(cache) > self.cached_words:  # words that come first are frequent ones
            for word in list(cache)[self.cached_words // 2 :]:
                del cache[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids.tolist() if 0 <= i < len(self.tokens)])

    def merges(self, ids: np.ndarray, ends: bool) -> np.ndarray:
        """Encode the text of ``ids``, parts of one word, again; ``ends``: the word ends here."""
        text = "".join([self.tokens[i].removesuffix(self.suffix) for i in ids.tolist()])
        return np.array((self.outer if ends else self.inner).encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two halves of a text that was cut inside a word.

        A half's last token may carry the end of a word that goes on behind
        it; the window always includes it.
        """
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        ends = np.flatnonzero(self.ends_word[left[:-1]])
        start = int(ends[-1]) + 1 if len(ends) else 0  # of the word that was cut, in the left half
        word_end = np.flatnonzero(self.ends_word[right])
        stop = int(word_end[0]) + 1 if len(word_end) else len(right)
        size = WINDOW
        while True:
            a, b = max(start, len(left) - size), min(stop, size)
            closed = b == stop and len(word_end) > 0
            window = self.merges(np.concatenate([left[a:], right[:b]]), closed)
            ok_left = a == start or (len(left) - a > 1 and window[0] == left[a])
            ok_right = b == stop or (window[-1] == right[b - 1])
            if ok_left and ok_right:
                return np.concatenate([left[:a], window, right[b:]])
            size *= 2


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path)


_LETTERS, _MARKS = regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}\p{M}\p{C}]+")
_BLANK = re.compile(r"[ \t\r\n]")


def _inside_word(text: str, at: int) -> bool:
    """Whether both sides of ``at`` belong to one run of letters or of marks, far enough from anything else.

    The characters around it must not change or combine under normalisation.
    """
    around = text[max(0, at - _MARGIN) : at + _MARGIN]
    if len(around) < 2 * _MARGIN or not (_LETTERS.fullmatch(around) or _MARKS.fullmatch(around)):
        return False
    steady = all(not unicodedata.combining(c) and not "ᄀ" <= c <= "ᇿ" and not "ꥠ" <= c <= "퟿" for c in around)
    return steady and unicodedata.is_normalized("NFC", around) and "|" not in around


def cut_points(text: str, piece_chars: int = PIECE_CHARS) -> list[tuple[int, bool]]:
    """(place, inside a word) of the cuts of a text, ascending: a range is halved until its parts are short enough.

    A half begins at the blank nearest to the middle, in the middle half of
    the range; without one, at the nearest place inside a word where the
    pieces can be joined. A range without any such place stays whole.
    """
    cuts: list[tuple[int, bool]] = []
    todo = [(0, len(text))]
    while todo:
        start, stop = todo.pop()
        if stop - start <= piece_chars:
            continue
        middle, reach = (start + stop) // 2, (stop - start) // 4
        before = max(text.rfind(c, middle - reach, middle) for c in " \n\t\r")
        found = _BLANK.search(text, middle, middle + reach)
        if before >= 0 or found:
            after = found.start() if found else stop
            at, inside = (before, False) if before >= 0 and middle - before <= after - middle else (after, False)
        else:
            near = (middle + sign * d for d in range(reach) for sign in (1, -1))
            at, inside = next(((p, True) for p in near if _inside_word(text, p)), (0, False))
            if not at:
                continue
        cuts.append((at, inside))
        todo += [(start, at), (at, stop)]
    return sorted(cuts)


_IDS = ArrayType(IntegerType())


def _encoded(batches: Iterator[pa.RecordBatch], text: str, ids: str, path: str, decoded: str | None) -> Iterator[pa.RecordBatch]:
    """The rows with a column of ids, and what they decode to if asked for, in small batches: ids are as large as texts."""
    tool = encoder(path)
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(start, OUT_ROWS)
            found = tool.encode_all(["" if t is None else t for t in part.column(text).to_pylist()])
            part = part.append_column(ids, _lists(found))
            yield part if decoded is None else part.append_column(decoded, pa.array([tool.decode(f) for f in found], pa.string()))
    pa.default_memory_pool().release_unused()  # the worker is used again


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32), pa.int32()))


def _with_ids(df: DataFrame, text: str, ids: str, path: str, decoded: str | None = None) -> DataFrame:
    added = [StructField(ids, _IDS), *([StructField(decoded, StringType())] if decoded else [])]
    return df.mapInArrow(lambda batches: _encoded(batches, text, ids, path, decoded), StructType([*df.schema.fields, *added]))


def _cut(batches: Iterator[pa.RecordBatch], piece_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cuts = cut_points(text, piece_chars)
            starts, stops = [0, *(at for at, _ in cuts)], [*(at for at, _ in cuts), len(text)]
            joined = [False, *(inside for _, inside in cuts)]
            for k, (start, stop) in enumerate(zip(starts, stops, strict=True)):
                arrays = [pa.array([v]) for v in (row, k, joined[k], text[start:stop])]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "piece", "joined", "part"])


def join_pieces(tool: Encoder, pieces: list[np.ndarray], joined: list[bool]) -> np.ndarray:
    """Put pieces together pair by pair, as a tree; ``joined`` says whether a piece begins inside a word."""
    items = [(ids, flag) for ids, flag in zip(pieces, joined, strict=True)]
    while len(items) > 1:
        pairs = []
        for k in range(0, len(items) - 1, 2):
            (left, flag), (right, inside) = items[k], items[k + 1]
            pairs.append((tool.join(left, right) if inside else np.concatenate([left, right]), flag))
        items = pairs + items[len(items) - len(items) % 2 :]
    return items[0][0]


def _joined(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tool = encoder(path)
    for rows in key_runs(batches, ["row"]):
        pieces = [np.frombuffer(b, dtype=np.int32) for b in (np.asarray(v, dtype=np.int32).tobytes() for v in rows.column("ids").to_pylist())]
        ids = join_pieces(tool, pieces, rows.column("joined").to_pylist())
        yield pa.RecordBatch.from_arrays([rows.column("row").combine_chunks()[:1], pa.array([ids], pa.list_(pa.int32()))], names=["row", "ids"])


def encode(docs: DataFrame, path: str, ids: str = "ids", piece_chars: int = PIECE_CHARS, decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of its column ``text``.

    ``decoded`` names one more column, the text that the ids decode to. It is
    made where the ids are, so that a task needs one Python worker; ``decode``
    after ``encode`` in one stage needs two, with a vocabulary each. Columns of
    ``docs`` that have these names are replaced. Rows may come in any order and
    from any plan: long texts are stored once, with a number each.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))
    names = [f"`{c}`" for c in docs.columns]
    is_long = F.char_length(F.coalesce("text", F.lit(""))) > piece_chars
    short = _with_ids(docs.where(~is_long), "text", ids, path, decoded)
    row, found = fresh(docs, "row"), fresh(docs, "found")
    # Stored, so that the pieces and the rows they return to carry the same numbers.
    long = save(docs.where(is_long).withColumn(row, F.monotonically_increasing_id()), "bpe-long")
    pieces = long.select(row, "text").mapInArrow(lambda b: _cut(b, piece_chars), "row long, piece long, joined boolean, part string")
    encoded = _with_ids(pieces.repartition("row", "piece"), "part", "ids", path).drop("part")
    whole = encoded.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(lambda b: _joined(b, path), "row long, ids array<int>")
    right = whole.select(F.col("row").alias(f"{row}_right"), F.col("ids").alias(found))
    both = long.join(right, long[row] == right[f"{row}_right"]).select(*names, F.col(found).alias(ids))
    return short.union(decode(both, path, ids, decoded) if decoded else both)


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, text: str, path: str) -> Iterator[pa.RecordBatch]:
    tool = encoder(path)
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(start, OUT_ROWS)
            rows = (v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, dtype=np.int32) for v in part.column(ids))
            yield part.append_column(text, pa.array([tool.decode(r) for r in rows], pa.string()))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library decodes from each row's ids."""
    schema = StructType([*encoded.schema.fields, StructField(text, StringType())])
    return encoded.mapInArrow(lambda batches: _decoded(batches, ids, text, path), schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by a blank."""
    return F.array_join(ids.cast("array<string>"), " ")
