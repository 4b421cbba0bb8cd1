"""Line dedup: range-partitioned line hashes, first occurrences, compressed bitmaps of the lines to keep.

A document is split at newlines. A line's key is the line without ASCII
white space at both ends and with A-Z in lower case. Lines whose key is long
enough and is found in two documents or more stay only in the smallest
doc_id that holds it (all its lines there, repeats included).

Only 128-bit hashes of keys move, range-partitioned by (hash, document,
position), so that a line found in a third of all documents is spread over
many tasks. Each task streams its rows once: the first document of a key
keeps it. A key that begins before a task's first row is settled afterwards
from one row per task. The result is one bitmap per document that loses
lines, not text.

Defined results: a null or empty text is one empty line. Rows without doc_id
keep their lines and cost no other document any. Rows that repeat a doc_id
count as one document, each with its own lines. Other columns are kept.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from scorecast.llm.common import fresh
from scorecast.sources.store import save

MIN_CHARS = 10
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_hash(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row_hash, n_lines, pos) of every line that can be a duplicate."""
    lines = docs.where("doc_id is not null").select("doc_id", _row_hash(F.col("text")).alias("row_hash"), _lines(F.col("text")).alias("lines"))
    each = lines.select("doc_id", "row_hash", F.size("lines").alias("n_lines"), F.posexplode(F.transform("lines", line_key)).alias("pos", "key"))
    return each.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second hash"), "key").alias("h2"), "doc_id", "row_hash", "n_lines", "pos"
    )


_STREAMED = "kind int, h1 long, h2 long, doc_id long, row_hash long, n_lines int, pos int"
_DROP, _OPEN, _FIRST = 0, 1, 2


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a task's sorted rows; state is one key and its first document.

    Lines to drop come out with kind 0. Lines of the task's first key, which
    may have begun in an earlier task, come out with kind 1; the first
    documents of the task's first and last key with kind 2.
    """
    head = last = None  # last: (h1, h2, first document) of the key that is being read
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row_hash, n_lines, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        starts = np.ones(len(h1), dtype=bool)
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if head is None:
            head = (h1[0], h2[0], doc[0])
        starts[0] = last is None or (h1[0], h2[0]) != last[:2]
        at = np.maximum.accumulate(np.where(starts, np.arange(len(h1)), -1))
        first = np.where(at >= 0, doc[at], last[2] if last else 0)
        last = (h1[-1], h2[-1], first[-1])
        is_open = (h1 == head[0]) & (h2 == head[1])
        out = np.flatnonzero(is_open | (doc != first))
        kind = np.where(is_open[out], _OPEN, _DROP)
        yield _streamed(kind, h1[out], h2[out], doc[out], row_hash[out], n_lines[out], pos[out])
    if head is not None:
        ends = [head] if last[:2] == head[:2] else [head, last]
        zero = np.zeros(len(ends), dtype=np.int64)
        yield _streamed(zero + _FIRST, *(np.array(c, dtype=np.int64) for c in zip(*ends, strict=True)), zero, zero, zero)


def _streamed(*columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in _STREAMED.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in _STREAMED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=names)


@F.pandas_udf(BinaryType())
def _pack(dropped: pd.Series, n_lines: pd.Series) -> pd.Series:
    def pack(at: np.ndarray, n: int) -> bytes:
        keep = np.ones(n, dtype=bool)
        keep[at] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([pack(np.asarray(a), int(n)) for a, n in zip(dropped, n_lines, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, n_dropped, bitmap) of every document that loses lines; a set bit keeps its line."""
    order = ("h1", "h2", "doc_id", "pos")
    ordered = keyed_lines(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = save(ordered.mapInArrow(first_occurrences, _STREAMED), "line-firsts")
    firsts = streamed.where(F.col("kind") == _FIRST).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    # At most two rows from each task of the sort.
    settled = streamed.where(F.col("kind") == _OPEN).join(F.broadcast(firsts), ["h1", "h2"]).where("doc_id <> first_doc")
    columns = ("doc_id", "row_hash", "n_lines", "pos")
    dropped = streamed.where(F.col("kind") == _DROP).select(*columns).union(settled.select(*columns))
    lines = dropped.groupBy("doc_id", "row_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))
    return lines.select("doc_id", "row_hash", F.size("pos").alias("n_dropped"), _pack("pos", "n_lines").alias("bitmap"))


@F.pandas_udf(StringType())
def _kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    def kept(text: str | None, bitmap: bytes | None) -> str | None:
        if text is None or bitmap is None:
            return None
        lines = text.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
        return "\n".join([lines[i] for i in np.flatnonzero(bits)])

    return pd.Series([kept(t, b) for t, b in zip(texts, bitmaps, strict=True)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, kept: str = "kept_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the text that stays and the numbers of lines before and dropped."""
    row, doc = fresh(docs, "row_hash"), fresh(docs, "bitmap_doc")
    dropped, bits = fresh(docs, "bitmap_dropped"), fresh(docs, "bitmap")
    right = bitmaps.select(F.col("doc_id").alias(doc), F.col("row_hash").alias(f"{row}_right"), F.col("n_dropped").alias(dropped), F.col("bitmap").alias(bits))
    left = docs.withColumn(row, _row_hash(docs["text"]))
    joined = left.join(right, (left["doc_id"] == right[doc]) & (left[row] == right[f"{row}_right"]), "left")
    whole = F.coalesce(F.col("text"), F.lit(""))
    # Only texts that lose lines travel to Python.
    cut = _kept(F.when(F.col(bits).isNotNull(), whole), F.col(bits))
    return joined.select(
        *[f"`{c}`" for c in docs.columns],
        F.coalesce(cut, whole).alias(kept),
        (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(n_lines),
        F.coalesce(F.col(dropped), F.lit(0)).cast("long").alias(n_dropped),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, **names: str) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars), **names)
