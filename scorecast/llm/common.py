"""Small helpers that several operators share: hashing folds, labels, column names, runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the same with leading underscores, such that ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; rows without an id are held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, wanted: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents outside the held-out fold.

    They are those with the smallest hash of the id, so the choice is the
    same in each run. Rows without label or id are left out; if an id has
    several labels, the largest counts. ``wanted`` restricts to one label.
    The join's small side has at most ``max_rows`` rows by construction.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if wanted is not None:
        chosen = chosen.where(F.col("y") == wanted)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def key_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``keys``; the rows of a task must be sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        first = tuple(column[0] for column in columns)
        change[0] = last is not None and first != last
        start = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(column[-1] for column in columns)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is connected to by the links left-right."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
