r"""SimHash near-dedup with vantage-point trees.

A text's words (`[^\x20\x09-\x0D]+`, A-Z in lower case) give 3-word shingles,
repeats included; a fingerprint bit is 1 if it is set in over half of their
XXH64 values (seed 42). Fingerprints link at 2 or fewer differing bits.

Distinct fingerprints are dealt to shards by a vantage-point tree: each
inner node holds a fingerprint and a radius, and a fingerprint goes inside
or outside by its Hamming distance to it. By the triangle inequality only
fingerprints within the link distance of the radius can have a partner on
the other side. Those inside are sent to the outer subtree as visitors as
well, so each linked pair meets in exactly one shard, where a tree of its
own finds it. A shard reports a spanning forest of its links, not all pairs.

The upper tree is fitted on a bounded sample of distinct fingerprints
(``MAX_SAMPLE``, those with the smallest hashes), which sets only how evenly
the shards are filled; every fingerprint is compared, and the links are exact.

Defined results: a null text or one without words has fingerprint zero,
linked like any other; with fewer than 3 words the whole sequence is the one
shingle. Rows without doc_id count for links, but name no component unless
all its rows lack one. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scorecast.llm.common import forest, key_runs
from scorecast.llm.components import components
from scorecast.sources.store import save

SHINGLE_WORDS = 3
MAX_BITS = 2
MAX_SAMPLE = 20_000
SHARD_ROWS = 4_096
"""Distinct fingerprints that a shard of the upper tree should hold."""
SAMPLE_PER_SHARD = 8
LEAF_ROWS = 64
_BLOCK = 65_536
_HELD = 1_000_000


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    count, ones = max(1, len(words) - SHINGLE_WORDS + 1), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        hashes = [digest(b" ".join(words), 42)]
        ones += np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8), bitorder="little")
    else:
        for start in range(0, count, _BLOCK):
            part = words[start : start + _BLOCK + SHINGLE_WORDS - 1]
            hashes = [digest(shingle, 42) for shingle in map(b"%b %b %b".__mod__, zip(part, part[1:], part[2:], strict=False))]
            bits = np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def simhash(text: Column) -> Column:
    """The fingerprint as a signed bigint; ``hex_digits`` shows it."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def hex_digits(fingerprints: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprints), 16, "0"))


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


@dataclass(frozen=True)
class UpperTree:
    """Inner nodes as arrays; a child below zero is the shard -1 - child."""

    point: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    def deal(self, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): where each fingerprint lives and which shards it visits."""
        rows, homes, shards = [], [], []
        root = 0 if len(self.point) else -1
        todo = [(root, np.arange(len(prints)), np.ones(len(prints), dtype=bool))]
        while todo:
            node, row, home = todo.pop()
            if not len(row):
                continue
            if node < 0:
                rows.append(row), homes.append(home), shards.append(np.full(len(row), -1 - node))
                continue
            d = distance(prints[row], self.point[node])
            is_in = d <= self.radius[node]
            # A fingerprint at home visits the outer side only: its partners there do not visit it.
            go_in = is_in | (~home & (d <= self.radius[node] + reach))
            go_out = ~is_in | (d > self.radius[node] - reach)
            todo.append((int(self.inside[node]), row[go_in], home[go_in]))
            todo.append((int(self.outside[node]), row[go_out], (home & ~is_in)[go_out]))
        if not rows:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, empty.astype(bool)
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def _split(prints: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves ``prints`` best, of a few points tried; None if nothing splits them."""
    best = None
    for at in sorted({0, len(prints) // 3, len(prints) // 2, len(prints) - 1}):
        counts = np.bincount(distance(prints, prints[at]), minlength=65).cumsum()
        crossing = counts[:-MAX_BITS] - np.concatenate([np.zeros(MAX_BITS, dtype=np.int64), counts[: -2 * MAX_BITS]])
        balance = np.minimum(counts, len(prints) - counts)[:-MAX_BITS]
        gain = balance - crossing
        radius = int(gain.argmax())
        if balance[radius] and (best is None or gain[radius] > best[0]):
            best = (gain[radius], prints[at], radius)
    return None if best is None else (best[1], best[2])


def grow_upper_tree(sample: np.ndarray, shards: int) -> UpperTree:
    """A tree whose shards hold about equal parts of the sample."""
    point, radius, children = [], [], []
    enough = max(SAMPLE_PER_SHARD, len(sample) / max(1, shards))
    next_shard = 0

    def grow(part: np.ndarray) -> int:
        nonlocal next_shard
        split = _split(part) if len(part) > enough else None
        if split is None:
            next_shard += 1
            return -next_shard
        node = len(point)
        point.append(split[0]), radius.append(split[1]), children.append((0, 0))
        near = distance(part, split[0]) <= split[1]
        children[node] = (grow(part[near]), grow(part[~near]))
        return node

    grow(np.sort(sample))
    ends = np.array(children, dtype=np.int64).reshape(-1, 2)
    return UpperTree(np.array(point, dtype=np.uint64), np.array(radius, dtype=np.int64), ends[:, 0], ends[:, 1])


def linked_roots(prints: np.ndarray, home: np.ndarray, reach: int = MAX_BITS) -> np.ndarray:
    """For each fingerprint of a shard the smallest row number it is connected to; two visitors do not link directly.

    The links found so far are reduced to a forest whenever ``_HELD`` of them have gathered.
    """
    left, right, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    # rows are compared with each other and with the guests
    todo = [(np.arange(len(prints)), np.zeros(0, dtype=np.int64))]
    while todo:
        rows, guests = todo.pop()
        if not len(rows):
            continue
        split = _split(prints[rows]) if len(rows) > LEAF_ROWS else None
        if split is not None:
            d, g = distance(prints[rows], split[0]), distance(prints[guests], split[0])
            near = d <= split[1]
            border = rows[near & (d > split[1] - reach)]
            todo.append((rows[near], guests[g <= split[1] + reach]))
            todo.append((rows[~near], np.concatenate([guests[g > split[1] - reach], border])))
            continue
        everyone = np.concatenate([rows, guests])
        for start in range(0, len(rows), LEAF_ROWS):
            block = rows[start : start + LEAF_ROWS]
            for other in range(0, len(everyone), _BLOCK):
                against = everyone[other : other + _BLOCK]
                i, j = np.nonzero(np.bitwise_count(prints[block][:, None] ^ prints[against][None, :]) <= reach)
                keep = ((other + j >= len(rows)) | (start + i < other + j)) & (home[block[i]] | home[against[j]])
                left.append(block[i[keep]]), right.append(against[j[keep]])
                held += int(keep.sum())
                if held > _HELD:
                    root = forest(len(prints), np.concatenate(left), np.concatenate(right))
                    left, right, held = [np.arange(len(prints))], [root], 0
    return forest(len(prints), np.concatenate(left), np.concatenate(right))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, column ``fp``, that connect what is connected.

    Of a shard's links a spanning forest comes out: every linked fingerprint
    with the smallest one that it is connected to inside the shard.
    """
    total = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(MAX_SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64)
    tree = grow_upper_tree(sample.view(np.uint64), -(-total // SHARD_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, shard, home = tree.deal(values.view(np.uint64), MAX_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(values[row]), pa.array(home)], names=["shard", "fp", "home"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in key_runs(batches, ["shard"]):
            values = shard.column("fp").to_numpy().astype(np.int64)
            order = np.argsort(values, kind="stable")
            values = values[order]
            home = shard.column("home").to_numpy(zero_copy_only=False).astype(bool)[order]
            root = linked_roots(values.view(np.uint64), home)
            linked = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[root[linked]])], names=["a", "b"])

    dealt = prints.mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(within, "a long, b long")


def roots(marked: DataFrame) -> DataFrame:
    """(fp, first_doc, root) of every fingerprint of ``marked`` (doc_id, fp): its smallest doc_id and the fingerprint that names its group."""
    prints = save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-prints")
    found = components(links(prints.select("fp")))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    return save(named, "simhash-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the fingerprint and the smallest doc_id reachable by links."""
    marked = save(docs.select("doc_id", simhash(F.col("text")).alias("fp")), "simhash-docs")
    named = roots(marked)
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = save(named.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")
