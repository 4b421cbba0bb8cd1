"""Document fingerprints: MinHash signatures over word shingles, and near duplicates by signature bands.

Words are hashed once; five words in a row make a shingle, whose hash mixes
theirs. ``PERMUTATIONS`` universal hash functions are applied to all shingles
in numpy and their minima are the fingerprint. The share of equal minima of
two fingerprints estimates the Jaccard similarity of their shingle sets.

Near duplicates: fingerprints are cut into bands, as many minima each as the
asked similarity allows without missing more than ``MISS`` of the pairs at it,
and texts with an equal band are a group. Every member is first compared with the group's smallest one.
Groups whose members are then not all connected are compared in full: every
pair of members that are not connected yet, in the first band that both share.
Groups beyond ``BLOCK`` texts or ``BLOCK_BYTES`` of text are cut into
blocks, and each pair of blocks is a group of its own. A group reports links
that connect, never its pairs. A comparison takes the Jaccard similarity of
the whole shingle sets, and copies are compared once. Texts travel compressed
and are hashed where they are compared.

Defined results: A-Z and other letters in lower case; a null text is empty;
a text of fewer than five words is one shingle; texts without words have a
fingerprint of their own, equal among themselves. Rows without doc_id have
no next document: their edited text loses its last half. Rows with equal doc_id are ordered by their texts' hashes.
Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType

from scorecast.llm.common import key_runs
from scorecast.llm.components import components
from scorecast.llm.hash_filter import hash_filter, may_hold
from scorecast.sources.store import release, save

SHINGLE_WORDS = 5
PERMUTATIONS = 128
SIMILARITY = 0.8
MISS = 1e-6  # of a pair exactly at the threshold: at 0.8 it gives 32 bands of 4 minima, which miss 5e-8
BLOCK = 512
BLOCK_BYTES = 6 << 20
_SEED = 7
_BLOCK = 2_048
_RANDOM = np.random.default_rng(_SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)


class WordHashes(dict):
    """Hashes of words, with the most recent ones kept."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()


def shingle_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order, repeats included."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _HASHES
    hashes = np.array([known[w] for w in words], dtype=np.uint64)
    width = min(SHINGLE_WORDS, len(words))
    n = len(hashes) - width + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for place in range(width):
        mixed += (hashes[place : place + n] ^ (hashes[place : place + n] >> np.uint64(29))) * _PLACES[place]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FACTORS[0]
    return mixed ^ (mixed >> np.uint64(31))


def signature(text: str | None) -> np.ndarray:
    """The minima of all hash functions over a text's shingles."""
    shingles = shingle_hashes(text)
    if not len(shingles):
        return EMPTY
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), _BLOCK):
        x = shingles[start : start + _BLOCK] >> np.uint64(32)
        low = np.minimum(low, (_FACTORS[:, None] * x[None, :] + _SHIFTS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _bytes(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u4").tobytes()


def to_hex(fingerprint: np.ndarray) -> str:
    return _bytes(fingerprint).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of equal minima."""
    return float((a == b).mean())


def fingerprint(text: Column) -> Column:
    """The fingerprint as bytes, four for each minimum."""

    @F.pandas_udf(BinaryType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_bytes(signature(t)) for t in texts], dtype=object)

    return of(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))


# Texts on the way.


def packed(text: str) -> bytes:
    return zstandard.compress(text.encode("utf-8", "replace"), 3)


def unpacked(data: bytes) -> str:
    return zstandard.decompress(data).decode()


# Neighbours in the order of ids.


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, turn, doc_id, text, guest): documents in ascending order within buckets of consecutive ids, texts compressed.

    Bucket borders are quantiles of the ids; each is itself an id, the first
    of its bucket. The first document of each bucket is a guest at the end of
    the one before, and the very first at the end of the last, so that each
    document's successor is in its bucket. The text moves once, and only one
    document of each bucket moves twice. At most ``buckets`` ids reach the driver.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    low, ends = known.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 100 * buckets)).first()
    firsts = docs.sparkSession.sparkContext.broadcast(np.unique([x for x in (low, *(ends or [] if buckets > 1 else [])) if x is not None]).astype(np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = firsts.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            bucket = np.searchsorted(borders, ids, side="right") - 1
            guests = np.flatnonzero(borders[bucket] == ids)
            rows = np.concatenate([np.arange(len(ids)), guests])
            texts = pa.array([packed(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([bucket, (bucket[guests] - 1) % len(borders)]), pa.int32()),
                    pa.array(np.arange(len(rows)) >= len(ids)),
                    *(batch.column(c).take(pa.array(rows)) for c in ("doc_id", "turn")),
                    texts.take(pa.array(rows)),
                ],
                names=["bucket", "guest", "doc_id", "turn", "text"],
            )

    spread = known.withColumn("turn", F.xxhash64("text")).mapInArrow(place, "bucket int, guest boolean, doc_id long, turn long, text binary")
    return spread.repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "turn")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, str]]:
    """(doc_id, hash of the text, text, next text) of a task's rows, which are read once; one document is held."""
    held: tuple[int, int, int, str] | None = None  # bucket, doc_id, turn, text
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "turn", "text"))
        for bucket, guest, doc_id, turn, data in zip(*columns, strict=True):
            text = unpacked(data)
            if held is not None and bucket == held[0]:
                yield *held[1:], text
            held = None if guest else (bucket, doc_id, turn, text)


_EDITED = "doc_id long, node long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edit_rows(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in _EDITED.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[kind] for _, kind in fields]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    own: tuple[str, np.ndarray] | None = None
    for doc_id, node, text, following in _with_next(batches):
        mine = own[1] if own is not None and own[0] == text else signature(text)
        edited = edited_text(text, following)
        new, own = signature(edited), (following, signature(following))
        digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        rows.append((doc_id, node, len(text), digest, _bytes(mine), _bytes(new), likeness(mine, new), likeness(mine, own[1])))
        if len(rows) >= 1_000:
            yield _edit_rows(rows)
            rows = []
    if rows:
        yield _edit_rows(rows)


def _edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    buckets = buckets or max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    alone = docs.where("doc_id is null").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    return in_order(docs, buckets).mapInArrow(_compared, _EDITED).union(alone.mapInArrow(_without_next, _EDITED))


def compare_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document, of its edited text and their likeness, and the likeness to the next document's."""
    return _readable(_edits(docs, buckets).drop("node"))


def _readable(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: hex_digits(F.col(c)) for c in rows.columns if c.endswith("fingerprint")})


def _without_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without an id: the edited text loses its last half, and there is no next document to be like."""
    for batch in batches:
        for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True):
            mine, edited = signature(text), edited_text(text, "")
            new = signature(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
            yield _edit_rows([(None, node, len(text), digest, _bytes(mine), _bytes(new), likeness(mine, new), None)])


# Near duplicates.


def band_rows(similarity: float, miss: float = MISS) -> int:
    """The most minima a band can have so that a pair at ``similarity`` shares no band with probability ``miss`` at most."""
    fits = [r for r in range(1, 33) if (1 - similarity**r) ** (PERMUTATIONS // r) <= miss]
    return max(fits, default=1)


def band_keys(fingerprint: Column, rows: int) -> Column:
    """A hash of each band of ``rows`` minima."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(fingerprints: pd.Series) -> pd.Series:
        if not len(fingerprints):
            return pd.Series([], dtype=object)
        minima = np.frombuffer(b"".join(fingerprints), dtype=">u4").reshape(len(fingerprints), PERMUTATIONS).astype(np.uint64)
        bands = minima[:, : PERMUTATIONS // rows * rows].reshape(len(fingerprints), -1, rows)
        keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) * _FACTORS[1], bands.shape[:2]).copy()
        for k in range(rows):
            keys = (keys ^ (keys >> np.uint64(29)) ^ bands[:, :, k]) * _FACTORS[2 + k]
        return pd.Series(list((keys ^ (keys >> np.uint64(32))).view(np.int64)), dtype=object)

    return of(fingerprint)


class ShingleSets(OrderedDict):
    """Shingle sets of texts by name; the last ones used are kept, up to a number of shingles."""

    def __init__(self, most: int = 1 << 21) -> None:
        super().__init__()
        self.most, self.size = most, 0

    def of(self, node: int, data: bytes) -> np.ndarray:
        if node in self:
            self.move_to_end(node)
            return self[node]
        found = np.unique(shingle_hashes(unpacked(data)))
        self[node] = found
        self.size += len(found)
        while self.size > self.most and len(self) > 1:
            self.size -= len(self.popitem(last=False)[1])
        return found


_SETS = ShingleSets()


@F.pandas_udf(DoubleType())
def _jaccard(node: pd.Series, a: pd.Series, pivot: pd.Series, b: pd.Series) -> pd.Series:
    def similarity(x: np.ndarray, y: np.ndarray) -> float:
        if not len(x) or not len(y):
            return float(len(x) == len(y))
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common / (len(x) + len(y) - common)

    # The pivot first: many texts in a row have the same one, and it stays while theirs pass.
    return pd.Series([similarity(_SETS.of(q, y), _SETS.of(p, x)) for p, x, q, y in zip(node, a, pivot, b, strict=True)])


class _Sets:
    """Sets of numbers, counted by flags over the numbers that occur."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        known, places = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(places, np.cumsum(self.sizes)[:-1])
        self.flags = np.zeros(len(known), dtype=bool)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """How many numbers of set ``one`` each of the others holds."""
        self.flags[self.sets[one]] = True
        found = self.flags[np.concatenate([self.sets[k] for k in others])]
        self.flags[self.sets[one]] = False
        ends = np.cumsum(self.sizes[others])
        running = np.concatenate([[0], np.cumsum(found)])
        return running[ends] - running[ends - self.sizes[others]]


def connecting(sets: _Sets, earlier: _Sets, labels: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links between members of different labels, enough to connect all that are linked.

    Members that share an ``earlier`` band are compared there. With ``side``,
    only members of different sides are compared. Every member is compared
    with all that are not connected to it when its turn comes.
    """
    ours = [np.flatnonzero(labels == label) for label in range(labels.max() + 1)]
    waiting = np.ones(len(labels), dtype=bool)
    links = []
    for label in range(len(ours)):
        if not waiting[ours[label][0]]:
            continue
        queue = ours[label].tolist()
        waiting[queue] = False
        while queue:
            one = queue.pop()
            size = sets.sizes[one]
            others = np.flatnonzero(waiting if side is None else waiting & (side != side[one]))
            sizes = sets.sizes[others]
            # What one set has more than the other cannot be common.
            others = others[np.minimum(size, sizes) >= similarity * np.maximum(size, sizes) - 0.5]
            others = others[earlier.common(one, others) == 0] if len(others) else others
            if not len(others):
                continue
            common = sets.common(one, others)
            union = size + sets.sizes[others] - common
            # Texts without words are equal among themselves.
            alike = np.where(union == 0, 1.0, common / np.maximum(union, 1))
            for other in others[alike >= similarity].tolist():
                if waiting[other]:
                    links.append((one, other))
                    waiting[ours[labels[other]]] = False
                    queue += ours[labels[other]].tolist()
    return links


def _in_groups(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for group in key_runs(batches, ["band", "one", "two"]):
        band, one, two = (group.column(c)[0].as_py() for c in ("band", "one", "two"))
        labels = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
        if labels.max() == 0:
            continue
        node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
        sets = [_SETS.of(k, t) for k, t in zip(node.tolist(), group.column("text").to_pylist(), strict=True)]
        bands = [b[b < band] for b in (s.values.to_numpy() for s in group.column("bands"))]
        links = connecting(_Sets([s.view(np.int64) for s in sets]), _Sets(bands), labels, None if one == two else block, similarity)
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def _across(members: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame | None:
    """Links (a, b) within bands whose members do not all have one root yet; None if there are no such bands."""
    placed = members.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = placed.join(texts.select("node", "size"), "node").groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count"), F.sum("size").alias("size")
    )
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("size") / BLOCK_BYTES)).cast("int")
    mixed = save(sums.where("low <> high").select("band", blocks.alias("blocks")), "minhash-mixed")
    if mixed.isEmpty():
        return None
    dealt = placed.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    columns = ["band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")]
    groups = met.select(*columns, "block", "node", "root").join(texts.drop("size"), "node")
    keys = ("band", "one", "two")
    sorted_ = groups.repartition(*keys).sortWithinPartitions(*keys)
    links = save(sorted_.mapInArrow(lambda batches: _in_groups(batches, similarity), "a long, b long"), "minhash-across")
    release(mixed)
    return links


def _node() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")


def _packed_texts(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, text, size) of the distinct texts in ``held``, and of few others that a filter of fixed size lets through.

    Only these are compressed and shuffled.
    """
    members = hash_filter(held, "node")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(np.flatnonzero(may_hold(members.value, batch.column("node").to_numpy())))
            texts = [t or "" for t in batch.column("text").take(rows).to_pylist()]
            columns = [batch.column("node").take(rows), pa.array([packed(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "text", "size"])

    return docs.select(_node(), "text").mapInArrow(pack, "node long, text binary, size long").dropDuplicates(["node"])


def _names(docs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """(node, component_id) of texts that are copied or linked, from ``marked`` (doc_id, node, fingerprint)."""
    keys = band_keys(F.col("fingerprint"), band_rows(similarity))
    bands = save(marked.select("node", F.explode(keys).alias("band")), "minhash-keys")
    ends = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    shared = save(ends.where("pivot <> last").select("band", "pivot"), "minhash-shared")
    members = save(bands.join(shared, "band").select("band", "node", "pivot").distinct(), "minhash-bands")
    release(bands, shared)
    held = save(members.groupBy("node").agg(F.collect_list("band").alias("bands")), "minhash-held")
    texts = save(_packed_texts(docs, held).join(held, "node"), "minhash-texts")
    pairs = members.where("node <> pivot").select("node", "pivot").distinct()
    left, right = texts.select("node", F.col("text").alias("a")), texts.select(F.col("node").alias("pivot"), F.col("text").alias("b"))
    near = pairs.join(left, "node").join(right, "pivot").where(_jaccard("node", "a", "pivot", "b") >= similarity)
    links = save(near.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "minhash-links")
    roots = components(links)
    further = _across(members, texts, roots, similarity)
    if further is not None:
        roots = components(links.union(further))
        release(further)
    release(members, held, texts, links)
    counted = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(roots, "node", "left")
    grouped = save(counted.where("copies > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "least"), "minhash-groups")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return save(grouped.join(smallest, "root").select("node", "component_id"), "minhash-components")


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with component_id in place of node; texts without a name are alone.

    A filter of fixed size tells which rows may have a name; only these are shuffled for the join.
    """
    members = hash_filter(names, "node")

    @F.pandas_udf(BooleanType())
    def may_have_name(node: pd.Series) -> pd.Series:
        return pd.Series(may_hold(members.value, node.to_numpy()))

    kept = [c for c in rows.columns if c != "node"]
    marked = rows.withColumn("named", may_have_name("node"))
    joined = marked.where("named").join(names, "node", "left").select(*kept, F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = marked.where("not named").select(*kept, F.col("doc_id").alias("component_id"))
    return _readable(joined.union(alone))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that verified links lead to."""
    marked = save(docs.select("doc_id", _node(), fingerprint(F.col("text")).alias("fingerprint")), "minhash-docs")
    return _named(marked, _names(docs, marked, similarity))


def compare_and_group(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``compare_edits`` with the component_id of ``near_duplicates`` as a further column.

    The edits come first and are stored, so that the groups reuse their fingerprints.
    """
    edits = save(_edits(docs), "minhash-edits")
    return _named(edits, _names(docs, edits, similarity))
