"""Embedding near-dedup by randomised-rotation binary codes.

A unit vector is turned by a seeded random rotation and stored as the signs
of its coordinates with one correction factor, the inner product of the
vector with its own code. Divided by it, the inner product of the code with
another vector is an unbiased estimate of the cosine, whose error has a known
bound. Only pairs whose upper confidence bound reaches the threshold are
computed again, in double precision, and that decides.

Which pairs are estimated: codes of several rotations are cut into bands of
``band_bits`` bits, and vectors that share a band meet. The bits of a band
grow with the logarithm of the number of vectors, so that a bucket of
unrelated vectors stays small, and the number of bands follows from them so
that a pair exactly at the threshold is missed with probability ``MISS`` at
most. Pairs are counted in the first band they share. Buckets beyond
``BLOCK`` vectors (near copies of one vector) are cut into blocks, and each
pair of blocks is a group of its own. A group reports sums of links per
vector and a spanning forest, never pairs. Equal vectors are compared once.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are their own component. Vectors
of different lengths do not link. Rows without vec_id have no links and a
null component, and are not kept. Rows that repeat a vec_id each count as a
vector. Labels and other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from scorecast.llm.common import forest, key_runs
from scorecast.llm.components import components
from scorecast.sources.store import save

THRESHOLD = 0.9
MISS = 1e-3
BUCKET_ROWS = 32
"""Unrelated vectors that should share a bucket."""
BLOCK = 1_024
EPSILON = 4.0
"""Width of the confidence bound, in standard errors of the estimate."""
SEED = 20


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation of ``dim`` dimensions, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a band, number of bands) for so many vectors."""
    bits = int(np.clip(np.ceil(np.log2(max(1, vectors) / BUCKET_ROWS)), 4, 48))
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISS) / np.log1p(-same)))


def signs(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Sign bits of as many rotations as the bands need, one row of bands * bits for each vector."""
    dim = unit.shape[1]
    turns = -(-bits * bands // dim)
    return np.concatenate([unit @ rotation(dim, t) > 0 for t in range(turns)], axis=1)[:, : bits * bands]


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """One number for each vector and band, with the length of the vector in its upper part."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    keys = signs(unit, bits, bands).reshape(len(unit), bands, bits) @ weights
    return keys + ((unit.shape[1] % (1 << 14)) << 48)


def binary_codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the first rotation, and the correction factor: the inner product of a vector with its code."""
    turned = unit @ rotation(unit.shape[1], 0)
    factor = np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), factor


def estimate(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosine of each coded vector with each of ``unit``, and their error bounds by code."""
    dim = unit.shape[1]
    spread = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = (unit @ rotation(dim, 0)).astype(np.float32)
    error = EPSILON * np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors / np.sqrt(max(1, dim - 1))
    return (spread @ turned.T) / factors[:, None].astype(np.float32), error


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaling by the largest component first keeps squares in range."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    dot = (a * b).sum(axis=1)
    return dot / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def linked_pairs(
    vectors: np.ndarray, codes: np.ndarray, factors: np.ndarray, rows: np.ndarray, against: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other) at the threshold or above, decided exactly; pairs the estimates rule out are not computed."""
    unit = unit_rows(vectors)
    estimated, error = estimate(codes[rows], factors[rows], unit[against])
    i, j = np.nonzero(estimated + error[:, None] >= threshold - 1e-5)
    left, right = rows[i], against[j]
    ok = np.zeros(len(left), dtype=bool)
    for start in range(0, len(left), 65_536):
        part = slice(start, start + 65_536)
        ok[part] = exact_cosine(vectors[left[part]], vectors[right[part]]) >= threshold
    return left[ok], right[ok]


def stored_type(embeddings: DataFrame) -> str:
    """How vectors travel: single precision where they are given so, which loses nothing, else double."""
    return "float32" if embeddings.schema["embedding"].dataType.elementType == FloatType() else "float64"


def _matrix(column: pa.ChunkedArray | pa.Array, stored: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors in double precision) by vector length."""
    blobs = column.to_pylist()
    lengths = np.array([len(b) for b in blobs])
    return [
        (at := np.flatnonzero(lengths == n), np.frombuffer(b"".join(blobs[i] for i in at), dtype=stored).astype(np.float64).reshape(len(at), -1))
        for n in np.unique(lengths).tolist()
    ]


def _banded(batches: Iterator[pa.RecordBatch], bits: int, bands: int, stored: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            for at, vectors in _matrix(part.column("vector"), stored):
                unit = unit_rows(vectors)
                keys = band_keys(unit, bits, bands)
                codes, factors = binary_codes(unit)
                rows = pa.table(part.take(pa.array(at)).to_pydict() | {"code": [c.tobytes() for c in codes], "factor": factors}).to_batches()
                rows = rows[0]
                for band in range(bands):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), band, dtype=np.int32)), pa.array(keys[:, band]), *rows.columns],
                        names=["band", "key", *rows.schema.names],
                    )


def _grouped(batches: Iterator[pa.RecordBatch], bits: int, bands: int, threshold: float, stored: str) -> Iterator[pa.RecordBatch]:
    for group in key_runs(batches, ["band", "key", "one", "two"]):
        if group.num_rows < 2:
            continue
        band, one, two = (group.column(c)[0].as_py() for c in ("band", "one", "two"))
        (_, vectors), *_ = _matrix(group.column("vector"), stored)
        node = group.column("node").to_numpy()
        copies = group.column("copies").to_numpy().astype(np.int64)
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        factors = group.column("factor").to_numpy()
        block = group.column("block").to_numpy()
        everyone = np.arange(len(node))
        against = everyone if one == two else np.flatnonzero(block == two)
        left, right = [], []
        for start in range(0, len(node), 256):
            rows = everyone[start : start + 256]
            rows = rows if one == two else rows[block[rows] == one]
            if len(rows) and len(against):
                a, b = linked_pairs(vectors, codes, factors, rows, against, threshold)
                keep = a < b if one == two else a >= 0
                left.append(a[keep]), right.append(b[keep])
        if not left:
            continue
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a) and band:
            keys = band_keys(unit_rows(vectors), bits, bands)[:, :band]
            first = np.concatenate([~(keys[a[s : s + 65_536]] == keys[b[s : s + 65_536]]).any(axis=1) for s in range(0, len(a), 65_536)])
            a, b = a[first], b[first]
        if not len(a):
            continue
        n = len(node)
        links = np.bincount(a, copies[b], minlength=n) + np.bincount(b, copies[a], minlength=n)
        root = forest(n, a, b)
        out = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[out]), pa.array(links[out].astype(np.int64)), pa.array(node[root[out]])], names=["node", "links", "root"]
        )


def distinct_vectors(embeddings: DataFrame) -> DataFrame:
    """(node, vec_id, copies, vector) of every different vector that can be compared; ``node`` hashes its components."""
    wide = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return wide.where(sound).groupBy("v").agg(F.count("*").alias("copies")).select(F.xxhash64("v").alias("node"), "copies", "v")


def _bytes(batches: Iterator[pa.RecordBatch], stored: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("v")
        blobs = [np.asarray(v, dtype=stored).tobytes() for v in vectors.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(blobs, pa.binary())], names=["node", "copies", "vector"])


def link_sums(distinct: DataFrame, threshold: float = THRESHOLD, stored: str = "float64") -> DataFrame:
    """(node, links, root) from the groups: parts of the number of linked rows, and links that connect."""
    bits, bands = band_plan(distinct.count(), threshold)
    banded = distinct.mapInArrow(
        lambda batches: _banded(batches, bits, bands, stored), "band int, key long, node long, copies long, vector binary, code binary, factor double"
    )
    sizes = banded.groupBy("band", "key").count().where(F.col("count") > BLOCK)
    large = save(sizes.select("band", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "embedding-buckets")
    joined = banded.join(large, ["band", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = joined.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    columns = ["band", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")]
    groups = met.select(*columns, "block", "node", "copies", "vector", "code", "factor")
    keys = ("band", "key", "one", "two")
    dealt = groups.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _grouped(batches, bits, bands, threshold, stored), "node long, links long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    stored = stored_type(embeddings)
    packed = distinct_vectors(embeddings).mapInArrow(lambda batches: _bytes(batches, stored), "node long, copies long, vector binary")
    distinct = save(packed, "embeddings")
    sums = save(link_sums(distinct, threshold, stored), "embedding-links")
    counts = sums.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(sums.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = distinct.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    nodes = save(nodes.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "embedding-nodes")
    wide = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = save(wide.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.xxhash64("v")).alias("node")), "embedding-rows")
    named = rows.join(nodes, "node", "left")
    smallest = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(smallest, "root", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
