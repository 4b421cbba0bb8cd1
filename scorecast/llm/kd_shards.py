"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Equal texts form one group, the unit that is dealt; its metadata are its
bytes, smallest doc_id, language and source. The groups are split again and
again at a weighted median (by bytes) of the dimension that is widest in the
node, until there are as many leaves as the target bytes ask for. A median is
sought in histograms: all nodes of a level sum bytes by bin in one
aggregation, and only the bin that holds the median is looked into again, so
no node is ever sorted or gathered. A hash of the text follows each
coordinate and splits rows that agree in it.

Groups that weigh more than ``HEAVY`` of a leaf are few (at most leaves /
HEAVY of them); they are placed first, largest on the emptiest leaf, and the
medians leave room for them. A group heavier than a whole leaf is cut into
pieces by the hash of the doc_id; its rows then have several shards.

Defined results: a null text has no bytes (size 1) and groups with empty
texts. Null metadata lie at the lower end of their dimension. Rows that agree
in everything count each. Other columns are left alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecast.sources.store import save

HEAVY = 0.01
BINS = 1_024
TOLERANCE = 0.002
"""A median is good enough when its error is below this share of a leaf."""
DIMENSIONS = ("size", "doc", "lang_at", "source_at")
_HASH_BITS = 31


def text_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _place(text: Column) -> Column:
    """A text's first six bytes as a number, so that its order is kept."""
    padded = F.rpad(F.substring(F.hex(F.coalesce(text, F.lit("")).cast("binary")), 1, 12), 12, "0")
    return F.conv(padded, 16, 10).cast("double")


def metadata(docs: DataFrame) -> DataFrame:
    """One row per document without its text."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.md5(whole.cast("binary")).alias("group"),
        _place(F.col("lang")).alias("lang_at"), _place(F.col("source")).alias("source_at"),
    )


def _table(spark: SparkSession, rows: Iterable[tuple[Any, ...]], schema: str) -> DataFrame:
    """A control table from one literal that the JVM unfolds, so that no Python worker is started for it."""
    fields = [field.split() for field in schema.split(", ")]
    written = json.dumps([dict(zip([name for name, _ in fields], row, strict=True)) for row in rows])
    fields = ", ".join(f"{name}: {kind}" for name, kind in fields)
    return spark.range(1).select(F.inline(F.from_json(F.lit(written), f"array<struct<{fields}>>")))


def _heavy_pieces(heavy: list[Any], leaf: float) -> list[tuple[str, int, int, float]]:
    """(group, piece, pieces, weight); groups heavier than a leaf fall into pieces of a hundredth of a leaf or more."""
    out = []
    for row in heavy:
        pieces = 1 if row["weight"] <= leaf else int(row["weight"] / (leaf * HEAVY)) + 1
        out += [(row["group"], piece, pieces, row["weight"] / pieces) for piece in range(pieces)]
    return sorted(out, key=lambda x: (-x[3], x[0], x[1]))


def _coordinate(nodes: DataFrame) -> DataFrame:
    """``at``: a group's place in its node's widest dimension and then by hash, as one number from 0 up."""
    value = F.lit(0.0)
    for i, d in enumerate(DIMENSIONS):
        value = F.when(F.col("axis") == i, F.col(d)).otherwise(value)
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, F.floor((value - F.col("low")) / width * ((1 << 30) - 1))).otherwise(0).cast("long")
    clipped = F.greatest(F.lit(0), F.least(place, F.lit((1 << 30) - 1)))
    hashed = F.pmod(F.xxhash64("group", "piece"), F.lit(1 << _HASH_BITS))
    return nodes.withColumn("at", F.shiftleft(clipped, _HASH_BITS) + hashed)


def _medians(placed: DataFrame, wanted: dict[int, float], slack: float) -> dict[int, int]:
    """For each node the coordinate below which about ``wanted`` bytes lie.

    The driver holds one row per node. Each pass splits the interval in
    question into BINS bins, for all nodes in one aggregation.
    """
    state = {node: [0, 1 << (30 + _HASH_BITS), 0.0, want] for node, want in wanted.items()}
    found: dict[int, int] = {}
    while state:
        spark = placed.sparkSession
        rows = [(n, lo, max(1, -(-(hi - lo) // BINS)), hi) for n, (lo, hi, _, _) in state.items()]
        intervals = F.broadcast(_table(spark, rows, "node long, lo long, step long, hi long"))  # one row per node
        inside = placed.join(intervals, "node").where("at >= lo and at < hi")
        bins = inside.groupBy("node", F.expr("(at - lo) div step").alias("bin")).agg(F.sum("weight").alias("w"))
        running = bins.withColumn("sum", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        steps = {n: (lo, step, hi) for n, lo, step, hi in rows}
        crossing = running.join(F.broadcast(_table(spark, [(n, float(s[3] - s[2])) for n, s in state.items()], "node long, want double")), "node")
        hit = crossing.where("sum >= want").groupBy("node").agg(F.min_by(F.struct("bin", "w", "sum"), "bin").alias("b")).collect()
        hits = {row["node"]: row["b"] for row in hit}
        for node in list(state):
            lo, step, hi = steps[node]
            if node not in hits:  # everything fits below
                found[node] = hi
                del state[node]
                continue
            b = hits[node]
            lower, upper = lo + b["bin"] * step, min(hi, lo + (b["bin"] + 1) * step)
            below, want = state[node][2] + b["sum"] - b["w"], state[node][3]
            if b["w"] <= slack or upper - lower <= 1:
                found[node] = upper if want - below > b["w"] / 2 else lower
                del state[node]
            else:
                state[node][:3] = [lower, upper, below]
    return found


def deal_groups(groups: DataFrame, leaves: int, total: float) -> DataFrame:
    """(group, piece, pieces, shard) for rows of (group, weight and dimensions)."""
    spark, leaf = groups.sparkSession, total / leaves
    heavy = groups.where(F.col("weight") > leaf * HEAVY).select("group", "weight").collect()  # at most leaves / HEAVY rows
    load, placed_heavy = [(0.0, k) for k in range(leaves)], []
    for group, piece, pieces, weight in _heavy_pieces(heavy, leaf):
        used, shard = heapq.heappop(load)
        heapq.heappush(load, (used + weight, shard))
        placed_heavy.append((group, piece, pieces, shard))
    used = dict((k, w) for w, k in load)
    room = [max(0.0, leaf - used[k]) for k in range(leaves)]
    # Stored, so that the node is a column and the first level joins by it like all others.
    light = save(groups.where(F.col("weight") <= leaf * HEAVY).withColumns({"piece": F.lit(0), "node": F.lit(0).cast("long")}), "kd-light")
    spans = {0: (0, leaves)}
    done: dict[int, int] = {}
    number = 1
    while True:
        done |= {node: first for node, (first, last) in spans.items() if last - first == 1}
        spans = {node: span for node, span in spans.items() if span[1] - span[0] > 1}
        if not spans:
            break
        extents = [f(d).alias(f"{p}_{d}") for d in DIMENSIONS for p, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in light.groupBy("node").agg(F.sum("weight").alias("weight"), *extents).collect()}
        if number == 1:
            whole = {d: max(1e-9, stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) for d in DIMENSIONS} if 0 in stats else {}
        info, wanted = [], {}
        for node, (first, last) in spans.items():
            if node not in stats:
                continue
            s = stats[node]
            axis = max(range(len(DIMENSIONS)), key=lambda i: ((s[f"hi_{DIMENSIONS[i]}"] - s[f"lo_{DIMENSIONS[i]}"]) / whole[DIMENSIONS[i]], -i))
            middle, all_room = (first + last) // 2, sum(room[first:last])
            wanted[node] = s["weight"] * (sum(room[first:middle]) / all_room if all_room else (middle - first) / (last - first))
            info.append((node, axis, s[f"lo_{DIMENSIONS[axis]}"], s[f"hi_{DIMENSIONS[axis]}"]))
        if not info:
            done |= {node: first for node, (first, _) in spans.items()}
            break
        axes = F.broadcast(_table(spark, info, "node long, axis int, low double, high double"))  # one row per node
        coordinates = save(_coordinate(light.join(axes, "node", "left")).select("group", "piece", "weight", *DIMENSIONS, "node", "at"), "kd-level")
        cuts = _medians(coordinates.where(F.col("node").isin(list(wanted))) if len(wanted) < 100 else coordinates, wanted, leaf * TOLERANCE)
        split, next_spans = [], {}
        for node, cut in cuts.items():
            first, last = spans[node]
            middle = (first + last) // 2
            split.append((node, cut, number, number + 1))
            next_spans |= {number: (first, middle), number + 1: (middle, last)}
            number += 2
        table = F.broadcast(_table(spark, split, "node long, cut long, below long, above long"))  # one row per node
        moved = F.when(F.col("cut").isNull(), F.col("node")).when(F.col("at") < F.col("cut"), F.col("below")).otherwise(F.col("above"))
        light = coordinates.join(table, "node", "left").select("group", "piece", "weight", *DIMENSIONS, moved.alias("node"))
        spans = next_spans
    ends = F.broadcast(_table(spark, done.items(), "node long, shard int"))  # one row per leaf
    dealt = light.join(ends, "node").select("group", "piece", F.lit(1).alias("pieces"), "shard")
    return dealt.union(_table(spark, placed_heavy, "group string, piece int, pieces int, shard int"))


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near-equal bytes, and a gapless place in each.

    Give the number of shards, or the bytes that one should have.
    """
    rows = save(metadata(docs), "kd-rows")
    dimensions = [F.first("size").cast("double").alias("size"), F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)).alias("doc")]
    dimensions += [F.min(d).alias(d) for d in ("lang_at", "source_at")]
    groups = save(rows.groupBy("group").agg(F.sum("size").cast("double").alias("weight"), *dimensions), "kd-groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0.0
    if leaves is None:
        leaves = max(1, -(-int(total) // int(target_bytes)))
    dealt = save(deal_groups(groups, leaves, max(1.0, total)), "kd-dealt")
    pieces = dealt.select("group", "pieces").where("pieces > 1").distinct()
    known = rows.join(pieces, "group", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    known = known.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    placed = known.join(dealt.select("group", "piece", "shard"), ["group", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """``placed`` with ``slot``, counting from 0 in each shard by doc_id.

    Rows are range-partitioned by (shard, doc_id) and numbered in each
    partition; the counts of the partitions before are added.
    """
    order = ("shard", "doc_id", "text_crc32", "size")
    ranged = placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part", "shard").orderBy(*order[1:])
    local = save(ranged.withColumn("slot", F.row_number().over(here).cast("long") - 1), "kd-slots")
    counts = local.groupBy("shard", "part").count()
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    # One row per shard and partition of the sort.
    return local.join(F.broadcast(offsets), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("offset")).alias("slot"))
