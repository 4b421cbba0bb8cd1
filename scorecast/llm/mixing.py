r"""Mixing sources to target weights with hash-threshold histograms.

A document's size is its number of words `[^\x20\x09-\x0D]+`. Sources, in
code point order with null last, get weights in turn and share the total
size by them; no target exceeds ``cap`` times its source's size, and what
is cut off goes to the others by weight until none is above.

A source's target is met by whole passes over its documents plus one part:
the documents whose hash lies below a threshold. The threshold is found by
summing sizes by source and hash bucket, taking whole buckets while they
fit, and looking inside the boundary bucket only, level by level. Nothing is
sorted, thresholds for smaller budgets are nested in those for larger ones,
and reruns agree, because the hash depends on the id alone.

Defined results: a null or blank text has size 0, a null source is a source,
a null id hashes like an empty one. Rows with the same id are taken or left
together. A source of size 0 has target 0. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecast.llm.common import fresh
from scorecast.sources.store import save

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
LEVEL_BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The windows run over one row per source. Sources in ascending order of
    the level at which they reach their cap: the level that shares the rest
    among those after a source is largest where the first uncapped one stands.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    named = totals.select("source", "source_size", weight.alias("w"), turn.alias("turn"))
    full = F.lit(float(cap)) * F.col("source_size")
    before = Window.orderBy(full / F.col("w"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    share = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = named.withColumn("level", rest / share)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least(level * F.col("w"), full).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level))


def hash_thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, threshold) from rows of (source, size, hash).

    ``passes`` counts whole passes; documents with a hash below ``threshold``
    are taken once more. The last document goes with the nearer side.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passes = F.floor(ratio)
    state = save(
        targets.select(
            "source", "source_size", "target", passes.cast("long").alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("left")
        ).select("*", F.lit(None).cast("long").alias("threshold")),
        "mix-state",
    )
    rows = sizes.select("source", "size", "hash")
    columns = ("source", "source_size", "target", "passes", "left", "threshold")
    for level in range(LEVELS):
        histogram = rows.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("n"))
        so_far = Window.partitionBy("source").orderBy("bucket")
        running = histogram.select(F.col("source").alias("s"), "bucket", "n", F.sum("n").over(so_far).alias("sum"))
        open_ = state.where("threshold is null").select("source", "left")
        crossing = running.join(open_, running["s"].eqNullSafe(open_["source"])).where(F.col("sum") > F.col("left"))
        boundary = crossing.groupBy("s").agg(F.min_by(F.struct("bucket", "n", (F.col("sum") - F.col("n")).alias("below")), "bucket").alias("b"))
        last = level == LEVELS - 1
        # Without a boundary everything that is left fits; that happens only at the first level.
        left = F.col("left") - F.coalesce(F.col("b.below"), F.lit(0))
        edge = F.col("b.bucket") + F.when(left * 2 >= F.col("b.n"), 1).otherwise(0) if last else F.lit(None).cast("long")
        threshold = F.coalesce(F.col("threshold"), F.when(F.col("b").isNull(), F.lit(1 << (LEVEL_BITS * LEVELS))).otherwise(edge))
        joined = state.join(boundary, state["source"].eqNullSafe(boundary["s"]), "left")
        moved = joined.select("source", "source_size", "target", "passes", left.alias("left"), threshold.alias("threshold"), F.col("b.bucket").alias("bucket"))
        state = save(moved, "mix-state")
        if not last:
            inside = state.where("threshold is null").select(F.col("source").alias("s"), F.col("bucket").alias("at"))
            rows = rows.join(inside, rows["source"].eqNullSafe(inside["s"]) & (_bucket(level) == inside["at"])).select("source", "size", "hash")
            rows = save(rows, "mix-boundary")
        state = state.select(*columns)
    return state.select("source", "source_size", "target", "passes", "threshold")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(doc_id, size, source, source_size, target, passes): how often the mix takes each row of ``docs``."""
    sizes = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "mix-sizes")
    plan = hash_thresholds(sizes, source_targets(sizes, weights, cap))
    plan = plan.withColumnRenamed("source", "s").withColumnRenamed("passes", "whole")
    taken = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    joined = sizes.join(plan, sizes["source"].eqNullSafe(plan["s"]))
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.alias("passes"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says; rows with the same id have the same number."""
    known = mixed.groupBy(F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source")).agg(F.max("passes").alias("mixed_passes"))
    names = [f"`{c}`" for c in docs.columns]
    both = docs.join(known, docs["doc_id"].eqNullSafe(known["mixed_id"]) & docs["source"].eqNullSafe(known["mixed_source"]))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mixed_passes").cast("int")))
    return both.where("mixed_passes > 0").select(*names, copies.alias(fresh(docs, "copy"))).select(*names)
