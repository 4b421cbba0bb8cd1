"""Random forests grown level by level for all trees at once, from the stored bins of ``tree_tables``.

Each row carries its node in every tree and is counted in a tree as often as a
hash of its key says (a Poisson draw of mean 1, the same in every run). One
aggregation adds up a level by (tree, node, feature, bin); windows over these
sums find each node's best split, so the driver receives one row a node of the
level, and rows find their next node in an array of the level's splits.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecast.errors import EmptySourceError
from scorecast.operators.tree_tables import DIGITS, LEAF, Bins, Node, TreeModel
from scorecast.sources.store import release, save

# The shares of a Poisson variable of mean 1 that are at most 0, 1, 2, ...
_POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(10)]


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str = "sqrt"  # "sqrt", "log2" or "all", for each node anew
    bootstrap: bool = True
    seed: int = 42


# What a search draws from.
FOREST_GRID: Mapping[str, Sequence] = {
    "trees": [100, 200, 300, 400],
    "max_depth": [5, 10, 15, 20, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2"],
}


def features_of_a_node(kind: str, features: int) -> int:
    return {"sqrt": max(1, int(math.sqrt(features))), "log2": max(1, int(math.log2(features))), "all": features}[kind]


def _times(turn: Column, tree: Column, s: ForestSettings) -> Column:
    """How often a row counts in a tree."""
    if not s.bootstrap:
        return F.lit(1)
    share = F.pmod(F.xxhash64(turn, tree, F.lit(s.seed)), F.lit(1 << 40)) / float(1 << 40)
    times = F.lit(len(_POISSON))
    for k in reversed(range(len(_POISSON))):
        times = F.when(share < _POISSON[k], k).otherwise(times)
    return times


def _impurity(positive: Column, total: Column) -> Column:
    """Gini impurity times weight."""
    return F.coalesce(F.try_divide(2 * positive * (total - positive), total), F.lit(0.0))


def level_splits(rows: DataFrame, bins: Bins, s: ForestSettings, level: int) -> DataFrame:
    """(tree, node, positive, total, n, best) of every open node; ``best`` is null where no split is possible.

    ``rows`` has turn, label, weight, bins and nodes: the row's node within this level for each tree, null once it is
    in a leaf. ``best`` is (gain, feature, bin, positive, total, n), the sums being those of the left side.
    """
    each = rows.select("turn", "label", "weight", "bins", F.posexplode("nodes").alias("tree", "node")).where("node is not null")
    each = each.withColumn("times", _times(F.col("turn"), F.col("tree"), s)).where("times > 0")
    w = F.col("weight") * F.col("times")
    values = each.select("tree", "node", "times", w.alias("w"), (w * F.col("label")).alias("p"), F.posexplode("bins").alias("feature", "bin"))
    sums = values.groupBy("tree", "node", "feature", "bin").agg(F.sum("p").alias("p"), F.sum("w").alias("w"), F.sum("times").alias("n"))
    whole = Window.partitionBy("tree", "node", "feature")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select("tree", "node", "feature", "bin", *[F.sum(c).over(so_far).alias(f"{c}_left") for c in "pwn"], *[F.sum(c).over(whole).alias(c) for c in "pwn"])
    # Each node draws its features: those with the smallest hashes.
    draw = Window.partitionBy("tree", "node").orderBy(F.xxhash64(F.lit(s.seed), F.lit(level), "tree", "node", "feature"), "feature")
    cut = cut.withColumn("turn", F.dense_rank().over(draw))
    gain = _impurity(F.col("p"), F.col("w")) - _impurity(F.col("p_left"), F.col("w_left")) - _impurity(F.col("p") - F.col("p_left"), F.col("w") - F.col("w_left"))
    possible = (F.col("n") - F.col("n_left") >= s.min_samples_leaf) & (F.col("n_left") >= s.min_samples_leaf) & (F.col("n_left") < F.col("n"))
    possible &= (F.col("turn") <= features_of_a_node(s.max_features, len(bins.features))) & (F.col("n") >= s.min_samples_split) & (F.round(gain, DIGITS) > 0)
    split = F.struct((-F.round(gain, DIGITS)).alias("loss"), "feature", "bin", "p_left", "w_left", "n_left")
    # Sums of feature 0 are those of the node.
    node = [F.max(F.when(F.col("feature") == 0, F.col(c))).alias(c) for c in "pwn"]
    return cut.groupBy("tree", "node").agg(*node, F.min(F.when(possible, split)).alias("best"))


def _moved(splits: Sequence[Sequence[tuple[int, int, int, int] | None]]) -> Column:
    """The nodes of the next level; ``splits`` holds (feature, bin, left, right) for each tree and node."""
    lists = [[None if x is None else {"f": x[0], "b": x[1], "l": x[2], "r": x[3]} for x in tree] for tree in splits]
    table = F.from_json(F.lit(json.dumps(lists)), "array<array<struct<f:int,b:int,l:int,r:int>>>")

    def step(node: Column, tree: Column) -> Column:
        split = F.get(F.get(table, tree), node)
        side = F.when(F.get("bins", split["f"]) <= split["b"], split["l"]).otherwise(split["r"])
        return F.when(side >= 0, side)

    return F.transform("nodes", step)


def fit_forest(binned: DataFrame, bins: Bins, label: str, weight: str, settings: ForestSettings, keys: Sequence[str]) -> TreeModel:
    """A forest of class 1 from a stored table with ``bins``, a label of 0 and 1, a weight and ``keys`` that tell rows apart.

    Its probability is the mean of the leaves' weighted shares of class 1.
    """
    s = settings
    start = F.array_repeat(F.lit(0), s.trees)
    rows = binned.select(F.xxhash64(*keys).alias("turn"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"), "bins", start.alias("nodes"))
    done: list[list[Node]] = [[] for _ in range(s.trees)]
    # For each tree the places in ``done`` of the nodes that this level may split.
    open_ = [[0] for _ in range(s.trees)]
    stored, level = None, 0
    while any(open_):
        found = {(r["tree"], r["node"]): r for r in level_splits(rows, bins, s, level).collect()}
        if not level:
            if not found:
                raise EmptySourceError("no rows to fit a forest")
            for tree in range(s.trees):
                r = found.get((tree, 0))
                done[tree].append(_leaf(tree, 0, *((r["p"], r["w"], r["n"]) if r else (0.0, 0.0, 0))))
        splits, following = [], []
        for tree in range(s.trees):
            moves: list[tuple[int, int, int, int] | None] = []
            after: list[int] = []
            for k, place in enumerate(open_[tree]):
                r = found.get((tree, k))
                best = r["best"] if r and (s.max_depth is None or level < s.max_depth) else None
                if best is None:
                    moves.append(None)
                    continue
                left = (best["p_left"], best["w_left"], best["n_left"])
                right = tuple(r[c] - x for c, x in zip("pwn", left, strict=True))
                children = []
                for positive, total, n in (left, right):
                    child = len(done[tree])
                    done[tree].append(_leaf(tree, child, positive, total, n))
                    further = n >= s.min_samples_split and 0 < positive < total and (s.max_depth is None or level + 1 < s.max_depth)
                    children.append((child, len(after) if further else -1))
                    after += [child] if further else []
                (a, a_next), (b, b_next) = children
                done[tree][place] = Node(tree, place, best["feature"], bins.cuts[best["feature"]][best["bin"]], a, b, 0.0, -best["loss"], round(r["n"]))
                moves.append((best["feature"], best["bin"], a_next, b_next))
            splits.append(moves)
            following.append(after)
        open_, level = following, level + 1
        if any(open_):
            before, stored = stored, save(rows.withColumn("nodes", _moved(splits)), "forest-nodes")
            rows = stored
            if before is not None:
                release(before)
    if stored is not None:
        release(stored)
    return TreeModel(bins.features, 0.0, tuple(n for tree in done for n in tree), mean=True)


def _leaf(tree: int, node: int, positive: float, total: float, n: int) -> Node:
    return Node(tree, node, LEAF, 0.0, LEAF, LEAF, positive / total if total else 0.0, 0.0, round(n))
