"""Boosted trees grown leaf by leaf from histograms, and trees kept as tables that column expressions score.

Features are binned once and stored, a small number each; every fit reads the
same bins. A round adds up gradients and Hessians by (leaf, feature, bin) in
one aggregation, combined before the shuffle, so that only sums reach the
driver: at most ``2 * leaves * features * bins`` of them. Leaves are split
best first. One job measures the children of all leaves that may still be
split, so a tree needs about as many jobs as it is deep, not as it has leaves;
of two children only the smaller one is added up, the other is the rest.

A fitted model is a table with a row for each node. A row of features is
scored by walking arrays of these nodes with higher-order functions, in the
JVM and without collecting anything; importances are sums over the table.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.errors import EmptySourceError
from scorecast.sources.store import release, save

MOST_BINS = 255
DIGITS = 9  # gains that agree so far are ties: the first feature and cut wins
LEAF = -1


# Bins.


@dataclass(frozen=True)
class Bins:
    """Ascending cuts for each feature; a value's bin is the number of cuts below it, a missing value is in bin 0."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    @property
    def widest(self) -> int:
        return max(len(c) for c in self.cuts) + 1


def fit_bins(df: DataFrame, features: Sequence[str], most: int = MOST_BINS) -> Bins:
    """Cuts half-way between neighbouring values, or between quantiles where a feature has more than ``most`` values."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)])
    values = save(df.select(F.explode(pairs).alias("p")).select("p.k", "p.v").where("v is not null and not isnan(v)").distinct(), "bin-values")
    counts = {r["k"]: r["n"] for r in values.groupBy("k").agg(F.count("*").alias("n")).collect()}
    few = [k for k, n in counts.items() if n <= most]
    found: dict[int, list[float]] = {k: [] for k in range(len(features))}
    for row in values.where(F.col("k").isin(few)).collect() if few else []:  # at most ``most`` a feature
        found[row["k"]].append(row["v"])
    many = [k for k in counts if k not in few]
    if many:
        shares = [k / most for k in range(most + 1)]
        sketches = df.agg(*[F.percentile_approx(F.nanvl(F.col(features[k]).cast("double"), F.lit(None)), shares, 100 * most).alias(str(k)) for k in many]).first()
        found |= {k: sketches[str(k)] for k in many}
    release(values)
    cuts = []
    for k in range(len(features)):
        ordered = sorted(set(found[k]))
        cuts.append(tuple((a + b) / 2 for a, b in zip(ordered, ordered[1:], strict=False)))
    return Bins(tuple(features), tuple(cuts))


def with_bins(df: DataFrame, bins: Bins, keep: Sequence[str], name: str = "bins") -> DataFrame:
    """The columns ``keep`` and an array with the bin of each feature."""
    cuts = [np.array(c) for c in bins.cuts]
    kept = list(keep)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, len(cuts)), dtype=np.int16)
            for k, c in enumerate(cuts):
                values = batch.column(len(kept) + k).to_numpy(zero_copy_only=False).astype(np.float64)
                found[:, k] = np.where(np.isnan(values), 0, np.searchsorted(c, values, side="left"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(cuts), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), lists], names=[*kept, name])

    rows = df.select(*kept, *[F.col(f).cast("double").alias(f"_feature_{k}") for k, f in enumerate(bins.features)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)])
    return rows.mapInArrow(place, f"{schema}, {name} array<smallint>")


# Models.


@dataclass(frozen=True)
class Node:
    """A node of a tree: a split (values up to ``cut`` go left) or a leaf with a value."""

    tree: int
    node: int
    feature: int
    cut: float
    left: int
    right: int
    value: float
    gain: float
    rows: int


_NODES = "tree int, node int, feature int, cut double, left int, right int, value double, gain double, rows long"


@dataclass(frozen=True)
class TreeModel:
    """``mean`` models give the mean of their trees' values as the probability, others their sum as log-odds."""

    features: tuple[str, ...]
    base: float
    nodes: tuple[Node, ...] = field(repr=False)
    mean: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each node; ``feature`` is its place in ``features``, -1 in leaves."""
        return spark.createDataFrame([tuple(vars(n).values()) for n in self.nodes], _NODES)

    def margin(self, bins: Bins | None = None) -> Column:
        """The sum of the leaves' values that a row of features ends in, and the base.

        With ``bins``, rows have the array of bins that the model was fitted on in place of the features.
        """

        def cut(n: Node) -> float:
            return n.cut if bins is None or n.feature == LEAF else bins.cuts[n.feature].index(n.cut)

        trees: dict[int, list[Node]] = {}
        for node in self.nodes:
            trees.setdefault(node.tree, []).append(node)
        steps = max((_depth(t) for t in trees.values()), default=0)
        lists = [[{"f": n.feature, "c": cut(n), "l": n.left, "r": n.right, "v": n.value} for n in sorted(t, key=lambda n: n.node)] for t in trees.values()]
        # A constant: the parser runs once when the query is planned.
        forest = F.from_json(F.lit(json.dumps(lists)), "array<array<struct<f:int,c:double,l:int,r:int,v:double>>>")
        x = F.col("bins")
        if bins is None:
            x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(-math.inf)), F.lit(-math.inf)) for f in self.features])

        def walk(tree: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                node = F.get(tree, at)
                return F.when(node["f"] == LEAF, at).when(F.get(x, node["f"]) <= node["c"], node["l"]).otherwise(node["r"])

            return F.get(tree, F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0), step))["v"]

        return F.aggregate(F.transform(forest, walk), F.lit(float(self.base)), lambda total, v: total + v)

    def probability(self, bins: Bins | None = None) -> Column:
        """The probability of class 1."""
        margin = self.margin(bins)
        return margin / len({n.tree for n in self.nodes}) if self.mean else 1 / (1 + F.exp(-margin))

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance, splits): each feature's share of all gains, highest first."""
        gains = self.table(spark).where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))
        names = spark.createDataFrame(list(enumerate(self.features)), "feature int, name string")
        total = F.sum("gain").over(_everything())
        rows = names.join(gains, "feature", "left").withColumn("importance", F.coalesce(F.try_divide("gain", total), F.lit(0.0)))
        return rows.select(F.col("name").alias("feature"), "importance", F.coalesce("splits", F.lit(0)).alias("splits")).orderBy(F.desc("importance"), "feature")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # one row a feature


def _depth(nodes: Sequence[Node]) -> int:
    by_number = {n.node: n for n in nodes}
    depth, level = 0, [0]
    while level:
        level = [c for k in level if by_number[k].feature != LEAF for c in (by_number[k].left, by_number[k].right)]
        depth += bool(level)
    return depth


# Growing.


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 100
    learning_rate: float = 0.1
    leaves: int = 31
    max_depth: int = -1  # no limit
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    row_share: float = 1.0
    feature_share: float = 1.0
    store_every: int = 10
    seed: int = 42


# What a search draws from.
BOOST_GRID: Mapping[str, Sequence] = {
    "rounds": [100, 200, 400],
    "learning_rate": [0.01, 0.05, 0.1],
    "leaves": [20, 31, 40, 50],
    "max_depth": [-1, 10, 20],
    "l1": [0, 0.1, 0.5],
    "l2": [0, 0.1, 0.5],
}


@dataclass
class _Growing:
    """A node while its tree grows: sums by (feature, bin) of gradient, Hessian and rows, and its best split."""

    sums: np.ndarray
    depth: int = 0
    gain: float = -math.inf
    feature: int = LEAF
    bin: int = 0
    children: tuple[int, int] | None = None

    @property
    def totals(self) -> np.ndarray:
        return self.sums[0].sum(axis=0)


def _pull(g: np.ndarray, l1: float) -> np.ndarray:
    """The gradient moved towards zero by ``l1``, not beyond it."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _quality(g: np.ndarray, h: np.ndarray, s: BoostSettings) -> np.ndarray:
    return _pull(g, s.l1) ** 2 / np.maximum(h + s.l2, 1e-300)


def find_split(node: _Growing, cuts: Sequence[int], allowed: np.ndarray, s: BoostSettings) -> None:
    """Note the best split of a node: the highest gain, then the first feature, then the lowest cut."""
    left = np.cumsum(node.sums, axis=1)
    total = node.totals
    right = total - left
    with np.errstate(invalid="ignore", divide="ignore"):
        gains = _quality(left[..., 0], left[..., 1], s) + _quality(right[..., 0], right[..., 1], s) - _quality(total[0], total[1], s)
    possible = np.arange(node.sums.shape[1])[None, :] < np.array(cuts)[:, None]
    possible &= allowed[:, None] & (np.minimum(left[..., 2], right[..., 2]) >= s.min_rows) & (np.minimum(left[..., 1], right[..., 1]) >= s.min_hessian)
    gains = np.where(possible, np.round(gains, DIGITS), -math.inf)
    best = int(np.argmax(gains))
    node.feature, node.bin = divmod(best, gains.shape[1])
    node.gain = float(gains[node.feature, node.bin])
    if not node.gain > 0 or node.depth == s.max_depth:
        node.gain, node.feature = -math.inf, LEAF


def _place(nodes: Sequence[_Growing], at: int = 0) -> Column:
    """The node that a row with ``bins`` is in."""
    node = nodes[at]
    if node.children is None:
        return F.lit(at)
    left, right = node.children
    return F.when(F.get("bins", F.lit(node.feature)) <= node.bin, _place(nodes, left)).otherwise(_place(nodes, right))


def _measure(rows: DataFrame, nodes: Sequence[_Growing], wanted: Sequence[int], shape: tuple[int, int]) -> dict[int, np.ndarray]:
    """Sums of gradient, Hessian and rows by (feature, bin) of some nodes."""
    placed = rows.withColumn("node", _place(nodes)).where(F.col("node").isin(list(wanted)))
    each = placed.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    sums = each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).toArrow()
    node, feature, bin_ = (sums.column(c).to_numpy() for c in ("node", "feature", "bin"))
    found = {}
    for k in wanted:
        one = node == k
        found[k] = np.zeros((*shape, 3))
        found[k][feature[one], bin_[one]] = np.stack([sums.column(c).to_numpy()[one] for c in ("g", "h", "n")], axis=1)
    return found


def grow_tree(rows: DataFrame, bins: Bins, s: BoostSettings, allowed: np.ndarray) -> tuple[list[_Growing], list[int]]:
    """All nodes measured, and the numbers of the tree's leaves, chosen best first; ``rows`` has g, h and bins."""
    shape, cuts = (len(bins.features), bins.widest), [len(c) for c in bins.cuts]
    nodes = [_Growing(np.zeros((*shape, 3)))]
    nodes[0] = _Growing(_measure(rows, nodes, [0], shape)[0])
    find_split(nodes[0], cuts, allowed, s)
    while True:
        leaves = [0]
        missing = False
        while len(leaves) < s.leaves:
            best = max(leaves, key=lambda k: (nodes[k].gain, -k))
            if nodes[best].gain == -math.inf:
                break
            if nodes[best].children is None:
                missing = True
                break
            leaves.remove(best)
            leaves += nodes[best].children
        if not missing:
            return nodes, leaves
        # Split every leaf that may still be chosen, and measure the smaller child of each.
        open_ = sorted((k for k in leaves if nodes[k].children is None and nodes[k].gain > 0), key=lambda k: (-nodes[k].gain, k))[: s.leaves - len(leaves)]
        small = []
        for k in open_:
            nodes[k].children = (len(nodes), len(nodes) + 1)
            left = nodes[k].sums[nodes[k].feature, : nodes[k].bin + 1, 2].sum()
            small.append(nodes[k].children[0 if 2 * left <= nodes[k].totals[2] else 1])
            nodes += [_Growing(np.zeros((*shape, 3)), nodes[k].depth + 1) for _ in range(2)]
        measured = _measure(rows, nodes, small, shape)
        for k, one in zip(open_, small, strict=True):
            other = sum(nodes[k].children) - one
            nodes[one].sums, nodes[other].sums = measured[one], nodes[k].sums - measured[one]
            for child in nodes[k].children:
                find_split(nodes[child], cuts, allowed, s)


def _finished(tree: int, nodes: Sequence[_Growing], leaves: Sequence[int], bins: Bins, s: BoostSettings) -> list[Node]:
    """The tree's nodes, numbered from the root; children that were measured but not chosen are left out."""
    chosen, done, order = set(leaves), [], [0]
    number = {0: 0}
    for k in order:
        if k not in chosen:
            for child in nodes[k].children:
                number[child] = len(order)
                order.append(child)
    for k in order:
        g, h, n = nodes[k].totals
        if k in chosen:
            value = -s.learning_rate * float(_pull(g, s.l1)) / max(float(h) + s.l2, 1e-300)
            done.append(Node(tree, number[k], LEAF, 0.0, LEAF, LEAF, value, 0.0, round(float(n))))
        else:
            left, right = nodes[k].children
            done.append(Node(tree, number[k], nodes[k].feature, bins.cuts[nodes[k].feature][nodes[k].bin], number[left], number[right], 0.0, nodes[k].gain, round(float(n))))
    return done


def _added(nodes: Sequence[Node], bins: Bins, at: int = 0) -> Column:
    """The value of the leaf that a row with ``bins`` ends in."""
    node = nodes[at]
    if node.feature == LEAF:
        return F.lit(node.value)
    place = bins.cuts[node.feature].index(node.cut)
    return F.when(F.get("bins", F.lit(node.feature)) <= place, _added(nodes, bins, node.left)).otherwise(_added(nodes, bins, node.right))


def fit_boosted(binned: DataFrame, bins: Bins, label: str, weight: str, settings: BoostSettings, keys: Sequence[str] = ()) -> TreeModel:
    """A model of class 1 by logistic loss, from a stored table with ``bins``, a label of 0 and 1 and a weight.

    ``row_share`` below 1 takes rows by a hash of ``keys`` and the round, so a
    task that is run again takes the same rows. Margins are stored every
    ``store_every`` rounds; in between they are the sum of a few expressions.
    """
    s = settings
    chooser = random.Random(s.seed)
    positive, negative = binned.agg(F.sum(F.when(F.col(label) == 1, F.col(weight))), F.sum(F.when(F.col(label) == 0, F.col(weight)))).first()
    if not positive or not negative:
        raise EmptySourceError("rows of both classes are needed to fit a model")
    base = math.log(positive / negative)
    rows = binned.select("*", F.lit(base).alias("_margin"))
    stored, done = None, []
    for tree in range(s.rounds):
        p = 1 / (1 + F.exp(-F.col("_margin")))
        sample = rows
        if s.row_share < 1:
            turn = F.pmod(F.xxhash64(F.lit(s.seed), F.lit(tree), *keys), F.lit(1 << 20))
            sample = rows.where(turn < int(s.row_share * (1 << 20)))
        slopes = sample.select("bins", (F.col(weight) * (p - F.col(label))).alias("g"), (F.col(weight) * p * (1 - p)).alias("h"))
        taken = max(1, round(s.feature_share * len(bins.features)))
        allowed = np.isin(np.arange(len(bins.features)), chooser.sample(range(len(bins.features)), taken))
        nodes, leaves = grow_tree(slopes, bins, s, allowed)
        if len(leaves) == 1 and taken == len(bins.features) and s.row_share >= 1:
            break  # no split helps, and none will in later rounds
        finished = _finished(tree, nodes, leaves, bins, s)
        done += finished
        rows = rows.withColumn("_margin", F.col("_margin") + _added(finished, bins))
        if (tree + 1) % s.store_every == 0 and tree + 1 < s.rounds:
            before, stored = stored, save(rows, "boost-margins")
            rows = stored
            if before is not None:
                release(before)
    if stored is not None:
        release(stored)
    return TreeModel(bins.features, base, tuple(done))
