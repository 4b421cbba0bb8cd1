"""Histogram trees against a plain search over all splits."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecast.errors import EmptySourceError
from scorecast.operators import tree_tables as tt
from scorecast.sources.store import save

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 12, 500), rng.integers(0, 30, 500) / 4, rng.integers(0, 2, 500)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 3)) & (rng.random(500) < 0.9)
    w = np.where(y, 2.0, 1.0)
    rows = [(i, *map(float, r), int(v), float(u)) for i, (r, v, u) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double"), x, y.astype(float), w


def brute_boost(x, y, w, s):
    """Margins after growing each tree best first, with every split tried on the rows themselves."""
    margin = np.full(len(y), math.log(w[y == 1].sum() / w[y == 0].sum()))
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in (sorted(set(c)) for c in x.T)]

    def pull(g):
        return math.copysign(max(abs(g) - s.l1, 0.0), g)

    def quality(rows):
        return pull(g[rows].sum()) ** 2 / (h[rows].sum() + s.l2)

    def best(rows):
        found = (-math.inf, None, None)
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) < s.min_rows or min(h[left].sum(), h[right].sum()) < s.min_hessian:
                    continue
                gain = round(quality(left) + quality(right) - quality(rows), tt.DIGITS)
                if gain > found[0]:
                    found = (gain, left, right)
        return found

    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(leaves) < s.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            if leaves[k][1][0] <= 0:
                break
            _, left, right = leaves.pop(k)[1]
            leaves += [(left, best(left)), (right, best(right))]
        for rows, _ in leaves:
            margin[rows] -= s.learning_rate * pull(g[rows].sum()) / (h[rows].sum() + s.l2)
    return margin


def fitted(df, settings, keys=("id",)):
    bins = tt.fit_bins(df, FEATURES)
    stored = save(tt.with_bins(df, bins, ["id", "y", "w"]), "test-bins")
    return tt.fit_boosted(stored, bins, "y", "w", settings, keys)


@pytest.mark.parametrize(
    "settings",
    [
        tt.BoostSettings(rounds=3, leaves=5, l2=0.5, min_rows=10, store_every=2),
        tt.BoostSettings(rounds=2, leaves=8, l1=1.0, l2=0.1, min_rows=25, learning_rate=0.4),
    ],
)
def test_boosting_matches_a_plain_search(table, settings):
    df, x, y, w = table
    model = fitted(df, settings)
    margins = {r["id"]: r["m"] for r in df.select("id", model.margin().alias("m")).collect()}
    assert [margins[i] for i in range(len(y))] == pytest.approx(brute_boost(x, y, w, settings), abs=1e-6)


def test_the_table_holds_whole_trees(spark, table):
    df, *_ = table
    model = fitted(df, tt.BoostSettings(rounds=4, leaves=6, min_rows=5))
    rows = model.table(spark).collect()
    for tree in range(4):
        nodes = {r["node"]: r for r in rows if r["tree"] == tree}
        inner = [r for r in nodes.values() if r["feature"] >= 0]
        assert len(nodes) == 2 * len(inner) + 1 <= 11 and nodes[0]["rows"] == 500
        assert all(nodes[r["left"]]["rows"] + nodes[r["right"]]["rows"] == r["rows"] and r["gain"] > 0 for r in inner)
        assert min(r["rows"] for r in nodes.values()) >= 5
    shares = model.importances(spark).collect()
    assert sum(r["importance"] for r in shares) == pytest.approx(1) and [r["importance"] for r in shares] == sorted((r["importance"] for r in shares), reverse=True)
    assert sum(r["splits"] for r in shares) == sum(r["feature"] >= 0 for r in rows)


def test_missing_values_go_left_and_sampling_repeats(table):
    df, *_ = table
    holes = df.withColumn("a", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit(math.nan)).otherwise(F.col("a")))
    settings = tt.BoostSettings(rounds=3, leaves=4, row_share=0.6, feature_share=0.67, min_rows=5)
    one, two = fitted(holes, settings), fitted(holes.repartition(5), settings)
    assert [(n.tree, n.node, n.feature, n.cut, n.rows) for n in one.nodes] == [(n.tree, n.node, n.feature, n.cut, n.rows) for n in two.nodes]
    assert all(250 < n.rows < 350 for n in one.nodes if n.node == 0)
    rows = holes.select(F.coalesce(F.nanvl("a", F.lit(None)), F.lit(-1e9)).alias("a"), "b", "c", one.margin().alias("m"))
    again = rows.select("m", one.margin().alias("same")).collect()
    assert all(r["m"] == pytest.approx(r["same"]) for r in again)


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5_000).select(F.col("id").cast("double").alias("v"), F.lit(None).cast("double").alias("none"), F.lit(3.0).alias("same"))
    bins = tt.fit_bins(df, ["v", "none", "same"], most=16)
    assert len(bins.cuts[0]) == 16 and bins.cuts[1:] == ((), ())
    sizes = tt.with_bins(df, bins, ["v"]).groupBy(F.col("bins")[0].alias("b")).count().collect()
    assert all(r["count"] < 500 for r in sizes)


def test_one_class_is_refused_and_no_split_is_a_base(spark, table):
    df, *_ = table
    with pytest.raises(EmptySourceError):
        fitted(df.where("y = 1"), tt.BoostSettings(rounds=1))
    model = fitted(df, tt.BoostSettings(rounds=3, min_rows=400))
    assert model.nodes == () and df.select(model.margin().alias("m")).distinct().count() == 1
    assert tt.TreeModel(("a",), 0.5, ()).table(spark).count() == 0
