"""Forests grown by level, and the search that scores all draws at once, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecast.errors import EmptySourceError
from scorecast.operators import forest_tables as forest
from scorecast.operators import tree_search, tree_tables
from scorecast.operators.folds import with_blocks
from scorecast.operators.search import draw_params
from scorecast.sources.store import save

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 9, 400), rng.integers(0, 25, 400) / 2, rng.integers(0, 3, 400)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)) ^ (rng.random(400) < 0.1)
    w = np.where(y, 1.5, 1.0)
    rows = [(i, 2000 + i % 3, i % 18, *map(float, r), int(v), float(u)) for i, (r, v, u) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "id long, season int, week int, a double, b double, c double, y int, w double"), x, y.astype(float), w


def fitted(df, settings):
    bins = tree_tables.fit_bins(df, FEATURES)
    stored = save(tree_tables.with_bins(df, bins, ["id", "y", "w"]), "test-bins")
    return forest.fit_forest(stored, bins, "y", "w", settings, ["id"])


def brute_tree(x, y, w, s):
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in (sorted(set(c)) for c in x.T)]

    def impurity(rows):
        p, total = (w * y)[rows].sum(), w[rows].sum()
        return 2 * p * (total - p) / total

    def grow(rows, depth):
        best = (0.0, None, None, None)
        if len(rows) >= s.min_samples_split and (s.max_depth is None or depth < s.max_depth):
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= s.min_samples_leaf:
                        gain = round(impurity(rows) - impurity(left) - impurity(right), tree_tables.DIGITS)
                        if gain > best[0]:
                            best = (gain, left, right, f)
        if best[1] is None:
            p[rows] = (w * y)[rows].sum() / w[rows].sum()
        else:
            grow(best[1], depth + 1)
            grow(best[2], depth + 1)

    p = np.zeros(len(y))
    grow(np.arange(len(y)), 0)
    return p


@pytest.mark.parametrize(
    "settings",
    [
        forest.ForestSettings(trees=2, max_depth=3, min_samples_split=30, min_samples_leaf=4, max_features="all", bootstrap=False),
        forest.ForestSettings(trees=1, min_samples_split=40, max_features="all", bootstrap=False),
    ],
)
def test_whole_trees_match_a_plain_search(table, settings):
    df, x, y, w = table
    model = fitted(df, settings)
    found = {r["id"]: r["p"] for r in df.select("id", model.probability().alias("p")).collect()}
    assert [found[i] for i in range(len(y))] == pytest.approx(brute_tree(x, y, w, settings), abs=1e-9)


def test_bagged_trees_differ_repeat_and_keep_their_minima(table):
    df, x, y, _ = table
    settings = forest.ForestSettings(trees=15, max_depth=6, min_samples_split=20, min_samples_leaf=3)
    model, again = fitted(df, settings), fitted(df.repartition(5), settings)
    assert [(n.tree, n.node, n.feature, n.cut, n.rows) for n in model.nodes] == [(n.tree, n.node, n.feature, n.cut, n.rows) for n in again.nodes]
    roots = [n for n in model.nodes if n.node == 0]
    assert len(roots) == 15 and len({n.rows for n in roots}) > 5 and abs(np.mean([n.rows for n in roots]) - 400) < 20
    assert len({n.feature for n in roots}) > 1  # sqrt(3) is one feature a node
    assert min(n.rows for n in model.nodes) >= 3 and all(n.rows >= 20 for n in model.nodes if n.feature >= 0)
    right = df.select(((model.probability() > 0.5).cast("int") == F.col("y")).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert right > 0.8


def test_draws_per_row_follow_a_poisson_law(spark):
    s = forest.ForestSettings()
    rows = spark.range(20_000).select(forest._times(F.xxhash64("id"), F.lit(3), s).alias("t")).groupBy("t").count().collect()
    shares = {r["t"]: r["count"] / 20_000 for r in rows}
    assert [shares[k] for k in range(3)] == pytest.approx([0.3679, 0.3679, 0.1839], abs=0.012)


def test_forest_edges(table):
    df, *_ = table
    with pytest.raises(EmptySourceError):
        fitted(df.limit(0), forest.ForestSettings(trees=2))
    model = fitted(df.where("y = 1"), forest.ForestSettings(trees=2, bootstrap=False))
    assert [n.value for n in model.nodes] == [1.0, 1.0]


def test_the_grids_are_whole():
    assert len(draw_params(forest.FOREST_GRID, 10_000)) == 360 and len(draw_params(tree_tables.BOOST_GRID, 10_000)) == 972


@pytest.mark.parametrize("learner", [tree_search.FOREST, tree_search.BOOSTED])
def test_search_scores_like_one_fit_after_the_other(table, learner):
    df, *_ = table
    small = {"trees": [2, 3], "max_depth": [2]} if learner.name == "forest" else {"rounds": [1, 2], "leaves": [3], "min_rows": [5]}
    found = tree_search.search(df, FEATURES, "y", ["id"], learner, draws=2, n_splits=2, grid=small)
    scores = {(r["draw"], r["fold"]): r["f1"] for r in found.scores.collect()}
    assert set(scores) == {(d, f) for d in range(2) for f in (1, 2)}
    blocks = save(tree_tables.with_bins(with_blocks(df, 2), found.bins, ["id", "y", "block", *FEATURES]), "test-blocks")
    for (draw, fold), score in scores.items():
        params = draw_params(small, 2, tree_search.SEED)[draw]
        model = learner.fit(blocks.where(F.col("block") < fold), found.bins, "y", ["id"], params)
        rows = blocks.where(F.col("block") == fold).select("y", (model.probability() >= 0.5).alias("p")).collect()
        tp, wrong = sum(r["p"] and r["y"] for r in rows), sum(r["p"] != bool(r["y"]) for r in rows)
        assert score == pytest.approx(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
    assert found.params in draw_params(small, 2, tree_search.SEED) and found.model.nodes
