"""Randomised search over tree models: one store of bins for all fits, one scan that scores all draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.operators.evaluate import f1, predicted
from scorecast.operators.folds import with_blocks
from scorecast.operators.forest_tables import FOREST_GRID, ForestSettings, fit_forest
from scorecast.operators.models import SEED, WEIGHT, with_weight
from scorecast.operators.search import draw_params
from scorecast.operators.tree_tables import BOOST_GRID, Bins, BoostSettings, TreeModel, fit_bins, fit_boosted, with_bins
from scorecast.session import side_by_side
from scorecast.sources.store import save


@dataclass(frozen=True)
class TreeLearner:
    """A kind of tree model: how to fit it on bins, how classes are weighted, and what is searched."""

    name: str
    weighting: str
    grid: Mapping[str, Sequence[Any]]

    def fit(self, binned: DataFrame, bins: Bins, label: str, keys: Sequence[str], params: Mapping[str, Any]) -> TreeModel:
        weighed = with_weight(binned, label, self.weighting)
        if self.name == "forest":
            return fit_forest(weighed, bins, label, WEIGHT, ForestSettings(**params), keys)
        return fit_boosted(weighed, bins, label, WEIGHT, BoostSettings(**params), keys)


FOREST = TreeLearner("forest", "balanced", FOREST_GRID)
BOOSTED = TreeLearner("boosted", "positive", BOOST_GRID)


def score_draws(rows: DataFrame, probabilities: Mapping[int, Sequence[Column]], label: str, threshold: float = 0.5) -> DataFrame:
    """(draw, fold, tp, fp, fn, f1) for every draw and fold, from one scan and one aggregation.

    ``probabilities`` holds a column for each draw, by the ``block`` of the rows that a fold is tested on.
    """
    scored = F.lit(None).cast("array<double>")
    for block, columns in probabilities.items():
        scored = F.when(F.col("block") == block, F.array(*columns)).otherwise(scored)
    each = rows.select(F.col("block").alias("fold"), (F.col(label) == 1).alias("actual"), F.posexplode(scored).alias("draw", "p"))
    positive, actual = predicted(F.col("p"), threshold) == 1, F.col("actual")
    counts = each.groupBy("draw", "fold").agg(
        F.count_if(positive & actual).alias("tp"), F.count_if(positive & ~actual).alias("fp"), F.count_if(~positive & actual).alias("fn")
    )
    return counts.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


@dataclass(frozen=True)
class Found:
    params: dict[str, Any]
    scores: DataFrame
    model: TreeModel
    bins: Bins


def search(
    df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], learner: TreeLearner, draws: int, n_splits: int = 5, grid: Mapping[str, Sequence] | None = None, threads: int = 4
) -> Found:
    """Draw settings, fit each on expanding folds, score all of them together, and fit the best on all rows.

    Bins are fitted on all training rows and stored once, a small number a
    value, with the fold's block; every fit reads them. ``df`` has season and
    week. The best draw has the highest mean F1, of equal ones the first.
    """
    drawn = draw_params(grid or learner.grid, draws, SEED)
    bins = fit_bins(df, features)
    binned = save(with_bins(with_blocks(df, n_splits), bins, [*dict.fromkeys([*keys, label, "block"])]), "search-bins")
    tasks = [(fold, params) for fold in range(1, n_splits + 1) for params in drawn]
    models = side_by_side(df.sparkSession, lambda t: learner.fit(binned.where(F.col("block") < t[0]), bins, label, keys, t[1]), tasks, threads)
    by_fold = {fold: [m.probability(bins) for (f, _), m in zip(tasks, models, strict=True) if f == fold] for fold in range(1, n_splits + 1)}
    scores = save(score_draws(binned, by_fold, label), "search-scores")
    means = scores.groupBy("draw").agg(F.avg("f1").alias("mean")).orderBy(F.desc("mean"), "draw").first()
    best = drawn[means["draw"]]
    return Found(best, scores, learner.fit(binned, bins, label, keys, best), bins)

