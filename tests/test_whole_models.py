"""Queries that fit models: whole ones, on the rows they need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import model_queries
from checks.asof_queries import SEASON
from scorecast.operators import features as ft
from scorecast.operators.models import BOOSTED_TREES
from scorecast.sources.store import save


class Seen(Exception):
    pass


def test_gbt_score_fits_a_whole_boosted_model(monkeypatch):
    fitted = []
    monkeypatch.setattr(model_queries, "_held_out_scores", lambda spark, sf_dir, *fit: fitted.append(fit))
    model_queries.gbt_score(None, "")
    [(learner, params)] = fitted
    assert learner is BOOSTED_TREES
    assert params["maxIter"] >= min(learner.grid["maxIter"]) and 2 ** params["maxDepth"] >= 31
    assert params["stepSize"] == pytest.approx(0.1)


def test_random_search_reads_training_seasons_alone(spark, monkeypatch):
    columns = {c: F.lit(1.0) for c in ft.FEATURES} | {"week": F.lit(1), "season": F.lit(SEASON) - F.col("id") % 3, ft.LABEL: F.lit(1)}
    stored = save(spark.range(30).select(*[c.alias(name) for name, c in columns.items()]), "seasons", partition_by="season")

    def seen(df, *rest):
        raise Seen(df._jdf.queryExecution().executedPlan().toString(), df.count())

    monkeypatch.setattr(model_queries, "features", lambda spark, sf_dir: stored)
    monkeypatch.setattr(model_queries, "prepare", seen)
    with pytest.raises(Seen) as found:
        model_queries.search(spark, "")
    plan, rows = found.value.args
    assert "PartitionFilters: [isnotnull(season" in plan and rows == 20
