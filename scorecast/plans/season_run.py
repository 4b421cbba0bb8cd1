"""The whole run: features, backtest of one season, and the scores of a coming week."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from scorecast.operators import market
from scorecast.operators.features import FEATURES
from scorecast.operators.models import BOOSTED_TREES, RANDOM_FOREST, assemble
from scorecast.operators.plays import roster_positions
from scorecast.plans.backtest import Backtest, Evaluation, evaluate_stack, stack, tune
from scorecast.plans.feature_table import Inputs, build_histories, encode, lagged_features, opponent_codes
from scorecast.plans.week_scores import PROBABILITY, score_week, scoring_frame
from scorecast.sources import tables
from scorecast.sources.store import save


@dataclass(frozen=True)
class Paths:
    """Where the sources are: Parquet for the first four, CSV for the rest."""

    weekly: str
    plays: str
    rosters: str
    schedule: str
    historical_odds: str
    teams: str
    upcoming_lines: str
    prices: str


@dataclass(frozen=True)
class Settings:
    seasons: Sequence[int]
    validation_season: int
    season: int
    week: int
    draws: int = 25
    n_splits: int = 5
    n_folds: int = 5
    fold_by: str = "stratified"
    parallelism: int = 4
    min_usage: bool = False
    max_fit_rows: int | None = None  # about so many rows at most for any fit; all are scored
    grids: Mapping[str, Mapping[str, Sequence[Any]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Run:
    backtests: dict[str, Backtest]
    stacked: Evaluation
    predictions: DataFrame
    path: str
    doubts: dict[str, DataFrame]  # what ``doubts`` found


def read_inputs(spark: SparkSession, paths: Paths, seasons: Sequence[int]) -> tuple[Inputs, DataFrame]:
    """The inputs of the feature table, and the team ids."""
    ids = market.team_ids(tables.read_teams(spark, paths.teams))
    inputs = Inputs(
        weekly=tables.read_weekly(spark, paths.weekly, seasons),
        plays=tables.read_plays(spark, paths.plays, seasons),
        positions=roster_positions(tables.read_rosters(spark, paths.rosters, seasons)),
        lines=market.team_game_lines(tables.read_historical_odds(spark, paths.historical_odds), ids, seasons),
    )
    return inputs, ids


def doubts(frame: DataFrame, lines: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """What makes rows of the coming week uncertain; all tables are empty if nothing does.

    Teams without a line score as if it were 0, players listed twice are
    scored twice, and a name with several prices or players meets the longest
    price for each of them.
    """
    return {
        "teams_without_line": market.uncovered_teams(frame, "team", lines, "team"),
        "repeated_players": tables.duplicate_keys(frame, ["player_id"]),
        "names_with_several_prices": tables.duplicate_keys(market.price_table(prices), ["merge_name"]),
        "names_of_several_players": market.shared_names(frame),
    }


def run(spark: SparkSession, paths: Paths, settings: Settings, output: str) -> Run:
    """Tune both learners and their stack on the validation season, then score the coming week with everything.

    Predictions are in the order of their column ``rank``. They are written as CSV below ``output``, in a folder named after season and week.
    """
    inputs, ids = read_inputs(spark, paths, settings.seasons)
    histories = build_histories(inputs, check=True)
    lagged = save(lagged_features(histories), "features", partition_by="season", rebalance=True)

    known = encode(lagged, opponent_codes(histories, settings.validation_season))
    backtests = {
        learner.name: tune(
            known,
            settings.validation_season,
            learner,
            draws=settings.draws,
            n_splits=settings.n_splits,
            grid=settings.grids.get(learner.name),
            parallelism=settings.parallelism,
            max_fit_rows=settings.max_fit_rows,
        )
        for learner in (RANDOM_FOREST, BOOSTED_TREES)
    }
    params = {name: backtest.search.best_params for name, backtest in backtests.items()}
    folds = {
        "n_folds": settings.n_folds,
        "fold_by": settings.fold_by,
        "parallelism": settings.parallelism,
        "max_fit_rows": settings.max_fit_rows,
    }
    _, stacked = evaluate_stack(known, settings.validation_season, params, **folds)

    codes = opponent_codes(histories)
    final = stack(encode(lagged, codes), params, **folds)
    upcoming = market.consolidate_lines(tables.read_upcoming_lines(spark, paths.upcoming_lines), ids)
    coming = scoring_frame(
        histories,
        tables.read_schedule(spark, paths.schedule, [settings.season]),
        tables.read_rosters(spark, paths.rosters, [settings.season]),
        settings.season,
        settings.week,
        opponents=codes,
        lines=upcoming,
    )
    frame = save(coming, "coming-week")
    prices = tables.read_prices(spark, paths.prices)
    scored = score_week(assemble(frame, FEATURES), final.score, prices, min_usage=settings.min_usage)
    # Files are read back in any order, so the order is in a column, and every reader sorts by it.
    predictions = save(market.with_rank(scored, PROBABILITY, ["player_id"]), "predictions").orderBy("rank")
    path = tables.write_predictions(predictions, output, settings.season, settings.week)
    return Run(backtests, stacked, predictions, path, doubts(frame, upcoming, prices))
