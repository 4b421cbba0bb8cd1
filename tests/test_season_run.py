"""From files to predictions on a small league, and the parts in between."""

from __future__ import annotations

import csv

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from scorecast.errors import DuplicateKeyError, EmptySourceError, UnmappedTeamError
from scorecast.operators import features as ft
from scorecast.operators.folds import hashed_folds, season_split, with_blocks
from scorecast.operators.models import BOOSTED_TREES, RANDOM_FOREST, Learner, assemble, importances, with_probability
from scorecast.operators.search import _LastFoldModels, draw_params, prepare, random_search
from scorecast.operators.stacking import out_of_fold
from scorecast.plans import backtest, season_run
from scorecast.plans.backtest import stack
from scorecast.plans.feature_table import Inputs, build_histories, encode, lagged_features, opponent_codes
from scorecast.plans.week_scores import PROBABILITY, score_week, scoring_frame
from scorecast.sources import schemas, tables
from scorecast.sources.store import save
from tests import league
from tests.conftest import records

SMALL = {"rf": {"numTrees": 5, "maxDepth": 3}, "gbt": {"maxIter": 2, "maxDepth": 2}}


def write_text(path, header, rows):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\r\n")
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("league")
    made = league.build()

    def parquet(name, rows, columns, schema):
        fields = {f.name: f.dataType.simpleString() for f in schema.fields}
        ddl = ", ".join(f"{c} {fields[c]}" for c in columns)
        df = spark.createDataFrame(rows, ddl)
        path = str(folder / name)
        df.write.partitionBy("season").parquet(path)
        return path

    weekly = (
        "player_id player_display_name position recent_team opponent_team season week carries rushing_yards"
        " rushing_tds receptions targets receiving_yards receiving_tds wopr rushing_epa receiving_epa target_share"
    ).split()
    plays = (
        "season week posteam defteam drive yardline_100 rush_attempt pass_attempt rusher_player_id"
        " receiver_player_id touchdown rush_touchdown pass_touchdown epa"
    ).split()
    price_rows = [
        ["", "", n.upper().replace("PLAYER", "Play'er") + " II", p]
        for (_, n, *_), p in zip(league.players(), range(-150, 2000, 75), strict=False)
    ] + [["", "", "Rookie RaMon", 900], ["", "", "Alphas D/ST", 500]]
    return season_run.Paths(
        weekly=parquet("weekly", made["weekly"], weekly, schemas.WEEKLY),
        plays=parquet("plays", made["plays"], plays, schemas.PLAYS),
        rosters=parquet("rosters", made["rosters"], schemas.ROSTERS.names, schemas.ROSTERS),
        schedule=parquet("schedule", made["schedule"], "season week home_team away_team".split(), schemas.SCHEDULE),
        historical_odds=write_text(
            folder / "odds.csv",
            ["schedule_date", "schedule_season", "schedule_week", "team_home", "team_away", "team_favorite_id",
             "spread_favorite", "over_under_line", "schedule_playoff", "weather_detail"],
            [["9/9/2021", *row, ""] for row in made["odds"]]
            + [["1/9/2022", "2021", "Wildcard", "Alphas", "Betas", "AAA", "-3", "", "TRUE", "rain"]],
        ),
        teams=write_text(
            folder / "teams.csv",
            ["team_name", "team_name_short", "team_id"],
            [[league.NAMES[t], t.lower(), league.DIMENSION_IDS[t]] for t in league.TEAMS],
        ),
        upcoming_lines=write_text(
            folder / "lines.csv",
            ["game_id", "home_team", "away_team", "market", "point_1", "label_2", "odd_2", "point_2", "over/under"],
            [["g1", "Alphas", "Deltas", "spreads", "-3", "Deltas", "1.9", "3", "45.5"],
             ["g2", "Gammas", "Betas", "spreads", "2.5", "Betas", "1.9", "-2.5", "41"]],
        ),
        prices=write_text(folder / "prices.csv", ["", "", "description", "price"], price_rows),
    )


@pytest.fixture(scope="module")
def inputs(spark, paths):
    return season_run.read_inputs(spark, paths, league.SEASONS)[0]


@pytest.fixture(scope="module")
def histories(inputs):
    return build_histories(inputs, check=True)


@pytest.fixture(scope="module")
def features(histories):
    return save(encode(lagged_features(histories), opponent_codes(histories)), "features", partition_by="season")


def test_csv_sources(spark, paths):
    prices = tables.read_prices(spark, paths.prices)
    assert prices.columns == ["description", "price"] and prices.where("price IS NULL").count() == 0
    assert prices.first().description.startswith("Play'er") or "PLAY" in prices.first().description.upper()
    lines = tables.read_upcoming_lines(spark, paths.upcoming_lines).collect()
    assert [(r["home_team"], r["point_1"], r["over/under"]) for r in lines] == [
        ("Alphas", "-3", "45.5"),
        ("Gammas", "2.5", "41"),
    ]
    odds = tables.read_historical_odds(spark, paths.historical_odds)
    assert odds.where("schedule_playoff").count() == 1
    assert odds.where("schedule_week = 'Wildcard' AND over_under_line IS NULL").count() == 1


def test_parquet_sources_prune_seasons_and_push_filters(spark, paths):
    plays = tables.read_plays(spark, paths.plays, [2022], last_week=3)
    assert {(r.season, r.week) for r in plays.select("season", "week").distinct().collect()} == {
        (2022, 1),
        (2022, 2),
        (2022, 3),
    }
    plan = plays.where("yardline_100 <= 5").select("posteam")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert "LessThanOrEqual(yardline_100," in plan and "LessThanOrEqual(week,3)" in plan
    weekly = tables.read_weekly(spark, paths.weekly, [2022])
    assert weekly.where("receiving_epa IS NOT NULL").count() == 0  # NaN in the file


def test_guards(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert tables.require_rows(df, "x") is df and tables.require_unique(df, ["a", "b"], "x") is df
    with pytest.raises(EmptySourceError, match="the schedule"):
        tables.require_rows(df.where("a > 1"), "the schedule")
    with pytest.raises(DuplicateKeyError, match="by a"):
        tables.require_unique(df, ["a"], "x")


def test_keys_of_the_feature_table(features, histories):
    tables.require_unique(features, ft.PLAYER_WEEK, "features")
    assert features.count() == histories.players.count()
    assert set(ft.FEATURES) <= set(features.columns) and len(ft.FEATURES) == 25
    assert features.where(" OR ".join(f"{c} IS NULL" for c in ft.FEATURES)).count() == 0
    assert features.where("position = 'K'").count() == 0


def test_first_games_have_no_past(features):
    first = features.where("season = 2021 AND week = 1")
    lagged = [*ft.PLAYER_MEANS, *ft.OFFENCE_MEANS, *ft.DEFENCE_MEANS]
    assert first.where(" OR ".join(f"{c} <> 0" for c in lagged)).count() == 0


def test_team_mates_share_team_means(features):
    per_team = features.groupBy("recent_team", "season", "week").agg(
        *[F.countDistinct(c).alias(c) for c in ["avg_redzone_td_rate", "avg_epa_allowed", "implied_total"]]
    )
    assert per_team.where("avg_redzone_td_rate > 1 OR avg_epa_allowed > 1 OR implied_total > 1").count() == 0


def test_checks_catch_repeated_rows_and_teams_without_lines(inputs):
    doubled = Inputs(inputs.weekly.union(inputs.weekly), inputs.plays, inputs.positions, inputs.lines)
    with pytest.raises(DuplicateKeyError, match="weekly"):
        build_histories(doubled, check=True)
    partial = Inputs(inputs.weekly, inputs.plays, inputs.positions, inputs.lines.where("team <> 'LV'"))
    with pytest.raises(UnmappedTeamError, match="LV"):
        build_histories(partial, check=True)


def test_scoring_frame(spark, paths, histories):
    schedule = tables.read_schedule(spark, paths.schedule, [2025])
    rosters = tables.read_rosters(spark, paths.rosters, [2025])
    codes = opponent_codes(histories)
    frame = scoring_frame(histories, schedule, rosters, 2025, 1, opponents=codes)
    got = records(frame, "player_id")
    assert len(got) == 4 * 6 + 1  # kickers are left out
    rookie = got["AAA-new"]
    assert rookie["opponent_team"] == "LA" and rookie["avg_carries"] == 0.0
    assert rookie["position_encoded"] == 1 and rookie["opponent_encoded"] == 2
    assert rookie["avg_epa_allowed"] == got["AAA-1"]["avg_epa_allowed"] != 0.0
    runner = got["AAA-1"]
    assert runner["positional_matchup_interaction"] == pytest.approx(
        runner["avg_redzone_carry_share"] * runner["avg_rushing_tds_allowed_to_RB"]
        + runner["avg_redzone_target_share"] * runner["avg_passing_tds_allowed_to_RB"]
    )
    assert got["LV-1"]["opponent_team"] == "BBB"
    with pytest.raises(EmptySourceError, match="week 17"):
        scoring_frame(histories, schedule, rosters, 2025, 17)


def test_scoring_a_past_week_equals_its_feature_rows(spark, paths, histories, features):
    """What is known before a week is the same whether the week lies ahead or behind."""
    frame = scoring_frame(
        histories,
        tables.read_schedule(spark, paths.schedule, [2024]),
        tables.read_rosters(spark, paths.rosters, [2024]),
        2024,
        5,
    )
    ahead, behind = records(frame, "player_id"), records(features.where("season = 2024 AND week = 5"), "player_id")
    assert set(behind) == set(ahead)
    means = [*ft.PLAYER_MEANS, *ft.OFFENCE_MEANS, *ft.DEFENCE_MEANS, "positional_matchup_interaction"]
    for player, row in behind.items():
        assert row["opponent_team"] == ahead[player]["opponent_team"]
        for mean in means:
            assert ahead[player][mean] == pytest.approx(row[mean]), (player, mean)


def area(df, probability):
    return BinaryClassificationEvaluator(rawPredictionCol=probability, labelCol=ft.LABEL).evaluate(df)


@pytest.mark.parametrize("learner", [RANDOM_FOREST, BOOSTED_TREES], ids=lambda x: x.name)
def test_learners_find_the_planted_habit(spark, features, learner):
    train, held_out = season_split(assemble(features, ft.FEATURES), 2024)
    model = learner.fit(train, ft.LABEL, SMALL[learner.name])
    scored = with_probability(model, held_out, "p")
    assert scored.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    assert area(scored, "p") > 0.7
    top = importances(spark, model, ft.FEATURES).limit(20).collect()
    assert len(top) == 20 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)


def test_draws_are_different_and_repeatable():
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    drawn = draw_params(grid, 4, seed=1)
    assert drawn == draw_params(grid, 4, seed=1) and len({tuple(d.items()) for d in drawn}) == 4
    assert len(draw_params(grid, 25)) == 6
    assert len(draw_params(RANDOM_FOREST.grid, 25)) == 25


def test_search_scores_every_draw_on_every_fold(spark, features):
    train, _ = season_split(assemble(features, ft.FEATURES), 2024)
    grid = {"numTrees": [2, 4], "maxDepth": [1, 3]}
    found = random_search(prepare(train, ft.LABEL, 2), RANDOM_FOREST, ft.LABEL, draws=3, n_splits=2, grid=grid)
    assert {(d, f) for d, f, _ in found.scores} == {(d, f) for d in range(3) for f in (1, 2)}
    means = [sum(s for d, _, s in found.scores if d == i) / 2 for i in range(3)]
    assert found.best_f1 == max(means) and found.best_params == found.drawn[means.index(max(means))]
    assert found.scores_table(spark).count() == 6


def test_tuning_reads_training_seasons_alone_and_fits_no_model_twice(features, monkeypatch):
    plans, fits = [], []

    def prepared(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return prepare(df, *rest)

    def fitted(learner, weighed, label, params):
        model = fit_weighed(learner, weighed, label, params)
        fits.append((weighed.count(), tuple(params.items())))
        return model

    fit_weighed = Learner.fit_weighed
    monkeypatch.setattr(backtest, "prepare", prepared)
    monkeypatch.setattr(Learner, "fit_weighed", fitted)
    found = backtest.tune(features, 2024, RANDOM_FOREST, draws=2, n_splits=2, grid={"numTrees": [2], "maxDepth": [1, 3]})
    assert "PartitionFilters: [isnotnull(season" in plans[0]
    assert len(fits) == len(set(fits)) == 2 * 2 + 1
    monkeypatch.undo()
    train = prepare(assemble(season_split(features, 2024)[0], ft.FEATURES), ft.LABEL, 2)
    again = RANDOM_FOREST.fit(train.where("block < 2"), ft.LABEL, found.search.best_params)
    assert found.search.last_fold_model.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]
    validation = train.where("block = 2")
    assert found.evaluation.threshold == backtest.threshold_from(validation, lambda df, column: with_probability(again, df, column))


def test_the_search_keeps_the_model_of_the_best_draw_alone():
    kept = _LastFoldModels(2)
    for draw, fold, score in [(0, 2, 0.5), (1, 1, 0.9), (0, 1, 0.5), (1, 2, 0.3), (2, 1, 0.6), (2, 2, 0.4), (3, 2, 0.0)]:
        kept.add(draw, fold, f"model {draw}", score)
    assert kept.of(1) == "model 1" and set(kept._models) == {1, 3}
    kept.add(3, 1, "fold 1", 0.1)
    assert set(kept._models) == {1}


def test_out_of_fold_rows_are_scored_once(features):
    rows = assemble(features, ft.FEATURES).select("features", ft.LABEL, *ft.PLAYER_WEEK)
    folded = hashed_folds(rows, ft.PLAYER_WEEK, 3)
    scored = out_of_fold(folded, [(RANDOM_FOREST, SMALL["rf"])], ft.LABEL, [0, 1, 2], "hash")
    tables.require_unique(scored, ft.PLAYER_WEEK, "out-of-fold rows")
    assert scored.count() == rows.count() and scored.where("p_rf IS NULL").count() == 0


def test_time_folds_never_look_ahead(features):
    rows = assemble(features, ft.FEATURES).select("features", ft.LABEL, *ft.PLAYER_WEEK)
    blocks = with_blocks(rows, 2).withColumnRenamed("block", "fold")
    scored = out_of_fold(blocks, [(RANDOM_FOREST, SMALL["rf"])], ft.LABEL, [1, 2], "time")
    assert scored.count() == blocks.where("fold > 0").count()


@pytest.mark.parametrize("fold_by", ["stratified", "hash", "time"])
def test_stack_scores_unseen_rows(features, fold_by):
    train, held_out = season_split(features, 2024)
    fitted = stack(train, SMALL, n_folds=2, fold_by=fold_by)
    assert set(fitted.bases) == {"rf", "gbt"}
    assert area(fitted.score(assemble(held_out, ft.FEATURES), "p"), "p") > 0.7


def test_stack_leaves_out_learners_without_parameters(features):
    assert set(stack(features, {"rf": SMALL["rf"], "gbt": None}, n_folds=2).bases) == {"rf"}
    with pytest.raises(ValueError, match="no base model"):
        stack(features, {})


def test_scores_are_ranked_and_usage_is_optional(spark, histories, paths):
    frame = scoring_frame(
        histories,
        tables.read_schedule(spark, paths.schedule, [2025]),
        tables.read_rosters(spark, paths.rosters, [2025]),
        2025,
        1,
    )

    def score(df, column):
        return df.withColumn(column, F.col("avg_touchdowns"))

    everyone = score_week(frame, score).collect()
    used = score_week(frame, score, min_usage=True).collect()
    assert len(everyone) == 25 and "AAA-new" not in {r.player_id for r in used}
    values = [r[PROBABILITY] for r in everyone]
    assert values == sorted(values, reverse=True)


def test_whole_run(spark, paths, tmp_path):
    settings = season_run.Settings(
        seasons=league.SEASONS,
        validation_season=2024,
        season=2025,
        week=1,
        draws=2,
        n_splits=2,
        n_folds=2,
        grids={"rf": {"numTrees": [3, 5], "maxDepth": [3]}, "gbt": {"maxIter": [2], "maxDepth": [2, 3]}},
    )
    result = season_run.run(spark, paths, settings, str(tmp_path))
    assert set(result.backtests) == {"rf", "gbt"}
    for backtest in result.backtests.values():
        assert 0.0 <= backtest.evaluation.threshold < 0.7
        assert records(backtest.evaluation.report, "row")["Scored TD"]["f1"] > 0.4
    assert result.stacked.report.count() == 5
    assert result.stacked.held_out_best.first()["f1"] >= records(result.stacked.report, "row")["Scored TD"]["f1"] - 1e-9
    assert result.path.endswith("final_predictions_2025_week_1")
    written = spark.read.option("header", True).csv(result.path)
    assert written.count() == result.predictions.count() == 25
    assert [r.rank for r in result.predictions.collect()] == list(range(1, 26))
    assert written.columns == [
        "rank",
        "player_id",
        "player_name",
        "team",
        "opponent_team",
        "position",
        PROBABILITY,
        "price",
        "market_implied_prob",
        "model_edge",
    ]
    best = records(result.stacked.held_out_best_report, "row")["Scored TD"]["f1"]
    assert best == pytest.approx(result.stacked.held_out_best.first()["f1"])
    assert set(result.doubts) == {
        "teams_without_line", "repeated_players", "names_with_several_prices", "names_of_several_players",
    }
    assert result.doubts["repeated_players"].isEmpty() and result.doubts["names_of_several_players"].isEmpty()
    row = result.predictions.where("player_id = 'AAA-new'").first()
    assert row.price == 900 and row.model_edge == pytest.approx(row[PROBABILITY] - 0.1)


def test_doubts_name_what_is_uncertain(spark):
    frame = spark.createDataFrame(
        [("1", "Al Bo", "A"), ("1", "Al Bo", "B"), ("2", "AL BO", "A"), ("3", None, "C"), ("4", "Cy Do", None)],
        "player_id string, player_name string, team string",
    )
    lines = spark.createDataFrame([("A",), ("B",)], "team string")
    prices = spark.createDataFrame([("Cy Do", 100.0), ("CY DO", 200.0), ("Al Bo", 300.0)], "description string, price double")
    found = {name: [tuple(r) for r in table.collect()] for name, table in season_run.doubts(frame, lines, prices).items()}
    assert found == {
        "teams_without_line": [("C",)],
        "repeated_players": [("1", 2)],
        "names_with_several_prices": [("cy do", 2)],
        "names_of_several_players": [("al bo", 2)],
    }


def test_arguments_fit_the_settings():
    from dataclasses import fields

    from scorecast.__main__ import arguments

    given = [f"--{f.name.replace('_', '-')}=x" for f in fields(season_run.Paths)]
    given += ["--output=o", "--seasons", "2021", "2022", "--validation-season=2022", "--season=2023", "--week=1"]
    parsed = vars(arguments().parse_args(given))
    known = {f.name for f in fields(season_run.Paths)} | {f.name for f in fields(season_run.Settings)}
    assert set(parsed) - known == {"output"} and parsed["seasons"] == [2021, 2022]
