"""From plays, weekly rows, rosters and lines to one row of features per player and week."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.functions.columns import fill_missing
from scorecast.operators import features as ft
from scorecast.operators.market import require_coverage
from scorecast.operators.play_sums import PlaySums, play_sums
from scorecast.operators.plays import ZONES
from scorecast.operators.windows import lagged_means
from scorecast.sources.store import save, save_together
from scorecast.sources.tables import require_unique

SHARES = [f"{zone}_{kind}_share" for zone in ZONES for kind in ("carry", "target")]


@dataclass(frozen=True)
class Inputs:
    """The tables a feature table is made from.

    weekly: one row per player, team and week. plays: one row per play.
    positions: one row per player, or player and season. lines: one row per
    team and week, as ``team_game_lines`` gives them.
    """

    weekly: DataFrame
    plays: DataFrame
    positions: DataFrame
    lines: DataFrame


@dataclass(frozen=True)
class Histories:
    """Stored tables without lags, from which feature rows and coming weeks are both made."""

    players: DataFrame
    offences: DataFrame
    defences: DataFrame


def player_history(inputs: Inputs, sums: PlaySums) -> DataFrame:
    labelled = ft.label_weekly(inputs.weekly)
    return save(ft.join_players(labelled, sums.usage_share(), SHARES), "players")


def offence_games(players: DataFrame, inputs: Inputs, sums: PlaySums) -> DataFrame:
    return ft.team_games(players, "recent_team", sums.drive_conversion(), ft.lines_by_team(inputs.lines))


def defence_games(players: DataFrame, inputs: Inputs, sums: PlaySums) -> DataFrame:
    return ft.team_games(
        players,
        "opponent_team",
        sums.allowed_by_team(),
        sums.allowed_by_position(inputs.positions),
    )


def build_histories(inputs: Inputs, check: bool = False) -> Histories:
    """Three stored tables: player weeks with usage, and the games of offences and of defences.

    The plays are read once, for all their aggregates together.

    ``check`` fails on repeated keys, which would multiply rows or counts, and
    on teams that have no lines at all, whose totals would silently be 0.
    """
    sums = play_sums(inputs.plays)
    players = player_history(inputs, sums)
    offences, defences = save_together(
        {"offences": offence_games(players, inputs, sums), "defences": defence_games(players, inputs, sums)}
    )
    histories = Histories(players, offences, defences)
    if check:
        keys = [key for key in ("player_id", "season") if key in inputs.positions.columns]
        require_unique(inputs.positions, keys, "positions")
        require_unique(histories.players, ft.PLAYER_WEEK, "weekly rows")
        require_unique(histories.offences, ["recent_team", "season", "week"], "lines")
        require_coverage(histories.offences, "recent_team", inputs.lines, "team")
    return histories


def raw_features(histories: Histories) -> DataFrame:
    """Player weeks with what happened in that very week: for study, not for training."""
    return ft.join_teams(histories.players, histories.defences, histories.offences)


def lagged_features(histories: Histories) -> DataFrame:
    """Player weeks whose ``avg_`` columns know only earlier weeks.

    Team means run over team games, so that team-mates share one value and
    their own game never enters it; they are then looked up by each player.
    """
    order = ["season", "week"]
    defences, offences = save_together(
        {
            "defence-means": lagged_means(histories.defences, ["opponent_team"], order, ft.DEFENCE_MEANS),
            "offence-means": lagged_means(histories.offences, ["recent_team"], order, ft.OFFENCE_MEANS),
        }
    )
    players = lagged_means(histories.players, ["player_id"], ft.PLAYER_ORDER, ft.PLAYER_MEANS)
    joined = ft.join_teams(fill_missing(players, list(ft.PLAYER_MEANS)), defences, offences)
    return joined.withColumn("positional_matchup_interaction", ft.matchup_interaction())


def encode(df: DataFrame, opponents: StringIndexerModel) -> DataFrame:
    return opponents.transform(ft.position_codes().transform(df))


def opponent_codes(histories: Histories, fit_before: int | None = None) -> StringIndexerModel:
    """Codes of the defences seen, in all seasons or in those before ``fit_before``."""
    seen = histories.defences
    if fit_before is not None:
        seen = seen.where(F.col("season") < fit_before)
    return ft.sorted_codes(seen, "opponent_team", "opponent_encoded")


def features_from(histories: Histories, opponents: StringIndexerModel) -> DataFrame:
    return encode(lagged_features(histories), opponents)


def build_features(inputs: Inputs, fit_before: int | None = None) -> DataFrame:
    """The whole feature table; codes are fitted on seasons before ``fit_before``, if given."""
    histories = build_histories(inputs)
    return features_from(histories, opponent_codes(histories, fit_before))
