"""The player-week feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.functions.columns import fill_missing, scored
from scorecast.operators.plays import ALLOWED_BY_POSITION, POSITIONS

LABEL = "scored_touchdown"
LAST_WEEK = 18
PLAYER_WEEK = ["player_id", "recent_team", "season", "week"]
PLAYER_ORDER = ["season", "week", "recent_team"]
ALLOWED = [f"{kind}_tds_allowed_to_{position}" for kind, position in ALLOWED_BY_POSITION]

# The lagged means of players, offences and defences, in rows.
PLAYER_MEANS = {
    "avg_carries": ("carries", 3),
    "avg_rushing_yards": ("rushing_yards", 3),
    "avg_receptions": ("receptions", 3),
    "avg_receiving_yards": ("receiving_yards", 3),
    "avg_wopr": ("wopr", 3),
    "avg_rushing_epa": ("rushing_epa", 3),
    "avg_receiving_epa": ("receiving_epa", 3),
    "avg_target_share": ("target_share", 3),
    "avg_touchdowns": (LABEL, 5),
    "avg_redzone_carry_share": ("redzone_carry_share", 5),
    "avg_redzone_target_share": ("redzone_target_share", 5),
    "avg_inside_5_carry_share": ("inside_5_carry_share", 5),
    "avg_inside_5_target_share": ("inside_5_target_share", 5),
}
OFFENCE_MEANS = {"avg_redzone_td_rate": ("redzone_td_rate", 5)}
DEFENCE_MEANS = {f"avg_{column}": (column, 5) for column in ["epa_allowed", *ALLOWED]}

FEATURES = [
    *PLAYER_MEANS,
    "avg_epa_allowed",
    "avg_redzone_td_rate",
    *[f"avg_{column}" for column in ALLOWED],
    "positional_matchup_interaction",
    "implied_total",
    "position_encoded",
    "opponent_encoded",
]


def label_weekly(
    weekly: DataFrame, last_week: int = LAST_WEEK, positions: Sequence[str] = tuple(POSITIONS)
) -> DataFrame:
    """Regular-season rows of the four positions, labelled, missing numbers 0."""
    kept = weekly.where((F.col("week") <= last_week) & F.col("position").isin(list(positions)))
    label = scored(F.col("rushing_tds"), F.col("receiving_tds"))
    return fill_missing(kept.withColumn(LABEL, label), keys=PLAYER_WEEK)


def team_games(players: DataFrame, team: str, *tables: DataFrame) -> DataFrame:
    """One row per game of ``team``, with the columns of every table, 0 where a table has no row.

    A week in which nothing happened must enter the means as 0, so the games
    come from the players and not from the tables.
    """
    keys = [team, "season", "week"]
    games = players.select(*keys).where(F.col(team).isNotNull()).distinct()
    for table in tables:
        games = games.join(table, keys, "left")
    return fill_missing(games, keys=keys)


def join_players(players: DataFrame, usage: DataFrame, shares: Sequence[str]) -> DataFrame:
    """Add a player's usage shares; the team is part of the key, as a player may change teams within a week."""
    usage = usage.withColumnRenamed("posteam", "recent_team").select(*PLAYER_WEEK, *shares)
    return fill_missing(players.join(usage, PLAYER_WEEK, "left"), shares)


def join_teams(players: DataFrame, *tables: DataFrame) -> DataFrame:
    """Add team tables by the keys they share with the players; missing numbers become 0.

    The tables are small and stored, so the optimiser broadcasts them while
    their file size allows and shuffles otherwise.
    """
    for table in tables:
        team = "opponent_team" if "opponent_team" in table.columns else "recent_team"
        added = [column for column in table.columns if column not in (team, "season", "week")]
        players = fill_missing(players.join(table, [team, "season", "week"], "left"), added)
    return players


def lines_by_team(lines: DataFrame) -> DataFrame:
    return lines.withColumnRenamed("team", "recent_team").select(
        "recent_team", "season", "week", "spread_line", "total_line", "implied_total"
    )


def matchup_interaction(prefix: str = "avg_") -> Column:
    """A player's part in the zone times what the opponent allows to the position."""
    carries, targets = F.col(f"{prefix}redzone_carry_share"), F.col(f"{prefix}redzone_target_share")

    def rushing(position: str) -> Column:
        return carries * F.col(f"{prefix}rushing_tds_allowed_to_{position}")

    def passing(position: str) -> Column:
        return targets * F.col(f"{prefix}passing_tds_allowed_to_{position}")

    position = F.col("position")
    return (
        F.when(position == "RB", rushing("RB") + passing("RB"))
        .when(position == "WR", passing("WR"))
        .when(position == "TE", passing("TE"))
        .when(position == "QB", rushing("QB"))
        .otherwise(0.0)
    )


def sorted_codes(df: DataFrame, column: str, code: str) -> StringIndexerModel:
    """Codes in alphabetical order, fitted on the distinct values; an unseen value gets one code more."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    indexer = StringIndexer(inputCol=column, outputCol=code, stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(values)


def position_codes(code: str = "position_encoded") -> StringIndexerModel:
    return StringIndexerModel.from_labels(POSITIONS, inputCol="position", outputCol=code, handleInvalid="keep")
