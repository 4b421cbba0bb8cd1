"""Betting lines per team and player prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecast.errors import UnmappedTeamError
from scorecast.functions.columns import (
    american_to_probability,
    edge,
    home_spread,
    implied_total,
    name_key,
    try_number,
    try_whole,
)
from scorecast.sources.store import save

# Team ids that the dimension writes differently from the weekly tables.
TEAM_ALIASES = {"LVR": "LV", "LAR": "LA"}


def team_ids(teams: DataFrame, aliases: Mapping[str, str] = TEAM_ALIASES) -> DataFrame:
    """One team_id per team_name, in the spelling of the weekly tables."""
    team_id = F.col("team_id")
    for written, used in aliases.items():
        team_id = F.when(F.col("team_id") == written, F.lit(used)).otherwise(team_id)
    return (
        teams.where("team_name IS NOT NULL AND team_id IS NOT NULL")
        .groupBy("team_name")
        .agg(F.max(team_id).alias("team_id"))
    )


def map_teams(df: DataFrame, ids: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the id of the team named in each key of ``columns``; an unknown name gives NULL."""
    for name, target in columns.items():
        lookup = ids.select(F.col("team_name").alias(name), F.col("team_id").alias(target))
        df = df.join(lookup, name, "left")
    return df


def alias_team(column: Column, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    for written, used in aliases.items():
        column = F.when(column == written, F.lit(used)).otherwise(column)
    return column


def coerce_odds(odds: DataFrame) -> DataFrame:
    """Text to numbers; rows whose week, total or spread is no number are dropped."""
    return odds.select(
        try_whole(F.col("schedule_season")).alias("season"),
        try_whole(F.col("schedule_week")).alias("week"),
        "team_home",
        "team_away",
        "team_favorite_id",
        try_number(F.col("spread_favorite")).alias("spread_favorite"),
        try_number(F.col("over_under_line")).alias("total_line"),
        "schedule_playoff",
    ).dropna(subset=["week", "total_line", "spread_favorite"])


def both_sides(games: DataFrame, keep: Sequence[str], home: str, away: str, opponent: bool = False) -> DataFrame:
    """One row per team of a game, the away spread being the home spread with its sign turned."""

    def side(team: str, other: str, spread: Column) -> Column:
        fields = [F.col(team).alias("team"), spread.alias("spread_line")]
        return F.struct(*fields, *([F.col(other).alias("opponent")] if opponent else []))

    sides = F.explode(F.array(side(home, away, F.col("home_spread")), side(away, home, -F.col("home_spread"))))
    rows = games.select(*keep, "total_line", sides.alias("side"))
    others = ["side.opponent"] if opponent else []
    return rows.select(*keep, "side.team", *others, "side.spread_line", "total_line").select(
        "*", implied_total(F.col("total_line"), F.col("spread_line")).alias("implied_total")
    )


def team_game_lines(odds: DataFrame, ids: DataFrame, seasons: Sequence[int]) -> DataFrame:
    """Regular-season lines: one row per team and game; teams without an id are dropped."""
    games = coerce_odds(odds).where(F.col("season").isin(list(seasons)) & ~F.col("schedule_playoff"))
    games = map_teams(games, ids, {"team_home": "home_id", "team_away": "away_id"}).withColumn(
        "home_spread",
        home_spread(alias_team(F.col("team_favorite_id")), F.col("home_id"), F.col("spread_favorite")),
    )
    return both_sides(games, ["season", "week"], "home_id", "away_id").dropna(subset=["team"])


def consolidate_lines(
    lines: DataFrame, ids: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("market",)
) -> DataFrame:
    """Upcoming lines: the market rows of a game become one, then one row per team.

    Spread and total are each the first present value by ``order``, then by value.
    """
    mapped = map_teams(lines, ids, {"home_team": "home_id", "away_team": "away_id"}).where(
        "home_id IS NOT NULL AND away_id IS NOT NULL"
    )
    spread, points = try_number(F.col("point_1")), try_number(F.col("over/under"))

    def first_present(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.struct(*order, value)))

    games = mapped.groupBy(*keys, "home_id", "away_id").agg(
        first_present(spread).alias("home_spread"), first_present(points).alias("total_line")
    )
    return both_sides(games, keys, "home_id", "away_id", opponent=True).dropna()


def uncovered_teams(used: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Teams of ``used`` that ``known`` lacks; without this check their lines would silently become 0."""
    wanted = used.select(F.col(column).alias("team")).where("team IS NOT NULL").distinct()
    return wanted.join(known.select(F.col(known_column).alias("team")).distinct(), "team", "left_anti")


def require_coverage(used: DataFrame, column: str, known: DataFrame, known_column: str) -> None:
    missing = [row.team for row in uncovered_teams(used, column, known, known_column).limit(10).collect()]
    if missing:
        raise UnmappedTeamError(f"teams without a counterpart: {', '.join(map(str, sorted(missing)))}")


def price_table(prices: DataFrame) -> DataFrame:
    """Prices with the key to match names by and the probability they imply."""
    return prices.select(
        "description",
        name_key(F.col("description")).alias("merge_name"),
        "price",
        american_to_probability(F.col("price")).alias("market_implied_prob"),
    )


def best_prices(prices: DataFrame) -> DataFrame:
    """One row per name: its longest price, what that implies, and how many prices the name had.

    A name with several prices must not multiply the predictions it meets;
    ``duplicate_keys`` on the price table lists such names. A price of 0
    counts only where there is no other. Prices are reduced per spelling
    first, so that names are normalised once per spelling and not per price.
    """
    price = F.col("price")
    spelled = prices.groupBy("description").agg(
        F.max(F.when(price != 0, price)).alias("offered"),
        F.max("price").alias("any"),
        F.count("price").alias("n"),
    )
    best = F.coalesce(F.max("offered"), F.max("any"))
    return (
        spelled.withColumn("merge_name", name_key(F.col("description")))
        .where(F.col("merge_name").isNotNull())
        .groupBy("merge_name")
        .agg(best.alias("price"), F.sum("n").alias("n_prices"))
        .withColumn("market_implied_prob", american_to_probability(F.col("price")))
    )


def shared_names(players: DataFrame) -> DataFrame:
    """Name keys that several players have; such players get the same price."""
    keyed = players.select(name_key(F.col("player_name")).alias("merge_name"), "player_id")
    named = keyed.where("merge_name IS NOT NULL").groupBy("merge_name")
    return named.agg(F.count_distinct("player_id").alias("n_players")).where("n_players > 1")


def attach_prices(predictions: DataFrame, prices: DataFrame, probability: str) -> DataFrame:
    """Predictions that have a price, with the edge over the market.

    Incomplete rows are dropped, as they cannot be compared.
    """
    keyed = predictions.withColumn("merge_name", name_key(F.col("player_name")))
    joined = keyed.where(F.col("merge_name").isNotNull()).join(best_prices(prices), "merge_name").withColumn(
        "model_edge", edge(F.col(probability), F.col("market_implied_prob"))
    )
    return joined.drop("merge_name", "n_prices").dropna()


def ranked(predictions: DataFrame, probability: str, tie_break: Sequence[str]) -> DataFrame:
    return predictions.orderBy(F.col(probability).desc(), *tie_break)


def with_rank(predictions: DataFrame, probability: str, tie_break: Sequence[str]) -> DataFrame:
    """``predictions`` with their place, from 1, in the order of ``ranked``.

    Rows are range-partitioned in that order and numbered in each partition;
    the counts of the partitions before are added, so no task sees all rows.
    """
    order = [F.col(probability).desc(), *tie_break]
    parts = save(predictions.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return parts.join(F.broadcast(offsets), "_part").select(place.alias("rank"), *predictions.columns)
