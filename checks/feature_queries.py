"""Labels, joins, lagged means, matchups and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.market_queries import lines
from checks.play_queries import positions
from checks.registry import register
from scorecast.operators import features as ft
from scorecast.operators.play_sums import play_sums
from scorecast.operators.plays import usage_share
from scorecast.operators.windows import cut_by_size, lagged_means, lagged_means_in_blocks
from scorecast.plans import feature_table as plan
from scorecast.sources.store import save

_WEEKLY_COLUMNS = """
  player_id, player_display_name, position, recent_team, opponent_team, season, week, carries, rushing_yards,
  rushing_tds, receptions, targets, receiving_yards, receiving_tds, round(wopr, 6) AS wopr,
  round(rushing_epa, 6) + 0.0 AS rushing_epa, round(receiving_epa, 6) + 0.0 AS receiving_epa,
  round(target_share, 6) AS target_share, CAST(scored_touchdown AS BIGINT) AS scored_touchdown
"""


def inputs(spark: SparkSession, sf_dir: str) -> plan.Inputs:
    # Here plays come from a join of four tables; storing them joins once instead of once per aggregate.
    plays = save(views.plays(spark, sf_dir), "plays")
    return plan.Inputs(
        weekly=views.weekly(spark, sf_dir, plays),
        plays=plays,
        positions=positions(spark, sf_dir),
        lines=views.consensus(lines(spark, sf_dir)),
    )


@register("weekly_label", views.with_sql("plays rosters weekly labelled", f"SELECT {_WEEKLY_COLUMNS} FROM labelled"))
def weekly_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.label_weekly(views.weekly(spark, sf_dir))


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"CAST(round({c}, 6) + 0.0 AS DOUBLE) AS {c}" for c in columns)


def _whole(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


_OFFENCE = ["redzone_trips", "redzone_tds", "redzone_td_rate", "spread_line", "total_line", "implied_total"]
_DEFENCE = ["passing_tds_allowed", "rushing_tds_allowed", "total_tds_allowed", "epa_allowed"]


@register(
    "feature_join",
    views.with_sql(
        views.MODEL_INPUTS,
        f"""
  SELECT {_WEEKLY_COLUMNS}, {_rounded([*plan.SHARES, *_DEFENCE, *_OFFENCE[2:]])},
         {_whole([*ft.ALLOWED, *_OFFENCE[:2]])}
  FROM players LEFT JOIN defences USING (opponent_team, season, week)
       LEFT JOIN offences USING (recent_team, season, week)
""",
    ),
)
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.raw_features(plan.build_histories(inputs(spark, sf_dir)))


def _mean_sql(means: dict[str, tuple[str, int]], partition: str, order: str) -> str:
    return ", ".join(
        f"round(avg({source}) OVER (PARTITION BY {partition} ORDER BY {order}"
        f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) + 0.0 AS {name}"
        for name, (source, n) in means.items()
    )


_PLAYER_3 = {name: mean for name, mean in ft.PLAYER_MEANS.items() if mean[1] == 3}
_PLAYER_5 = {name: mean for name, mean in ft.PLAYER_MEANS.items() if mean[1] == 5}
_PLAYER_SQL = "season, week, recent_team"


@register(
    "lagged_mean_entity_3",
    views.with_sql(
        "plays rosters weekly labelled",
        f"SELECT player_id, {_PLAYER_SQL}, {_mean_sql(_PLAYER_3, 'player_id', _PLAYER_SQL)} FROM labelled",
    ),
)
def lagged_mean_entity_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = ft.label_weekly(views.weekly(spark, sf_dir, opponents=False))
    means = lagged_means(labelled, ["player_id"], ft.PLAYER_ORDER, _PLAYER_3)
    return means.select(*ft.PLAYER_WEEK, *_PLAYER_3)


@register(
    "lagged_mean_entity_5",
    views.with_sql(
        "plays rosters weekly labelled shares players",
        f"SELECT player_id, {_PLAYER_SQL}, {_mean_sql(_PLAYER_5, 'player_id', _PLAYER_SQL)} FROM players",
    ),
)
def lagged_mean_entity_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = ft.label_weekly(views.weekly(spark, sf_dir, opponents=False))
    players = ft.join_players(labelled, usage_share(views.offence_plays(spark, sf_dir)), plan.SHARES)
    return lagged_means(players, ["player_id"], ft.PLAYER_ORDER, _PLAYER_5).select(*ft.PLAYER_WEEK, *_PLAYER_5)


_DAY_MEANS = {"avg_value": ("value", 3), "avg_events": ("n_events", 5)}


@register(
    "lagged_mean_entity_day",
    f"""
  SELECT user_id, day, {_mean_sql(_DAY_MEANS, 'user_id', 'day')}
  FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(value) AS value, count(*) AS n_events
        FROM events GROUP BY ALL)
""",
)
def lagged_mean_entity_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (
        views.table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_events"))
    )
    return lagged_means(days, ["user_id"], ["day"], _DAY_MEANS).select("user_id", "day", *_DAY_MEANS)


@register(
    "lagged_mean_team_game",
    views.with_sql(
        views.MODEL_INPUTS,
        f"""
  SELECT 'defence' AS side, opponent_team AS team, season, week,
         {_mean_sql(ft.DEFENCE_MEANS, 'opponent_team', 'season, week')}, NULL AS avg_redzone_td_rate FROM defences
  UNION ALL BY NAME
  SELECT 'offence' AS side, recent_team AS team, season, week,
         {_mean_sql(ft.OFFENCE_MEANS, 'recent_team', 'season, week')} FROM offences
""",
    ),
)
def lagged_mean_team_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, order = inputs(spark, sf_dir), ["season", "week"]
    sums = play_sums(given.plays)
    # Means of teams need the calendar of their games, not the players.
    games = ft.label_weekly(given.weekly).select("recent_team", "opponent_team", *order).distinct()
    games = save(games, "games")
    defences = lagged_means(plan.defence_games(games, given, sums), ["opponent_team"], order, ft.DEFENCE_MEANS).select(
        F.lit("defence").alias("side"), F.col("opponent_team").alias("team"), *order, *ft.DEFENCE_MEANS
    )
    offences = lagged_means(plan.offence_games(games, given, sums), ["recent_team"], order, ft.OFFENCE_MEANS).select(
        F.lit("offence").alias("side"), F.col("recent_team").alias("team"), *order, *ft.OFFENCE_MEANS
    )
    return defences.unionByName(offences, allowMissingColumns=True)


@register(
    "lagged_mean_rowwise",
    views.with_sql(
        views.MODEL_INPUTS,
        f"""
  SELECT player_id, {_PLAYER_SQL}, opponent_team,
         {_mean_sql(ft.DEFENCE_MEANS, 'opponent_team', 'season, week, player_id, recent_team')}
  FROM players LEFT JOIN defences USING (opponent_team, season, week)
""",
    ),
)
def lagged_mean_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team means over player rows instead of games; a team may have any number of them, so they run in blocks."""
    given = inputs(spark, sf_dir)
    players = save(ft.label_weekly(given.weekly).select(*ft.PLAYER_WEEK, "opponent_team"), "player-weeks")
    defences = save(plan.defence_games(players, given, play_sums(given.plays)), "defences")
    rows = ft.join_teams(players, defences).select(
        *ft.PLAYER_WEEK, "opponent_team", *[source for source, _ in ft.DEFENCE_MEANS.values()]
    )
    keys, order = ["opponent_team"], ["season", "week", "player_id", "recent_team"]
    return lagged_means_in_blocks(
        cut_by_size(rows, keys, order), keys=keys, block=["block"], order=order, means=ft.DEFENCE_MEANS
    ).select(*ft.PLAYER_WEEK, "opponent_team", *ft.DEFENCE_MEANS)


_INTERACTION = """
  CASE position WHEN 'RB' THEN {p}redzone_carry_share * {p}rushing_tds_allowed_to_RB
                             + {p}redzone_target_share * {p}passing_tds_allowed_to_RB
                WHEN 'WR' THEN {p}redzone_target_share * {p}passing_tds_allowed_to_WR
                WHEN 'TE' THEN {p}redzone_target_share * {p}passing_tds_allowed_to_TE
                WHEN 'QB' THEN {p}redzone_carry_share * {p}rushing_tds_allowed_to_QB ELSE 0 END
"""


@register(
    "matchup_interaction",
    views.with_sql(
        views.MODEL_INPUTS,
        f"""
  SELECT player_id, {_PLAYER_SQL}, position, round({_INTERACTION.format(p='')}, 6) AS interaction
  FROM players LEFT JOIN defences USING (opponent_team, season, week)
""",
    ),
)
def matchup_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = inputs(spark, sf_dir)
    sums = play_sums(given.plays)
    players = plan.player_history(given, sums)
    rows = ft.join_teams(players, save(plan.defence_games(players, given, sums), "defences"))
    return rows.select(*ft.PLAYER_WEEK, "position", ft.matchup_interaction("").alias("interaction"))


@register(
    "encode_sorted",
    views.with_sql(
        "plays rosters weekly labelled",
        f"""
  SELECT player_id, {_PLAYER_SQL}, position, opponent_team,
         CAST(dense_rank() OVER (ORDER BY position) - 1 AS DOUBLE) AS position_encoded,
         CAST(dense_rank() OVER (ORDER BY opponent_team) - 1 AS DOUBLE) AS opponent_encoded
  FROM labelled
""",
    ),
)
def encode_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = save(
        ft.label_weekly(views.weekly(spark, sf_dir)).select(*ft.PLAYER_WEEK, "position", "opponent_team"), "labelled"
    )
    return plan.encode(labelled, ft.sorted_codes(labelled, "opponent_team", "opponent_encoded"))


# Every lagged mean, the matchup and the codes in one table.
def _filled(means: dict[str, tuple[str, int]], partition: str, order: str) -> str:
    return ", ".join(
        f"coalesce(avg({source}) OVER (PARTITION BY {partition} ORDER BY {order}"
        f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS {name}"
        for name, (source, n) in means.items()
    )


views.SQL["lagged_players"] = f"SELECT *, {_filled(ft.PLAYER_MEANS, 'player_id', _PLAYER_SQL)} FROM players"
views.SQL["lagged_offences"] = f"SELECT *, {_filled(ft.OFFENCE_MEANS, 'recent_team', 'season, week')} FROM offences"
views.SQL["lagged_defences"] = f"SELECT *, {_filled(ft.DEFENCE_MEANS, 'opponent_team', 'season, week')} FROM defences"
views.SQL["features"] = f"""
  SELECT *, {_INTERACTION.format(p='avg_')} AS positional_matchup_interaction,
         dense_rank() OVER (ORDER BY position) - 1 AS position_encoded,
         dense_rank() OVER (ORDER BY opponent_team) - 1 AS opponent_encoded
  FROM lagged_players LEFT JOIN lagged_defences USING (opponent_team, season, week)
       LEFT JOIN lagged_offences USING (recent_team, season, week)
"""
FEATURE_VIEWS = f"{views.MODEL_INPUTS} lagged_players lagged_offences lagged_defences features"
FEATURE_KEYS = [*ft.PLAYER_WEEK, "opponent_team", "position", ft.LABEL]


@register(
    "feature_table",
    views.with_sql(
        FEATURE_VIEWS,
        f"""
  SELECT player_id, {_PLAYER_SQL}, opponent_team, position, CAST(scored_touchdown AS BIGINT) AS scored_touchdown,
         {_rounded(ft.FEATURES)} FROM features
""",
    ),
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.build_features(inputs(spark, sf_dir)).select(*FEATURE_KEYS, *ft.FEATURES)
