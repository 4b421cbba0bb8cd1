"""Usage, conversion and what defences allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks import views
from checks.registry import register
from scorecast.operators import plays as ops
from scorecast.operators.play_sums import summed_plays


def _usage_sql(zone: str, yards: int) -> str:
    return views.with_sql(
        "plays",
        f"""
  , zone AS (SELECT * FROM plays WHERE yardline_100 <= {yards})
  , team AS (SELECT posteam, season, week, sum(rush_attempt) AS tr, sum(pass_attempt) AS tt
             FROM zone GROUP BY ALL)
  , rushes AS (SELECT rusher_player_id AS player_id, posteam, season, week, sum(rush_attempt) AS pr
               FROM zone WHERE rusher_player_id IS NOT NULL GROUP BY ALL)
  , targets AS (SELECT receiver_player_id AS player_id, posteam, season, week, sum(pass_attempt) AS pt
                FROM zone WHERE receiver_player_id IS NOT NULL GROUP BY ALL)
  SELECT player_id, posteam, season, week,
         CAST(coalesce(pr, 0) AS DOUBLE) AS player_{zone}_rushes,
         CAST(coalesce(pt, 0) AS DOUBLE) AS player_{zone}_targets,
         CAST(tr AS DOUBLE) AS team_{zone}_rushes, CAST(tt AS DOUBLE) AS team_{zone}_targets,
         round(coalesce(CAST(pr AS DOUBLE) / nullif(tr, 0), 0), 6) AS {zone}_carry_share,
         round(coalesce(CAST(pt AS DOUBLE) / nullif(tt, 0), 0), 6) AS {zone}_target_share
  FROM rushes FULL JOIN targets USING (player_id, posteam, season, week)
       LEFT JOIN team USING (posteam, season, week)
""",
    )


@register("usage_share_zone20", _usage_sql("redzone", 20))
def usage_share_zone20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usage_share(views.offence_plays(spark, sf_dir), {"redzone": ops.ZONES["redzone"]})


@register("usage_share_zone5", _usage_sql("inside_5", 5))
def usage_share_zone5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usage_share(views.offence_plays(spark, sf_dir), {"inside_5": ops.ZONES["inside_5"]})


@register(
    "drive_conversion",
    views.with_sql(
        "plays",
        """
  , trips AS (SELECT posteam, season, week, drive, 1 AS is_trip FROM plays WHERE yardline_100 <= 20 GROUP BY ALL)
  , tds AS (SELECT posteam, season, week, drive, 1 AS is_td FROM plays
            WHERE yardline_100 <= 20 AND touchdown = 1 GROUP BY ALL)
  SELECT posteam AS recent_team, season, week, CAST(sum(is_trip) AS BIGINT) AS redzone_trips,
         CAST(sum(coalesce(is_td, 0)) AS BIGINT) AS redzone_tds,
         round(CAST(sum(coalesce(is_td, 0)) AS DOUBLE) / sum(is_trip), 6) AS redzone_td_rate
  FROM trips LEFT JOIN tds USING (posteam, season, week, drive) GROUP BY posteam, season, week
""",
    ),
)
def drive_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drive_conversion(views.offence_plays(spark, sf_dir))


@register(
    "allowed_by_team",
    views.with_sql(
        "plays",
        """
  SELECT defteam AS opponent_team, season, week, CAST(sum(pass_touchdown) AS DOUBLE) AS passing_tds_allowed,
         CAST(sum(rush_touchdown) AS DOUBLE) AS rushing_tds_allowed,
         CAST(sum(touchdown) AS DOUBLE) AS total_tds_allowed, round(CAST(sum(epa) AS DOUBLE), 4) + 0.0 AS epa_allowed
  FROM plays GROUP BY defteam, season, week
""",
    ),
    digits=4,
)
def allowed_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.allowed_by_team(views.plays(spark, sf_dir))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.roster_positions(views.rosters(spark, sf_dir), keys=["player_id"], latest_by=["listing"])


views.SQL["allowed_positions"] = """
  SELECT opponent_team, season, week,
         sum(CASE WHEN kind = 'rush' AND position = 'RB' THEN 1 ELSE 0 END) AS rushing_tds_allowed_to_RB,
         sum(CASE WHEN kind = 'rush' AND position = 'WR' THEN 1 ELSE 0 END) AS rushing_tds_allowed_to_WR,
         sum(CASE WHEN kind = 'rush' AND position = 'QB' THEN 1 ELSE 0 END) AS rushing_tds_allowed_to_QB,
         sum(CASE WHEN kind = 'pass' AND position = 'RB' THEN 1 ELSE 0 END) AS passing_tds_allowed_to_RB,
         sum(CASE WHEN kind = 'pass' AND position = 'WR' THEN 1 ELSE 0 END) AS passing_tds_allowed_to_WR,
         sum(CASE WHEN kind = 'pass' AND position = 'TE' THEN 1 ELSE 0 END) AS passing_tds_allowed_to_TE
  FROM (SELECT defteam AS opponent_team, season, week, rusher_player_id AS player_id, 'rush' AS kind
        FROM plays WHERE rush_touchdown = 1
        UNION ALL
        SELECT defteam, season, week, receiver_player_id, 'pass' FROM plays WHERE pass_touchdown = 1)
       JOIN positions USING (player_id)
  GROUP BY opponent_team, season, week
"""


@register(
    "allowed_by_position",
    views.with_sql(
        "plays rosters positions allowed_positions",
        """
  SELECT opponent_team, season, week, CAST(COLUMNS('_tds_allowed_to_') AS BIGINT) FROM allowed_positions
""",
    ),
)
def allowed_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.allowed_by_position(views.plays(spark, sf_dir), positions(spark, sf_dir))


_ZONE = "SELECT *, yardline_100 <= 5 AS near FROM plays WHERE yardline_100 <= 20"
_NONE = "CAST(0 AS DOUBLE)"


def _kind_sql(kind: str, team: str, sums: list[str], source: str, player: str = "NULL", drive: str = "NULL") -> str:
    numbers = ", ".join(f"{s} AS sum_{i}" for i, s in enumerate(sums + [_NONE] * (4 - len(sums))))
    return f"""
  SELECT '{kind}' AS kind, {team} AS team, season, week, {player} AS player_id, {drive} AS drive, {numbers}
  FROM {source} WHERE {team} IS NOT NULL AND season IS NOT NULL AND week IS NOT NULL
  GROUP BY ALL
"""


def _number(column: str, where: str = "true") -> str:
    return f"coalesce(CAST(sum({column}) FILTER (WHERE {where}) AS DOUBLE), 0)"


_RUSHES = [_number("rush_attempt"), _NONE, _number("rush_attempt", "near"), _NONE]
_TARGETS = [_NONE, _number("pass_attempt"), _NONE, _number("pass_attempt", "near")]
_PLAYER_SUMS = ", ".join(f"sum(sum_{i}) AS sum_{i}" for i in range(4))
_SCORED = "SELECT * FROM plays WHERE {flag} = 1 AND {player} IS NOT NULL"
_SUMS_SQL = " UNION ALL ".join(
    [
        _kind_sql("team", "posteam", [_RUSHES[0], _TARGETS[1], _RUSHES[2], _TARGETS[3]], f"({_ZONE})"),
        f"""SELECT kind, team, season, week, player_id, drive, {_PLAYER_SUMS} FROM (
              {_kind_sql("player", "posteam", _RUSHES, f"({_ZONE} AND rusher_player_id IS NOT NULL)", "rusher_player_id")}
              UNION ALL
              {_kind_sql("player", "posteam", _TARGETS, f"({_ZONE} AND receiver_player_id IS NOT NULL)", "receiver_player_id")}
            ) GROUP BY ALL""",
        _kind_sql("drive", "posteam", [_number("1", "touchdown = 1")], f"({_ZONE} AND drive IS NOT NULL)", drive="drive"),
        _kind_sql(
            "defence",
            "defteam",
            [_number(c) for c in ("pass_touchdown", "rush_touchdown", "touchdown")] + [f"round({_number('epa')}, 4) + 0.0"],
            "(SELECT * FROM plays WHERE posteam IS NOT NULL)",
        ),
        f"""SELECT kind, team, season, week, player_id, drive, {_PLAYER_SUMS} FROM (
              {_kind_sql("scorer", "defteam", [_number("1"), _NONE],
                         f"({_SCORED.format(flag='rush_touchdown', player='rusher_player_id')})", "rusher_player_id")}
              UNION ALL
              {_kind_sql("scorer", "defteam", [_NONE, _number("1")],
                         f"({_SCORED.format(flag='pass_touchdown', player='receiver_player_id')})", "receiver_player_id")}
            ) GROUP BY ALL""",
    ]
)


@register("play_sums", views.with_sql("plays", _SUMS_SQL), digits=4)
def play_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums behind usage, drives and what defences allow, for all kinds of group in one scan."""
    return summed_plays(views.plays(spark, sf_dir))
