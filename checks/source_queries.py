"""The readers: views written in the layout of the sources, read back by their own reader.

Parquet is written in season folders with a column too many, NaN where a
number is missing, and seasons and weeks beyond those wanted; CSV with other
columns in another order.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.registry import register
from scorecast.session import shared_folder
from scorecast.sources import tables as readers
from scorecast.sources.store import save

SEASONS = [1994, 1996, 1997]
_WANTED = f"season IN ({', '.join(map(str, SEASONS))})"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/scorecast/{name}-{uuid4().hex}"


def _season_folders(df: DataFrame, name: str) -> str:
    path = _path(df.sparkSession, name)
    df.withColumn("unused", F.lit("x")).write.partitionBy("season").parquet(path)
    return path


def _csv(df: DataFrame, name: str) -> str:
    """Columns in the reverse of alphabetical order, and one that no reader asks for."""
    other = df.select(F.lit("x").alias("unused"), *[F.col(f"`{c}`") for c in sorted(df.columns, reverse=True)])
    return readers.write_csv(other, _path(df.sparkSession, name))


def _nan(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(float("nan")))


@register(
    "source_weekly",
    views.with_sql(
        "plays rosters weekly",
        f"""
  SELECT CAST(player_id AS VARCHAR) AS player_id, player_display_name, position, recent_team, opponent_team,
         season, week, carries, CAST(round(rushing_yards, 6) AS DOUBLE) AS rushing_yards, rushing_tds, receptions,
         targets, CAST(round(receiving_yards, 6) AS DOUBLE) AS receiving_yards, receiving_tds,
         CAST(round(wopr, 6) AS DOUBLE) AS wopr, CAST(round(rushing_epa, 6) + 0.0 AS DOUBLE) AS rushing_epa,
         CAST(round(receiving_epa, 6) + 0.0 AS DOUBLE) AS receiving_epa,
         CAST(round(target_share, 6) AS DOUBLE) AS target_share
  FROM weekly WHERE {_WANTED}
""",
    ),
)
def source_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = views.weekly(spark, sf_dir).withColumns({c: _nan(c) for c in ("rushing_tds", "receiving_tds")})
    return readers.read_weekly(spark, _season_folders(weekly, "weekly"), SEASONS)


@register(
    "source_uneven_seasons",
    views.with_sql(
        "plays rosters weekly",
        f"""
  SELECT CAST(player_id AS VARCHAR) AS player_id, player_display_name, position, recent_team, opponent_team,
         season, week, carries, CAST(round(rushing_yards, 6) AS DOUBLE) AS rushing_yards, rushing_tds, receptions,
         targets, CAST(round(receiving_yards, 6) AS DOUBLE) AS receiving_yards, receiving_tds,
         CASE WHEN season <> 1996 THEN CAST(round(wopr, 6) AS DOUBLE) END AS wopr, CAST(round(rushing_epa, 6) + 0.0 AS DOUBLE) AS rushing_epa,
         CAST(round(receiving_epa, 6) + 0.0 AS DOUBLE) AS receiving_epa,
         CAST(round(target_share, 6) AS DOUBLE) AS target_share
  FROM weekly WHERE {_WANTED}
""",
    ),
)
def source_uneven_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One season has no ``wopr``, another holds ``carries`` as whole numbers and ``week`` as text, the rest are as they should be."""
    path = _path(spark, "uneven")
    weekly = save(views.weekly(spark, sf_dir), "weekly", partition_by="season")
    odd = {1996: lambda df: df.drop("wopr"), 1997: lambda df: df.withColumns({"carries": F.col("carries").cast("int"), "week": F.col("week").cast("string")})}
    usual = weekly.where(~F.col("season").isin(list(odd)))
    usual.withColumn("unused", F.lit("x")).write.partitionBy("season").parquet(path)
    for season, change in odd.items():
        change(weekly.where(F.col("season") == season)).drop("season").write.parquet(f"{path}/season={season}")
    return readers.read_weekly(spark, path, SEASONS, uneven=True)


@register(
    "source_plays",
    views.with_sql(
        "plays",
        f"""
  SELECT season, week + 12 * (drive % 2) AS week, posteam, defteam, CAST(rusher_player_id AS VARCHAR) AS rusher_player_id,
         CAST(receiver_player_id AS VARCHAR) AS receiver_player_id, CAST(drive AS DOUBLE) AS drive,
         CAST(yardline_100 AS DOUBLE) AS yardline_100, CAST(rush_attempt AS DOUBLE) AS rush_attempt,
         CAST(pass_attempt AS DOUBLE) AS pass_attempt, CAST(touchdown AS DOUBLE) AS touchdown,
         CAST(rush_touchdown AS DOUBLE) AS rush_touchdown, CAST(pass_touchdown AS DOUBLE) AS pass_touchdown,
         CASE WHEN drive % 7 <> 0 THEN CAST(round(epa, 6) + 0.0 AS DOUBLE) END AS epa
  FROM plays WHERE {_WANTED} AND week + 12 * (drive % 2) <= 18
""",
    ),
)
def source_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of odd drives are played twelve weeks later, most of them after the last week."""
    drive = F.col("drive")
    epa = F.when(drive % 7 == 0, F.lit(float("nan"))).otherwise(F.col("epa"))
    plays = views.plays(spark, sf_dir).withColumns({"week": F.col("week") + 12 * (drive % 2), "epa": epa})
    return readers.read_plays(spark, _season_folders(plays, "source-plays"), SEASONS)


@register(
    "source_rosters",
    views.with_sql(
        "rosters",
        f"""
  SELECT * FROM (SELECT CAST(player_id AS VARCHAR) AS player_id, player_name, position, team,
                        CAST(1993 + player_id % 6 AS BIGINT) AS season FROM rosters)
  WHERE {_WANTED}
""",
    ),
)
def source_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rosters = views.rosters(spark, sf_dir).withColumn("season", F.lit(1993) + F.col("player_id") % 6)
    return readers.read_rosters(spark, _season_folders(rosters, "rosters"), SEASONS)


@register(
    "source_schedule",
    views.with_sql("paired_orders schedule", f"SELECT season, week, home_team, away_team FROM schedule WHERE {_WANTED}"),
)
def source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_schedule(spark, _season_folders(views.schedule(spark, sf_dir), "schedule"), SEASONS)


@register(
    "source_historical_odds",
    views.with_sql(
        "paired_orders odds",
        """
  SELECT schedule_season, schedule_week, team_home, team_away, team_favorite_id, spread_favorite,
         CAST(schedule_playoff AS BIGINT) AS schedule_playoff,
         CASE WHEN over_under_line <> ' ' THEN over_under_line ELSE 'none' END AS over_under_line
  FROM odds
""",
    ),
)
def source_historical_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total of one blank comes back as an empty text, whose spelling is left to the CSV writer."""
    odds = readers.read_historical_odds(spark, _csv(views.odds(spark, sf_dir), "odds"))
    total = F.trim(F.coalesce("over_under_line", F.lit("")))
    return odds.withColumn("over_under_line", F.when(total == "", "none").otherwise(total))


@register("source_teams", "SELECT n_name AS team_name, CAST(n_nationkey AS VARCHAR) AS team_id FROM nation")
def source_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_teams(spark, _csv(views.teams(spark, sf_dir), "teams"))


@register(
    "source_upcoming_lines",
    views.with_sql(
        "paired_orders",
        """
  SELECT 'NATION_' || home AS home_team, 'NATION_' || away AS away_team, 'spreads' AS market,
         CAST(price % 29 - 14 AS VARCHAR) AS point_1, 'NATION_' || away AS label_2, '-110' AS odd_2,
         CAST(14 - price % 29 AS VARCHAR) AS point_2, NULL AS "over/under" FROM paired_orders
  UNION ALL
  SELECT 'NATION_' || home, 'NATION_' || away, 'totals', NULL, NULL, '-110', NULL,
         CASE WHEN o_orderkey % 41 = 0 THEN 'off' ELSE CAST(35 + price % 20 AS VARCHAR) END FROM paired_orders
""",
    ),
)
def source_upcoming_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.col("market") == "spreads"
    lines = views.upcoming_lines(spark, sf_dir).withColumns(
        {
            "label_2": F.when(spread, F.col("away_team")),
            "odd_2": F.lit("-110"),
            "point_2": F.when(spread, (-F.col("point_1").cast("bigint")).cast("string")),
        }
    )
    return readers.read_upcoming_lines(spark, _csv(lines, "upcoming-lines"))


@register("source_prices", views.with_sql("prices", "SELECT description, nullif(price, 0) AS price FROM prices"))
def source_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price of 0 is written as a text that is no number."""
    price = F.col("price")
    prices = views.prices(spark, sf_dir).withColumn("price", F.when(price == 0, "n/a").otherwise(price.cast("string")))
    return readers.read_prices(spark, _csv(prices, "prices"))
