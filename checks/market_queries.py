"""Lines, team coverage, names and prices."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.registry import register
from scorecast.functions.columns import name_key
from scorecast.operators import market as ops
from scorecast.session import shared_folder
from scorecast.sources import schemas
from scorecast.sources.tables import duplicate_keys, read_csv_table, write_csv

SEASONS = list(range(1995, 2002))


@register(
    "coerce_numbers",
    views.with_sql(
        "paired_orders odds odds_numbers",
        "SELECT * REPLACE (CAST(schedule_playoff AS BIGINT) AS schedule_playoff) FROM odds_numbers",
    ),
)
def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coerce_odds(views.odds(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.team_game_lines(views.odds(spark, sf_dir), ops.team_ids(views.teams(spark, sf_dir)), SEASONS)


@register(
    "team_game_lines",
    views.with_sql(
        "paired_orders odds odds_numbers home_lines team_lines",
        "SELECT season, week, team, spread_line + 0.0 AS spread_line, total_line, implied_total FROM team_lines",
    ),
)
def team_game_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


@register(
    "consolidate_lines",
    views.with_sql(
        "paired_orders",
        """
  , games AS (
      SELECT year AS season, month AS week, CAST(h.n_nationkey AS VARCHAR) AS home_id,
             CAST(a.n_nationkey AS VARCHAR) AS away_id,
             arg_min(CAST(price % 29 - 14 AS DOUBLE), o_orderkey) AS spread,
             arg_min(CAST(35 + price % 20 AS DOUBLE), o_orderkey) FILTER (WHERE o_orderkey % 41 <> 0) AS total_line
      FROM paired_orders JOIN nation h ON 'NATION_' || home = h.n_name JOIN nation a ON 'NATION_' || away = a.n_name
      GROUP BY ALL)
  , sides AS (
      SELECT season, week, home_id AS team, away_id AS opponent, spread AS spread_line, total_line FROM games
      UNION ALL SELECT season, week, away_id, home_id, -spread, total_line FROM games)
  SELECT CAST(season AS BIGINT) AS season, CAST(week AS BIGINT) AS week, team, opponent,
         spread_line + 0.0 AS spread_line, total_line, total_line / 2 - spread_line / 2 AS implied_total
  FROM sides WHERE total_line IS NOT NULL
""",
    ),
)
def consolidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.consolidate_lines(
        views.upcoming_lines(spark, sf_dir),
        ops.team_ids(views.teams(spark, sf_dir)),
        keys=["season", "week"],
        order=["market", "o_orderkey"],
    )


@register(
    "team_coverage",
    views.with_sql(
        "paired_orders odds",
        """
  SELECT DISTINCT team FROM (SELECT team_home AS team FROM odds UNION ALL SELECT team_away FROM odds)
  WHERE team NOT IN (SELECT n_name FROM nation)
""",
    ),
)
def team_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.odds(spark, sf_dir).select(F.explode(F.array("team_home", "team_away")).alias("team"))
    return ops.uncovered_teams(named, "team", views.teams(spark, sf_dir), "team_name")


@register(
    "name_key",
    views.with_sql(
        "prices",
        """
  SELECT description, trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9\\s]', '', 'g'),
                                          '\\s(jr|sr|ii|iii|iv)$', '')) AS merge_name, count(*) AS n_rows
  FROM prices GROUP BY ALL
""",
    ),
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = views.prices(spark, sf_dir).groupBy("description").agg(F.count(F.lit(1)).alias("n_rows"))
    return described.withColumn("merge_name", name_key(F.col("description")))


@register(
    "american_to_prob",
    views.with_sql(
        "prices",
        """
  SELECT description, price,
         round(CASE WHEN price > 0 THEN 100.0 / (price + 100.0)
                    WHEN price < 0 THEN abs(price) / (abs(price) + 100.0) ELSE 0 END, 6) AS market_implied_prob
  FROM prices
""",
    ),
)
def american_to_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.price_table(views.prices(spark, sf_dir)).drop("merge_name")


@register(
    "duplicate_price_names",
    views.with_sql(
        "prices best_prices", "SELECT merge_name, n_prices AS n_rows FROM best_prices WHERE n_prices > 1"
    ),
)
def duplicate_price_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(ops.price_table(views.prices(spark, sf_dir)), ["merge_name"])


@register(
    "ambiguous_names",
    views.with_sql(
        "rosters prices best_prices",
        """
  , players AS (
      SELECT trim(regexp_replace(regexp_replace(lower(player_name), '[^a-z0-9\\s]', '', 'g'),
                                 '\\s(jr|sr|ii|iii|iv)$', '')) AS merge_name, count(DISTINCT player_id) AS n_players
      FROM rosters GROUP BY ALL)
  SELECT 'names_with_several_prices' AS doubt, merge_name, n_prices AS n_rows FROM best_prices WHERE n_prices > 1
  UNION ALL
  SELECT 'names_of_several_players', merge_name, n_players FROM players WHERE n_players > 1
""",
    ),
)
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ops.price_table(views.prices(spark, sf_dir))
    several = duplicate_keys(prices, ["merge_name"]).select(F.lit("names_with_several_prices").alias("doubt"), "merge_name", "n_rows")
    shared = ops.shared_names(views.rosters(spark, sf_dir))
    return several.union(shared.select(F.lit("names_of_several_players"), "merge_name", "n_players"))


# A probability made from the key stands in for a model, so that SQL can check the ranking.
def formula_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rosters(spark, sf_dir).where("listing = 1").select(
        "player_id",
        "player_name",
        "team",
        "position",
        ((F.col("player_id") * 37 % 1009) / F.lit(1009.0)).alias("predicted_touchdown_probability"),
    )


views.SQL["edges"] = """
  SELECT player_id, player_name, team, position, (player_id * 37 % 1009) / 1009.0 AS p, price, market_implied_prob
  FROM rosters JOIN best_prices ON lower(player_name) = merge_name WHERE listing = 1
"""

_EDGE_COLUMNS = """
  SELECT player_id, player_name, team, position, round(p, 6) AS predicted_touchdown_probability,
         CAST(price AS BIGINT) AS price, round(market_implied_prob, 6) AS market_implied_prob,
         round(p - market_implied_prob, 6) AS model_edge FROM edges
"""


@register("model_edge", views.with_sql("rosters prices best_prices edges", _EDGE_COLUMNS))
def model_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attach_prices(
        formula_predictions(spark, sf_dir), views.prices(spark, sf_dir), "predicted_touchdown_probability"
    )


@register(
    "model_edge_topk",
    views.with_sql("rosters prices best_prices edges", _EDGE_COLUMNS + " ORDER BY p DESC, player_id LIMIT 25"),
)
def model_edge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ranked(model_edge(spark, sf_dir), "predicted_touchdown_probability", ["player_id"]).limit(25)


@register(
    "ranked_predictions",
    views.with_sql(
        "rosters prices best_prices edges",
        "SELECT row_number() OVER (ORDER BY round(p, 6) DESC, player_id) AS rank, player_id,"
        " round(p, 6) AS predicted_touchdown_probability FROM edges",
    ),
)
def ranked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every prediction, as it stands in the written files."""
    probability = "predicted_touchdown_probability"
    predictions = model_edge(spark, sf_dir).withColumn(probability, F.round(probability, 6))
    return ops.with_rank(predictions, probability, ["player_id"]).select("rank", "player_id", probability)


@register("csv_roundtrip", views.with_sql("rosters prices best_prices edges", _EDGE_COLUMNS))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked predictions, written as CSV and read back."""
    predictions = ops.ranked(model_edge(spark, sf_dir), "predicted_touchdown_probability", ["player_id"])
    path = write_csv(predictions, f"{shared_folder(spark)}/scorecast/csv-{uuid4().hex}")
    schema = schemas.columns(
        bigint="player_id price",
        text="player_name team position",
        double="predicted_touchdown_probability market_implied_prob model_edge",
    )
    return read_csv_table(spark, path, schema)
