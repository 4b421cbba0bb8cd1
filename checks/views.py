"""The given tables in the shape of the domain, as DataFrames and as SQL.

Each view reads its tables whole. ``SQL`` holds the same views as common table
expressions for DuckDB; a view may name the views before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.operators.features import ALLOWED
from scorecast.plans.feature_table import SHARES

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plays(lines: DataFrame) -> DataFrame:
    rush, target = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    touchdown = (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.05)
    columns = {
        "drive": F.col("l_orderkey"),
        "posteam": F.col("s_nationkey").cast("string"),
        "season": F.year("l_shipdate").cast("bigint"),
        "week": F.month("l_shipdate").cast("bigint"),
        "yardline_100": F.col("l_quantity"),
        "rush_attempt": rush.cast("double"),
        "pass_attempt": target.cast("double"),
        "rusher_player_id": F.when(rush, F.col("l_partkey")),
        "receiver_player_id": F.when(target, F.col("l_partkey")),
        "touchdown": touchdown.cast("double"),
        "rush_touchdown": (touchdown & rush).cast("double"),
        "pass_touchdown": (touchdown & target).cast("double"),
        "epa": F.col("l_tax") - F.lit(0.04),
        "player_id": F.col("l_partkey"),
    }
    if "c_nationkey" in lines.columns:
        columns["defteam"] = F.col("c_nationkey").cast("string")
    return lines.select(*[column.alias(name) for name, column in columns.items()])


def offence_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays without the defence, for what needs no join with orders and customer."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return _plays(lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    defences = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return _plays(
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
            defences, F.col("l_orderkey") == F.col("o_orderkey")
        )
    )


SQL["plays"] = """
  SELECT l_orderkey AS drive, CAST(s_nationkey AS VARCHAR) AS posteam, CAST(c_nationkey AS VARCHAR) AS defteam,
         CAST(year(l_shipdate) AS BIGINT) AS season, CAST(month(l_shipdate) AS BIGINT) AS week,
         l_quantity AS yardline_100,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS rush_attempt,
         CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS pass_attempt,
         CASE WHEN l_returnflag = 'R' THEN l_partkey END AS rusher_player_id,
         CASE WHEN l_returnflag = 'A' THEN l_partkey END AS receiver_player_id,
         CASE WHEN l_linestatus = 'F' AND l_discount >= 0.05 THEN 1.0 ELSE 0.0 END AS touchdown,
         CASE WHEN l_linestatus = 'F' AND l_discount >= 0.05 AND l_returnflag = 'R' THEN 1.0 ELSE 0.0 END
           AS rush_touchdown,
         CASE WHEN l_linestatus = 'F' AND l_discount >= 0.05 AND l_returnflag = 'A' THEN 1.0 ELSE 0.0 END
           AS pass_touchdown,
         l_tax - 0.04 AS epa, l_partkey AS player_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a player; large ones are listed twice, the second time at another position."""
    parts = table(spark, sf_dir, "part")
    position = (
        F.when(F.col("p_type") == "LARGE", "QB")
        .when(F.col("p_type") == "MEDIUM", "RB")
        .when(F.col("p_type") == "SMALL", "TE")
        .when(F.col("p_type") == "STANDARD", "WR")
        .otherwise(F.col("p_type"))
    )
    listings = F.explode(
        F.when(
            F.col("p_size") >= 40,
            F.array(
                F.struct(F.lit(1).alias("listing"), position.alias("position")),
                F.struct(F.lit(2).alias("listing"), F.lit("RB").alias("position")),
            ),
        ).otherwise(F.array(F.struct(F.lit(1).alias("listing"), position.alias("position"))))
    )
    name = F.concat(F.initcap("p_name"), F.lit(" "), (F.col("p_partkey") % 700).cast("string"))
    return parts.select(
        F.col("p_partkey").alias("player_id"),
        name.alias("player_name"),
        (F.col("p_partkey") % 25).cast("string").alias("team"),
        listings.alias("l"),
    ).select("player_id", "player_name", "team", "l.listing", "l.position")


SQL["rosters"] = """
  SELECT p_partkey AS player_id,
         upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' '
           || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2)
           || ' ' || CAST(p_partkey % 700 AS VARCHAR) AS player_name,
         CAST(p_partkey % 25 AS VARCHAR) AS team, listing,
         CASE WHEN listing = 2 THEN 'RB'
              WHEN p_type = 'LARGE' THEN 'QB' WHEN p_type = 'MEDIUM' THEN 'RB'
              WHEN p_type = 'SMALL' THEN 'TE' WHEN p_type = 'STANDARD' THEN 'WR' ELSE p_type END AS position
  FROM part, (VALUES (1), (2)) v(listing)
  WHERE listing = 1 OR p_size >= 40
"""

SQL["positions"] = """
  SELECT player_id, arg_max(position, listing) AS position FROM rosters GROUP BY player_id
"""


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("team_name"), F.col("n_nationkey").cast("string").alias("team_id")
    )


def _paired_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a game: nations 0 and 1 meet, 2 and 3 meet, and so on; the last meets an unknown team."""
    nation = F.col("c_nationkey")
    home = nation - nation % 2
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            "o_orderpriority",
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
            F.floor("o_totalprice").alias("price"),
            home.alias("home"),
            (home + 1).alias("away"),
        )
    )


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("price")
    return _paired_orders(spark, sf_dir).select(
        "o_orderkey",
        F.col("year").cast("string").alias("schedule_season"),
        F.when(key % 50 == 0, "Wildcard").otherwise(F.col("month").cast("string")).alias("schedule_week"),
        F.concat(F.lit("NATION_"), F.col("home")).alias("team_home"),
        F.concat(F.lit("NATION_"), F.col("away")).alias("team_away"),
        F.when(key % 3 == 0, F.col("home").cast("string"))
        .when(key % 3 == 1, F.col("away").cast("string"))
        .alias("team_favorite_id"),
        F.when(key % 37 == 0, "PK")
        .otherwise(F.concat(F.lit("-"), (price % 14).cast("string"), F.lit(".5")))
        .alias("spread_favorite"),
        F.when(key % 41 == 0, " ").otherwise((F.lit(35) + price % 20).cast("string")).alias("over_under_line"),
        (F.col("o_orderpriority") == "1-URGENT").alias("schedule_playoff"),
    )


SQL["paired_orders"] = """
  SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month,
         CAST(floor(o_totalprice) AS BIGINT) AS price, c_nationkey - c_nationkey % 2 AS home,
         c_nationkey - c_nationkey % 2 + 1 AS away
  FROM orders JOIN customer ON o_custkey = c_custkey
"""

SQL["odds"] = """
  SELECT o_orderkey, CAST(year AS VARCHAR) AS schedule_season,
         CASE WHEN o_orderkey % 50 = 0 THEN 'Wildcard' ELSE CAST(month AS VARCHAR) END AS schedule_week,
         'NATION_' || home AS team_home, 'NATION_' || away AS team_away,
         CASE o_orderkey % 3 WHEN 0 THEN CAST(home AS VARCHAR) WHEN 1 THEN CAST(away AS VARCHAR) END
           AS team_favorite_id,
         CASE WHEN o_orderkey % 37 = 0 THEN 'PK' ELSE '-' || price % 14 || '.5' END AS spread_favorite,
         CASE WHEN o_orderkey % 41 = 0 THEN ' ' ELSE CAST(35 + price % 20 AS VARCHAR) END AS over_under_line,
         o_orderpriority = '1-URGENT' AS schedule_playoff
  FROM paired_orders
"""

SQL["odds_numbers"] = """
  SELECT CAST(try_cast(schedule_season AS DOUBLE) AS BIGINT) AS season,
         CAST(try_cast(schedule_week AS DOUBLE) AS BIGINT) AS week, team_home, team_away, team_favorite_id,
         try_cast(spread_favorite AS DOUBLE) AS spread_favorite, try_cast(over_under_line AS DOUBLE) AS total_line,
         schedule_playoff
  FROM odds
  WHERE try_cast(schedule_week AS DOUBLE) IS NOT NULL AND try_cast(spread_favorite AS DOUBLE) IS NOT NULL
        AND try_cast(over_under_line AS DOUBLE) IS NOT NULL
"""

SQL["home_lines"] = """
  SELECT season, week, CAST(h.n_nationkey AS VARCHAR) AS home_id, CAST(a.n_nationkey AS VARCHAR) AS away_id,
         CASE WHEN team_favorite_id = CAST(h.n_nationkey AS VARCHAR) THEN spread_favorite ELSE -spread_favorite END
           AS home_spread, total_line
  FROM odds_numbers LEFT JOIN nation h ON team_home = h.n_name LEFT JOIN nation a ON team_away = a.n_name
  WHERE NOT schedule_playoff AND season BETWEEN 1995 AND 2001
"""

SQL["team_lines"] = """
  SELECT season, week, team, spread_line, total_line, total_line / 2 - spread_line / 2 AS implied_total
  FROM (SELECT season, week, home_id AS team, home_spread AS spread_line, total_line FROM home_lines
        UNION ALL SELECT season, week, away_id, -home_spread, total_line FROM home_lines)
  WHERE team IS NOT NULL
"""


def upcoming_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as two market rows, one with the spread and one with the total."""
    key, price = F.col("o_orderkey"), F.col("price")
    spread = (price % 29 - 14).cast("string")
    points = F.when(key % 41 == 0, "off").otherwise((F.lit(35) + price % 20).cast("string"))
    rows = F.explode(
        F.array(
            F.struct(
                F.lit("spreads").alias("market"),
                spread.alias("point_1"),
                F.lit(None).cast("string").alias("over/under"),
            ),
            F.struct(
                F.lit("totals").alias("market"), F.lit(None).cast("string").alias("point_1"), points.alias("over/under")
            ),
        )
    )
    return (
        _paired_orders(spark, sf_dir)
        .select(
            F.col("year").alias("season"),
            F.col("month").alias("week"),
            F.concat(F.lit("NATION_"), F.col("home")).alias("home_team"),
            F.concat(F.lit("NATION_"), F.col("away")).alias("away_team"),
            "o_orderkey",
            rows.alias("r"),
        )
        .select("season", "week", "home_team", "away_team", "o_orderkey", "r.*")
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a price on its part, the name written in several ways."""
    number = F.col("l_linenumber")
    suffix = F.when(number == 1, " Jr.").when(number == 2, " II").when(number == 3, "").otherwise(" Sr")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.upper("p_name"), F.lit("' "), (F.col("p_partkey") % 700).cast("string"), suffix).alias(
                "description"
            ),
            F.when(F.col("l_quantity") <= 12, -F.lit(95) - F.col("l_quantity") * 8)
            .when(F.col("l_quantity") == 13, F.lit(0))
            .otherwise(F.col("l_quantity") * 20 - 180)
            .cast("int")
            .alias("price"),
        )
    )


SQL["prices"] = """
  SELECT upper(p_name) || ''' ' || CAST(p_partkey % 700 AS VARCHAR)
           || CASE l_linenumber WHEN 1 THEN ' Jr.' WHEN 2 THEN ' II' WHEN 3 THEN '' ELSE ' Sr' END AS description,
         CAST(CASE WHEN l_quantity <= 12 THEN -95 - l_quantity * 8 WHEN l_quantity = 13 THEN 0
                   ELSE l_quantity * 20 - 180 END AS BIGINT) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey
"""

SQL["best_prices"] = """
  SELECT merge_name, price, n_prices,
         CASE WHEN price > 0 THEN 100.0 / (price + 100) WHEN price < 0 THEN abs(price) / (abs(price) + 100.0)
              ELSE 0 END AS market_implied_prob
  FROM (SELECT trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9\\s]', '', 'g'),
                                   '\\s(jr|sr|ii|iii|iv)$', '')) AS merge_name,
               coalesce(max(price) FILTER (WHERE price <> 0), max(price)) AS price, count(*) AS n_prices
        FROM prices GROUP BY ALL)
"""


def weekly(
    spark: SparkSession, sf_dir: str, played: DataFrame | None = None, opponents: bool = True
) -> DataFrame:
    """Plays summed to one row per part, team, season and week; part and position are looked up afterwards.

    Without ``opponents`` the plays need no join with orders and customer.
    """
    rush, target = F.col("rush_attempt"), F.col("pass_attempt")
    yards, epa = F.col("yardline_100"), F.col("epa")
    if played is None:
        played = plays(spark, sf_dir) if opponents else offence_plays(spark, sf_dir)
    sums = {
        "carries": F.sum(rush),
        "rushing_yards": F.sum(yards * rush),
        "rushing_tds": F.sum(F.when(rush == 1, F.col("rush_touchdown"))),
        "receptions": F.sum(F.when(epa >= 0, target).otherwise(0.0)),
        "targets": F.sum(target),
        "receiving_yards": F.sum(yards * target),
        "receiving_tds": F.sum(F.when(target == 1, F.col("pass_touchdown"))),
        "yards": F.sum(yards),
        "rushing_epa": F.sum(epa * rush),
        "receiving_epa": F.sum(epa * target),
        "n_plays": F.count(F.lit(1)),
    }
    if opponents:
        sums["opponent_team"] = F.min(F.col("defteam").cast("int")).cast("string")
    summed = played.groupBy("player_id", F.col("posteam").alias("recent_team"), "season", "week").agg(
        *[column.alias(name) for name, column in sums.items()]
    )
    target_share = F.col("targets") / F.col("n_plays")
    listed = rosters(spark, sf_dir).where("listing = 1").select("player_id", "player_name", "position")
    return (
        summed.join(listed, "player_id")
        .withColumns(
            {
                "target_share": target_share,
                "wopr": target_share * 1.5 + F.col("receiving_yards") / F.col("yards") * 0.7,
            }
        )
        .drop("yards", "n_plays")
        .withColumnRenamed("player_name", "player_display_name")
    )


SQL["weekly"] = """
  SELECT s.*, player_name AS player_display_name, position, targets / n_plays AS target_share,
         targets / n_plays * 1.5 + receiving_yards / yards * 0.7 AS wopr
  FROM (SELECT player_id, posteam AS recent_team, season, week,
               CAST(min(CAST(defteam AS INTEGER)) AS VARCHAR) AS opponent_team,
               CAST(sum(rush_attempt) AS DOUBLE) AS carries, sum(yardline_100 * rush_attempt) AS rushing_yards,
               CAST(sum(CASE WHEN rush_attempt = 1 THEN rush_touchdown END) AS DOUBLE) AS rushing_tds,
               CAST(sum(CASE WHEN epa >= 0 THEN pass_attempt ELSE 0.0 END) AS DOUBLE) AS receptions,
               CAST(sum(pass_attempt) AS DOUBLE) AS targets, sum(yardline_100 * pass_attempt) AS receiving_yards,
               CAST(sum(CASE WHEN pass_attempt = 1 THEN pass_touchdown END) AS DOUBLE) AS receiving_tds,
               sum(yardline_100) AS yards, sum(epa * rush_attempt) AS rushing_epa,
               sum(epa * pass_attempt) AS receiving_epa, CAST(count(*) AS DOUBLE) AS n_plays
        FROM plays GROUP BY player_id, posteam, season, week) s
       JOIN (SELECT player_id, player_name, position FROM rosters WHERE listing = 1) USING (player_id)
"""

SQL["labelled"] = """
  SELECT * REPLACE (coalesce(rushing_tds, 0) AS rushing_tds, coalesce(receiving_tds, 0) AS receiving_tds),
         CASE WHEN coalesce(rushing_tds, 0) > 0 OR coalesce(receiving_tds, 0) > 0 THEN 1 ELSE 0 END
           AS scored_touchdown
  FROM weekly WHERE week <= 18 AND position IN ('QB', 'RB', 'TE', 'WR')
"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _paired_orders(spark, sf_dir)
        .select(
            F.col("year").cast("bigint").alias("season"),
            F.col("month").cast("bigint").alias("week"),
            F.col("home").cast("string").alias("home_team"),
            F.col("away").cast("string").alias("away_team"),
        )
        .distinct()
    )


SQL["schedule"] = """
  SELECT DISTINCT year AS season, month AS week, CAST(home AS VARCHAR) AS home_team, CAST(away AS VARCHAR) AS away_team
  FROM paired_orders
"""


def consensus(lines: DataFrame) -> DataFrame:
    """Many games a week here: their mean is the team's line."""
    return lines.groupBy("team", "season", "week").agg(
        *[F.avg(c).alias(c) for c in ("spread_line", "total_line", "implied_total")]
    )


SQL["consensus"] = """
  SELECT team AS recent_team, season, week, avg(spread_line) AS spread_line, avg(total_line) AS total_line,
         avg(implied_total) AS implied_total
  FROM team_lines GROUP BY ALL
"""

SQL["shares"] = """
  SELECT player_id, posteam AS recent_team, season, week,
         coalesce(r20 / nullif(tr20, 0), 0) AS redzone_carry_share, coalesce(t20 / nullif(tt20, 0), 0)
           AS redzone_target_share,
         coalesce(r5 / nullif(tr5, 0), 0) AS inside_5_carry_share, coalesce(t5 / nullif(tt5, 0), 0)
           AS inside_5_target_share
  FROM (SELECT player_id, posteam, season, week, CAST(sum(rush_attempt) AS DOUBLE) AS r20,
               CAST(sum(pass_attempt) AS DOUBLE) AS t20,
               CAST(coalesce(sum(rush_attempt) FILTER (WHERE yardline_100 <= 5), 0) AS DOUBLE) AS r5,
               CAST(coalesce(sum(pass_attempt) FILTER (WHERE yardline_100 <= 5), 0) AS DOUBLE) AS t5
        FROM plays WHERE yardline_100 <= 20 AND rush_attempt + pass_attempt > 0 GROUP BY ALL)
       JOIN (SELECT posteam, season, week, CAST(sum(rush_attempt) AS DOUBLE) AS tr20,
                    CAST(sum(pass_attempt) AS DOUBLE) AS tt20,
                    CAST(coalesce(sum(rush_attempt) FILTER (WHERE yardline_100 <= 5), 0) AS DOUBLE) AS tr5,
                    CAST(coalesce(sum(pass_attempt) FILTER (WHERE yardline_100 <= 5), 0) AS DOUBLE) AS tt5
             FROM plays WHERE yardline_100 <= 20 GROUP BY ALL) USING (posteam, season, week)
"""

SQL["conversion"] = """
  SELECT recent_team, season, week, count(*) AS redzone_trips, sum(is_td) AS redzone_tds,
         CAST(sum(is_td) AS DOUBLE) / count(*) AS redzone_td_rate
  FROM (SELECT posteam AS recent_team, season, week, drive, max(touchdown) AS is_td
        FROM plays WHERE yardline_100 <= 20 GROUP BY ALL)
  GROUP BY ALL
"""

SQL["allowed"] = """
  SELECT defteam AS opponent_team, season, week, sum(pass_touchdown) AS passing_tds_allowed,
         sum(rush_touchdown) AS rushing_tds_allowed, sum(touchdown) AS total_tds_allowed, sum(epa) AS epa_allowed
  FROM plays GROUP BY ALL
"""

def _zeros(columns: list[str]) -> str:
    return ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in columns)


SQL["players"] = f"""
  SELECT labelled.*, {_zeros(SHARES)} FROM labelled LEFT JOIN shares USING (player_id, recent_team, season, week)
"""

SQL["offences"] = f"""
  SELECT recent_team, season, week,
         {_zeros(["redzone_trips", "redzone_tds", "redzone_td_rate", "spread_line", "total_line", "implied_total"])}
  FROM (SELECT DISTINCT recent_team, season, week FROM players)
       LEFT JOIN conversion USING (recent_team, season, week) LEFT JOIN consensus USING (recent_team, season, week)
"""

SQL["defences"] = f"""
  SELECT opponent_team, season, week,
         {_zeros(["passing_tds_allowed", "rushing_tds_allowed", "total_tds_allowed", "epa_allowed", *ALLOWED])}
  FROM (SELECT DISTINCT opponent_team, season, week FROM players)
       LEFT JOIN allowed USING (opponent_team, season, week)
       LEFT JOIN allowed_positions USING (opponent_team, season, week)
"""

MODEL_INPUTS = (
    "plays rosters positions allowed_positions weekly labelled shares conversion allowed paired_orders odds"
    " odds_numbers home_lines team_lines consensus players offences defences"
)


def with_sql(names: str, body: str) -> str:
    """``body`` behind the named views, given in the order they build on each other."""
    parts = [f"{name} AS ({SQL[name]})" for name in names.split()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
