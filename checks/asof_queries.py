"""What was known before a week, and the frame of a coming week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.feature_queries import inputs
from checks.market_queries import lines
from checks.registry import register
from scorecast.operators import asof
from scorecast.operators import features as ft
from scorecast.operators.tails import merge_tails, tail_means, tails
from scorecast.operators.windows import latest_present, latest_rows, recent_means
from scorecast.plans.feature_table import Histories, build_histories, opponent_codes
from scorecast.plans.week_scores import scoring_frame as make_frame
from scorecast.sources.store import save

# The coming week of these queries.
SEASON, WEEK = 2000, 6
BEFORE = f"(season < {SEASON} OR (season = {SEASON} AND week < {WEEK}))"
_KEYS = "player_id, recent_team, season, week"

_STATS = ["carries", "rushing_yards", "receptions", "targets", "receiving_yards"]


def _weekly(spark: SparkSession, sf_dir: str, opponents: bool = False) -> DataFrame:
    return ft.label_weekly(views.weekly(spark, sf_dir, opponents=opponents))


@register(
    "history_before",
    views.with_sql("plays rosters weekly labelled", f"SELECT {_KEYS}, carries FROM labelled WHERE {BEFORE}"),
)
def history_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.history_before(_weekly(spark, sf_dir), SEASON, WEEK).select(*ft.PLAYER_WEEK, "carries")


@register(
    "latest_by_player",
    views.with_sql(
        "plays rosters weekly labelled",
        f"""
  SELECT {_KEYS}, {', '.join(_STATS)}
  FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC, recent_team DESC) AS rn
        FROM labelled WHERE {BEFORE}) WHERE rn = 1
""",
    ),
)
def latest_by_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = asof.history_before(_weekly(spark, sf_dir), SEASON, WEEK)
    return latest_rows(history.select(*ft.PLAYER_WEEK, *_STATS), ["player_id"], ft.PLAYER_ORDER)


@register(
    "latest_by_team",
    views.with_sql(
        "plays rosters weekly labelled",
        f"""
  SELECT recent_team, season, week, player_id, opponent_team
  FROM (SELECT *, row_number() OVER (PARTITION BY recent_team ORDER BY season DESC, week DESC, player_id DESC) AS rn
        FROM labelled WHERE {BEFORE}) WHERE rn = 1
""",
    ),
)
def latest_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = asof.history_before(_weekly(spark, sf_dir, opponents=True), SEASON, WEEK)
    return latest_rows(
        history.select(*ft.PLAYER_WEEK, "opponent_team"), ["recent_team"], ["season", "week", "player_id"]
    )


@register(
    "latest_present_by_player",
    views.with_sql(
        "plays rosters weekly",
        """
  SELECT player_id,
         arg_max(rushing_tds, (season, week, recent_team)) FILTER (WHERE rushing_tds IS NOT NULL) AS rushing_tds,
         arg_max(receiving_tds, (season, week, recent_team)) FILTER (WHERE receiving_tds IS NOT NULL) AS receiving_tds
  FROM weekly GROUP BY player_id
""",
    ),
)
def latest_present_by_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_present(
        views.weekly(spark, sf_dir, opponents=False), ["player_id"], ft.PLAYER_ORDER, ["rushing_tds", "receiving_tds"]
    )


def _recent_sql(means: dict[str, tuple[str, int]], key: str, order: str, source: str, where: str = BEFORE) -> str:
    columns = ", ".join(f"avg({c}) FILTER (WHERE rn <= {n}) AS {name}" for name, (c, n) in means.items())
    return f"""
  SELECT {key}, {columns}
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source} WHERE {where})
  WHERE rn <= 5 GROUP BY {key}
"""


_PLAYER_DESC = "season DESC, week DESC, recent_team DESC"
_LATEST_MEANS = {name: mean for name, mean in ft.PLAYER_MEANS.items() if not mean[0].endswith("_share")}
views.SQL["latest_player_means"] = _recent_sql(_LATEST_MEANS, "player_id", _PLAYER_DESC, "labelled")


@register(
    "latest_mean",
    views.with_sql(
        "plays rosters weekly labelled latest_player_means",
        "SELECT player_id, "
        + ", ".join(f"round({name}, 6) + 0.0 AS {name}" for name in _LATEST_MEANS)
        + " FROM latest_player_means",
    ),
)
def latest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = asof.history_before(_weekly(spark, sf_dir), SEASON, WEEK)
    return recent_means(history, ["player_id"], ft.PLAYER_ORDER, _LATEST_MEANS)


@register(
    "tail_update",
    views.with_sql(
        "plays rosters weekly labelled latest_player_means",
        "SELECT player_id, "
        + ", ".join(f"round({name}, 6) + 0.0 AS {name}" for name in _LATEST_MEANS)
        + " FROM latest_player_means",
    ),
)
def tail_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of the seasons long past, then one season and the weeks of another merged in; the SQL reads the whole history."""
    keys, longest = ["player_id"], max(n for _, n in _LATEST_MEANS.values())
    sources = sorted({source for source, _ in _LATEST_MEANS.values()})
    history = asof.history_before(_weekly(spark, sf_dir), SEASON, WEEK)
    history = save(history.select(*ft.PLAYER_WEEK, *sources), "history", partition_by="season")
    season = F.col("season")
    kept = save(tails(history.where(season < SEASON - 1), keys, ft.PLAYER_ORDER, sources, longest), "tails")
    for arrived in (season == SEASON - 1, season == SEASON):
        new = tails(history.where(arrived), keys, ft.PLAYER_ORDER, sources, longest)
        kept = save(merge_tails(kept, new, keys, ft.PLAYER_ORDER, longest), "tails")
    return tail_means(kept, keys, _LATEST_MEANS)


_PAIRS = """
  SELECT season, week, team, max(opponent_team) AS opponent_team
  FROM (SELECT season, week, home_team AS team, away_team AS opponent_team FROM schedule
        UNION ALL SELECT season, week, away_team, home_team FROM schedule)
  GROUP BY ALL
"""


@register("opponent_pairs", views.with_sql("paired_orders schedule", _PAIRS))
def opponent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.opponent_pairs(views.schedule(spark, sf_dir), keys=["season", "week"])


views.SQL["week_pairs"] = f"SELECT team, opponent_team FROM ({_PAIRS}) WHERE season = {SEASON} AND week = {WEEK}"
views.SQL["latest_rosters"] = """
  SELECT player_id, arg_max(player_name, listing) AS player_name, arg_max(team, listing) AS team,
         arg_max(position, listing) AS position
  FROM rosters GROUP BY player_id
"""
views.SQL["playing"] = """
  SELECT player_id, player_name, position, team, opponent_team
  FROM latest_rosters JOIN week_pairs USING (team) WHERE position IN ('QB', 'RB', 'TE', 'WR')
"""


def current_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(views.rosters(spark, sf_dir), ["player_id"], ["listing"])


@register(
    "playing_roster",
    views.with_sql("rosters latest_rosters paired_orders schedule week_pairs playing", "SELECT * FROM playing"),
)
def playing_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = asof.week_of(views.schedule(spark, sf_dir), SEASON, WEEK)
    return asof.playing_roster(current_rosters(spark, sf_dir), asof.opponent_pairs(games))


views.SQL["player_means"] = _recent_sql(ft.PLAYER_MEANS, "player_id", _PLAYER_DESC, "players")
views.SQL["offence_means"] = _recent_sql(ft.OFFENCE_MEANS, "recent_team", "season DESC, week DESC", "offences")
views.SQL["defence_means"] = _recent_sql(ft.DEFENCE_MEANS, "opponent_team", "season DESC, week DESC", "defences")
_MEANS = [*ft.PLAYER_MEANS, *ft.OFFENCE_MEANS, *ft.DEFENCE_MEANS]
_LINES = ["spread_line", "total_line", "implied_total"]
views.SQL["frame"] = f"""
  SELECT player_id, player_name, position, team, opponent_team,
         {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*_MEANS, *_LINES])}
  FROM playing LEFT JOIN player_means USING (player_id)
       LEFT JOIN (SELECT * RENAME (recent_team AS team) FROM offence_means) USING (team)
       LEFT JOIN defence_means USING (opponent_team)
       LEFT JOIN (SELECT recent_team AS team, spread_line, total_line, implied_total FROM consensus
                  WHERE season = {SEASON} AND week = {WEEK}) USING (team)
"""
# Teams that never defended before share one code after the last.
views.SQL["codes"] = """
  SELECT opponent_team, CAST(row_number() OVER (ORDER BY opponent_team) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT opponent_team FROM defences)
"""
_INTERACTION = """
  CASE position WHEN 'RB' THEN avg_redzone_carry_share * avg_rushing_tds_allowed_to_RB
                             + avg_redzone_target_share * avg_passing_tds_allowed_to_RB
                WHEN 'WR' THEN avg_redzone_target_share * avg_passing_tds_allowed_to_WR
                WHEN 'TE' THEN avg_redzone_target_share * avg_passing_tds_allowed_to_TE
                WHEN 'QB' THEN avg_redzone_carry_share * avg_rushing_tds_allowed_to_QB ELSE 0 END
"""
_FRAME_VIEWS = (
    f"{views.MODEL_INPUTS} latest_rosters schedule week_pairs playing player_means offence_means defence_means"
    " frame codes"
)
_FRAME_SQL = f"""
  SELECT player_id, player_name, position, team, opponent_team,
         {', '.join(f'CAST(round({c}, 6) + 0.0 AS DOUBLE) AS {c}' for c in [*_MEANS, *_LINES])},
         round({_INTERACTION}, 6) AS positional_matchup_interaction,
         CAST(CASE position WHEN 'QB' THEN 0 WHEN 'RB' THEN 1 WHEN 'TE' THEN 2 ELSE 3 END AS BIGINT)
           AS position_encoded,
         coalesce(code, (SELECT count(*) FROM codes)) AS opponent_encoded
  FROM frame LEFT JOIN codes USING (opponent_team)
"""


def frame(spark: SparkSession, sf_dir: str, histories: Histories) -> DataFrame:
    upcoming = views.consensus(lines(spark, sf_dir)).where((F.col("season") == SEASON) & (F.col("week") == WEEK))
    return make_frame(
        histories,
        views.schedule(spark, sf_dir),
        current_rosters(spark, sf_dir),
        SEASON,
        WEEK,
        opponents=opponent_codes(histories),
        lines=upcoming,
    )


@register("scoring_frame", views.with_sql(_FRAME_VIEWS, _FRAME_SQL))
def scoring_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, build_histories(inputs(spark, sf_dir)))


@register(
    "usage_filter",
    views.with_sql(
        "plays rosters weekly labelled latest_player_means",
        """
  SELECT player_id, round(avg_carries, 6) AS avg_carries, round(avg_receptions, 6) AS avg_receptions
  FROM latest_player_means WHERE avg_carries >= 2 OR avg_receptions >= 1
""",
    ),
)
def usage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.minimum_usage(latest_mean(spark, sf_dir)).select("player_id", "avg_carries", "avg_receptions")
