"""Per-week aggregates of the play table: usage, conversion and what defences allow.

Every aggregate is a plain sum or maximum, so Spark combines rows before each
shuffle; a team, player or drive that holds most of the plays sends one
partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.functions.columns import amount, fill_missing, is_one, present, rate, share, total
from scorecast.sources.store import save_split

# Zones in yards from the goal line, and the positions in play.
ZONES = {"redzone": 20, "inside_5": 5}
POSITIONS = ["QB", "RB", "TE", "WR"]
TEAM_WEEK = ["posteam", "season", "week"]
DEFENCE_WEEK = ["defteam", "season", "week"]
ALLOWED_BY_POSITION = [
    ("rushing", "RB"),
    ("rushing", "WR"),
    ("rushing", "QB"),
    ("passing", "RB"),
    ("passing", "WR"),
    ("passing", "TE"),
]


def usage_share(plays: DataFrame, zones: Mapping[str, int] = ZONES) -> DataFrame:
    """Each player's part of the team's rushes and targets inside every zone.

    Result key: player_id, posteam, season, week. A play counts once for the
    team, once for its rusher and once for its receiver; all three and all
    zones are summed in one scan and one shuffle. The summed table is written
    out, so that the team totals join back without reading the plays again.
    """
    inside = plays.where(F.col("yardline_100") <= max(zones.values())).where(present(*TEAM_WEEK))
    nothing = F.lit(0.0)
    rush, target = amount(F.col("rush_attempt")), amount(F.col("pass_attempt"))
    no_player = F.lit(None).cast(plays.schema["rusher_player_id"].dataType)

    def role(is_team: bool, player: Column, rushes: Column, targets: Column) -> Column:
        return F.struct(
            F.lit(is_team).alias("is_team"),
            player.alias("player_id"),
            rushes.alias("rushes"),
            targets.alias("targets"),
        )

    roles = F.explode(
        F.array(
            role(True, no_player, rush, target),
            role(False, F.col("rusher_player_id"), rush, nothing),
            role(False, F.col("receiver_player_id"), nothing, target),
        )
    )
    sums = []
    for zone, yards in zones.items():
        in_zone = F.col("yardline_100") <= yards
        sums += [
            F.sum(F.when(in_zone, F.col("rushes")).otherwise(0.0)).alias(f"{zone}_rushes"),
            F.sum(F.when(in_zone, F.col("targets")).otherwise(0.0)).alias(f"{zone}_targets"),
        ]
    summed = (
        inside.select(*TEAM_WEEK, "yardline_100", roles.alias("role"))
        .select(*TEAM_WEEK, "yardline_100", "role.*")
        .where(F.col("is_team") | F.col("player_id").isNotNull())
        .groupBy("is_team", "player_id", *TEAM_WEEK)
        .agg(*sums)
    )
    teams, players = save_split(summed, "usage", "is_team")
    return shares_of(players, teams, zones)


def shares_of(players: DataFrame, teams: DataFrame, zones: Mapping[str, int] = ZONES) -> DataFrame:
    """Each player's sums beside those of the team, and the part they are; both tables have the sums of every zone."""
    counted = [f"{zone}_{kind}" for zone in zones for kind in ("rushes", "targets")]
    teams = teams.select(*TEAM_WEEK, *[F.col(name).alias(f"team_{name}") for name in counted])
    players = players.withColumnsRenamed({name: f"player_{name}" for name in counted})
    joined = players.join(teams, TEAM_WEEK, "left")
    shares = []
    for zone in zones:
        for kind, name in (("rushes", "carry"), ("targets", "target")):
            shares.append(
                share(F.col(f"player_{zone}_{kind}"), F.col(f"team_{zone}_{kind}")).alias(f"{zone}_{name}_share")
            )
    return joined.select("*", *shares)


def drive_conversion(plays: DataFrame, zone: int = ZONES["redzone"]) -> DataFrame:
    """Drives that reach the zone, those with a touchdown there, and the rate.

    The touchdown may be anyone's, the defence's too.
    """
    drives = (
        plays.where(F.col("yardline_100") <= zone)
        .where(present(*TEAM_WEEK, "drive"))
        .groupBy(*TEAM_WEEK, "drive")
        .agg(F.max(is_one(F.col("touchdown")).cast("int")).alias("is_td"))
    )
    return conversion_of(drives)


def conversion_of(drives: DataFrame) -> DataFrame:
    """Trips, touchdowns and rate per team and week, from one row per drive with its ``is_td``."""
    return (
        drives.groupBy(*TEAM_WEEK)
        .agg(F.count(F.lit(1)).alias("redzone_trips"), F.sum("is_td").alias("redzone_tds"))
        .select(
            F.col("posteam").alias("recent_team"),
            "season",
            "week",
            "redzone_trips",
            "redzone_tds",
            rate(F.col("redzone_tds"), F.col("redzone_trips")).alias("redzone_td_rate"),
        )
    )


def allowed_by_team(plays: DataFrame) -> DataFrame:
    """Touchdowns and expected points a defence gives up per week."""
    return (
        plays.where(present("posteam", *DEFENCE_WEEK))
        .groupBy(*DEFENCE_WEEK)
        .agg(
            total(F.col("pass_touchdown")).alias("passing_tds_allowed"),
            total(F.col("rush_touchdown")).alias("rushing_tds_allowed"),
            total(F.col("touchdown")).alias("total_tds_allowed"),
            total(F.col("epa")).alias("epa_allowed"),
        )
        .withColumnRenamed("defteam", "opponent_team")
    )


def roster_positions(
    rosters: DataFrame, keys: Sequence[str] = ("player_id", "season"), latest_by: Sequence[str] = ()
) -> DataFrame:
    """One position per player and season: that of the last row by ``latest_by``.

    Rows that tie fall back to the position's name.
    """
    order = F.struct(*latest_by, "position")
    return (
        rosters.where(present(*keys, "position"))
        .groupBy(*keys)
        .agg(F.max_by("position", order).alias("position"))
    )


def allowed_by_position(plays: DataFrame, positions: DataFrame) -> DataFrame:
    """Touchdowns a defence gives up per week to each scoring position.

    ``positions`` has one row per player, or per player and season. Scoring
    plays are counted per scorer first, so that a prolific scorer does not
    skew the join. A scorer of an unlisted position keeps the defence's row;
    a scorer on no roster is not counted.
    """
    rushing, passing = is_one(F.col("rush_touchdown")), is_one(F.col("pass_touchdown"))
    scores = F.explode(
        F.array(
            F.struct(F.lit("rushing").alias("kind"), F.when(rushing, F.col("rusher_player_id")).alias("player_id")),
            F.struct(F.lit("passing").alias("kind"), F.when(passing, F.col("receiver_player_id")).alias("player_id")),
        )
    )
    per_scorer = (
        plays.where((F.col("rush_touchdown") == 1) | (F.col("pass_touchdown") == 1))
        .where(present(*DEFENCE_WEEK))
        .select(*DEFENCE_WEEK, scores.alias("score"))
        .select(*DEFENCE_WEEK, "score.*")
        .where(F.col("player_id").isNotNull())
        .groupBy(*DEFENCE_WEEK, "player_id")
        .agg(
            F.count_if(F.col("kind") == "rushing").alias("rushing"),
            F.count_if(F.col("kind") == "passing").alias("passing"),
        )
    )
    return allowed_of(per_scorer, positions)


def allowed_of(per_scorer: DataFrame, positions: DataFrame) -> DataFrame:
    """Touchdowns allowed by position, from the ``rushing`` and ``passing`` ones of each scorer against a defence."""
    keys = ["player_id", "season"] if "season" in positions.columns else ["player_id"]
    counts = [
        F.sum(F.when(F.col("position") == position, F.col(kind))).alias(f"{kind}_tds_allowed_to_{position}")
        for kind, position in ALLOWED_BY_POSITION
    ]
    allowed = per_scorer.join(positions, keys).groupBy(*DEFENCE_WEEK).agg(*counts)
    return fill_missing(allowed, [f"{k}_tds_allowed_to_{p}" for k, p in ALLOWED_BY_POSITION]).withColumnRenamed(
        "defteam", "opponent_team"
    )
