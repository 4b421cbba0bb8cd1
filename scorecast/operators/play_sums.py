"""All aggregates of the play table from one scan and one shuffle.

A play counts for up to seven rows: its team, its rusher and its receiver in
the zones, its drive, the defence, and the scorers. Each row has the kind of
group it belongs to, the group's key and four or more numbers to add up, so
one aggregate that Spark combines before the shuffle does for all kinds. The
sums are stored by kind; drives become teams and scorers become positions from
there, on far fewer rows than there are plays.

Defined results are those of the single aggregates in ``plays``: rows with a
missing group key count for no group, missing numbers and NaN count as 0.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.functions.columns import amount, is_one, present
from scorecast.operators import plays as ops
from scorecast.sources.store import save_parts

KINDS = ["team", "player", "drive", "defence", "scorer"]
KEYS = ["kind", "team", "season", "week", "player_id", "drive"]


@dataclass(frozen=True)
class PlaySums:
    """Stored sums by kind of group, with the columns that the second steps in ``plays`` read."""

    teams: DataFrame
    players: DataFrame
    drives: DataFrame
    defences: DataFrame
    scorers: DataFrame
    zones: Mapping[str, int]

    def usage_share(self) -> DataFrame:
        return ops.shares_of(self.players, self.teams, self.zones)

    def drive_conversion(self) -> DataFrame:
        return ops.conversion_of(self.drives)

    def allowed_by_team(self) -> DataFrame:
        return self.defences.withColumnRenamed("defteam", "opponent_team")

    def allowed_by_position(self, positions: DataFrame) -> DataFrame:
        return ops.allowed_of(self.scorers, positions)


def summed_plays(plays: DataFrame, zones: Mapping[str, int] = ops.ZONES, zone: int = ops.ZONES["redzone"]) -> DataFrame:
    """One row per group of every kind: its key, NULL where the kind has none, and ``sum_0``, ``sum_1``, ...

    team and player: rushes and targets of each zone. drive: touchdowns.
    defence: passing, rushing and all touchdowns, expected points. scorer:
    rushing and passing touchdowns against a defence.
    """
    width = max(4, 2 * len(zones))
    types = {name: plays.schema[name].dataType for name in ("rusher_player_id", "drive")}
    no_player, no_drive = F.lit(None).cast(types["rusher_player_id"]), F.lit(None).cast(types["drive"])
    rush, target = amount(F.col("rush_attempt")), amount(F.col("pass_attempt"))
    one, nothing = F.lit(1.0), F.lit(0.0)

    def row(
        kind: str,
        condition: Column,
        numbers: list[Column],
        team: str,
        player: Column = no_player,
        drive: Column = no_drive,
    ) -> Column:
        sums = [n.alias(f"sum_{i}") for i, n in enumerate(numbers + [nothing] * (width - len(numbers)))]
        keys = [F.lit(kind).alias("kind"), F.col(team).alias("team"), player.alias("player_id"), drive.alias("drive")]
        return F.when(condition, F.struct(*keys, *sums))

    def in_zones(rushes: Column, targets: Column) -> list[Column]:
        return [
            F.when(F.col("yardline_100") <= yards, value).otherwise(nothing)
            for yards in zones.values()
            for value in (rushes, targets)
        ]

    rusher, receiver = F.col("rusher_player_id"), F.col("receiver_player_id")
    inside = (F.col("yardline_100") <= max(zones.values())) & present(*ops.TEAM_WEEK)
    in_drive = (F.col("yardline_100") <= zone) & present(*ops.TEAM_WEEK, "drive")
    against, ran, threw = present(*ops.DEFENCE_WEEK), is_one(F.col("rush_touchdown")), is_one(F.col("pass_touchdown"))
    given_up = [amount(F.col(c)) for c in ("pass_touchdown", "rush_touchdown", "touchdown", "epa")]
    scored = F.when(is_one(F.col("touchdown")), one).otherwise(nothing)
    rows = F.array(
        row("team", inside, in_zones(rush, target), "posteam"),
        row("player", inside & rusher.isNotNull(), in_zones(rush, nothing), "posteam", rusher),
        row("player", inside & receiver.isNotNull(), in_zones(nothing, target), "posteam", receiver),
        row("drive", in_drive, [scored], "posteam", drive=F.col("drive")),
        row("defence", against & present("posteam"), given_up, "defteam"),
        row("scorer", against & ran & rusher.isNotNull(), [one, nothing], "defteam", rusher),
        row("scorer", against & threw & receiver.isNotNull(), [nothing, one], "defteam", receiver),
    )
    expanded = plays.select("season", "week", F.explode(rows).alias("row")).where("row IS NOT NULL")
    sums = [F.sum(f"sum_{i}").alias(f"sum_{i}") for i in range(width)]
    return expanded.select("season", "week", "row.*").groupBy(*KEYS).agg(*sums)


def play_sums(
    plays: DataFrame, zones: Mapping[str, int] = ops.ZONES, zone: int = ops.ZONES["redzone"]
) -> PlaySums:
    """Reads the plays once and stores their sums, a folder for each kind."""
    parts = save_parts(summed_plays(plays, zones, zone), "play-sums", "kind", KINDS)
    counted = [f"{name}_{what}" for name in zones for what in ("rushes", "targets")]
    in_zone = [F.col(f"sum_{i}").alias(name) for i, name in enumerate(counted)]
    offence, defence = [[F.col("team").alias(team), "season", "week"] for team in ("posteam", "defteam")]
    allowed = ["passing_tds_allowed", "rushing_tds_allowed", "total_tds_allowed", "epa_allowed"]
    kinds = [F.col(f"sum_{i}").cast("long").alias(name) for i, name in enumerate(("rushing", "passing"))]
    return PlaySums(
        teams=parts["team"].select(*offence, *in_zone),
        players=parts["player"].select("player_id", *offence, *in_zone),
        drives=parts["drive"].select(*offence, "drive", (F.col("sum_0") > 0).cast("int").alias("is_td")),
        defences=parts["defence"].select(*defence, *[F.col(f"sum_{i}").alias(name) for i, name in enumerate(allowed)]),
        scorers=parts["scorer"].select(*defence, "player_id", *kinds),
        zones=zones,
    )
