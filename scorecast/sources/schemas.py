"""Columns and types of every source."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

_TYPES: dict[str, DataType] = {
    "text": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "flag": BooleanType(),
}


def columns(**by_type: str) -> StructType:
    """A schema from space-separated column names per type, in the order given."""
    schema = StructType()
    for kind, names in by_type.items():
        for name in names.split():
            schema.add(name, _TYPES[kind])
    return schema


WEEKLY = columns(
    text="player_id player_display_name position recent_team opponent_team",
    int="season week",
    double="carries rushing_yards rushing_tds receptions targets receiving_yards receiving_tds wopr rushing_epa"
    " receiving_epa target_share",
)

PLAYS = columns(
    int="season week",
    text="posteam defteam rusher_player_id receiver_player_id",
    double="drive yardline_100 rush_attempt pass_attempt touchdown rush_touchdown pass_touchdown epa",
)

ROSTERS = columns(text="player_id player_name position team", int="season")

SCHEDULE = columns(int="season week", text="home_team away_team")

# Read as text: the numbers need a forgiving cast.
HISTORICAL_ODDS = columns(
    text="schedule_season schedule_week team_home team_away team_favorite_id spread_favorite over_under_line",
    flag="schedule_playoff",
)

TEAMS = columns(text="team_name team_id")

UPCOMING_LINES = columns(text="home_team away_team market point_1 label_2 odd_2 point_2 over/under")

PRICES = columns(text="description", int="price")
