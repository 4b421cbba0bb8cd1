from __future__ import annotations

import pytest

from scorecast.operators import plays as ops
from tests.conftest import records

SCHEMA = (
    "posteam string, defteam string, season int, week int, drive double, yardline_100 double, rush_attempt double,"
    " pass_attempt double, rusher_player_id string, receiver_player_id string, touchdown double,"
    " rush_touchdown double, pass_touchdown double, epa double"
)
NAN = float("nan")


def play(team="A", other="B", week=1, drive=1.0, yards=10.0, rusher=None, receiver=None, td=0.0, epa=0.0, **flags):
    rush = 1.0 if rusher else 0.0
    target = 1.0 if receiver else 0.0
    row = {
        "posteam": team,
        "defteam": other,
        "season": 2024,
        "week": week,
        "drive": drive,
        "yardline_100": yards,
        "rush_attempt": rush,
        "pass_attempt": target,
        "rusher_player_id": rusher,
        "receiver_player_id": receiver,
        "touchdown": td,
        "rush_touchdown": (td or 0.0) * rush,
        "pass_touchdown": (td or 0.0) * target,
        "epa": epa,
    }
    row.update(flags)
    return tuple(row.values())


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(
        [
            play(rusher="r1"),
            play(rusher="r1", yards=4.0),
            play(rusher="r2", yards=20.0),
            play(receiver="w1", yards=15.0),
            play(receiver="r1", yards=3.0),
            play(rush_attempt=1.0),  # nobody carried it, the team did
            play(rusher="r2", yards=21.0),  # outside the zone
            play(rusher="r2", yards=NAN),
            play(rusher="r2", yards=None),
            play(team=None, rusher="r9"),
            play(team="C", rusher="c1", week=2, yards=5.0),  # a team without passes
            play(team="C", rusher="c2", week=2, yards=5.0, rush_attempt=NAN),
        ],
        SCHEMA,
    )


def test_usage_shares(plays):
    got = records(ops.usage_share(plays), "player_id", "posteam")
    assert set(got) == {("r1", "A"), ("r2", "A"), ("w1", "A"), ("c1", "C"), ("c2", "C")}
    r1 = got["r1", "A"]
    assert r1["team_redzone_rushes"] == 4 and r1["team_redzone_targets"] == 2
    assert r1["redzone_carry_share"] == 0.5 and r1["redzone_target_share"] == 0.5
    assert r1["inside_5_carry_share"] == 1.0 and r1["inside_5_target_share"] == 1.0
    assert got["w1", "A"]["redzone_carry_share"] == 0.0 and got["w1", "A"]["inside_5_target_share"] == 0.0
    assert got["c1", "C"]["redzone_target_share"] == 0.0 and got["c1", "C"]["redzone_carry_share"] == 1.0
    assert got["c2", "C"]["redzone_carry_share"] == 0.0


def test_shares_of_a_team_never_exceed_one(plays):
    shares = ops.usage_share(plays).groupBy("posteam", "season", "week").sum("redzone_carry_share").collect()
    assert all(row[3] <= 1.0 + 1e-9 for row in shares)


def test_usage_of_no_plays(plays):
    assert ops.usage_share(plays.where("false")).count() == 0


def test_one_zone_holds_only_players_seen_there(plays):
    got = records(ops.usage_share(plays, {"inside_5": 5}), "player_id", "posteam")
    assert set(got) == {("r1", "A"), ("c1", "C"), ("c2", "C")}


def test_drive_conversion(spark):
    df = spark.createDataFrame(
        [
            play(td=1.0),
            play(td=1.0),  # two touchdown plays on a drive: one trip, one touchdown
            play(drive=2.0),
            play(drive=2.0, td=None),
            play(drive=3.0, td=1.0, yards=60.0),  # scored from outside, never reached the zone
            play(drive=None, td=1.0),
            play(week=2, drive=1.0, td=NAN),
        ],
        SCHEMA,
    )
    got = records(ops.drive_conversion(df), "week")
    assert (got[1]["redzone_trips"], got[1]["redzone_tds"], got[1]["redzone_td_rate"]) == (2, 1, 0.5)
    assert (got[2]["redzone_trips"], got[2]["redzone_tds"], got[2]["redzone_td_rate"]) == (1, 0, 0.0)


def test_allowed_by_team(spark):
    df = spark.createDataFrame(
        [
            play(rusher="r", td=1.0, epa=2.0),
            play(receiver="w", td=1.0, epa=NAN),
            play(td=1.0, epa=-0.5),  # a defensive touchdown counts in the total
            play(epa=None),
            play(other=None, td=1.0),
            play(team=None, td=1.0),
        ],
        SCHEMA,
    )
    (row,) = ops.allowed_by_team(df).collect()
    assert row.asDict() == {
        "opponent_team": "B",
        "season": 2024,
        "week": 1,
        "passing_tds_allowed": 1.0,
        "rushing_tds_allowed": 1.0,
        "total_tds_allowed": 3.0,
        "epa_allowed": 1.5,
    }


def test_allowed_by_position(spark):
    df = spark.createDataFrame(
        [
            play(rusher="rb", td=1.0),
            play(rusher="rb", td=1.0),
            play(receiver="rb", td=1.0),
            play(receiver="wr", td=1.0),
            play(rusher="qb", td=1.0),
            play(rusher="stranger", td=1.0),
            play(td=1.0, rush_touchdown=1.0),  # no scorer
            play(other="D", rusher="fb", td=1.0),  # unlisted position: the row stays
            play(other="E", rusher="stranger", td=1.0),  # nobody known scored: no row
            play(rusher="rb"),
        ],
        SCHEMA,
    )
    rosters = spark.createDataFrame(
        [
            ("rb", "WR", 2024, 1),
            ("rb", "RB", 2024, 2),  # the later position wins and counts once
            ("rb", "TE", 2023, 9),
            ("wr", "WR", 2024, 1),
            ("qb", "QB", 2024, 1),
            ("fb", "FB", 2024, 1),
            (None, "RB", 2024, 1),
        ],
        "player_id string, position string, season int, listing int",
    )
    positions = ops.roster_positions(rosters, latest_by=["listing"])
    got = records(ops.allowed_by_position(df, positions), "opponent_team")
    assert set(got) == {"B", "D"}
    b = got["B"]
    assert b["rushing_tds_allowed_to_RB"] == 2 and b["passing_tds_allowed_to_RB"] == 1
    assert b["passing_tds_allowed_to_WR"] == 1 and b["rushing_tds_allowed_to_QB"] == 1
    assert b["rushing_tds_allowed_to_WR"] == 0 and b["passing_tds_allowed_to_TE"] == 0
    assert all(v == 0 for k, v in got["D"].items() if "allowed_to" in k)
