from __future__ import annotations

import pytest

from pyspark.sql import functions as F
from scorecast.sources.store import save
from scorecast.sources.tables import write_csv
from scorecast.errors import UnmappedTeamError
from scorecast.operators import market as ops
from scorecast.sources.tables import duplicate_keys
from tests.conftest import records

ODDS = (
    "schedule_season string, schedule_week string, team_home string, team_away string, team_favorite_id string,"
    " spread_favorite string, over_under_line string, schedule_playoff boolean"
)


@pytest.fixture(scope="module")
def ids(spark):
    teams = [
        ("Alphas", "AAA"),
        ("Betas", "BBB"),
        ("Gammas", "LVR"),
        ("Old Gammas", "LVR"),
        ("Deltas", "DDD"),
        ("Nameless", None),
    ]
    return ops.team_ids(spark.createDataFrame(teams, "team_name string, team_id string"))


def test_many_names_one_id_in_weekly_spelling(ids):
    got = records(ids, "team_name")
    assert got["Gammas"]["team_id"] == got["Old Gammas"]["team_id"] == "LV"
    assert "Nameless" not in got


def test_team_game_lines(spark, ids):
    odds = spark.createDataFrame(
        [
            ("2023", "1", "Alphas", "Betas", "AAA", "-3.5", "47", False),
            ("2023", "2", "Betas", "Gammas", "LVR", "-7", "40.5", False),  # the alias is known to the favourite too
            ("2023", "3", "Alphas", "Deltas", "PICK", "0", "44", False),  # no favourite
            ("2023", "4", "Alphas", "Deltas", None, "-2", "44", False),
            ("2023", "5", "Alphas", "Strangers", "AAA", "-2", "44", False),  # one side unknown
            ("2023", "Wildcard", "Alphas", "Betas", "AAA", "-3", "45", False),
            ("2023", "6", "Alphas", "Betas", "AAA", "-3", "", False),
            ("2023", "7", "Alphas", "Betas", "AAA", "off", "45", False),
            ("2023", "8", "Alphas", "Betas", "AAA", "-3", "45", True),  # playoff
            ("2023", "9", "Alphas", "Betas", "AAA", "-3", "45", None),
            ("2019", "1", "Alphas", "Betas", "AAA", "-3", "45", False),
        ],
        ODDS,
    )
    got = records(ops.team_game_lines(odds, ids, [2023]), "week", "team")
    weeks = {1: ["AAA", "BBB"], 2: ["BBB", "LV"], 3: ["AAA", "DDD"], 4: ["AAA", "DDD"], 5: ["AAA"]}
    assert set(got) == {(week, team) for week, teams in weeks.items() for team in teams}
    assert got[1, "AAA"]["spread_line"] == -3.5 and got[1, "BBB"]["spread_line"] == 3.5
    assert got[1, "AAA"]["implied_total"] == 25.25 and got[1, "BBB"]["implied_total"] == 21.75
    assert got[2, "LV"]["spread_line"] == -7.0 and got[2, "BBB"]["spread_line"] == 7.0
    assert got[3, "AAA"]["spread_line"] == 0.0
    assert got[4, "AAA"]["spread_line"] == 2.0
    for week in (1, 2, 3, 4):
        sides = [row for (w, _), row in got.items() if w == week]
        assert sum(row["spread_line"] for row in sides) == 0
        assert sum(row["implied_total"] for row in sides) == sides[0]["total_line"]


def test_consolidated_lines(spark, ids):
    lines = spark.createDataFrame(
        [
            ("Alphas", "Betas", "spreads", "-7", None),
            ("Alphas", "Betas", "totals", None, "46.5"),
            ("Gammas", "Deltas", "spreads", "2.5", "45.5"),
            ("Deltas", "Strangers", "spreads", "1", "40"),  # unknown opponent: no game
            ("Betas", "Gammas", "spreads", "1", None),  # no total anywhere
        ],
        "home_team string, away_team string, market string, point_1 string, `over/under` string",
    )
    got = records(ops.consolidate_lines(lines, ids), "team")
    assert set(got) == {"AAA", "BBB", "LV", "DDD"}
    assert got["AAA"]["opponent"] == "BBB" and got["BBB"]["opponent"] == "AAA"
    assert (got["AAA"]["spread_line"], got["AAA"]["total_line"], got["AAA"]["implied_total"]) == (-7.0, 46.5, 26.75)
    assert got["DDD"]["spread_line"] == -2.5


def test_coverage_check_names_the_teams(spark):
    used = spark.createDataFrame([("AAA",), ("LA",), (None,)], "team string")
    known = spark.createDataFrame([("AAA",), ("LAR",)], "id string")
    assert [r.team for r in ops.uncovered_teams(used, "team", known, "id").collect()] == ["LA"]
    with pytest.raises(UnmappedTeamError, match="LA"):
        ops.require_coverage(used, "team", known, "id")
    ops.require_coverage(used.where("team = 'AAA'"), "team", known, "id")


PRICES = [
    ("Marvin Harrison Jr.", 200),
    ("MARVIN HARRISON", -110),
    ("Ja'Marr Chase", -125),
    ("Nobody Known", 500),
    ("Even Money", 0),
    ("Half Priced", 0),
    ("Half Priced", -150),
    ("half priced", None),
]


def test_best_price_and_repeated_names(spark):
    prices = spark.createDataFrame(PRICES, "description string, price int")
    best = records(ops.best_prices(prices), "merge_name")
    assert best["marvin harrison"]["price"] == 200 and best["marvin harrison"]["n_prices"] == 2
    assert best["marvin harrison"]["market_implied_prob"] == pytest.approx(1 / 3)
    # A price of 0 gives way to a real one, and the probability is that of the price shown.
    assert best["half priced"]["price"] == -150 and best["half priced"]["n_prices"] == 2
    assert best["half priced"]["market_implied_prob"] == pytest.approx(0.6)
    assert best["even money"]["price"] == 0 and best["even money"]["market_implied_prob"] == 0.0
    repeated = duplicate_keys(ops.price_table(prices), ["merge_name"]).collect()
    assert sorted(tuple(r) for r in repeated) == [("half priced", 3), ("marvin harrison", 2)]


def test_ranks_survive_many_files(spark, tmp_path):
    rows = [(i, float((i * 7919) % 5003) / 5003, "x" * (i % 90)) for i in range(4_000)]
    predictions = spark.createDataFrame(rows, "player_id int, p double, note string")
    merging = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        stored = save(ops.with_rank(predictions, "p", ["player_id"]), "ranked-test")
        assert len(stored.inputFiles()) >= 5
        path = write_csv(stored.orderBy("rank"), str(tmp_path / "ranked"))
        written = spark.read.option("header", True).csv(path).orderBy(F.col("rank").cast("int")).limit(25).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merging)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.player_id for r in stored.orderBy("rank").limit(25).collect()] == expected[:25]
    assert [int(r.player_id) for r in written] == expected[:25]
    assert [(r["rank"], r.player_id) for r in stored.orderBy("rank").collect()] == list(enumerate(expected, start=1))


def test_edges_keep_one_row_per_prediction(spark):
    predictions = spark.createDataFrame(
        [
            (1, "Marvin Harrison", 0.5),
            (2, "Ja'Marr Chase", 0.6),
            (3, "JaMarr Chase", 0.1),  # a namesake gets the same price
            (4, "Unpriced Player", 0.9),
            (5, None, 0.4),
            (6, "Even Money", 0.2),
        ],
        "player_id int, player_name string, p double",
    )
    prices = spark.createDataFrame(PRICES, "description string, price int")
    got = ops.ranked(ops.attach_prices(predictions, prices, "p"), "p", ["player_id"]).collect()
    assert [r.player_id for r in got] == [2, 1, 6, 3]
    by_id = {r.player_id: r for r in got}
    assert by_id[1].model_edge == pytest.approx(0.5 - 1 / 3)
    assert by_id[6].market_implied_prob == 0.0
    assert by_id[2].market_implied_prob == by_id[3].market_implied_prob == pytest.approx(125 / 225)
