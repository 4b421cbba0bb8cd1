from __future__ import annotations

import math
import random

import pytest

from scorecast.operators import plays as ops
from scorecast.operators.play_sums import play_sums, summed_plays
from scorecast.sources.store import save
from tests.test_plays import NAN, SCHEMA, play


def random_plays(n: int = 1_500):
    """Plays of five teams, one of them with a third of all; any column may be missing, and numbers may be NaN."""
    rng = random.Random(11)
    rows = []
    for _ in range(n):
        team, other = rng.choice("AAABCDE"), rng.choice("ABCDE")
        rusher, receiver = rng.choice([(f"r{rng.randint(1, 9)}", None), (None, f"r{rng.randint(1, 9)}"), (None, None)])
        row = list(
            play(team, other, rng.randint(1, 4), float(rng.randint(1, 6)), float(rng.randint(1, 30)), rusher, receiver,
                 td=float(rng.random() < 0.3), epa=rng.randint(-20, 20) / 4)
        )
        if rng.random() < 0.2:
            row[rng.randrange(len(row))] = None
        if rng.random() < 0.1:
            row[rng.choice([6, 7, 13])] = NAN
        rows.append(tuple(row))
    return rows


@pytest.fixture(scope="module")
def plays(spark):
    return save(spark.createDataFrame(random_plays(), SCHEMA), "plays")


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame([(f"r{i}", p) for i, p in enumerate("RB WR QB TE RB WR FB".split(), 1)], "player_id string, position string")


def rows_of(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(str({c: plain(row[c]) for c in sorted(df.columns)}) for row in df.collect())


def test_each_second_step_gives_what_the_single_aggregate_gives(plays, positions):
    sums = play_sums(plays)
    for together, single in [
        (sums.usage_share(), ops.usage_share(plays)),
        (sums.drive_conversion(), ops.drive_conversion(plays)),
        (sums.allowed_by_team(), ops.allowed_by_team(plays)),
        (sums.allowed_by_position(positions), ops.allowed_by_position(plays, positions)),
    ]:
        assert dict(together.dtypes) == dict(single.dtypes)
        assert rows_of(together) == rows_of(single) and together.count()


def test_other_zones(plays):
    zones = {"near": 3, "far": 25, "middle": 12}
    assert rows_of(play_sums(plays, zones).usage_share()) == rows_of(ops.usage_share(plays, zones))


def test_no_plays(plays, positions):
    sums = play_sums(plays.where("false"))
    for df in (sums.usage_share(), sums.drive_conversion(), sums.allowed_by_team(), sums.allowed_by_position(positions)):
        assert df.count() == 0


def test_the_plays_are_scanned_and_shuffled_once(plays):
    plan = summed_plays(plays)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
