"""A small made-up league: four teams, a few players each, with a planted scoring habit."""

from __future__ import annotations

import random

TEAMS = ["AAA", "BBB", "LV", "LA"]
NAMES = {"AAA": "Alphas", "BBB": "Betas", "LV": "Gammas", "LA": "Deltas"}
DIMENSION_IDS = {"AAA": "AAA", "BBB": "BBB", "LV": "LVR", "LA": "LAR"}
POSITIONS = ["QB", "RB", "RB", "WR", "WR", "TE", "K"]
SEASONS = [2021, 2022, 2023, 2024]
WEEKS = 8


def players():
    rows = []
    for team in TEAMS:
        for i, position in enumerate(POSITIONS):
            # The first runner and first receiver of each team score far more often.
            habit = 0.75 if i in (1, 3) else 0.1
            rows.append((f"{team}-{i}", f"Player {team} {'abcdefg'[i]}", position, team, habit))
    return rows


def games(season, week):
    rng = random.Random(season * 100 + week)
    order = TEAMS[:]
    rng.shuffle(order)
    return [(order[0], order[1]), (order[2], order[3])]


def build():
    rng = random.Random(1)
    weekly, plays, odds, schedule = [], [], [], []
    for season in SEASONS:
        for week in range(1, WEEKS + 1):
            for home, away in games(season, week):
                schedule.append((season, week, home, away))
                spread = -rng.choice([1.5, 3.0, 6.5])
                favourite = rng.choice([home, away, "PICK"])
                odds.append(
                    (
                        str(season),
                        str(week),
                        NAMES[home],
                        NAMES[away],
                        DIMENSION_IDS.get(favourite, favourite),
                        str(spread),
                        str(rng.randint(38, 52)),
                        "FALSE",
                    )
                )
                for team, other in ((home, away), (away, home)):
                    for player_id, name, position, its_team, habit in players():
                        if its_team != team:
                            continue
                        scored = rng.random() < habit
                        runs = position in ("RB", "QB")
                        touches = rng.randint(8, 14) if habit > 0.5 else rng.randint(1, 5)
                        for i in range(touches):
                            td = 1.0 if scored and i == 0 else 0.0
                            plays.append(
                                (
                                    season,
                                    week,
                                    team,
                                    other,
                                    float(rng.randint(1, 9)),
                                    3.0 if td else float(rng.randint(1, 60)),
                                    float(runs),
                                    float(not runs),
                                    player_id if runs else None,
                                    None if runs else player_id,
                                    td,
                                    td * runs,
                                    td * (not runs),
                                    rng.uniform(-1, 1),
                                )
                            )
                        yards = touches * 4.0
                        weekly.append(
                            (
                                player_id,
                                name,
                                position,
                                team,
                                other,
                                season,
                                week,
                                float(touches) if runs else 0.0,
                                yards if runs else 0.0,
                                float(scored) if runs else None,
                                0.0 if runs else float(touches),
                                0.0 if runs else touches + 1.0,
                                0.0 if runs else yards,
                                None if runs else float(scored),
                                0.1 * touches,
                                0.5,
                                float("nan"),
                                0.02 * touches,
                            )
                        )
    schedule += [(2025, 1, "AAA", "LA"), (2025, 1, "LV", "BBB"), (2025, 2, "AAA", "LV")]
    rosters = [(p, n, pos, t, s) for s in [*SEASONS, 2025] for p, n, pos, t, _ in players()]
    rosters.append(("AAA-new", "Rookie Ra'Mon Jr.", "RB", "AAA", 2025))
    return {"weekly": weekly, "plays": plays, "odds": odds, "schedule": schedule, "rosters": rosters}
