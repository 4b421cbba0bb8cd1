"""spark-submit entry of the whole run: python -m scorecast --help"""

from __future__ import annotations

import argparse
from dataclasses import fields

from scorecast.plans.season_run import Paths, Settings, run
from scorecast.session import build_session


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="scorecast", description="Backtest a season and score a coming week.")
    for field in fields(Paths):
        parser.add_argument(f"--{field.name.replace('_', '-')}", required=True, help="path of this source")
    parser.add_argument("--output", required=True, help="folder below which predictions are written")
    parser.add_argument("--seasons", required=True, type=int, nargs="+")
    parser.add_argument("--validation-season", required=True, type=int)
    parser.add_argument("--season", required=True, type=int)
    parser.add_argument("--week", required=True, type=int)
    parser.add_argument("--draws", type=int, default=25)
    parser.add_argument("--n-splits", type=int, default=5)
    parser.add_argument("--n-folds", type=int, default=5)
    parser.add_argument("--fold-by", choices=["hash", "time"], default="hash")
    parser.add_argument("--parallelism", type=int, default=4)
    parser.add_argument("--min-usage", action="store_true", help="list only players with recent usage")
    return parser


def main() -> None:
    given = vars(arguments().parse_args())
    paths = Paths(**{field.name: given.pop(field.name) for field in fields(Paths)})
    output = given.pop("output")
    result = run(build_session(), paths, Settings(**given), output)
    for name, backtest in result.backtests.items():
        print(name, backtest.search.best_params, "threshold", backtest.evaluation.threshold)
        backtest.evaluation.report.show()
        print("at the held-out season's own best threshold")
        backtest.evaluation.held_out_best_report.show()
        backtest.importances.show(truncate=False)
    print("stack, threshold", result.stacked.threshold)
    result.stacked.report.show()
    for name, table in result.doubts.items():
        if not table.isEmpty():
            print(name)
            table.show(25, truncate=False)
    result.predictions.show(25, truncate=False)
    print(result.path)


if __name__ == "__main__":
    main()
