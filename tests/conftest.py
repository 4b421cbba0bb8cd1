from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scorecast.session import RECOMMENDED  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted by ``order`` or by everything."""
    collected = [tuple(row) for row in df.select(*order, *[c for c in df.columns if c not in order]).collect()]
    return sorted(collected, key=repr)


def records(df, *keys):
    """Rows as dictionaries by key."""
    found = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        assert key not in found, f"{key} repeats"
        found[key[0] if len(keys) == 1 else key] = row.asDict()
    return found
