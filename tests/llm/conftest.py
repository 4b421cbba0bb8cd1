from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)
EXTRA = ("row", "copy", "score", "ids", "found", "row_hash", "bitmap", "SIZE", "grams", "learnt")


@pytest.fixture(scope="module")
def documents(spark):
    """Nulls, empty and long texts, copies, shared lines and repeated rows."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
    shared = "A line that many documents hold in full."
    texts: list[tuple] = [(i, f"{shared}\nown line number {i} of a text\n{shared.upper()} \n", "en", "hot") for i in range(1, 30)]
    texts += [(100 + i, f"exact copy of one and the same text here number {i % 2}", "fr", ["b", None][i % 2]) for i in range(12)]
    texts += [(200, None, None, None), (201, "", "de", "c"), (202, "   \n\n", "de", "c"), (203, long, "en", "c"), (204, "x" * 90_000, "en", "c")]
    texts += [(205, "é日本 <|endoftext|> it's", "ja", "c"), (205, "a second text with the same id", "en", "c"), (None, "no id here at all", "en", "hot")]
    texts += [(206, "twice the same row", "en", "b")] * 2
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in texts], DOCUMENTS)


@pytest.fixture(scope="module")
def wide(documents):
    """The same with extra columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit(k).alias(name) for k, name in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
