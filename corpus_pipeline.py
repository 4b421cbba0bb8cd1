"""A corpus from raw documents to token ids, in stages that are each written and read again.

Every stage takes all that the one before it kept; its decisions take effect
in what it returns. All but the last return the columns of documents, in
their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.llm import bpe, line_dedup, mixing, simhash, toxicity
from scorecast.llm.common import fresh
from scorecast.sources.store import save

VOCABULARY = "word_bpe_49k.json"
TOXIC_AT = 0.5


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below TOXIC_AT; a null text is not toxic."""
    chain = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    scored = docs.withColumn(score, toxicity.toxicity(F.col("text"), chain)["score"])
    return scored.where(F.col(score) < TOXIC_AT).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document before it has; n_chars follows the text."""
    names = {"kept": fresh(docs, "kept"), "n_lines": fresh(docs, "lines"), "n_dropped": fresh(docs, "dropped")}
    kept = line_dedup.dedup_lines(docs, **names)
    text = F.col(names["kept"])
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id, or none if no row has one, then the smallest hash of the text and of the row."""
    turn, row = fresh(docs, "turn"), fresh(docs, "row_hash")
    keyed = docs.withColumns({turn: F.xxhash64(F.coalesce("text", F.lit(""))), row: F.xxhash64(*_columns(docs))})
    marked = save(keyed.select("doc_id", turn, row, simhash.simhash(F.col("text")).alias("fp")), "simhash-docs")
    named = marked.join(simhash.roots(marked.select("doc_id", "fp")).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", turn, row)).alias("first")
    kept = named.groupBy("root").agg(first).select(f"first.{turn}", f"first.{row}")
    return keyed.join(kept, [turn, row]).dropDuplicates([turn, row]).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs, mixing.mix(docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    ids, decoded = fresh(docs, "ids"), fresh(docs, "decoded")
    encoded = bpe.encode(docs, path, ids=ids, decoded=decoded)
    digest = F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256")
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"), digest)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding and decoding", encode_texts),
]

ORACLE_SQL = None
"""Trained scores, XXH64 fingerprints and token ids have no SQL; the tests compare with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
