"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule (host, path, verdict) fits its host and all subdomains if the URL's
path starts with the rule's; of several, the longest wins. URLs without a rule
are judged by a model trained from a small labelled URL table. Host and path
are cut into character n-grams that Spark ML hashes and fits; both the
features and the fit run on the executors.

Host: behind the first `://` up to `/`, `?`, `#` or the end, A-Z in lower
case; path: from there up to `?`, `#` or the end. A null URL or one without
`://` has both empty, fits no rule and gets the model's verdict on an empty
URL. Without labels of both kinds the model's verdict is that of the labels
there are, or allow. Equal URLs get equal verdicts. Other columns are kept.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.llm.common import fresh
from scorecast.sources.store import save

MAX_FIT_ROWS = 20_000
"""Labelled URLs that the model is fitted on, at most: those with the smallest hashes."""
FEATURES = 1 << 14
GRAMS = (3, 4, 5)
BLOCK_AT = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls; meant for rules written by hand, sent as literals."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams with a mark in front; ``^`` and ``$`` stand for the ends."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    by_length = [
        F.when(
            F.length(framed) >= n,
            F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))
        for n in GRAMS
    ]
    return F.concat(*by_length)


def url_grams(url: Column) -> Column:
    digits = F.regexp_replace(path_of(url), "[0-9]", "0")  # page numbers differ, their shape does not
    return F.concat(_grams(host_of(url), "h:"), _grams(digits, "p:"))


@dataclass(frozen=True)
class UrlModel:
    stages: PipelineModel | None
    otherwise: str

    def verdict(self, urls: DataFrame, url: str, out: str) -> DataFrame:
        """``urls`` with a column ``out``: block or allow."""
        if self.stages is None:
            return urls.withColumn(out, F.lit(self.otherwise))
        names = [f"`{c}`" for c in urls.columns]
        scored = self.stages.transform(urls.select(F.struct(*names).alias("row"), url_grams(F.col(url)).alias("grams")))
        block = vector_to_array("probability")[1] >= BLOCK_AT
        return scored.select("row.*", F.when(block, "block").otherwise("allow").alias(out))


def train_url_model(labelled: DataFrame, max_rows: int = MAX_FIT_ROWS) -> UrlModel:
    """Fit on (url, verdict); rows with null url or verdict are left out, repeated URLs count once."""
    rows = labelled.where("url is not null and verdict is not null").select("url", (F.col("verdict") == "block").cast("double").alias("label"))
    rows = rows.groupBy("url").agg(F.max("label").alias("label"))
    rows = save(rows.orderBy(F.xxhash64("url"), "url").limit(max_rows), "url-labels")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return UrlModel(None, "block" if 1.0 in counts else "allow")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    stages = Pipeline(
        stages=[
            HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
            LogisticRegression(weightCol="weight", regParam=0.01, maxIter=20, standardization=False),
        ]
    )
    return UrlModel(stages.fit(rows.select("label", weight.alias("weight"), url_grams(F.col("url")).alias("grams"))), "allow")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, url: str = "url", suffix: str = "") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``suffix`` goes behind these names. Columns that have these names already are replaced."""
    judged = model.verdict(pages, url, learnt := fresh(pages, "learnt"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    name, verdict = longest_rule(host, path, rules)
    named = {"host": host, "path": path, "rule": name, "verdict": F.coalesce(verdict, F.col(learnt))}
    results = {name + suffix: column for name, column in named.items()}
    others = [f"`{c}`" for c in pages.columns if c.lower() not in {name.lower() for name in results}]
    return judged.select(*others, *[column.alias(name) for name, column in results.items()])
