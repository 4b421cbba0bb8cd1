"""Folds, weights, thresholds, reports, and fitted models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.asof_queries import SEASON, frame
from checks.feature_queries import inputs
from checks.registry import register
from scorecast.operators import evaluate as ev
from scorecast.operators import features as ft
from scorecast.operators.folds import season_split, stratified_folds, with_blocks
from scorecast.operators.forest_tables import ForestSettings, fit_forest
from scorecast.operators.logistic import fit_logistic
from scorecast.operators.models import (
    BOOSTED_TREES,
    RANDOM_FOREST,
    assemble,
    class_weights,
    importances,
    with_probability,
    with_weight,
)
from scorecast.operators.search import prepare, random_search
from scorecast.operators.tree_search import score_draws
from scorecast.operators.tree_tables import BoostSettings, TreeModel, fit_bins, fit_boosted, with_bins
from scorecast.plans.backtest import stack, tune
from scorecast.plans.feature_table import Histories, build_histories, features_from, opponent_codes
from scorecast.plans.week_scores import PROBABILITY, score_week
from scorecast.sources.store import save

_KEYS = "player_id, recent_team, season, week"
LABELLED = "plays rosters weekly labelled"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.label_weekly(views.weekly(spark, sf_dir, opponents=False))


@register(
    "split_and_folds",
    views.with_sql(
        LABELLED,
        f"""
  , calendar AS (SELECT season, week, row_number() OVER (ORDER BY season, week) AS r, count(*) OVER () AS n
                 FROM (SELECT DISTINCT season, week FROM labelled WHERE season < {SEASON}))
  , blocks AS (SELECT season, week, CAST(CASE WHEN r <= n - 5 * (n // 6) THEN 0
                                              ELSE (r - 1 - (n - 5 * (n // 6))) // (n // 6) + 1 END AS BIGINT) AS block
               FROM calendar)
  SELECT {_KEYS}, block FROM labelled JOIN blocks USING (season, week)
""",
    ),
)
def split_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(*ft.PLAYER_WEEK)
    train, _ = season_split(rows, SEASON)
    return with_blocks(train)


@register(
    "class_weights",
    views.with_sql(
        LABELLED,
        """
  , c AS (SELECT scored_touchdown AS label, count(*) AS n FROM labelled GROUP BY ALL)
  SELECT CAST(label AS BIGINT) AS label, n, round((SELECT sum(n) FROM c) / (2.0 * n), 6) AS balanced,
         round(CASE WHEN label = 1 THEN (SELECT CAST(n AS DOUBLE) FROM c WHERE label = 0) / n ELSE 1 END, 6) AS positive
  FROM c
""",
    ),
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_weights(_labelled(spark, sf_dir), ft.LABEL)


# A probability made from the row stands in for a model, so that SQL can check the counts.
views.SQL["scores"] = """
  SELECT scored_touchdown AS label,
         (0.1 * scored_touchdown + 0.9 * ((player_id * 37 + week * 11 + season) % 997) / 997.0) AS p
  FROM labelled
"""


def formula_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    noise = (F.col("player_id") * 37 + F.col("week") * 11 + F.col("season")) % 997
    return rows.select(
        F.col(ft.LABEL).alias("label"),
        (F.lit(0.1) * F.col(ft.LABEL) + F.lit(0.9) * noise / F.lit(997.0)).alias("p"),
    )


views.SQL["sweep"] = """
  SELECT i / 100.0 AS threshold, CAST(sum(CASE WHEN label = 1 AND p >= i / 100.0 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN label = 0 AND p >= i / 100.0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN label = 1 AND p < i / 100.0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM scores, range(20, 70) r(i) GROUP BY i
"""


@register(
    "threshold_sweep",
    views.with_sql(
        f"{LABELLED} scores sweep",
        "SELECT threshold, tp, fp, fn, round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 6) AS f1 FROM sweep",
    ),
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.threshold_sweep(formula_scores(spark, sf_dir), "p", "label")


@register(
    "best_threshold",
    views.with_sql(
        f"{LABELLED} scores sweep",
        """
  SELECT threshold, round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 6) AS f1 FROM sweep
  ORDER BY CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) DESC, threshold LIMIT 1
""",
    ),
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_threshold(threshold_sweep(spark, sf_dir))


@register(
    "classification_report",
    views.with_sql(
        f"{LABELLED} scores",
        """
  , c AS (SELECT count(*) FILTER (WHERE label = 1 AND p >= 0.45) AS tp,
                 count(*) FILTER (WHERE label = 0 AND p >= 0.45) AS fp,
                 count(*) FILTER (WHERE label = 1 AND p < 0.45) AS fn,
                 count(*) FILTER (WHERE label = 0 AND p < 0.45) AS tn FROM scores)
  , classes AS (
      SELECT 'No TD' AS row, tn / CAST(tn + fn AS DOUBLE) AS precision, tn / CAST(tn + fp AS DOUBLE) AS recall,
             2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f1, tn + fp AS support FROM c
      UNION ALL
      SELECT 'Scored TD', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE),
             2 * tp / CAST(2 * tp + fn + fp AS DOUBLE), tp + fn FROM c)
  , report AS (
      SELECT * FROM classes
      UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), tp + tn + fp + fn FROM c
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM classes
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support) FROM classes)
  SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
         CAST(support AS BIGINT) AS support FROM report
""",
    ),
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = formula_scores(spark, sf_dir).withColumn("prediction", ev.predicted(F.col("p"), 0.45))
    return ev.classification_report(scored, "label", "prediction")


@register(
    "draws_in_one_scan",
    views.with_sql(
        LABELLED,
        f"""
  , calendar AS (SELECT season, week, row_number() OVER (ORDER BY season, week) AS r, count(*) OVER () AS n
                 FROM (SELECT DISTINCT season, week FROM labelled WHERE season < {SEASON}))
  , blocks AS (SELECT season, week, CASE WHEN r <= n - 5 * (n // 6) THEN 0 ELSE (r - 1 - (n - 5 * (n // 6))) // (n // 6) + 1 END AS block FROM calendar)
  , each AS (SELECT draw, block AS fold, scored_touchdown AS y,
                    CASE WHEN ((draw + 1) * 0.1 + fold_part) * scored_touchdown + 0.8 * ((player_id * 37 + week * 11 + season + draw) % 997) / 997.0 >= 0.5 THEN 1 ELSE 0 END AS p
             FROM labelled JOIN blocks USING (season, week), range(0, 4) d(draw), (SELECT unnest(range(1, 6)) AS f, unnest(range(1, 6)) / 100.0 AS fold_part)
             WHERE block = f)
  SELECT CAST(draw AS BIGINT) AS draw, CAST(fold AS BIGINT) AS fold, CAST(sum(y * p) AS BIGINT) AS tp, CAST(sum((1 - y) * p) AS BIGINT) AS fp,
         CAST(sum(y * (1 - p)) AS BIGINT) AS fn, round(2.0 * sum(y * p) / (2 * sum(y * p) + sum((1 - y) * p) + sum(y * (1 - p))), 6) AS f1
  FROM each GROUP BY draw, fold
""",
    ),
)
def draws_in_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four draws on five folds, with formulas in place of models, counted by one aggregation."""
    train, _ = season_split(_labelled(spark, sf_dir), SEASON)

    def formula(draw: int, fold: int) -> Column:
        noise = (F.col("player_id") * 37 + F.col("week") * 11 + F.col("season") + draw) % 997
        return F.lit((draw + 1) * 0.1 + fold / 100.0) * F.col(ft.LABEL) + F.lit(0.8) * noise / F.lit(997.0)

    by_fold = {fold: [formula(draw, fold) for draw in range(4)] for fold in range(1, 6)}
    return score_draws(with_blocks(train.select(*ft.PLAYER_WEEK, ft.LABEL)), by_fold, ft.LABEL)


# Two formulas of the row stand in for the out-of-fold probabilities of two models.
views.SQL["logit_rows"] = """
  SELECT CAST(scored_touchdown AS DOUBLE) AS y, 0.1 * scored_touchdown + 0.9 * ((player_id * 37 + week * 11 + season) % 997) / 997.0 AS p_rf,
         0.2 * scored_touchdown + 0.7 * ((player_id * 17 + week * 5 + season * 3) % 991) / 991.0 AS p_gbt
  FROM labelled
"""
views.SQL["logit_beta0"] = "SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2"
_NEWTON_STEPS = 12


def _newton_sql(k: int) -> str:
    """One step: sums over all rows with the unit penalty, then three unknowns by Cramer's rule."""
    views.SQL[f"logit_sums{k}"] = f"""
  SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(p - y) AS g0,
         sum((p - y) * p_rf) + any_value(b1) AS g1, sum((p - y) * p_gbt) + any_value(b2) AS g2,
         sum(p * (1 - p)) AS a, sum(p * (1 - p) * p_rf) AS b, sum(p * (1 - p) * p_gbt) AS c,
         sum(p * (1 - p) * p_rf * p_rf) + 1 AS d, sum(p * (1 - p) * p_rf * p_gbt) AS e,
         sum(p * (1 - p) * p_gbt * p_gbt) + 1 AS f
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * p_rf + b2 * p_gbt))) AS p FROM logit_rows, logit_beta{k - 1})
"""
    views.SQL[f"logit_beta{k}"] = f"""
  SELECT b0 - (g0 * (d * f - e * e) + g1 * (c * e - b * f) + g2 * (b * e - c * d)) / det AS b0,
         b1 - (g0 * (c * e - b * f) + g1 * (a * f - c * c) + g2 * (b * c - a * e)) / det AS b1,
         b2 - (g0 * (b * e - c * d) + g1 * (b * c - a * e) + g2 * (a * d - b * b)) / det AS b2
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM logit_sums{k})
"""
    return f"logit_sums{k} logit_beta{k}"


@register(
    "meta_regression",
    views.with_sql(
        f"{LABELLED} logit_rows logit_beta0 {' '.join(_newton_sql(k + 1) for k in range(_NEWTON_STEPS))}",
        f"""
  SELECT unnest(['intercept', 'p_rf', 'p_gbt']) AS term, unnest([round(b0, 6), round(b1, 6), round(b2, 6)]) AS coefficient
  FROM logit_beta{_NEWTON_STEPS}
""",
    ),
)
def meta_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression on top of a stack, by sums over all rows."""
    first = (F.col("player_id") * 37 + F.col("week") * 11 + F.col("season")) % 997
    second = (F.col("player_id") * 17 + F.col("week") * 5 + F.col("season") * 3) % 991
    rows = _labelled(spark, sf_dir).select(
        F.col(ft.LABEL).alias("y"),
        (F.lit(0.1) * F.col(ft.LABEL) + F.lit(0.9) * first / F.lit(997.0)).alias("p_rf"),
        (F.lit(0.2) * F.col(ft.LABEL) + F.lit(0.7) * second / F.lit(991.0)).alias("p_gbt"),
    )
    return fit_logistic(save(rows, "meta-rows"), ["p_rf", "p_gbt"], "y").table(spark)


@register(
    "stratified_folds",
    views.with_sql(
        LABELLED,
        f"""
  SELECT {_KEYS}, CAST(scored_touchdown AS BIGINT) AS scored_touchdown,
         (row_number() OVER (PARTITION BY scored_touchdown ORDER BY md5(concat_ws('|', {_KEYS}))) - 1) % 5 AS fold
  FROM labelled
""",
    ),
)
def folds_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _KEYS.split(", ")
    rows = save(_labelled(spark, sf_dir).select(*keys, ft.LABEL), "fold-rows")
    return stratified_folds(rows, ft.LABEL, keys)


# Small forests: these queries show that fitting and scoring work, not how well.
RF_PARAMS = {"numTrees": 20, "maxDepth": 5}
GBT_PARAMS = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.1}
# A whole boosted model: the usual 100 rounds at 0.1, and a depth that has room for the usual 31 leaves.
WHOLE_GBT_PARAMS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}


def _stored_features(histories: Histories) -> DataFrame:
    """Features with codes of the seasons before the coming one, as a table with one folder per season."""
    table = features_from(histories, opponent_codes(histories, SEASON))
    table = table.select(*ft.PLAYER_WEEK, ft.LABEL, *ft.FEATURES)
    return save(table, "features", partition_by="season", rebalance=True)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_features(build_histories(inputs(spark, sf_dir)))


def _held_out_scores(spark: SparkSession, sf_dir: str, learner, params) -> DataFrame:
    train, held_out = season_split(assemble(features(spark, sf_dir), ft.FEATURES), SEASON)
    model = learner.fit(train, ft.LABEL, params)
    return with_probability(model, held_out, PROBABILITY).select(*ft.PLAYER_WEEK, ft.LABEL, PROBABILITY)


# One split over features of few values: the whole fit can be written in SQL. Both class weightings make the
# classes weigh the same, so a cut leaves the shares a and b of positives and negatives on its left.
views.SQL["stump_rows"] = f"""
  SELECT {_KEYS}, scored_touchdown AS label,
         [least(coalesce(carries, 0), 9), least(coalesce(targets, 0), 9), CAST(week AS DOUBLE)] AS x
  FROM labelled
"""
views.SQL["stump"] = f"""
  SELECT f, cut, a / (a + b) AS left_p, (1 - a) / (2 - a - b) AS right_p
  FROM (
    SELECT f, (v + lead(v) OVER by_value) / 2 AS cut,
           sum(pos) OVER by_value / sum(pos) OVER (PARTITION BY f) AS a,
           sum(neg) OVER by_value / sum(neg) OVER (PARTITION BY f) AS b
    FROM (SELECT f, x[f] AS v, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
          FROM stump_rows, range(1, 4) r(f) WHERE season < {SEASON} GROUP BY ALL)
    WINDOW by_value AS (PARTITION BY f ORDER BY v))
  WHERE cut IS NOT NULL
  ORDER BY a * b / (a + b) + (1 - a) * (1 - b) / (2 - a - b), f, cut LIMIT 1
"""
views.SQL["stump_scores"] = f"""
  SELECT {_KEYS}, label AS scored_touchdown, CASE WHEN x[f] <= cut THEN left_p ELSE right_p END AS p
  FROM stump_rows, stump WHERE season = {SEASON}
"""
_STUMP = f"{LABELLED} stump_rows stump stump_scores"


def _stump_scores(spark: SparkSession, sf_dir: str, learner, params) -> DataFrame:
    few = {c: F.least(F.coalesce(c, F.lit(0.0)), F.lit(9.0)).alias(f"few_{c}") for c in ("carries", "targets")}
    rows = _labelled(spark, sf_dir).select(*ft.PLAYER_WEEK, ft.LABEL, *few.values())
    train, held_out = season_split(assemble(rows, ["few_carries", "few_targets", "week"]), SEASON)
    model = learner.fit(train, ft.LABEL, params)
    return with_probability(model, held_out, PROBABILITY).select(*ft.PLAYER_WEEK, ft.LABEL, PROBABILITY)


@register(
    "rf_stump",
    views.with_sql(_STUMP, f"SELECT {_KEYS}, scored_touchdown, round(p, 6) AS {PROBABILITY} FROM stump_scores"),
)
def rf_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of one tree with one split, over all rows and features."""
    params = {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}
    return _stump_scores(spark, sf_dir, RANDOM_FOREST, params)


@register(
    "gbt_stump",
    views.with_sql(
        _STUMP,
        f"SELECT {_KEYS}, scored_touchdown, round(1 / (1 + exp(-2 * (2 * p - 1))), 6) AS {PROBABILITY} FROM stump_scores",
    ),
)
def gbt_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of boosting: the weighted mean of labels -1 and 1 on either side of one split."""
    return _stump_scores(spark, sf_dir, BOOSTED_TREES, {"maxIter": 1, "maxDepth": 1})


# Two rounds of trees with three leaves, grown best first with L1 and L2, over the same features of few values.
LEAFWISE = BoostSettings(rounds=2, learning_rate=0.3, leaves=3, l1=0.5, l2=1.0, min_rows=20)
_FEW = ["few_carries", "few_targets", "week"]
views.SQL["boost_cuts"] = f"""
  SELECT f, cut, row_number() OVER (ORDER BY f, cut) AS place
  FROM (SELECT f, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut
        FROM (SELECT DISTINCT f, x[f] AS v FROM stump_rows, range(1, 4) r(f) WHERE season < {SEASON}))
  WHERE cut IS NOT NULL
"""
views.SQL["boost_margins0"] = f"""
  SELECT r.*, CASE WHEN label = 1 THEN lift ELSE 1 END AS w, ln(lift * positives / negatives) AS margin
  FROM stump_rows r, (SELECT CAST(sum(1 - label) AS DOUBLE) / sum(label) AS lift, sum(label) AS positives, sum(1 - label) AS negatives
                      FROM stump_rows WHERE season < {SEASON})
"""


def _pull(g: str) -> str:
    return f"power(sign({g}) * greatest(abs({g}) - {LEAFWISE.l1}, 0), 2)"


def _best_split(sums: str) -> str:
    """The best split of each node of a table (node, f, v, g, h, n)."""
    gain = f"{_pull('gl')} / (hl + {LEAFWISE.l2}) + {_pull('(ga - gl)')} / (ha - hl + {LEAFWISE.l2}) - {_pull('ga')} / (ha + {LEAFWISE.l2})"
    return f"""
  SELECT node, f, cut, round({gain}, 9) AS gain
  FROM (SELECT c.f, c.cut, c.place, s.node, sum(g) FILTER (WHERE v <= cut) AS gl, sum(h) FILTER (WHERE v <= cut) AS hl, sum(n) FILTER (WHERE v <= cut) AS nl,
               sum(g) AS ga, sum(h) AS ha, sum(n) AS na
        FROM {sums} s JOIN boost_cuts c ON c.f = s.f GROUP BY ALL)
  WHERE nl >= {LEAFWISE.min_rows} AND na - nl >= {LEAFWISE.min_rows} AND hl >= {LEAFWISE.min_hessian} AND ha - hl >= {LEAFWISE.min_hessian}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, place) = 1
"""


def _round_sql(k: int) -> str:
    """Names of the steps of one round, each over those before it."""
    slopes = "w * (1 / (1 + exp(-margin)) - label) AS g, w / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) AS h"
    sums = f"SELECT {{}} AS node, f, x[f] AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {{}}, range(1, 4) r(f) WHERE season < {SEASON} GROUP BY ALL"
    views.SQL[f"boost_slopes{k}"] = f"SELECT *, {slopes} FROM boost_margins{k - 1}"
    views.SQL[f"boost_root_sums{k}"] = sums.format("0", f"boost_slopes{k}")
    views.SQL[f"boost_root{k}"] = _best_split(f"boost_root_sums{k}")
    views.SQL[f"boost_sides{k}"] = f"SELECT s.*, CASE WHEN x[f] <= cut THEN 1 ELSE 2 END AS side FROM boost_slopes{k} s, boost_root{k}"
    views.SQL[f"boost_side_sums{k}"] = sums.format("side", f"boost_sides{k}")
    views.SQL[f"boost_second{k}"] = f"SELECT * FROM ({_best_split(f'boost_side_sums{k}')}) WHERE gain > 0 ORDER BY gain DESC, node LIMIT 1"
    views.SQL[f"boost_leaves{k}"] = f"""
  SELECT s.*, CASE WHEN side <> node THEN side WHEN x[f] <= cut THEN 3 ELSE 4 END AS leaf FROM boost_sides{k} s, boost_second{k}
"""
    views.SQL[f"boost_values{k}"] = f"""
  SELECT leaf, -{LEAFWISE.learning_rate} * sign(sum(g)) * greatest(abs(sum(g)) - {LEAFWISE.l1}, 0) / (sum(h) + {LEAFWISE.l2}) AS value
  FROM boost_leaves{k} WHERE season < {SEASON} GROUP BY leaf
"""
    views.SQL[f"boost_margins{k}"] = f"""
  SELECT {_KEYS}, label, x, w, margin + value AS margin FROM boost_leaves{k} JOIN boost_values{k} USING (leaf)
"""
    return " ".join(f"boost_{step}{k}" for step in "slopes root_sums root sides side_sums second leaves values margins".split())


_LEAFWISE = f"{LABELLED} stump_rows boost_cuts boost_margins0 {_round_sql(1)} {_round_sql(2)}"


def _leafwise(spark: SparkSession, sf_dir: str) -> tuple[TreeModel, DataFrame]:
    few = {c: F.least(F.coalesce(c, F.lit(0.0)), F.lit(9.0)).alias(f"few_{c}") for c in ("carries", "targets")}
    train, held_out = season_split(_labelled(spark, sf_dir).select(*ft.PLAYER_WEEK, ft.LABEL, *few.values()), SEASON)
    bins = fit_bins(train, _FEW)
    stored = save(with_bins(with_weight(train, ft.LABEL, "positive"), bins, [ft.LABEL, "weight"]), "boost-bins")
    return fit_boosted(stored, bins, ft.LABEL, "weight", LEAFWISE), held_out


@register(
    "leafwise_boosting",
    views.with_sql(_LEAFWISE, f"SELECT {_KEYS}, label AS scored_touchdown, round(1 / (1 + exp(-margin)), 6) AS {PROBABILITY} FROM boost_margins2 WHERE season = {SEASON}"),
)
def leafwise_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of three leaves, found from histograms and scored from their table of nodes."""
    model, held_out = _leafwise(spark, sf_dir)
    return held_out.select(*ft.PLAYER_WEEK, ft.LABEL, model.probability().alias(PROBABILITY))


@register(
    "leafwise_importances",
    views.with_sql(
        _LEAFWISE,
        """
  , splits AS (SELECT f, gain FROM boost_root1 UNION ALL SELECT f, gain FROM boost_second1
               UNION ALL SELECT f, gain FROM boost_root2 UNION ALL SELECT f, gain FROM boost_second2)
  SELECT ['few_carries', 'few_targets', 'week'][f] AS feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM splits), 6) AS importance,
         count(gain) AS splits
  FROM range(1, 4) r(f) LEFT JOIN splits USING (f) GROUP BY f
""",
    ),
)
def leafwise_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leafwise(spark, sf_dir)[0].importances(spark)


# A whole tree of depth two by Gini impurity: a split of all rows, and one of each side where it is possible.
SHALLOW = ForestSettings(trees=1, max_depth=2, min_samples_split=300, min_samples_leaf=20, max_features="all", bootstrap=False)


def _gini_split(sums: str) -> str:
    """The best split of each node of a table (node, f, v, p, w, n)."""

    def impurity(p: str, w: str) -> str:
        return f"2 * ({p}) * (({w}) - ({p})) / ({w})"

    gain = f"round({impurity('pa', 'wa')} - {impurity('pl', 'wl')} - {impurity('pa - pl', 'wa - wl')}, 9)"
    return f"""
  SELECT node, f, cut, {gain} AS gain
  FROM (SELECT c.f, c.cut, c.place, s.node, sum(p) FILTER (WHERE v <= cut) AS pl, sum(w) FILTER (WHERE v <= cut) AS wl, sum(n) FILTER (WHERE v <= cut) AS nl,
               sum(p) AS pa, sum(w) AS wa, sum(n) AS na
        FROM {sums} s JOIN boost_cuts c ON c.f = s.f GROUP BY ALL)
  WHERE nl >= {SHALLOW.min_samples_leaf} AND na - nl >= {SHALLOW.min_samples_leaf} AND na >= {SHALLOW.min_samples_split} AND {gain} > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, place) = 1
"""


_GINI_SUMS = f"SELECT {{}} AS node, f, x[f] AS v, sum(w * label) AS p, sum(w) AS w, count(*) AS n FROM {{}}, range(1, 4) r(f) WHERE season < {SEASON} GROUP BY ALL"
views.SQL["tree_rows"] = f"""
  SELECT r.*, CASE WHEN label = 1 THEN n / (2.0 * positives) ELSE n / (2.0 * (n - positives)) END AS w
  FROM stump_rows r, (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS positives FROM stump_rows WHERE season < {SEASON})
"""
views.SQL["tree_root_sums"] = _GINI_SUMS.format("0", "tree_rows")
views.SQL["tree_root"] = _gini_split("tree_root_sums")
views.SQL["tree_sides"] = "SELECT t.*, CASE WHEN x[f] <= cut THEN 1 ELSE 2 END AS side FROM tree_rows t, tree_root"
views.SQL["tree_side_sums"] = _GINI_SUMS.format("side", "tree_sides")
views.SQL["tree_second"] = _gini_split("tree_side_sums")
views.SQL["tree_leaves"] = """
  SELECT s.*, side * 10 + CASE WHEN node IS NULL THEN 0 WHEN x[f] <= cut THEN 1 ELSE 2 END AS leaf
  FROM tree_sides s LEFT JOIN tree_second t ON t.node = s.side
"""
views.SQL["tree_values"] = f"SELECT leaf, sum(w * label) / sum(w) AS p FROM tree_leaves WHERE season < {SEASON} GROUP BY leaf"


@register(
    "forest_tree",
    views.with_sql(
        f"{LABELLED} stump_rows boost_cuts tree_rows tree_root_sums tree_root tree_sides tree_side_sums tree_second tree_leaves tree_values",
        f"SELECT {_KEYS}, label AS scored_touchdown, round(p, 6) AS {PROBABILITY} FROM tree_leaves JOIN tree_values USING (leaf) WHERE season = {SEASON}",
    ),
)
def forest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of depth two with a minimum split size, over all rows and features."""
    few = {c: F.least(F.coalesce(c, F.lit(0.0)), F.lit(9.0)).alias(f"few_{c}") for c in ("carries", "targets")}
    train, held_out = season_split(_labelled(spark, sf_dir).select(*ft.PLAYER_WEEK, ft.LABEL, *few.values()), SEASON)
    bins = fit_bins(train, _FEW)
    stored = save(with_bins(with_weight(train, ft.LABEL, "balanced"), bins, [*ft.PLAYER_WEEK, ft.LABEL, "weight"]), "forest-bins")
    model = fit_forest(stored, bins, ft.LABEL, "weight", SHALLOW, ft.PLAYER_WEEK)
    return held_out.select(*ft.PLAYER_WEEK, ft.LABEL, model.probability().alias(PROBABILITY))


@register("rf_score")
def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out_scores(spark, sf_dir, RANDOM_FOREST, RF_PARAMS)


@register("gbt_score")
def gbt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out_scores(spark, sf_dir, BOOSTED_TREES, WHOLE_GBT_PARAMS)


@register("stack_score")
def stack_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stack fitted on the seasons before the coming week, its probabilities for that week and the edges."""
    histories = build_histories(inputs(spark, sf_dir))
    history = _stored_features(histories).where(F.col("season") < SEASON)
    fitted = stack(history, {"rf": RF_PARAMS, "gbt": GBT_PARAMS}, n_folds=5)
    coming = assemble(frame(spark, sf_dir, histories), ft.FEATURES)
    return score_week(coming, fitted.score, views.prices(spark, sf_dir), min_usage=False)


@register("random_search")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = season_split(features(spark, sf_dir), SEASON)
    grid = {"numTrees": [5, 10], "maxDepth": [3, 5], "featureSubsetStrategy": ["sqrt", "log2"]}
    found = random_search(prepare(assemble(train, ft.FEATURES), ft.LABEL, 5), RANDOM_FOREST, ft.LABEL, draws=3, n_splits=5, grid=grid)
    return found.scores_table(spark)


@register("importance_topk")
def importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = season_split(assemble(features(spark, sf_dir), ft.FEATURES), SEASON)
    return importances(spark, RANDOM_FOREST.fit(train, ft.LABEL, RF_PARAMS), ft.FEATURES).limit(20)


@register("backtest_report")
def backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search on the seasons before one, choose a threshold on their last fold, report on that season."""
    grid = {"numTrees": [10], "maxDepth": [3, 5]}
    found = tune(features(spark, sf_dir), SEASON, RANDOM_FOREST, draws=2, n_splits=5, grid=grid)
    return found.evaluation.report
