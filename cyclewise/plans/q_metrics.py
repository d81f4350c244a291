"""Queries: evaluation, selection and registry (X1-X9, M5, V1, V2) on three
baseline predictors fitted in Spark (global mean RUL, mean RUL per 25-cycle
bucket, mean RUL per regime) - evaluation without an ML library, as planned.

Validation = the 20% held-out training engines (G2) truncated at 0.6-0.9 of
their life; test = the test engines truncated at 0.8 with the uncapped truth.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewise.functions.exprs import r6
from cyclewise.operators import metrics as X
from cyclewise.operators.labels import clip_prediction, with_rul
from cyclewise.operators.profile import histogram
from cyclewise.operators.windows import group_holdout, truncation_ends
from cyclewise.plans.catalog import register
from cyclewise.plans.oracle import with_fleets
from cyclewise.session import stage
from cyclewise.sources.tables import fleet

MODELS = ("global_mean", "cycle_mean", "regime_mean")
BUCKET = 25
CUTOFFS = (0.6, 0.7, 0.8, 0.9)
CHOSEN = {"lineitem": "cycle_mean"}


_SCORED: dict = {}


def scored(spark, sf):
    """(dataset, model, set, cutoff, engine_id, regime, y, p); one staged
    table per session and table folder."""
    import os
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _SCORED:
        _SCORED[key] = _scored(spark, sf)
    return _SCORED[key]


def _scored(spark, sf):
    df = with_rul(fleet(spark, sf, "lineitem"))
    df = with_rul(df, None, out="true_rul")
    train = df.filter("split = 'train'")
    hold = group_holdout(train, 0.2, 42)
    train = train.join(hold, ["dataset", "engine_id"])
    fit = train.filter(~F.col("holdout"))
    g = fit.groupBy("dataset").agg(F.avg("rul").alias("g"))
    b = fit.groupBy("dataset", (F.floor(F.col("cycle") / BUCKET)).alias("bucket")).agg(F.avg("rul").alias("pb"))
    r = fit.groupBy("dataset", "regime_key").agg(F.avg("rul").alias("pr"))

    def ends(rows, cutoffs, label, target):
        e = truncation_ends(rows, cutoffs)
        at = rows.join(e.withColumnRenamed("end_cycle", "cycle"), ["dataset", "engine_id", "cycle"])
        return at.select("dataset", "engine_id", "cutoff", "cycle", "regime_key",
                         F.col(target).cast("double").alias("y"), F.lit(label).alias("set"))

    pts = (ends(train.filter("holdout"), CUTOFFS, "validation", "rul")
           .unionByName(ends(df.filter("split = 'test'"), (0.8,), "test", "true_rul")))
    pts = pts.withColumn("bucket", F.floor(F.col("cycle") / BUCKET))
    j = (pts.join(F.broadcast(g), "dataset").join(b, ["dataset", "bucket"], "left")
         .join(r, ["dataset", "regime_key"], "left"))
    preds = F.array(
        F.struct(F.lit("global_mean").alias("model"), F.col("g").alias("raw")),
        F.struct(F.lit("cycle_mean").alias("model"), F.coalesce("pb", "g").alias("raw")),
        F.struct(F.lit("regime_mean").alias("model"), F.coalesce("pr", "g").alias("raw")))
    out = j.select("dataset", "set", "cutoff", "engine_id", F.col("regime_key").alias("regime"), "y",
                   F.explode(preds).alias("m"))
    return stage(out.select("dataset", "m.model", "set", "cutoff", "engine_id", "regime", "y",
                            clip_prediction(F.col("m.raw")).alias("p")))


SCORED_SQL = with_fleets("lineitem", extra=f"""
lab AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) AS INTEGER) AS rul,
               max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle AS true_rul,
               count(*) OVER (PARTITION BY dataset, engine_id) AS n FROM fleet_lineitem),
eng AS (SELECT dataset, engine_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || CAST(engine_id AS VARCHAR))) AS pos,
               count(*) OVER (PARTITION BY dataset) AS ne FROM (SELECT DISTINCT dataset, engine_id FROM lab WHERE split = 'train')),
tr AS (SELECT l.*, pos <= ceil(ne * 0.2) AS holdout FROM lab l JOIN eng USING (dataset, engine_id)),
fit AS (SELECT * FROM tr WHERE NOT holdout),
g AS (SELECT dataset, avg(rul) AS g FROM fit GROUP BY ALL),
b AS (SELECT dataset, floor(cycle / {BUCKET}) AS bucket, avg(rul) AS pb FROM fit GROUP BY ALL),
r AS (SELECT dataset, regime_key, avg(rul) AS pr FROM fit GROUP BY ALL),
cuts AS (SELECT * FROM (VALUES (CAST('0.6' AS DOUBLE), 'validation'), (CAST('0.7' AS DOUBLE), 'validation'),
             (CAST('0.8' AS DOUBLE), 'validation'), (CAST('0.9' AS DOUBLE), 'validation'), (CAST('0.8' AS DOUBLE), 'test')) c(cutoff, set)),
pts AS (SELECT t.dataset, t.engine_id, c.cutoff, t.cycle, t.regime_key, CAST(t.rul AS DOUBLE) AS y, c.set FROM tr t JOIN cuts c
          ON c.set = 'validation' AND t.holdout AND t.cycle = least(t.n, greatest(50, floor(t.n * c.cutoff)))
        UNION ALL
        SELECT t.dataset, t.engine_id, c.cutoff, t.cycle, t.regime_key, CAST(t.true_rul AS DOUBLE) AS y, c.set FROM lab t JOIN cuts c
          ON c.set = 'test' AND t.split = 'test' AND t.cycle = least(t.n, greatest(50, floor(t.n * c.cutoff)))),
j AS (SELECT p.*, g.g, b.pb, r.pr FROM pts p JOIN g USING (dataset) LEFT JOIN b ON b.dataset = p.dataset
        AND b.bucket = floor(p.cycle / {BUCKET}) LEFT JOIN r ON r.dataset = p.dataset AND r.regime_key = p.regime_key),
scored AS (SELECT dataset, m.model, set, cutoff, engine_id, regime_key AS regime, y,
             greatest(least(m.raw, 125.0), 0.0) AS p FROM (SELECT *, unnest([{{'model': 'global_mean', 'raw': g}},
             {{'model': 'cycle_mean', 'raw': coalesce(pb, g)}}, {{'model': 'regime_mean', 'raw': coalesce(pr, g)}}]) AS m FROM j))
""")


def _metrics_sql(src: str, keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS n, round(sqrt(sum((p - y) * (p - y)) / count(*)), 3) AS rmse, "
            f"round(avg(abs(p - y)), 3) AS mae, round(CASE WHEN var_pop(y) * count(*) = 0 THEN "
            f"CASE WHEN sum((p - y) * (p - y)) = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - sum((p - y) * (p - y)) / "
            f"(var_pop(y) * count(*)) END, 3) AS r2, round(avg(CASE WHEN p - y < 0 THEN exp(-(p - y) / 13.0) - 1 "
            f"ELSE exp((p - y) / 10.0) - 1 END), 3) AS nasa_score FROM {src} GROUP BY ALL")


@register("regression_metrics", SCORED_SQL + _metrics_sql(
    "(SELECT * FROM scored WHERE set = 'test' OR cutoff = 0.8)", "dataset, set, model"))
def regression_metrics(spark, sf):
    """RMSE, MAE, R2, mean NASA score of clipped predictions."""
    s = scored(spark, sf).filter((F.col("set") == "test") | (F.col("cutoff") == 0.8))
    return X.regression_metrics(s, ["dataset", "set", "model"])


@register("per_regime_metrics", SCORED_SQL + _metrics_sql(
    "(SELECT * FROM scored WHERE set = 'test' AND regime IS NOT NULL)", "dataset, model, regime"))
def per_regime_metrics(spark, sf):
    """Test metrics by the regime of the last reading."""
    s = scored(spark, sf).filter(F.col("set") == "test")
    return X.per_regime_metrics(s, ["dataset", "model"])


@register("multi_origin_validation", SCORED_SQL + """
SELECT dataset, model, round(avg(h), 6) AS huber, round(avg(m), 6) AS mse FROM (
  SELECT dataset, model, cutoff, avg(CASE WHEN abs(y - p) <= 10.0 THEN 0.5 * abs(y - p) * abs(y - p)
         ELSE 10.0 * (abs(y - p) - 0.5 * 10.0) END) AS h, avg((y - p) * (y - p)) AS m
  FROM scored WHERE set = 'validation' GROUP BY ALL) GROUP BY ALL""")
def multi_origin_validation(spark, sf):
    """M5: mean over cutoffs of mean Huber loss (delta 10) and MSE."""
    s = scored(spark, sf).filter(F.col("set") == "validation")
    m = X.multi_origin_validation(s, ["dataset", "model"])
    return m.select("dataset", "model", r6("huber").alias("huber"), r6("mse").alias("mse"))


@register("residual_histogram", SCORED_SQL + """,
res AS (SELECT dataset, model, y - p AS residual FROM scored WHERE set = 'test'),
rng AS (SELECT dataset, model, min(residual) AS lo, max(residual) AS hi FROM res GROUP BY ALL)
SELECT dataset, model, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((residual - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin,
       count(*) AS count, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi
FROM res JOIN rng USING (dataset, model) GROUP BY ALL""")
def residual_histogram(spark, sf):
    """Residuals (actual - predicted) in 30 equal-width bins."""
    res = X.residuals(scored(spark, sf).filter(F.col("set") == "test"), ["dataset", "model"])
    h = histogram(res, "residual", 30, ("dataset", "model"))
    return h.select("dataset", "model", "bin", "count", r6("lo").alias("lo"), r6("hi").alias("hi"))


_SEL_SQL = SCORED_SQL + f""",
v AS ({_metrics_sql("(SELECT * FROM scored WHERE set = 'validation' AND cutoff = 0.8)", "dataset, model")}),
t AS ({_metrics_sql("(SELECT * FROM scored WHERE set = 'test')", "dataset, model")}),
jj AS (SELECT t.dataset, t.model, v.rmse AS validation_rmse, v.mae AS validation_mae, v.r2 AS validation_r2,
             t.rmse AS test_rmse, t.mae AS test_mae, t.r2 AS test_r2, t.nasa_score AS test_nasa_score
      FROM t LEFT JOIN v USING (dataset, model)),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY coalesce(validation_rmse, test_rmse)) AS rmse_rank,
              rank() OVER (PARTITION BY dataset ORDER BY coalesce(validation_mae, test_mae)) AS mae_rank,
              rank() OVER (PARTITION BY dataset ORDER BY coalesce(validation_r2, test_r2) DESC) AS r2_rank FROM jj)
"""


@register("model_selection", _SEL_SQL + """
SELECT *, (rmse_rank + mae_rank + r2_rank) / 3.0 AS average_rank,
       (dataset = 'lineitem' AND model = 'cycle_mean') AS selected_for_explanation,
       'RMSE + MAE + R2 comparison; configured research choice' AS selection_basis FROM rk""")
def model_selection(spark, sf):
    """Rank table; the configured model per dataset is the pick."""
    s = scored(spark, sf)
    v = X.regression_metrics(s.filter((F.col("set") == "validation") & (F.col("cutoff") == 0.8)), ["dataset", "model"])
    t = X.regression_metrics(s.filter(F.col("set") == "test"), ["dataset", "model"])
    return X.model_selection_table(v, t, CHOSEN)


@register("all_model_metrics", SCORED_SQL + f""",
t AS ({_metrics_sql("(SELECT * FROM scored WHERE set = 'test')", "dataset, model")})
SELECT dataset, model, 'rmse' AS metric, rmse AS value FROM t UNION ALL SELECT dataset, model, 'mae', mae FROM t
UNION ALL SELECT dataset, model, 'r2', r2 FROM t UNION ALL SELECT dataset, model, 'nasa_score', nasa_score FROM t""")
def all_model_metrics(spark, sf):
    """Union of per-model metrics in long form."""
    s = scored(spark, sf).filter(F.col("set") == "test")
    per = [X.regression_metrics(s.filter(F.col("model") == m), ["dataset", "model"]) for m in ("global_mean", "cycle_mean", "regime_mean")]
    return X.to_long_metrics(X.all_model_metrics(*per).drop("n"))


_REG_SQL = SCORED_SQL + f""",
t AS ({_metrics_sql("(SELECT * FROM scored WHERE set = 'test')", "dataset, model")}),
c AS (SELECT dataset, model, rmse, CASE model WHEN 'global_mean' THEN 1 WHEN 'cycle_mean' THEN 2 ELSE 3 END AS created_at FROM t),
reg AS (SELECT *, CASE WHEN min(rmse) OVER (PARTITION BY dataset ORDER BY created_at, model ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING) IS NULL OR rmse < min(rmse) OVER (PARTITION BY dataset ORDER BY created_at, model
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'promote' ELSE 'discard' END AS decision,
             row_number() OVER (PARTITION BY dataset ORDER BY created_at, model) AS version FROM c)
"""


def _registry(spark, sf):
    s = scored(spark, sf).filter(F.col("set") == "test")
    t = X.regression_metrics(s, ["dataset", "model"])
    order = F.when(F.col("model") == "global_mean", 1).when(F.col("model") == "cycle_mean", 2).otherwise(3)
    cand = t.select("dataset", "model", "rmse", order.alias("created_at"))
    return X.register_candidates(None, cand)


@register("model_registry", _REG_SQL + "SELECT dataset, model, rmse, created_at, decision, CAST(version AS INTEGER) AS version FROM reg")
def model_registry(spark, sf):
    """V1 + X9: append-only versions with strict-improvement promotion."""
    return _registry(spark, sf).select("dataset", "model", "rmse", "created_at", "decision", "version")


@register("current_models", _REG_SQL + """
SELECT dataset, model, rmse, created_at, decision, CAST(version AS INTEGER) AS version FROM reg
WHERE decision = 'promote' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY version DESC) = 1""")
def current_models(spark, sf):
    """V2: latest promoted model per dataset."""
    return X.current_models(_registry(spark, sf)).select("dataset", "model", "rmse", "created_at", "decision", "version")


@register("baseline_cross_validation", with_fleets("lineitem", extra=f"""
lab AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) AS INTEGER) AS rul,
               count(*) OVER (PARTITION BY dataset, engine_id) AS n FROM fleet_lineitem WHERE split = 'train'),
folds AS (SELECT dataset, engine_id, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold
          FROM (SELECT dataset, engine_id, row_number() OVER (PARTITION BY dataset ORDER BY size DESC, engine_id) - 1 AS p
                FROM (SELECT dataset, engine_id, count(*) AS size FROM lab GROUP BY ALL))),
lf AS (SELECT l.*, f.fold FROM lab l JOIN folds f USING (dataset, engine_id)),
fit AS (SELECT l.dataset, k.k AS fold, floor(l.cycle / {BUCKET}) AS bucket, l.rul
        FROM lf l JOIN range(0, 5) k(k) ON l.fold <> k.k),
gm AS (SELECT dataset, fold, avg(rul) AS g FROM fit GROUP BY ALL),
bm AS (SELECT dataset, fold, bucket, avg(rul) AS pb FROM fit GROUP BY ALL),
pts AS (SELECT dataset, engine_id, fold, cycle, CAST(rul AS DOUBLE) AS y FROM lf
        WHERE cycle >= 50 OR (n < 50 AND cycle = n)),
sc AS (SELECT p.dataset, p.fold, p.y, greatest(least(coalesce(b.pb, g.g), 125.0), 0.0) AS p
       FROM pts p JOIN gm g USING (dataset, fold) LEFT JOIN bm b ON b.dataset = p.dataset AND b.fold = p.fold
            AND b.bucket = floor(p.cycle / {BUCKET})),
per AS (SELECT dataset, fold, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae,
          CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((p - y) * (p - y)) = 0 THEN 1.0 ELSE 0.0 END
               ELSE 1.0 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) END AS r2,
          avg(CASE WHEN p - y < 0 THEN exp(-(p - y) / 13.0) - 1 ELSE exp((p - y) / 10.0) - 1 END) AS nasa_score
        FROM sc GROUP BY ALL)
""") + """
SELECT dataset, fold, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(r2, 3) AS r2, round(nasa_score, 3) AS nasa_score FROM per
UNION ALL
SELECT dataset, -1, round(avg(rmse), 3), round(avg(mae), 3), round(avg(r2), 3), round(avg(nasa_score), 3) FROM per GROUP BY dataset""")
def baseline_cross_validation(spark, sf):
    """M1/X4 data path with an exact oracle: 5 engine folds (G1); for every
    fold the cycle-bucket mean-RUL model is fit on the other folds (totals
    less the fold's own sums, no row is copied), every window of the fold is
    scored, metrics per fold and their unweighted mean (fold -1)."""
    from cyclewise.operators.windows import group_kfold
    train = with_rul(fleet(spark, sf, "lineitem")).filter("split = 'train'")
    folds = group_kfold(train, 5).select("dataset", "engine_id", "fold", F.col("size").alias("n"))
    lf = train.join(folds, ["dataset", "engine_id"]).withColumn("bucket", F.floor(F.col("cycle") / BUCKET))
    gm = X.leave_fold_out_mean(lf, ["dataset"], "rul", out="g")
    bm = X.leave_fold_out_mean(lf, ["dataset", "bucket"], "rul", out="pb")
    ends = (F.col("cycle") >= 50) | ((F.col("n") < 50) & (F.col("cycle") == F.col("n")))
    pts = lf.filter(ends).select("dataset", "fold", "bucket", F.col("rul").cast("double").alias("y"))
    sc = (pts.join(gm, ["dataset", "fold"]).join(bm, ["dataset", "fold", "bucket"], "left")
          .select("dataset", "fold", "y", clip_prediction(F.coalesce("pb", "g")).alias("p")))
    per = X.regression_metrics(sc, ["dataset", "fold"], digits=None).drop("n")
    mean = X.cv_summary(per, ["dataset"]).withColumn("fold", F.lit(-1))
    per = per.select("dataset", "fold", *[F.round(c, 3).alias(c) for c in ("rmse", "mae", "r2", "nasa_score")])
    return per.unionByName(mean.select("dataset", F.col("fold").cast("int").alias("fold"), "rmse", "mae", "r2", "nasa_score"))
