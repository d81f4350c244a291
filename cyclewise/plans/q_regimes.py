"""Queries: regimes (R1-R16), sensor selection (T1, T2, T7), normalisation (Z3).

Regimes of the lineitem fleet: regime_id = rank of returnflag||linestatus
(6 regimes); settings = (discount, tax, quantity), z-scored on train (R1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewise.functions.exprs import r6
from cyclewise.operators import regimes as R
from cyclewise.operators import temporal
from cyclewise.operators.drift import to_long
from cyclewise.operators.labels import with_rul
from cyclewise.operators.temporal import select_degradation_sensors
from cyclewise.plans.catalog import register
from cyclewise.plans.oracle import with_fleets
from cyclewise.session import stage
from cyclewise.sources.tables import SENSORS, SETTINGS, fleet

SENS = SENSORS["lineitem"]
Z = [f"z_{s}" for s in SETTINGS]


_FRAMES: dict = {}


def regime_frame(spark, sf):
    """lineitem + rul + regime_id + z-scored settings (train-fitted); one
    staged table per session and table folder."""
    import os
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _FRAMES:
        _FRAMES[key] = _regime_frame(spark, sf)
    return _FRAMES[key]


def _regime_frame(spark, sf):
    df = R.with_regime_id(with_rul(fleet(spark, sf, "lineitem")))
    params = R.fit_settings_scaler(df.filter("split = 'train'"))
    return stage(R.scale_settings(df, params))


BASE_SQL = with_fleets("lineitem", extra="""
lab AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) AS INTEGER) AS rul
        FROM fleet_lineitem),
rid AS (SELECT dataset, regime_key, CAST(row_number() OVER (PARTITION BY dataset ORDER BY regime_key) - 1 AS INTEGER) AS regime_id
        FROM (SELECT DISTINCT dataset, regime_key FROM lab WHERE regime_key IS NOT NULL)),
sp AS (SELECT dataset, avg(setting_1) AS m1, stddev_pop(setting_1) AS s1, avg(setting_2) AS m2, stddev_pop(setting_2) AS s2,
              avg(setting_3) AS m3, stddev_pop(setting_3) AS s3 FROM lab WHERE split = 'train' GROUP BY ALL),
base AS (SELECT l.*, r.regime_id,
   (setting_1 - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END AS z_setting_1,
   (setting_2 - m2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1.0 ELSE s2 END AS z_setting_2,
   (setting_3 - m3) / CASE WHEN s3 = 0 OR s3 IS NULL THEN 1.0 ELSE s3 END AS z_setting_3
   FROM lab l LEFT JOIN rid r USING (dataset, regime_key) JOIN sp USING (dataset))
""")


@register("settings_scaler", BASE_SQL + """
SELECT dataset, 'setting_1' AS setting, round(m1, 6) AS mean, round(s1, 6) AS std FROM sp UNION ALL
SELECT dataset, 'setting_2', round(m2, 6), round(s2, 6) FROM sp UNION ALL
SELECT dataset, 'setting_3', round(m3, 6), round(s3, 6) FROM sp""")
def settings_scaler(spark, sf):
    """Train-fitted z-score of the operating settings (population std)."""
    p = R.fit_settings_scaler(fleet(spark, sf, "lineitem").filter("split = 'train'"))
    return p.select("dataset", "setting", r6("mean").alias("mean"), r6("std").alias("std"))


_SQD = "(((z_setting_1 - c1) * (z_setting_1 - c1) + (z_setting_2 - c2) * (z_setting_2 - c2)) + (z_setting_3 - c3) * (z_setting_3 - c3))"

QUALITY_SQL = BASE_SQL + f""",
cents AS (SELECT dataset, regime_id, count(*) AS nk, avg(z_setting_1) AS c1, avg(z_setting_2) AS c2, avg(z_setting_3) AS c3
          FROM base GROUP BY ALL),
s AS (SELECT dataset, regime_id, avg(sqrt({_SQD})) AS s FROM base JOIN cents USING (dataset, regime_id) GROUP BY ALL),
ci AS (SELECT * FROM cents JOIN s USING (dataset, regime_id)),
db AS (SELECT dataset, avg(m) AS davies_bouldin FROM (SELECT a.dataset, a.regime_id, max((a.s + b.s) / sqrt(
          ((a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2)) + (a.c3 - b.c3) * (a.c3 - b.c3))) AS m
        FROM ci a JOIN ci b ON a.dataset = b.dataset AND a.regime_id <> b.regime_id GROUP BY ALL) GROUP BY ALL),
g AS (SELECT dataset, count(*) AS n, avg(z_setting_1) AS g1, avg(z_setting_2) AS g2, avg(z_setting_3) AS g3 FROM base GROUP BY ALL),
w AS (SELECT dataset, sum({_SQD}) AS W FROM base JOIN cents USING (dataset, regime_id) GROUP BY ALL),
bb AS (SELECT dataset, sum(nk * (((c1 - g1) * (c1 - g1) + (c2 - g2) * (c2 - g2)) + (c3 - g3) * (c3 - g3))) AS B,
              count(*) AS k, any_value(n) AS n FROM cents JOIN g USING (dataset) GROUP BY ALL)
"""


@register("regime_quality", QUALITY_SQL + """
SELECT dataset, k, round(davies_bouldin, 6) AS davies_bouldin, round((B / (k - 1)) / (W / (n - k)), 3) AS calinski_harabasz
FROM db JOIN bb USING (dataset) JOIN w USING (dataset)""")
def regime_quality(spark, sf):
    """Davies-Bouldin and Calinski-Harabasz of the regime labels on scaled settings."""
    df = regime_frame(spark, sf)
    db = R.davies_bouldin(df, Z, "regime_id")
    ch = R.calinski_harabasz(df, Z, "regime_id")
    return db.join(ch, "dataset").select("dataset", "k", r6("davies_bouldin").alias("davies_bouldin"),
                                         F.round("calinski_harabasz", 3).alias("calinski_harabasz"))


@register("assign_regimes", BASE_SQL + f""",
cents AS (SELECT dataset, regime_id AS label, avg(z_setting_1) AS c1, avg(z_setting_2) AS c2, avg(z_setting_3) AS c3
          FROM base WHERE split = 'train' GROUP BY ALL)
SELECT dataset, split, engine_id, cycle, regime_id, assigned FROM (
  SELECT b.dataset, b.split, b.engine_id, b.cycle, b.regime_id, c.label AS assigned,
         row_number() OVER (PARTITION BY b.dataset, b.engine_id, b.cycle ORDER BY {_SQD}, c.label) AS rk
  FROM base b JOIN cents c USING (dataset)) WHERE rk = 1""")
def assign_regimes(spark, sf):
    """Nearest train centroid of the scaled settings for every row."""
    df = regime_frame(spark, sf)
    cents = R.centroids_from_labels(df.filter("split = 'train'"), Z, "regime_id")
    out = R.assign_regimes(df, cents, Z)
    return out.select("dataset", "split", "engine_id", "cycle", "regime_id", F.col("assigned").cast("int"))


def _regime_scaled_sql(final: str) -> str:
    sel = ", ".join(f"({s} - p.m_{s}) / CASE WHEN p.s_{s} IS NULL OR p.s_{s} = 0 THEN 1.0 ELSE p.s_{s} END AS {s}"
                    for s in SENS)
    par = ", ".join(f"avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}" for s in SENS)
    return BASE_SQL + f""",
rp AS (SELECT dataset, regime_id, {par} FROM base WHERE split = 'train' GROUP BY ALL),
rs AS (SELECT b.dataset, b.split, b.engine_id, b.cycle, b.regime_id, b.rul, {sel} FROM base b JOIN rp p USING (dataset, regime_id))
""" + final


@register("regime_scaled_sensors", _regime_scaled_sql(
    "SELECT dataset, split, engine_id, cycle, regime_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in SENS) + " FROM rs"))
def regime_scaled_sensors(spark, sf):
    """Per-regime population z-score fitted on train, applied to both splits."""
    df = regime_frame(spark, sf)
    params = R.fit_regime_scalers(to_long(df.filter("split = 'train'"), SENS, ("dataset", "regime_id")))
    out = R.apply_regime_scalers(df, params, SENS)
    return out.select("dataset", "split", "engine_id", "cycle", "regime_id", *[r6(s).alias(s) for s in SENS])


def _norm_sql():
    gsel = ", ".join(f"round(({s} - g.m_{s}) / CASE WHEN g.s_{s} IS NULL OR g.s_{s} = 0 THEN 1.0 ELSE g.s_{s} END, 6) AS {s}"
                     for s in SENS)
    gpar = ", ".join(f"avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}" for s in SENS)
    return _regime_scaled_sql(f""",
gp AS (SELECT dataset, {gpar} FROM rs WHERE split = 'train' GROUP BY ALL)
SELECT r.dataset, r.split, r.engine_id, r.cycle, {gsel} FROM rs r JOIN gp g USING (dataset)""")


@register("normalize_regime_plus_global", _norm_sql())
def normalize_regime_plus_global(spark, sf):
    """Z3 (default mode): per-regime scaling, then a global z-score on train."""
    out = R.normalize(regime_frame(spark, sf), SENS, "regime_plus_global")
    return out.select("dataset", "split", "engine_id", "cycle", *[r6(s).alias(s) for s in SENS])


@register("regime_one_hot", BASE_SQL + """,
tr AS (SELECT DISTINCT regime_id FROM base WHERE split = 'train')
SELECT dataset, split, engine_id, cycle, regime_id,
  CASE WHEN regime_id = 0 THEN 1.0 ELSE 0.0 END AS regime_onehot_0, CASE WHEN regime_id = 1 THEN 1.0 ELSE 0.0 END AS regime_onehot_1,
  CASE WHEN regime_id = 2 THEN 1.0 ELSE 0.0 END AS regime_onehot_2, CASE WHEN regime_id = 3 THEN 1.0 ELSE 0.0 END AS regime_onehot_3,
  CASE WHEN regime_id = 4 THEN 1.0 ELSE 0.0 END AS regime_onehot_4, CASE WHEN regime_id = 5 THEN 1.0 ELSE 0.0 END AS regime_onehot_5,
  CAST(CASE WHEN regime_id BETWEEN 0 AND 5 THEN regime_id + 1 ELSE 0 END AS BIGINT) AS fixed_hot_position
FROM base""")
def regime_one_hot(spark, sf):
    """R11 (one column per training regime) and R12 (fixed width 6)."""
    df = regime_frame(spark, sf)
    regs = [r.regime_id for r in df.filter("split = 'train'").select("regime_id").distinct().collect()]
    out = R.regime_one_hot(df, regs).withColumn("_fixed", R.regime_one_hot_fixed())
    cols = [f"regime_onehot_{r}" for r in sorted(regs)]
    return out.select("dataset", "split", "engine_id", "cycle", "regime_id", *cols,
                      F.array_position("_fixed", 1.0).alias("fixed_hot_position"))


@register("regime_weights", BASE_SQL + """,
c AS (SELECT dataset, regime_id, count(*) AS n FROM base GROUP BY ALL)
SELECT c.dataset, c.regime_id, round(least(max(n) OVER (PARTITION BY c.dataset) / n, 2.5), 6) AS regime_weight, n AS rows
FROM c""")
def regime_weights(spark, sf):
    """min(max_count / count, 2.5) per row (reported per regime)."""
    w = R.regime_weights(regime_frame(spark, sf))
    return w.groupBy("dataset", "regime_id").agg(r6(F.first("regime_weight")).alias("regime_weight"),
                                                 F.count(F.lit(1)).alias("rows"))


@register("regime_distribution", BASE_SQL + "SELECT dataset, split, regime_id, count(*) AS rows FROM base GROUP BY ALL")
def regime_distribution(spark, sf):
    """Rows per regime per split."""
    return R.regime_distribution(regime_frame(spark, sf))


def _corr_long_sql(by: str) -> str:
    parts = " UNION ALL ".join(f"SELECT dataset, regime_id, {i} AS sensor_order, '{s}' AS sensor, {s} AS value, rul "
                               f"FROM base WHERE split = 'train'" for i, s in enumerate(SENS))
    return (f"SELECT dataset, {by} sensor, sensor_order, coalesce(abs(CASE WHEN stddev_pop(x) * stddev_pop(y) = 0 THEN NULL "
            f"ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END), 0.0) AS abs_corr FROM (SELECT *, "
            f"CASE WHEN rul IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL THEN CAST(rul AS DOUBLE) END AS y "
            f"FROM ({parts})) GROUP BY ALL")


@register("sensor_rul_correlation", BASE_SQL + f"""
SELECT dataset, CAST(-1 AS INTEGER) AS regime_id, sensor, round(abs_corr, 6) AS abs_corr FROM ({_corr_long_sql('')})
UNION ALL SELECT dataset, regime_id, sensor, round(abs_corr, 6) FROM ({_corr_long_sql('regime_id,')})""")
def sensor_rul_correlation(spark, sf):
    """|Pearson(sensor, RUL)| globally (regime -1) and per regime."""
    from cyclewise.operators.temporal import sensor_rul_correlation as corr
    df = regime_frame(spark, sf).filter("split = 'train'")
    long = to_long(df, SENS, ("dataset", "regime_id", "rul"))
    g = corr(long, ("dataset",)).withColumn("regime_id", F.lit(-1))
    r = corr(long, ("dataset", "regime_id"))
    return g.unionByName(r).select("dataset", "regime_id", "sensor", r6("abs_corr").alias("abs_corr"))


SELECT_SQL = BASE_SQL + f""",
cr AS ({_corr_long_sql('regime_id,')}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, regime_id ORDER BY abs_corr DESC, sensor_order) AS rk
        FROM cr) WHERE rk <= 3),
firsts AS (SELECT dataset, sensor, min(regime_id * 1000 + rk) AS f FROM top GROUP BY ALL),
sel AS (SELECT dataset, sensor, row_number() OVER (PARTITION BY dataset ORDER BY f) AS pick FROM firsts QUALIFY pick <= 6)
"""


def _selection(df):
    long = to_long(df.filter("split = 'train'"), SENS, ("dataset", "regime_id", "rul"))
    long = long.withColumn("sensor_order", F.array_position(F.array(*[F.lit(s) for s in SENS]), F.col("sensor")) - 1)
    return select_degradation_sensors(long, 3, 6)


@register("degradation_sensors", SELECT_SQL + "SELECT dataset, sensor, CAST(pick AS INTEGER) AS pick FROM sel")
def degradation_sensors(spark, sf):
    """Top-3 |corr| sensors per regime, first-seen order, at most 6."""
    return _selection(regime_frame(spark, sf)).select("dataset", "sensor", F.col("pick").cast("int"))


@register("degradation_features", SELECT_SQL + """,
lng AS (""" + " UNION ALL ".join(f"SELECT dataset, engine_id, cycle, '{s}' AS sensor, {s} AS value FROM base" for s in SENS) + """)
SELECT l.dataset, l.engine_id, l.cycle, l.sensor, CAST(s.pick AS INTEGER) AS pick,
  round(coalesce(value - lag(value) OVER w, 0), 6) AS diff1, round(avg(value) OVER wr, 6) AS roll_mean5,
  round(coalesce(stddev_pop(value) OVER wr, 0), 6) AS roll_std5
FROM lng l JOIN sel s USING (dataset, sensor)
WINDOW w AS (PARTITION BY l.dataset, l.engine_id, l.sensor ORDER BY cycle),
       wr AS (PARTITION BY l.dataset, l.engine_id, l.sensor ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def degradation_features(spark, sf):
    """Selection on train, the same sensors' diff1 / rolling features on both splits."""
    feats, sel = temporal.degradation_features(regime_frame(spark, sf), SENS)
    made = [s for s in SENS if f"{s}_diff1" in feats.columns]
    cell = F.explode(F.array(*[F.struct(
        F.lit(s).alias("sensor"), r6(f"{s}_diff1").alias("diff1"), r6(f"{s}_roll_mean5").alias("roll_mean5"),
        r6(f"{s}_roll_std5").alias("roll_std5")) for s in made])).alias("c")
    return (feats.select("dataset", "engine_id", "cycle", cell).select("dataset", "engine_id", "cycle", "c.*")
            .join(sel.select("dataset", "sensor", F.col("pick").cast("int").alias("pick")), ["dataset", "sensor"]))


# ---------------------------------------------------------------- sweep and vote

#: k-means restarts of the reference
RESTARTS = 20

_SIL = " + ".join(f"z_setting_{j} * c.c{j}" for j in (1, 2, 3))


@register("regime_silhouette", BASE_SQL + f""",
pt AS (SELECT dataset, regime_id, z_setting_1, z_setting_2, z_setting_3,
              z_setting_1 * z_setting_1 + z_setting_2 * z_setting_2 + z_setting_3 * z_setting_3 AS nn,
              count(*) AS w FROM base GROUP BY ALL),
cl AS (SELECT dataset, regime_id, sum(w) AS nk, sum(w * z_setting_1) / sum(w) AS c1, sum(w * z_setting_2) / sum(w) AS c2,
              sum(w * z_setting_3) / sum(w) AS c3, sum(w * nn) / sum(w) AS q FROM pt GROUP BY ALL),
m AS (SELECT p.dataset, p.regime_id, p.w, p.z_setting_1, p.z_setting_2, p.z_setting_3,
             max(CASE WHEN c.regime_id = p.regime_id THEN greatest(0, (nn - 2 * ({_SIL}) + q) * nk / (nk - 1)) END) AS a,
             min(CASE WHEN c.regime_id <> p.regime_id THEN greatest(0, nn - 2 * ({_SIL}) + q) END) AS b
      FROM pt p JOIN cl c USING (dataset) GROUP BY ALL)
SELECT dataset, round(sum(w * (b - a) / greatest(a, b)) / sum(w), 6) AS silhouette FROM m GROUP BY ALL""")
def regime_silhouette(spark, sf):
    """Squared-Euclidean silhouette of the regime labels on scaled settings."""
    s = R.silhouette(regime_frame(spark, sf), Z, "regime_id")
    return s.select("dataset", r6("silhouette").alias("silhouette"))


@register("regime_sweep")
def regime_sweep(spark, sf):
    """K-means k=2..10 on distinct scaled settings (weighted), best of 20 restarts;
    inertia, silhouette, Davies-Bouldin, Calinski-Harabasz per k."""
    import os
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _SWEEPS:
        df = regime_frame(spark, sf).filter("split = 'train'")
        _SWEEPS[key] = stage(R.sweep_regimes(df, Z, range(2, 11), RESTARTS))
    return _SWEEPS[key]


_SWEEPS: dict = {}


@register("regime_vote")
def regime_vote(spark, sf):
    """One condition -> one cluster, else elbow and majority vote over the sweep."""
    return R.recommend_k(regime_frame(spark, sf).filter("split = 'train'"), SETTINGS, regime_sweep(spark, sf))


@register("regime_projection")
def regime_projection(spark, sf):
    """2-D PCA of the scaled settings with the regime label."""
    return R.regime_projection_2d(regime_frame(spark, sf), Z)
