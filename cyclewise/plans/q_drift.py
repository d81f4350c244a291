"""Queries: drift monitoring (D1-D15, S11) with the DuckDB oracle written
from the reference's definitions (sorted ranks, per-bin sums, window ECDFs),
not from our closed forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cyclewise.functions.exprs import r6
from cyclewise.operators import drift as D
from cyclewise.plans.catalog import register
from cyclewise.plans.monitor import MONITOR_SENSORS, NOISE_STD, SEED, monitor, monitor_input
from cyclewise.plans.oracle import with_fleets

TWO_PI = 2.0 * math.pi


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _quantile_sql(src: str, keys: str, value: str, q: float, name: str) -> str:
    """numpy linear quantile over sorted ranks (virtual index n*q + (1-q) - 1)."""
    qd = _dbl(q)
    return f"""
{name}_r AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS r,
                count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
{name}_h AS (SELECT DISTINCT {keys}, n, (n * {qd} + (1.0 - {qd})) - 1.0 AS h FROM {name}_r),
{name} AS (SELECT {', '.join('h.' + k.strip() for k in keys.split(','))},
  CASE WHEN h.h - floor(h.h) < 0.5 THEN lo.v + (hi.v - lo.v) * (h.h - floor(h.h))
       ELSE hi.v - (hi.v - lo.v) * (1.0 - (h.h - floor(h.h))) END AS quantile
  FROM {name}_h h
  JOIN {name}_r lo ON {' AND '.join(f'lo.{k.strip()} = h.{k.strip()}' for k in keys.split(','))} AND lo.r = floor(h.h)
  JOIN {name}_r hi ON {' AND '.join(f'hi.{k.strip()} = h.{k.strip()}' for k in keys.split(','))}
                   AND hi.r = least(floor(h.h) + 1, h.n - 1))"""


def _ks_pvalue_sql(name: str) -> str:
    """P(D_N >= d), N = n*m/(n+m) rounded: the one-sided sum with the gamma
    function in the tail, Durbin's matrix applied N times to a unit vector up
    to N = 140, the Pelz-Good series beyond."""
    series = lambda lo, hi, body: f"list_sum(list_transform(range({lo}, {hi}), lambda k: {body}))"
    half, whole = "((pi() * (k + 0.5)) ** 2)", "((pi() * k) ** 2)"
    eh, ew = f"exp(-{half} / (2 * z2))", f"exp(-{whole} / (2 * z2))"
    k0 = series(-20, 20, f"{eh} / z")
    k1 = series(-20, 20, f"({half} - z2) * {eh}") + " / (6 * z2 ** 2)"
    k2 = series(-20, 20, f"(6 * z2 ** 3 + 2 * z2 ** 2 + {half} * (2 * z2 ** 2 - 5 * z2) "
                         f"+ {half} ** 2 * (1 - 2 * z2)) * {eh}") + " / (72 * z ** 7) - " \
        + series(-20, 21, f"{whole} * {ew}") + " / (36 * z ** 3)"
    k3 = series(-20, 20, f"({half} ** 3 * (5 - 30 * z2) + {half} ** 2 * (-60 * z2 + 212 * z2 ** 2) "
                         f"+ {half} * (135 * z2 ** 2 - 96 * z2 ** 3) - 30 * z2 ** 3 - 90 * z2 ** 4) * {eh}") \
        + " / (6480 * z2 ** 5) + " + series(-20, 21, f"(3 * {whole} * z2 - {whole} ** 2) * {ew}") + " / (216 * z2 ** 3)"
    return f"""
{name}_nd AS (SELECT DISTINCT d, round_even(m * n / (m + n), 0) AS en FROM {name}_d),
{name}_edge AS (SELECT d, en, CASE WHEN en * d <= 0.5 THEN 1.0 ELSE 0.0 END AS p FROM {name}_nd WHERE en * d <= 0.5 OR d >= 1),
{name}_in AS (SELECT *, CAST(ceil(en * d) AS INTEGER) AS k, ceil(en * d) - en * d AS h, 2 * CAST(ceil(en * d) AS INTEGER) - 1 AS mm
   FROM {name}_nd WHERE en * d > 0.5 AND d < 1),
{name}_tail AS (SELECT d, en, least(1.0, 2 * d * list_sum(list_transform(range(0, CAST(floor(en * (1 - d)) AS BIGINT) + 1),
     lambda j: CASE WHEN 1 - d - j / en <= 0 THEN 0.0 ELSE exp(lgamma(en + 1) - lgamma(j + 1.0) - lgamma(en - j + 1)
          + (j - 1) * ln(d + j / en) + (en - j) * ln(1 - d - j / en)) END))) AS p
   FROM {name}_in WHERE en * d * d >= 4),
{name}_mat AS (SELECT d, en, k, mm, list_transform(range(1, mm + 1), lambda i: list_transform(range(1, mm + 1), lambda j:
     CASE WHEN j > i + 1 THEN 0.0
          WHEN j = 1 AND i = mm THEN (1 - 2 * h ** mm + greatest(0.0, 2 * h - 1) ** mm) / gamma(mm + 1.0)
          WHEN j = 1 THEN (1 - h ** i) / gamma(i + 1.0)
          WHEN i = mm THEN (1 - h ** (mm - j + 1)) / gamma(mm - j + 2.0)
          ELSE 1 / gamma(i - j + 2.0) END)) AS hm
   FROM {name}_in WHERE en * d * d < 4 AND en <= 140),
{name}_pow AS (SELECT d, en, k, list_reduce(list_transform(range(0, CAST(en AS BIGINT) + 1),
     lambda s: list_transform(range(1, mm + 1), lambda i: CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)),
     lambda v, s: list_transform(hm, lambda r: list_dot_product(r, v))) AS v FROM {name}_mat),
{name}_small AS (SELECT d, en, 1 - v[k] * exp(lgamma(en + 1) - en * ln(en)) AS p FROM {name}_pow),
{name}_z AS (SELECT d, en, d * sqrt(en) AS z, d * d * en AS z2 FROM {name}_in WHERE en * d * d < 4 AND en > 140),
{name}_large AS (SELECT d, en, 1 - sqrt(pi() / 2) * ({k0} + ({k1}) / sqrt(en) + ({k2}) / en + ({k3}) / en ** 1.5) AS p FROM {name}_z),
{name}_p AS (SELECT d, en, least(1.0, greatest(0.0, p)) AS p FROM (SELECT * FROM {name}_edge UNION ALL SELECT * FROM {name}_tail
   UNION ALL SELECT * FROM {name}_small UNION ALL SELECT * FROM {name}_large)),
{name}_ks AS (SELECT q.*, x.p FROM {name}_d q JOIN {name}_p x ON x.d = q.d AND x.en = round_even(q.m * q.n / (q.m + q.n), 0))"""


def _tests_sql(batch: str, keys: str, name: str) -> str:
    """PSI and KS per (keys, sensor) batch from the textbook definitions."""
    k = keys
    return f"""
{name}_m AS (SELECT {k}, sensor, count(*) AS m FROM {batch} WHERE value IS NOT NULL GROUP BY ALL),
{name}_cb AS (SELECT b.{k.replace(', ', ', b.')}, b.sensor, len(list_filter(e.cuts, lambda x: x <= b.value)) AS bin,
              count(*) AS cc FROM {batch} b JOIN edges e USING (dataset, sensor) WHERE b.value IS NOT NULL GROUP BY ALL),
{name}_ab AS (SELECT m.*, unnest(range(0, len(e.cuts) + 1)) AS bin FROM {name}_m m JOIN edges e USING (dataset, sensor)),
{name}_psi AS (SELECT a.{k.replace(', ', ', a.')}, a.sensor,
   sum((greatest(coalesce(c.cc, 0) / a.m, 1e-6) - coalesce(rb.r, 1e-6))
       * ln(greatest(coalesce(c.cc, 0) / a.m, 1e-6) / coalesce(rb.r, 1e-6))) AS psi
   FROM {name}_ab a LEFT JOIN {name}_cb c USING ({k}, sensor, bin) LEFT JOIN rb USING (dataset, sensor, bin)
   GROUP BY ALL),
{name}_pts AS (SELECT DISTINCT dataset, sensor, value FROM {batch} WHERE value IS NOT NULL),
{name}_mrg AS (SELECT dataset, sensor, value, sum(cnt) AS cnt FROM
   (SELECT dataset, sensor, value, cnt FROM refc UNION ALL SELECT dataset, sensor, value, 0 FROM {name}_pts) GROUP BY ALL),
{name}_look AS (SELECT dataset, sensor, value, cnt,
   sum(cnt) OVER (PARTITION BY dataset, sensor ORDER BY value ROWS UNBOUNDED PRECEDING) AS le FROM {name}_mrg),
{name}_bc AS (SELECT {k}, sensor, value, count(*) AS cb FROM {batch} WHERE value IS NOT NULL GROUP BY ALL),
{name}_fb AS (SELECT *, sum(cb) OVER (PARTITION BY {k}, sensor ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum_b,
   sum(cb) OVER (PARTITION BY {k}, sensor) AS m FROM {name}_bc),
{name}_d AS (SELECT f.{k.replace(', ', ', f.')}, f.sensor,
   max(greatest(abs(l.le / s.n - f.cum_b / f.m), abs((l.le - l.cnt) / s.n - (f.cum_b - f.cb) / f.m))) AS d,
   any_value(f.m) AS m, any_value(s.n) AS n
   FROM {name}_fb f JOIN {name}_look l USING (dataset, sensor, value) JOIN stats s USING (dataset, sensor) GROUP BY ALL),
{_ks_pvalue_sql(name)},
{name} AS (SELECT p.*, k.d AS ks_statistic, k.p AS ks_pvalue, k.m AS sample_size
   FROM {name}_psi p JOIN {name}_ks k USING ({k}, sensor) WHERE k.m >= 5)"""


def monitor_sql(final: str) -> str:
    longs = []
    for name, cols in MONITOR_SENSORS.items():
        for c in cols:
            longs.append(f"SELECT dataset, split, engine_id, cycle, '{c}' AS sensor, {c} AS value FROM fleet_{name}")
    sev = ", ".join(f"('{s}', {_dbl(m)})" for s, m in D.SEVERITY_MULTIPLIERS.items())
    qs = ", ".join(f"({i}, {_dbl(q)})" for i, q in enumerate(D.linspace_quantiles(D.PSI_BINS)))
    u = lambda lo: f"((('0x' || substr(h, {lo}, 8))::UBIGINT + 0.5) / 4294967296.0)"
    body = f"""
long AS ({' UNION ALL '.join(longs)}),
train AS (SELECT dataset, engine_id, cycle, sensor, value FROM long WHERE split = 'train'),
test AS (SELECT dataset, engine_id, cycle, sensor, value FROM long WHERE split = 'test'),
stats AS (SELECT dataset, sensor, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std
          FROM train WHERE value IS NOT NULL GROUP BY ALL),
refc AS (SELECT dataset, sensor, value, count(*) AS cnt FROM train WHERE value IS NOT NULL GROUP BY ALL),
rk AS (SELECT dataset, sensor, value, row_number() OVER (PARTITION BY dataset, sensor ORDER BY value) - 1 AS r
       FROM train WHERE value IS NOT NULL),
qt AS (SELECT s.dataset, s.sensor, s.n, q.qi, (s.n * q.q + (1.0 - q.q)) - 1.0 AS h
       FROM stats s, (VALUES {qs}) q(qi, q)),
qv AS (SELECT qt.dataset, qt.sensor, qt.qi, qt.h - floor(qt.h) AS t, lo.value AS a, hi.value AS b FROM qt
       JOIN rk lo ON lo.dataset = qt.dataset AND lo.sensor = qt.sensor AND lo.r = floor(qt.h)
       JOIN rk hi ON hi.dataset = qt.dataset AND hi.sensor = qt.sensor AND hi.r = least(floor(qt.h) + 1, qt.n - 1)),
qe AS (SELECT dataset, sensor, list_sort(list_distinct(list(CASE WHEN t < 0.5 THEN a + (b - a) * t
          ELSE b - (b - a) * (1.0 - t) END))) AS u FROM qv GROUP BY ALL),
edges AS (SELECT dataset, sensor, CASE WHEN len(u) >= 3 THEN list_slice(u, 2, len(u) - 1)
          ELSE list_transform(range(1, {D.PSI_BINS}), lambda i: i * (((mean + 3 * greatest(std, 1e-6))
               - (mean - 3 * greatest(std, 1e-6))) / {D.PSI_BINS}) + (mean - 3 * greatest(std, 1e-6))) END AS cuts
          FROM qe JOIN stats USING (dataset, sensor)),
rb0 AS (SELECT t.dataset, t.sensor, len(list_filter(e.cuts, lambda x: x <= t.value)) AS bin, count(*) AS rc
        FROM train t JOIN edges e USING (dataset, sensor) WHERE t.value IS NOT NULL GROUP BY ALL),
rb AS (SELECT dataset, sensor, bin, greatest(rc / n, 1e-6) AS r FROM rb0 JOIN stats USING (dataset, sensor)),
cal_batch AS (SELECT dataset, 'calibration' AS severity, engine_id, cycle, sensor, value FROM train),
{_tests_sql('cal_batch', 'dataset, severity, engine_id', 'cal')},
{_quantile_sql('cal', 'dataset, sensor', 'psi', D.CALIBRATION_QUANTILE, 'cq_psi')},
{_quantile_sql('cal', 'dataset, sensor', 'ks_pvalue', 1.0 - D.CALIBRATION_QUANTILE, 'cq_p')},
thr AS (SELECT s.dataset, s.sensor, coalesce(greatest(0.2, a.quantile), 0.2) AS psi_threshold,
               coalesce(least(0.05, b.quantile), 0.05) AS ks_pvalue_threshold
        FROM stats s LEFT JOIN cq_psi a USING (dataset, sensor) LEFT JOIN cq_p b USING (dataset, sensor)),
sev AS (SELECT * FROM (VALUES {sev}) v(severity, mult)),
shifted0 AS (SELECT t.*, s.severity, s.mult,
   md5(concat_ws('|', '{SEED}', s.severity, t.dataset, CAST(t.engine_id AS VARCHAR), CAST(t.cycle AS VARCHAR), t.sensor)) AS h
   FROM test t, sev s),
shifted AS (SELECT dataset, engine_id, cycle, sensor, severity,
   CASE WHEN severity = 'normal' THEN value * mult
        ELSE value * mult + {_dbl(NOISE_STD)} * (sqrt(-2.0 * ln({u(1)})) * cos({_dbl(TWO_PI)} * {u(9)})) END AS value
   FROM shifted0),
{_tests_sql('shifted', 'dataset, severity, engine_id', 'bt')},
pos AS (SELECT dataset, engine_id, row_number() OVER (PARTITION BY dataset ORDER BY engine_id) - 1 AS batch_index
        FROM (SELECT DISTINCT dataset, engine_id FROM test)),
results AS (SELECT bt.dataset, printf('%s_%04d', severity, p.batch_index) AS batch_id,
   bt.engine_id, severity, sensor, psi, ks_statistic, ks_pvalue,
   CASE WHEN psi > psi_threshold AND ks_pvalue < ks_pvalue_threshold THEN 'drift' ELSE 'stable' END AS status,
   psi_threshold, ks_pvalue_threshold, psi > psi_threshold AS psi_flag, ks_pvalue < ks_pvalue_threshold AS ks_flag,
   'AND' AS decision_rule, CAST(sample_size AS BIGINT) AS sample_size, sample_size < 20 AS small_batch, p.batch_index
   FROM bt JOIN pos p USING (dataset, engine_id) LEFT JOIN thr USING (dataset, sensor)),
rollup0 AS (SELECT dataset, batch_id, severity, median(psi) AS psi, median(ks_statistic) AS ks_statistic,
   count(*) AS sensor_checks, CAST(sum(CASE WHEN status = 'drift' THEN 1 ELSE 0 END) AS BIGINT) AS drifted_sensor_checks,
   avg(CASE WHEN status = 'drift' THEN 1.0 ELSE 0.0 END) AS drift_rate FROM results GROUP BY ALL),
rollup AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY batch_id) - 1 AS BIGINT) AS batch FROM rollup0),
flags AS (SELECT p.dataset, s.severity, p.engine_id, p.batch_index,
   printf('%s_%04d', s.severity, p.batch_index) AS batch_id,
   CAST(coalesce(sum(CASE WHEN r.status = 'drift' THEN 1 ELSE 0 END), 0) AS BIGINT) AS drifted_sensor_count,
   count(r.sensor) AS checks
   FROM pos p CROSS JOIN sev s LEFT JOIN results r ON r.dataset = p.dataset AND r.engine_id = p.engine_id
        AND r.severity = s.severity GROUP BY ALL),
g1 AS (SELECT *, drifted_sensor_count >= 3 AS d,
   row_number() OVER w AS rn,
   coalesce(max(CASE WHEN drifted_sensor_count < 3 THEN row_number_ END) OVER w, 0) AS last_stable,
   coalesce(max(CASE WHEN drifted_sensor_count >= 3 THEN row_number_ END) OVER w, 0) AS last_drift
   FROM (SELECT *, row_number() OVER (PARTITION BY dataset, severity ORDER BY batch_index) AS row_number_ FROM flags)
   WINDOW w AS (PARTITION BY dataset, severity ORDER BY batch_index ROWS UNBOUNDED PRECEDING)),
g2 AS (SELECT *, rn - last_stable AS run, rn - last_drift AS srun FROM g1),
g3 AS (SELECT *, sum(CASE WHEN srun = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, severity ORDER BY batch_index
   ROWS UNBOUNDED PRECEDING) AS ep FROM g2),
g4 AS (SELECT *, max(CASE WHEN run >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, severity, ep ORDER BY batch_index
   ROWS UNBOUNDED PRECEDING) = 1 AS active FROM g3),
gate AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY dataset, severity, ep ORDER BY batch_index), false)
   AS trig FROM g4)
"""
    return with_fleets(*MONITOR_SENSORS, extra=body) + final


_RUNS: dict = {}


def _run(spark, sf):
    """One monitor sweep per session and table folder; its stages are
    checkpointed tables, so the drift queries share them."""
    import os
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _RUNS:
        _RUNS[key] = monitor(monitor_input(spark, sf))
    return _RUNS[key]


# ---------------------------------------------------------------- queries

@register("drift_reference_stats", monitor_sql(
    "SELECT dataset, sensor, n, round(mean, 6) AS mean, round(std, 6) AS std FROM stats"))
def drift_reference_stats(spark, sf):
    """Reference size, mean and population std per sensor."""
    _, stats = D.fit_reference(monitor_input(spark, sf).filter(F.col("split") == "train"))
    return stats.select("dataset", "sensor", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@register("drift_psi_edges", monitor_sql(
    "SELECT dataset, sensor, CAST(i AS INTEGER) AS edge_index, round(cuts[i], 6) AS edge "
    "FROM (SELECT dataset, sensor, cuts, unnest(range(1, len(cuts) + 1)) AS i FROM edges)"))
def drift_psi_edges(spark, sf):
    """Inner PSI edges (deciles made unique, or the +-3 std fallback)."""
    ecdf, stats = D.fit_reference(monitor_input(spark, sf).filter(F.col("split") == "train"))
    e = D.psi_edges(ecdf, stats)
    return e.select("dataset", "sensor", F.posexplode("inner").alias("i", "edge")).select(
        "dataset", "sensor", (F.col("i") + 1).alias("edge_index"), r6("edge").alias("edge"))


@register("drift_thresholds", monitor_sql(
    "SELECT dataset, sensor, round(psi_threshold, 6) AS psi_threshold, "
    "round(ks_pvalue_threshold, 6) AS ks_pvalue_threshold FROM thr"))
def drift_thresholds(spark, sf):
    """Calibrated thresholds from every training engine."""
    t = _run(spark, sf).thresholds
    return t.select("dataset", "sensor", r6("psi_threshold").alias("psi_threshold"),
                    r6("ks_pvalue_threshold").alias("ks_pvalue_threshold"))


_RESULT_COLS = ["dataset", "batch_id", "engine_id", "severity", "sensor", "status", "psi_flag", "ks_flag",
                "decision_rule", "sample_size", "small_batch"]
_RESULT_DBL = ["psi", "ks_statistic", "ks_pvalue", "psi_threshold", "ks_pvalue_threshold"]


@register("drift_results", monitor_sql(
    f"SELECT {', '.join(_RESULT_COLS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _RESULT_DBL)} FROM results"))
def drift_results(spark, sf):
    """PSI, KS and flags per batch x sensor (timestamp omitted: wall clock)."""
    r = _run(spark, sf).results
    return r.select(*_RESULT_COLS, *[r6(c).alias(c) for c in _RESULT_DBL])


@register("drift_decisions", monitor_sql(
    "SELECT dataset, severity, batch_id, engine_id, bool_or(status = 'drift') AS drift_detected, "
    "CASE WHEN bool_or(status = 'drift') THEN 'trigger_retraining' ELSE 'continue_prediction' END AS action, "
    "CAST(count(DISTINCT CASE WHEN status = 'drift' THEN sensor END) AS BIGINT) AS drifted_sensor_count, "
    "coalesce(string_agg(DISTINCT CASE WHEN status = 'drift' THEN sensor END, ',' ORDER BY "
    "CASE WHEN status = 'drift' THEN sensor END), '') AS drifted_sensors FROM results GROUP BY ALL"))
def drift_decisions(spark, sf):
    """Per-batch retraining decision with the sorted drifted sensors."""
    d = _run(spark, sf).decisions
    return d.select("dataset", "severity", "batch_id", "engine_id", "drift_detected", "action",
                    F.size("drifted_sensors").cast("long").alias("drifted_sensor_count"),
                    F.array_join("drifted_sensors", ",").alias("drifted_sensors"))


@register("drift_gate", monitor_sql(
    "SELECT dataset, severity, engine_id, batch_id, CAST(batch_index AS BIGINT) AS batch_index, drifted_sensor_count, "
    "d AS drift_detected, CAST(run AS BIGINT) AS consecutive_drift_batches, active AS retraining_episode_active, "
    "CASE WHEN trig THEN 'trigger_retraining' WHEN active AND d THEN 'retraining_pending' "
    "ELSE 'continue_prediction' END AS action FROM gate"))
def drift_gate_q(spark, sf):
    """Consecutive-batch gate per (dataset, severity), skipped batches included."""
    g = _run(spark, sf).gate
    return g.select("dataset", "severity", "engine_id", "batch_id", F.col("batch_index").cast("long").alias("batch_index"),
                    "drifted_sensor_count", "drift_detected", "consecutive_drift_batches",
                    "retraining_episode_active", "action")


@register("drift_batch_rollup", monitor_sql(
    "SELECT dataset, batch_id, severity, batch, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, "
    "sensor_checks, drifted_sensor_checks, round(drift_rate, 6) AS drift_rate FROM rollup"))
def drift_batch_rollup(spark, sf):
    """Per-batch medians and drift rate."""
    r = _run(spark, sf).rollup
    return r.select("dataset", "batch_id", "severity", "batch", r6("psi").alias("psi"),
                    r6("ks_statistic").alias("ks_statistic"), "sensor_checks", "drifted_sensor_checks",
                    r6("drift_rate").alias("drift_rate"))


_SUMMARY_SQL = """
SELECT s.dataset, s.severity, s.sensor_checks, s.sensor_drift_checks,
       round(s.sensor_drift_checks / s.sensor_checks, 6) AS sensor_drift_rate,
       b.batches, b.batches_with_drift, round(b.batches_with_drift / b.batches, 6) AS batch_drift_rate,
       b.batches_meeting_sensor_quorum
FROM (SELECT dataset, severity, count(*) AS sensor_checks,
             CAST(sum(CASE WHEN status = 'drift' THEN 1 ELSE 0 END) AS BIGINT) AS sensor_drift_checks
      FROM results GROUP BY ALL) s
JOIN (SELECT dataset, severity, count(DISTINCT batch) AS batches,
             CAST(sum(CASE WHEN drift_rate > 0 THEN 1 ELSE 0 END) AS BIGINT) AS batches_with_drift,
             CAST(sum(CASE WHEN drifted_sensor_checks >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS batches_meeting_sensor_quorum
      FROM rollup GROUP BY ALL) b USING (dataset, severity)"""


@register("drift_detection_summary", monitor_sql(_SUMMARY_SQL))
def drift_detection_summary(spark, sf):
    """D11/D15 flagship: per (dataset, severity) sensor and batch drift rates."""
    s = _run(spark, sf).summary
    return s.select("dataset", "severity", "sensor_checks", "sensor_drift_checks",
                    r6("sensor_drift_rate").alias("sensor_drift_rate"), "batches", "batches_with_drift",
                    r6("batch_drift_rate").alias("batch_drift_rate"), "batches_meeting_sensor_quorum")


@register("drift_sensitivity", monitor_sql(
    "SELECT dataset, severity, round(avg(drift_rate), 6) AS drift_rate FROM rollup GROUP BY ALL"))
def drift_sensitivity(spark, sf):
    """Unweighted mean of per-batch drift rates per severity."""
    r = D.sensitivity_by_severity(_run(spark, sf).rollup)
    return r.select("dataset", "severity", r6("drift_rate").alias("drift_rate"))


@register("drift_timeline", monitor_sql(
    "SELECT dataset, severity, batch, batch_id, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, "
    "round(drift_rate, 6) AS drift_rate, psi > 0.2 AS psi_above_threshold FROM rollup"))
def drift_timeline(spark, sf):
    """Per-batch timeline table against the 0.20 PSI line."""
    t = D.drift_timeline(_run(spark, sf).rollup)
    return t.select("dataset", "severity", "batch", "batch_id", r6("psi").alias("psi"),
                    r6("ks_statistic").alias("ks_statistic"), r6("drift_rate").alias("drift_rate"),
                    "psi_above_threshold")


@register("drift_shift", monitor_sql(
    "SELECT dataset, engine_id, cycle, sensor, severity, round(value, 6) AS value FROM shifted"))
def drift_shift(spark, sf):
    """Severity copies of the test split with keyed Gaussian noise."""
    s = _run(spark, sf).shifted
    return s.select("dataset", "engine_id", "cycle", "sensor", "severity", r6("value").alias("value"))


@register("drift_skipped_batches", monitor_sql(
    "SELECT dataset, severity, engine_id, batch_index, 'batch below minimum sample size' AS reason "
    "FROM flags WHERE checks = 0"))
def drift_skipped_batches(spark, sf):
    """Batches with no usable sensor (fewer than 5 non-null rows)."""
    s = _run(spark, sf).skipped
    return s.select("dataset", "severity", "engine_id", F.col("batch_index").cast("long").alias("batch_index"), "reason")
