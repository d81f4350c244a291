"""Queries: profiling (E1-E12, P4, P5), pruning (F1, F2), global scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewise.functions.exprs import r6
from cyclewise.operators import profile as P
from cyclewise.operators.drift import to_long
from cyclewise.operators.labels import with_rul
from cyclewise.plans.catalog import register
from cyclewise.plans.oracle import SENSORS_SQL, long_sql, with_fleets
from cyclewise.sources.tables import SENSORS, SETTINGS, fleet

ALL = ("events", "lineitem")


def _union_sql(body_for, names=ALL):
    return " UNION ALL ".join(f"({body_for(n)})" for n in names)


def _both(spark, sf, fn, names=ALL):
    out = None
    for n in names:
        part = fn(fleet(spark, sf, n), n)
        out = part if out is None else out.unionByName(part)
    return out


def _long(df, n, ids=("dataset", "split", "engine_id", "cycle")):
    return to_long(df, SENSORS[n], ids)


# E1
def _e1_sql(n):
    cols = ["dataset", "split", "engine_id", "cycle", *SETTINGS, "regime_key", *SENSORS_SQL[n]]
    data = [c for c in cols if c not in ("dataset", "split")]
    nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in data)
    return (f"SELECT a.dataset, a.split, a.rows, {len(cols)} AS columns, a.missing_values, "
            f"a.rows - b.d AS duplicate_rows, a.engines FROM (SELECT dataset, split, count(*) AS rows, "
            f"CAST(sum({nulls}) AS BIGINT) AS missing_values, count(DISTINCT engine_id) AS engines FROM fleet_{n} "
            f"GROUP BY ALL) a JOIN (SELECT dataset, split, count(*) AS d FROM (SELECT DISTINCT * FROM fleet_{n}) "
            f"GROUP BY ALL) b USING (dataset, split)")


@register("validate_dataset", with_fleets(*ALL) + _union_sql(_e1_sql))
def validate_dataset(spark, sf):
    """Rows, columns, nulls, duplicate rows and engines per split."""
    return _both(spark, sf, lambda df, n: P.validate_dataset(df))


@register("dataset_summary", with_fleets(*ALL) + _union_sql(
    lambda n: f"SELECT dataset, split, count(*) AS rows, {8 + len(SENSORS_SQL[n])} AS columns, "
              f"count(DISTINCT engine_id) AS engines FROM fleet_{n} GROUP BY ALL"))
def dataset_summary(spark, sf):
    """Rows, columns, engines per split."""
    return _both(spark, sf, lambda df, n: P.dataset_summary(df))


def _long_train_sql(n):
    return f"SELECT * FROM ({long_sql(n)}) WHERE split = 'train'"


@register("sensor_statistics", with_fleets(*ALL) + _union_sql(
    lambda n: f"SELECT dataset, sensor, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, "
              f"round(min(value), 3) AS min, round(max(value), 3) AS max FROM ({_long_train_sql(n)}) GROUP BY ALL"))
def sensor_statistics(spark, sf):
    """E3 (+P4 melt): mean, std (ddof 1), min, max per sensor on train."""
    return _both(spark, sf, lambda df, n: P.sensor_statistics(_long(df.filter("split = 'train'"), n)))


@register("constant_sensors", with_fleets(*ALL) + _union_sql(
    lambda n: f"SELECT dataset, sensor, count(value) > 0 AND min(value) = max(value) AS constant "
              f"FROM ({_long_train_sql(n)}) GROUP BY ALL"))
def constant_sensors(spark, sf):
    """One distinct non-null value on train."""
    return _both(spark, sf, lambda df, n: P.constant_sensor_report(_long(df.filter("split = 'train'"), n)))


@register("low_variance_sensors", with_fleets(*ALL) + _union_sql(
    lambda n: f"SELECT dataset, sensor, round(var_samp(value), 5) AS variance, "
              f"coalesce(var_samp(value) < 0.01, false) AS low_variance FROM ({_long_train_sql(n)}) GROUP BY ALL"))
def low_variance_sensors(spark, sf):
    """E5: sample variance and the < 0.01 flag of the EDA report."""
    return _both(spark, sf, lambda df, n: P.low_variance_report(_long(df.filter("split = 'train'"), n)))


@register("prune_sensors", with_fleets(*ALL) + _union_sql(
    lambda n: f"SELECT dataset, sensor, constant, round(variance, 3) AS variance, CASE WHEN constant THEN 'constant' "
              f"WHEN variance < 0.001 THEN 'low_variance' END AS dropped_as FROM (SELECT dataset, sensor, "
              f"count(value) > 0 AND min(value) = max(value) AS constant, var_samp(value) AS variance "
              f"FROM ({_long_train_sql(n)}) GROUP BY ALL)"))
def prune_sensors(spark, sf):
    """F1 + F2: train-fitted drop list (constant, then variance < 0.001)."""
    def one(df, n):
        d = P.sensors_to_drop(_long(df.filter("split = 'train'"), n))
        return d.select("dataset", "sensor", "constant", F.round("variance", 3).alias("variance"), "dropped_as")
    return _both(spark, sf, one)


def _pruned_sql(n):
    return (f"SELECT l.dataset, split, engine_id, cycle, l.sensor, value FROM ({long_sql(n)}) l JOIN (SELECT dataset, sensor, "
            f"count(value) > 0 AND min(value) = max(value) AS constant, var_samp(value) AS variance "
            f"FROM ({_long_train_sql(n)}) GROUP BY ALL) d ON d.dataset = l.dataset AND d.sensor = l.sensor "
            f"WHERE NOT constant AND NOT coalesce(variance < 0.001, false)")


@register("pruned_readings", with_fleets(*ALL) + _union_sql(_pruned_sql))
def pruned_readings(spark, sf):
    """F1 + F2: both splits without the sensors that the train split calls constant or of low variance."""
    def one(df, n):
        kept = P.prune(df, P.sensors_to_drop(_long(df.filter("split = 'train'"), n)))
        return to_long(kept, [s for s in SENSORS[n] if s in kept.columns])
    return _both(spark, sf, one)


def _corr_sql(n):
    s = SENSORS_SQL[n]
    parts = []
    for i, a in enumerate(s):
        for b in s:
            parts.append(
                f"SELECT dataset, '{a}' AS sensor_a, '{b}' AS sensor_b, round(CASE WHEN stddev_pop(x) * stddev_pop(y) = 0 "
                f"THEN NULL ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS corr FROM "
                f"(SELECT dataset, CASE WHEN {b} IS NOT NULL THEN {a} END AS x, CASE WHEN {a} IS NOT NULL THEN {b} END AS y "
                f"FROM fleet_{n}) GROUP BY dataset")
    return " UNION ALL ".join(parts)


@register("correlation_matrix", with_fleets(*ALL) + _union_sql(_corr_sql))
def correlation_matrix(spark, sf):
    """Pairwise Pearson, NULL on zero variance (no ANSI divide error)."""
    return _both(spark, sf, lambda df, n: P.correlation_matrix(df, SENSORS[n]).select(
        "dataset", "sensor_a", "sensor_b", r6("corr").alias("corr")))


RUL_CTE = ("lab_{n} AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) "
           "AS INTEGER) AS rul FROM fleet_{n})")


@register("rul_histogram", with_fleets(*ALL, extra=", ".join(RUL_CTE.format(n=n) for n in ALL)) + _union_sql(
    lambda n: f"SELECT dataset, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((rul - lo) / (hi - lo) * 30), 29) END "
              f"AS INTEGER) AS bin, count(*) AS count, any_value(lo) AS lo, any_value(hi) AS hi FROM lab_{n} JOIN "
              f"(SELECT dataset, min(rul) AS lo, max(rul) AS hi FROM lab_{n} WHERE split = 'train' GROUP BY ALL) "
              f"USING (dataset) WHERE split = 'train' GROUP BY ALL"))
def rul_histogram(spark, sf):
    """30 equal-width RUL bins on train."""
    return _both(spark, sf, lambda df, n: P.histogram(with_rul(df.filter("split = 'train'")), "rul"))


_REPS = ("SELECT dataset, engine_id, length, role FROM (SELECT dataset, engine_id, length, "
         "row_number() OVER (PARTITION BY dataset ORDER BY length, engine_id) AS rank, count(*) OVER (PARTITION BY dataset) AS n "
         "FROM (SELECT dataset, engine_id, max(cycle) AS length FROM fleet_{n} GROUP BY ALL)) "
         "JOIN (VALUES ('shortest'), ('middle'), ('longest')) r(role) ON (role = 'shortest' AND rank = 1) "
         "OR (role = 'middle' AND rank = n // 2 + 1) OR (role = 'longest' AND rank = n)")


@register("representative_engines", with_fleets(*ALL) + _union_sql(lambda n: _REPS.format(n=n)))
def representative_engines(spark, sf):
    """Shortest, middle and longest engine."""
    return _both(spark, sf, lambda df, n: P.representative_engines(df))


@register("engine_trends", with_fleets("lineitem", extra=RUL_CTE.format(n="lineitem"))
          + "SELECT r.role, l.dataset, l.engine_id, l.cycle, l.sensor_1, l.sensor_2, l.sensor_3, l.sensor_4, l.rul "
            "FROM lab_lineitem l JOIN (" + _REPS.format(n="lineitem") + ") r USING (dataset, engine_id)")
def engine_trends(spark, sf):
    """Sensor and RUL curves of the representative engines."""
    return P.engine_trends(with_rul(fleet(spark, sf, "lineitem")), SENSORS["lineitem"])


@register("data_summary", with_fleets(*ALL, "parts") + _union_sql(
    lambda n: f"SELECT dataset, split, count(*) AS engines, {len(SENSORS_SQL[n])} AS sensors, 3 AS settings, "
              f"50 AS window_size, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n < 50 THEN 1 "
              f"ELSE (n - 50) // 1 + 1 END) AS BIGINT) AS windows FROM (SELECT dataset, split, engine_id, count(*) AS n "
              f"FROM fleet_{n} GROUP BY ALL) GROUP BY ALL", ALL + ("parts",)))
def data_summary(spark, sf):
    """Engines, rows and closed-form window counts (w=50, step 1)."""
    return _both(spark, sf, lambda df, n: P.data_summary(df, SENSORS[n], SETTINGS), ALL + ("parts",))


@register("operating_conditions", with_fleets(*ALL) + _union_sql(
    lambda n: f"SELECT dataset, count(DISTINCT (setting_1, setting_2, setting_3)) AS operating_conditions, "
              f"count(DISTINCT (setting_1, setting_2, setting_3)) > 1 AS clustering_enabled FROM fleet_{n} GROUP BY ALL"))
def operating_conditions(spark, sf):
    """Distinct settings triples."""
    return _both(spark, sf, lambda df, n: P.distinct_operating_conditions(df, SETTINGS))


@register("take_engines", with_fleets("lineitem")
          + "SELECT f.dataset, f.engine_id, f.cycle, f.sensor_1 FROM fleet_lineitem f JOIN (SELECT DISTINCT engine_id "
            "FROM fleet_lineitem ORDER BY engine_id LIMIT 10) USING (engine_id)")
def take_engines(spark, sf):
    """P5: the --max-engines feature: every row of the first 10 engines."""
    return P.take_engines(fleet(spark, sf, "lineitem"), 10).select("dataset", "engine_id", "cycle", "sensor_1")


def _z_sql(n):
    s = SENSORS_SQL[n]
    sel = ", ".join(f"round(({c} - p.m_{c}) / CASE WHEN p.s_{c} IS NULL OR p.s_{c} = 0 THEN 1.0 ELSE p.s_{c} END, 6) AS {c}"
                    for c in s)
    par = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in s)
    return (f"SELECT f.dataset, f.split, f.engine_id, f.cycle, {sel} FROM fleet_{n} f JOIN "
            f"(SELECT dataset, {par} FROM fleet_{n} WHERE split = 'train' GROUP BY ALL) p USING (dataset)")


@register("global_zscore", with_fleets("lineitem") + _z_sql("lineitem"))
def global_zscore(spark, sf):
    """Train-fitted population z-score applied to both splits."""
    def one(df, n):
        params = P.fit_global_zscore(_long(df.filter("split = 'train'"), n))
        z = P.apply_zscore(df, params, SENSORS[n])
        return z.select("dataset", "split", "engine_id", "cycle", *[r6(c).alias(c) for c in SENSORS[n]])
    return _both(spark, sf, one, ("lineitem",))


def _zr_sql(n):
    s = SENSORS_SQL[n]
    lng = " UNION ALL ".join(f"SELECT dataset, '{c}' AS sensor, {c} AS v FROM z" for c in s)
    zsel = ", ".join(f"({c} - p.m_{c}) / CASE WHEN p.s_{c} IS NULL OR p.s_{c} = 0 THEN 1.0 ELSE p.s_{c} END AS {c}"
                     for c in s)
    par = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in s)
    return (f"WITH z AS (SELECT f.dataset, {zsel} FROM fleet_{n} f JOIN (SELECT dataset, {par} FROM fleet_{n} "
            f"WHERE split = 'train' GROUP BY ALL) p USING (dataset) WHERE f.split = 'train') "
            f"SELECT dataset, count(*) AS sensors, round(max(abs(m)), 6) AS max_abs_mean, "
            f"round(max(abs(s - 1)), 6) AS max_std_error FROM (SELECT dataset, sensor, avg(v) AS m, "
            f"stddev_pop(v) AS s FROM ({lng}) GROUP BY ALL) GROUP BY ALL")


@register("zscore_report", with_fleets(*ALL) + _union_sql(_zr_sql))
def zscore_report(spark, sf):
    """Max |mean| and max |std - 1| of the scaled train split."""
    def one(df, n):
        tr = df.filter("split = 'train'")
        params = P.fit_global_zscore(_long(tr, n))
        z = P.apply_zscore(tr, params, SENSORS[n])
        r = P.zscore_report(_long(z, n))
        return r.select("dataset", "sensors", r6("max_abs_mean").alias("max_abs_mean"),
                        r6("max_std_error").alias("max_std_error"))
    return _both(spark, sf, one)
