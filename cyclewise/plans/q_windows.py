"""Queries: windows (W1-W7), window scaler (Z4), splits.

Window features are integer-valued (props.k / quantity, RUL), so the
order-sensitive window checksum is exact in any summation order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewise.functions.exprs import r6
from cyclewise.operators import windows as W
from cyclewise.operators.labels import with_rul
from cyclewise.plans.catalog import register
from cyclewise.plans.oracle import with_fleets
from cyclewise.sources.tables import fleet

RUL = ("lab AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) AS INTEGER) AS rul, "
       "count(*) OVER (PARTITION BY dataset, engine_id) AS n FROM fleet_{n})")


def _summary(df):
    return df.select("dataset", "engine_id", "end_cycle", F.col("y").cast("int").alias("y"),
                     F.size("x").alias("steps"), F.size(W.flatten_window("x")).alias("flat_len"),
                     W.window_regime("x").alias("last_first"), W.window_checksum("x").alias("checksum"))


@register("sliding_windows_events", with_fleets("events", extra=RUL.format(n="events")) + """
SELECT dataset, engine_id, cycle AS end_cycle, rul AS y, 50 AS steps, 100 AS flat_len, CAST(sensor_2 AS DOUBLE) AS last_first,
       CAST((50 - cycle) * sg + scg AS DOUBLE) AS checksum
FROM (SELECT *, sum(sensor_2 + 2 * rul) OVER w AS sg, sum(cycle * (sensor_2 + 2 * rul)) OVER w AS scg FROM lab
      WINDOW w AS (PARTITION BY dataset, engine_id ORDER BY cycle ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
WHERE cycle >= 50 OR (n < 50 AND cycle = n)""")
def sliding_windows_events(spark, sf):
    """Every 50-step window (padded short engines), target RUL."""
    df = with_rul(fleet(spark, sf, "events"))
    return _summary(W.sliding_windows(df, ["sensor_2", "rul"], 50, 1))


@register("last_windows_parts", with_fleets("parts", extra=RUL.format(n="parts")) + """
SELECT dataset, engine_id, CAST(n AS INTEGER) AS end_cycle, any_value(CASE WHEN cycle = n THEN rul END) AS y, 50 AS steps, 100 AS flat_len,
       CAST(max(CASE WHEN cycle = n THEN sensor_1 END) AS DOUBLE) AS last_first,
       CAST(sum((50 - n + cycle) * (sensor_1 + 2 * rul)) AS DOUBLE) AS checksum
FROM lab WHERE cycle > n - 50 GROUP BY dataset, engine_id, n""")
def last_windows_parts(spark, sf):
    """The last 50 rows of each of 20k short engines, zero-padded in front."""
    df = with_rul(fleet(spark, sf, "parts"))
    return _summary(W.last_windows(df, ["sensor_1", "rul"], 50))


@register("truncated_windows_lineitem", with_fleets("lineitem", extra=RUL.format(n="lineitem")) + """,
ends AS (SELECT DISTINCT dataset, engine_id, c.cutoff, CAST(least(n, greatest(50, floor(n * c.cutoff))) AS INTEGER) AS e
         FROM lab, (VALUES (CAST('0.6' AS DOUBLE)), (CAST('0.7' AS DOUBLE)), (CAST('0.8' AS DOUBLE)),
                           (CAST('0.9' AS DOUBLE))) c(cutoff))
SELECT l.dataset, l.engine_id, e AS end_cycle, cutoff, any_value(CASE WHEN cycle = e THEN rul END) AS y, 50 AS steps,
       100 AS flat_len, CAST(max(CASE WHEN cycle = e THEN sensor_1 END) AS DOUBLE) AS last_first,
       CAST(sum((50 - e + cycle) * (sensor_1 + 2 * rul)) AS DOUBLE) AS checksum
FROM lab l JOIN ends USING (dataset, engine_id) WHERE cycle <= e AND cycle > e - 50
GROUP BY l.dataset, l.engine_id, e, cutoff""")
def truncated_windows_lineitem(spark, sf):
    """Last window of each engine truncated at 0.6/0.7/0.8/0.9 of its life."""
    df = with_rul(fleet(spark, sf, "lineitem"))
    t = W.truncated_windows(df, ["sensor_1", "rul"])
    return t.select("dataset", "engine_id", "end_cycle", "cutoff", F.col("y").cast("int").alias("y"),
                    F.size("x").alias("steps"), F.size(W.flatten_window("x")).alias("flat_len"),
                    W.window_regime("x").alias("last_first"), W.window_checksum("x").alias("checksum"))


@register("window_scaler_events", with_fleets("events", extra=RUL.format(n="events")) + """,
tr AS (SELECT * FROM lab WHERE split = 'train'),
ends AS (SELECT dataset, engine_id, cycle AS e, n FROM tr WHERE cycle >= 50 OR (n < 50 AND cycle = n)),
cells AS (SELECT t.dataset, f.feature, CASE f.feature WHEN 'sensor_1' THEN t.sensor_1 ELSE t.sensor_2 END AS v
          FROM tr t JOIN ends USING (dataset, engine_id), (VALUES ('sensor_1'), ('sensor_2')) f(feature)
          WHERE t.cycle <= ends.e AND t.cycle > ends.e - 50
          UNION ALL
          SELECT dataset, f.feature, 0.0 FROM ends, (VALUES ('sensor_1'), ('sensor_2')) f(feature), range(0, 50) r(i)
          WHERE n < 50 AND i < 50 - n)
SELECT dataset, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cells GROUP BY ALL""")
def window_scaler_events(spark, sf):
    """Scaler over flattened training windows via window multiplicities."""
    df = fleet(spark, sf, "events").filter("split = 'train'")
    s = W.window_scaler(df, ["sensor_1", "sensor_2"], 50, 1)
    return s.select("dataset", "feature", r6("mean").alias("mean"), r6("std").alias("std"))


@register("group_kfold_lineitem", with_fleets("lineitem") + """
SELECT dataset, engine_id, size, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold
FROM (SELECT dataset, engine_id, size, row_number() OVER (PARTITION BY dataset ORDER BY size DESC, engine_id) - 1 AS p
      FROM (SELECT dataset, engine_id, count(*) AS size FROM fleet_lineitem WHERE split = 'train' GROUP BY ALL))""")
def group_kfold_lineitem(spark, sf):
    """G1: 5 balanced engine folds of the training engines."""
    return W.group_kfold(fleet(spark, sf, "lineitem").filter("split = 'train'"), 5)


@register("group_holdout_events", with_fleets("events") + """
SELECT dataset, engine_id, p <= ceil(n * 0.2) AS holdout
FROM (SELECT dataset, engine_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || CAST(engine_id AS VARCHAR))) AS p,
             count(*) OVER (PARTITION BY dataset) AS n FROM (SELECT DISTINCT dataset, engine_id FROM fleet_events WHERE split = 'train'))""")
def group_holdout_events(spark, sf):
    """Hold out 20% of the training engines by a seeded hash order."""
    return W.group_holdout(fleet(spark, sf, "events").filter("split = 'train'"), 0.2, 42)
