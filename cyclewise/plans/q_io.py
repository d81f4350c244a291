"""Queries: sources and sinks (S1-S10) and positional truth (L2, S3).

Each query writes with the library's sink into a fresh folder of the shared
checkpoint location and reads it back with the matching source; the oracle
is the SQL of the data that was written, so a lossy round trip fails.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewise.functions.exprs import r6
from cyclewise.operators import regimes as R
from cyclewise.operators.drift import to_long
from cyclewise.operators.labels import attach_truth, engine_positions, with_rul
from cyclewise.plans import q_drift, q_regimes
from cyclewise.plans.catalog import ORACLE, register
from cyclewise.plans.monitor import monitor_input
from cyclewise.plans.oracle import with_fleets
from cyclewise.sources import io
from cyclewise.sources.tables import fleet
from cyclewise.streaming.engine_stream import scratch

RAW = ["engine_id", "cycle", "setting_1", "setting_2", "setting_3", "sensor_1", "sensor_2", "sensor_3", "sensor_4"]


@register("telemetry_text_roundtrip", with_fleets("lineitem")
          + "SELECT 'lineitem' AS dataset, 'all' AS split, " + ", ".join(RAW) + " FROM fleet_lineitem")
def telemetry_text_roundtrip(spark, sf):
    """Blank-separated headerless text written and parsed back with a declared schema."""
    path = scratch(spark, "raw-text")
    io.write_telemetry_text(fleet(spark, sf, "lineitem"), path, RAW)
    return io.read_telemetry(spark, path, "lineitem", "all", RAW)


_TRUTH = with_fleets("lineitem") + """
SELECT dataset, engine_id, CAST(row_number() OVER (PARTITION BY dataset ORDER BY engine_id) AS BIGINT) AS position,
       CAST(n - CAST(floor(n * 0.8) AS BIGINT) AS INTEGER) AS rul
FROM (SELECT dataset, engine_id, count(*) AS n FROM fleet_lineitem WHERE split = 'test' GROUP BY ALL)"""


@register("rul_truth_alignment", _TRUTH)
def rul_truth_alignment(spark, sf):
    """A truth file (line i = i-th smallest test engine) written,
    read back by position, checked against the engine count, attached."""
    test = fleet(spark, sf, "lineitem").filter("split = 'test'")
    n = test.groupBy("dataset", "engine_id").agg(F.count(F.lit(1)).alias("n"))
    truth = (engine_positions(test, ("dataset",)).join(n, ["dataset", "engine_id"])
             .select("dataset", "position", (F.col("n") - F.floor(F.col("n") * 0.8)).cast("int").alias("rul")))
    path = scratch(spark, "rul-truth")
    io.write_rul(truth, path)
    back = io.read_rul(spark, path, "lineitem")
    io.assert_rul_alignment(test, back)
    return attach_truth(test, back, required=True).select("dataset", "engine_id", "position", "rul")


@register("processed_roundtrip", with_fleets("lineitem", extra=(
    "lab AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) AS INTEGER) AS rul "
    "FROM fleet_lineitem)")) + "SELECT dataset, split, engine_id, cycle, rul, sensor_1, sensor_2, sensor_3, sensor_4 FROM lab")
def processed_roundtrip(spark, sf):
    """Processed split written partitioned by (dataset, split), read back pruned to one dataset."""
    path = scratch(spark, "processed")
    io.write_processed(with_rul(fleet(spark, sf, "lineitem")), path)
    back = io.read_processed(spark, path, "lineitem")
    return back.select("dataset", "split", "engine_id", "cycle", "rul", "sensor_1", "sensor_2", "sensor_3", "sensor_4")


@register("drift_results_sink", ORACLE["drift_results"])
def drift_results_sink(spark, sf):
    """Results appended severity by severity after a reset, read back."""
    run = q_drift._run(spark, sf)
    path = scratch(spark, "drift-results")
    sev = [r.severity for r in run.results.select("severity").distinct().collect()]
    for i, s in enumerate(sorted(sev)):
        io.append_rows(run.results.filter(F.col("severity") == s), path, reset=(i == 0))
    r = io.load_table(spark, path)
    return r.select(*q_drift._RESULT_COLS, *[r6(c).alias(c) for c in q_drift._RESULT_DBL])


@register("retraining_triggers_sink", ORACLE["drift_gate"])
def retraining_triggers_sink(spark, sf):
    """One JSON object per batch decision, appended, read back."""
    run = q_drift._run(spark, sf)
    path = scratch(spark, "triggers")
    io.append_rows(run.gate, path, fmt="json", reset=True)
    g = io.load_table(spark, path, "json", run.gate.schema)
    return g.select("dataset", "severity", "engine_id", "batch_id", F.col("batch_index").cast("long"),
                    "drifted_sensor_count", "drift_detected", "consecutive_drift_batches",
                    "retraining_episode_active", "action")


@register("reference_store_roundtrip", ORACLE["drift_reference_stats"])
def reference_store_roundtrip(spark, sf):
    """The whole reference published as one version, and its statistics auto-loaded."""
    from cyclewise.operators.drift import reference_or_fit
    path = scratch(spark, "reference")
    train = monitor_input(spark, sf).filter(F.col("split") == "train")
    reference_or_fit(spark, path, train)                # fitted and published
    s = reference_or_fit(spark, path, train.limit(0))[1]  # found there
    return s.select("dataset", "sensor", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@register("regime_params_roundtrip", ORACLE["regime_scaled_sensors"])
def regime_params_roundtrip(spark, sf):
    """Fitted per-regime scalers saved, loaded and applied; the sensor
    list is recovered from the saved parameters."""
    df = q_regimes.regime_frame(spark, sf)
    params = R.fit_regime_scalers(to_long(df.filter("split = 'train'"), q_regimes.SENS, ("dataset", "regime_id")))
    path = scratch(spark, "regime-params")
    io.save_table(params, path)
    loaded = io.load_table(spark, path)
    sensors = sorted(r.sensor for r in loaded.select("sensor").distinct().collect())
    out = R.apply_regime_scalers(df, loaded, sensors)
    return out.select("dataset", "split", "engine_id", "cycle", "regime_id", *[r6(s).alias(s) for s in sensors])


@register("report_csv_roundtrip", ORACLE["drift_detection_summary"])
def report_csv_roundtrip(spark, sf):
    """The detection summary as a CSV report with header, read back with its schema."""
    s = q_drift.drift_detection_summary(spark, sf)
    path = scratch(spark, "report")
    io.write_report(s, path)
    return io.read_report(spark, path, s.schema)
