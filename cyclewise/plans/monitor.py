"""The drift-monitoring sweep as one Spark job graph.

fit reference on the train split -> calibrate thresholds on train engines ->
shift the test engines once per severity -> PSI/KS per batch x sensor ->
detect -> gate per (dataset, severity) -> rollups and summary.
``dataset`` and ``severity`` are columns, so all sweeps run together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.operators import drift as D
from cyclewise.operators.gate import drift_gate
from cyclewise.operators.labels import engine_positions
from cyclewise.session import stage
from cyclewise.sources.tables import fleet

# sensors monitored per view: the constant events sensor is pruned (F1)
MONITOR_SENSORS = {
    "events": ["sensor_1", "sensor_2"],
    "lineitem": ["sensor_1", "sensor_2", "sensor_3", "sensor_4"],
}
NOISE_STD = 0.02
SEED = 42


@dataclass(eq=False)
class MonitorRun:
    """Results of one sweep; what derives from them is made when first asked for."""

    reference: tuple
    thresholds: DataFrame
    shifted: DataFrame
    positions: DataFrame
    results: DataFrame
    severities: tuple
    quorum: int

    @cached_property
    def _batches(self) -> DataFrame:
        """Every test engine is a batch of every severity, skipped ones included."""
        return self.positions.select("*", F.explode(F.array(*[F.lit(s) for s in self.severities])).alias("severity"))

    @cached_property
    def _per_batch(self) -> DataFrame:
        drifted = F.col("status") == "drift"
        return self.results.groupBy("dataset", "severity", "engine_id").agg(
            F.sum(drifted.cast("long")).alias("drifted_sensor_count"),
            F.sort_array(F.collect_set(F.when(drifted, F.col("sensor")))).alias("drifted_sensors"))

    @cached_property
    def gate(self) -> DataFrame:
        flags = (self._batches.join(self._per_batch, ["dataset", "severity", "engine_id"], "left")
                 .select("dataset", "severity", "engine_id", "batch_index", D.batch_id_col().alias("batch_id"),
                         F.coalesce("drifted_sensor_count", F.lit(0).cast("long")).alias("drifted_sensor_count"),
                         F.coalesce("drifted_sensors", F.array().cast("array<string>")).alias("drifted_sensors")))
        return drift_gate(flags, required_sensors=self.quorum)

    @cached_property
    def skipped(self) -> DataFrame:
        return (self._batches.join(self._per_batch, ["dataset", "severity", "engine_id"], "left_anti")
                .select("dataset", "severity", "engine_id", "batch_index",
                        F.lit("batch below minimum sample size").alias("reason")))

    @cached_property
    def rollup(self) -> DataFrame:
        return D.batch_rollup(self.results)

    @cached_property
    def summary(self) -> DataFrame:
        return D.detection_summary(self.results, self.rollup, self.quorum)

    @cached_property
    def decisions(self) -> DataFrame:
        return D.retraining_decision(self.results)


def monitor_input(spark: SparkSession, sf_dir: str, sensors: dict[str, list[str]] | None = None) -> DataFrame:
    sensors = sensors or MONITOR_SENSORS
    parts = [D.to_long(fleet(spark, sf_dir, name), cols) for name, cols in sensors.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def monitor(long_df: DataFrame, severities=tuple(D.SEVERITY_MULTIPLIERS), noise_std: float = NOISE_STD,
            seed: int = SEED, require_both: bool = True, quorum: int = 3) -> MonitorRun:
    cols = ["dataset", "engine_id", "cycle", "sensor", "value"]
    train = long_df.filter(F.col("split") == "train").select(*cols)
    test = long_df.filter(F.col("split") == "test").select(*cols)
    ref = D.reference_model(train)
    thresholds = D.calibrate(train, ref)
    shifted = D.what_if_shift(test, severities, noise_std, seed)
    pos = stage(engine_positions(test, ("dataset",))).select(
        "dataset", "engine_id", (F.col("position") - 1).alias("batch_index"))
    tests = D.batch_tests(shifted, ref).join(pos, ["dataset", "engine_id"])
    results = stage(D.detect(tests, thresholds, require_both))
    return MonitorRun(ref, thresholds, shifted, pos, results, tuple(severities), quorum)
