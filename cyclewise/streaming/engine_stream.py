"""Structured Streaming (K1-K4).

* K1 ``stage_engine_stream`` writes telemetry as files of whole engines into
  a folder under the shared checkpoint directory; ``engine_stream`` reads it
  back with ``readStream`` (``maxFilesPerTrigger`` engines-files per batch).
* K2 ``stream_detect`` runs the batch detector on every micro-batch against a
  fixed reference model (``foreachBatch``); each epoch overwrites its own
  output folder, so a retried epoch is idempotent.
* K3 ``stream_gate`` decides in every micro-batch on the batches whose turn has
  come; those ahead of a gap wait. The state is one row a gate.
* K4 ``stream_rollup`` windowed per-engine aggregates with a watermark
  (tumbling, sliding or session windows).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise.operators import drift as D
from cyclewise.functions.scan import ordered_scan
from cyclewise.operators.gate import drift_gate, gate_state
from cyclewise.session import checkpoint_dir, stage


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location (never machine-local on a cluster)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def stage_engine_stream(df: DataFrame, path: str, files: int = 16, engine: str = "engine_id") -> str:
    """K1 source side: whole engines per file (an engine never spans files)."""
    df.repartition(files, engine).write.mode("overwrite").parquet(path)
    return path


def engine_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """K1: replay the staged files as a stream; error on missing key columns."""
    for c in ("engine_id", "cycle"):
        if c not in schema.fieldNames():
            raise ValueError(f"the stream has no column {c}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def engine_count(staged: DataFrame, engine: str = "engine_id") -> int:
    """K1: number of engines (batches) the replay will deliver."""
    return staged.select(engine).distinct().count()


def stream_detect(stream: DataFrame, ref, thresholds: DataFrame, positions: DataFrame, sink: str,
                  require_both: bool = True, checkpoint: str | None = None, run_ts=None,
                  flags_sink: str | None = None, severities=tuple(D.SEVERITY_MULTIPLIERS)):
    """K2: detect per arriving micro-batch (``foreachBatch``) against a fixed
    reference; results go to ``sink/epoch=<id>`` (a retried epoch overwrites
    its own folder). With ``flags_sink`` it also writes one row per
    (engine, severity) with its drifted-sensor count - skipped batches
    included with 0 - which is the input of the streaming gate (K3).
    Runs with ``availableNow`` and returns the finished query."""
    spark = stream.sparkSession
    sev = F.explode(F.array(*[F.lit(x) for x in severities])).alias("severity")

    def per_batch(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        tests = D.batch_tests(batch, ref).join(positions, ["dataset", "engine_id"])
        res = stage(D.detect(tests, thresholds, require_both, run_ts))
        res.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))
        if flags_sink:
            engines = batch.select("dataset", "engine_id").distinct().join(positions, ["dataset", "engine_id"])
            counts = res.groupBy("dataset", "severity", "engine_id").agg(
                F.sum((F.col("status") == "drift").cast("long")).alias("drifted_sensor_count"))
            flags = (engines.select("*", sev).join(counts, ["dataset", "severity", "engine_id"], "left")
                     .select("dataset", "severity", "engine_id", F.col("batch_index").cast("long"),
                             F.coalesce("drifted_sensor_count", F.lit(0).cast("long")).alias("drifted_sensor_count")))
            flags.write.mode("overwrite").parquet(os.path.join(flags_sink, f"epoch={epoch}"))

    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint or scratch(spark, "detect-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


GATE_KEYS = ["dataset", "severity"]
GATE_OUT = ("dataset string, severity string, batch_index long, drifted_sensor_count long, drift_detected boolean, "
            "consecutive_drift_batches long, retraining_episode_active boolean, action string")
GATE_STATE = ("dataset string, severity string, batch_index long, consecutive_drift_batches long, "
              "consecutive_stable_batches long, retraining_episode_active boolean")
GATE_WAITING = "dataset string, severity string, batch_index long, drifted_sensor_count long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def gate_step(arrived: DataFrame, state: DataFrame, required_batches: int = 3, required_sensors: int = 3,
              stable_reset: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the streaming gate: (decisions, state, waiting).

    ``arrived`` (GATE_WAITING) holds the counts not yet decided on, new and
    waiting ones alike; ``state`` (GATE_STATE) is one row a gate. A batch's turn
    has come when every index from the gate's last one up to it is there; a
    batch that was decided on before or comes twice counts once."""
    last = F.coalesce(F.col("_last"), F.lit(-1))
    fresh = (arrived.join(state.select(*GATE_KEYS, F.col("batch_index").alias("_last")), GATE_KEYS, "left")
             .filter(F.col("batch_index") > last).dropDuplicates([*GATE_KEYS, "batch_index"]))
    placed = stage(ordered_scan(stage(fresh), GATE_KEYS, ["batch_index"], out="_rn")
                   .withColumn("_turn", F.col("batch_index") == last + F.col("_rn")))
    due = placed.filter("_turn").select(*_names(GATE_WAITING))
    decided = stage(drift_gate(due, required_batches, required_sensors, stable_reset, GATE_KEYS, before=state))
    moved = gate_state(decided, GATE_KEYS)
    after = moved.unionByName(state.join(moved, GATE_KEYS, "left_anti")).select(*_names(GATE_STATE))
    return decided.select(*_names(GATE_OUT)), after, placed.filter("NOT _turn").select(*_names(GATE_WAITING))


def stream_gate(flags_stream: DataFrame, positions: DataFrame, required_batches: int = 3, required_sensors: int = 3,
                stable_reset: int = 2, severities=tuple(D.SEVERITY_MULTIPLIERS), out: str | None = None) -> DataFrame:
    """K3: drives the stream of batch counts to the end of its input and gives
    the gate's rows; equals D9.

    Every micro-batch writes its decisions to ``out/decisions/epoch=<id>`` as
    soon as the batches' turn has come, together with the state after it and
    the batches that wait for an earlier one, so both stay as small as the
    gaps. A retried micro-batch starts from the state of the one before and
    overwrites its own folders. Batches may come in any order and any number
    of them ahead of others. ``positions`` (dataset, batch_index) names the
    batches there are; one without a count at the end has a null count and is
    a skipped batch to the gate, and those that waited for it are decided on
    then. A last decisions folder, of the epoch after the last, holds these.
    ``out`` is a new folder."""
    spark = flags_stream.sparkSession
    out = out or scratch(spark, "gate")
    rules = (required_batches, required_sensors, stable_reset)
    epochs = [-1]

    def read(part: str, epoch: int, schema: str) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{out}/{part}/epoch={epoch}")

    def write(parts: tuple, epoch: int) -> None:
        for part, df in zip(("decisions", "state", "waiting"), parts):
            df.write.mode("overwrite").parquet(f"{out}/{part}/epoch={epoch}")

    def per_batch(batch: DataFrame, epoch: int) -> None:
        new = batch.select(*GATE_KEYS, F.col("batch_index").cast("long").alias("batch_index"),
                           F.col("drifted_sensor_count").cast("long").alias("drifted_sensor_count"))
        arrived = new.unionByName(read("waiting", epoch - 1, GATE_WAITING))
        write(gate_step(arrived, read("state", epoch - 1, GATE_STATE), *rules), epoch)
        epochs.append(epoch)

    q = (flags_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    done = epochs[-1]
    state, waiting = read("state", done, GATE_STATE), read("waiting", done, GATE_WAITING)
    sev = F.explode(F.array(*[F.lit(x) for x in severities])).alias("severity")
    known = positions.select("dataset", sev, F.col("batch_index").cast("long").alias("batch_index"))
    left = (known.join(state.select(*GATE_KEYS, F.col("batch_index").alias("_last")), GATE_KEYS, "left")
            .filter(F.col("batch_index") > F.coalesce("_last", F.lit(-1))).drop("_last")
            .join(waiting, [*GATE_KEYS, "batch_index"], "full").withColumn("missing", F.col("drifted_sensor_count").isNull())
            .withColumn("drifted_sensor_count", F.coalesce("drifted_sensor_count", F.lit(0).cast("long"))))
    rest = drift_gate(left, *rules, GATE_KEYS, before=state).withColumn(
        "drifted_sensor_count", F.when(~F.col("missing"), F.col("drifted_sensor_count")))
    rest.select(*_names(GATE_OUT)).write.mode("overwrite").parquet(f"{out}/decisions/epoch={done + 1}")
    return spark.read.schema(GATE_OUT).parquet(f"{out}/decisions").select(*_names(GATE_OUT))


def stream_rollup(stream: DataFrame, kind: str = "tumbling", duration: str = "1 hour", slide: str = "30 minutes",
                  watermark: str = "1 hour", ts: str = "ts", engine: str = "engine_id", value: str = "value") -> DataFrame:
    """K4: per-engine count / mean / max in event-time windows with a watermark.
    A TIMESTAMP_NTZ ``ts`` (which ``withWatermark`` rejects) is read as a UTC
    wall clock whatever the session time zone, so windows align to UTC."""
    et = F.col(ts).cast("timestamp")
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        et = F.to_utc_timestamp(et, session_tz(stream.sparkSession))
    s = stream.withColumn("_et", et).withWatermark("_et", watermark)
    if kind == "tumbling":
        w = F.window("_et", duration)
    elif kind == "sliding":
        w = F.window("_et", duration, slide)
    elif kind == "session":
        w = F.session_window("_et", duration)
    else:
        raise ValueError(f"unknown window kind {kind!r}")
    return (s.groupBy(w.alias("w"), engine).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                                F.max(value).alias("max"))
            .select(engine, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n", "mean", "max"))


def session_tz(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.session.timeZone")


def utc_text(c) -> F.Column:
    """Render an instant as its UTC wall clock, whatever the session time zone."""
    col = F.col(c) if isinstance(c, str) else c
    spark = SparkSession.getActiveSession()
    return F.date_format(F.from_utc_timestamp(col, session_tz(spark)), "yyyy-MM-dd HH:mm:ss")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a streaming query to completion (availableNow) into a parquet
    folder and return the result as a static DataFrame."""
    spark = df.sparkSession
    out = scratch(spark, name)
    q = (df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ckpt").outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def windows_to_table(df: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Drive a windowed aggregate to the end of its input (availableNow) and
    return every window, those still open then included. Each epoch overwrites
    its own folder, so a retried epoch is idempotent. ``update`` sends changed
    windows, of which the last state per ``keys`` counts; session windows,
    whose bounds move, need ``complete``, where the last epoch counts and the
    state keeps all sessions. An empty input gives an empty table."""
    spark = df.sparkSession
    out = scratch(spark, name)
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/epoch=-1")

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", out + "-ckpt").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.schema(T.StructType([*df.schema, T.StructField("epoch", T.LongType())])).parquet(out)
    if mode == "complete":
        last = got.agg(F.max("epoch")).first()[0]
        return got.filter(F.col("epoch") == last).drop("epoch")
    state = F.struct(*[c for c in df.columns if c not in keys])
    return got.groupBy(*keys).agg(F.max_by(state, "epoch").alias("s")).select(*keys, "s.*").select(*df.columns)
