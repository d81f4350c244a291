"""Causal temporal features per engine.

All features are trailing frames over ``cycle`` inside an engine. They run
over cycle chunks with a halo (``chunk_frames``) so a very long engine is cut
into many tasks, and all features share one window spec: one Exchange and
one Sort for the whole set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.functions.exprs import guarded_abs_corr
from cyclewise.functions.scan import DEFAULT_CHUNK, chunk_frames, drop_halo
from cyclewise.session import stage

KEYS = ["dataset", "engine_id"]


def add_temporal(df: DataFrame, sensors: Sequence[str], window: int = 5, second: bool = False,
                 keys=KEYS, cycle: str = "cycle", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """T3 diff1, T4 trailing mean, T5 trailing population std, T6 diff2.

    ``cycle`` must be dense 1..n per engine (the fleet views guarantee it).
    """
    halo = max(window - 1, 2 if second else 1)
    c = chunk_frames(df, cycle, halo, chunk, keys)
    w = Window.partitionBy(*keys, "_chunk").orderBy(cycle)
    roll = w.rowsBetween(-(window - 1), 0)
    cols = []
    for s in sensors:
        x = F.col(s)
        cols.append(F.coalesce(x - F.lag(x, 1).over(w), F.lit(0.0)).alias(f"{s}_diff1"))
        cols.append(F.avg(x).over(roll).alias(f"{s}_roll_mean{window}"))
        cols.append(F.coalesce(F.stddev_pop(x).over(roll), F.lit(0.0)).alias(f"{s}_roll_std{window}"))
        if second:
            d2 = x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
            cols.append(F.coalesce(d2, F.lit(0.0)).alias(f"{s}_diff2"))
    return drop_halo(c.select("*", *cols))


def sensor_rul_correlation(long_df: DataFrame, by: Sequence[str] = ("dataset",),
                           target: str = "rul") -> DataFrame:
    """|Pearson(sensor, RUL)| per (by..., sensor); zero variance -> 0.

    ``long_df`` is the melted table (by..., sensor, value, rul)."""
    return (long_df.groupBy(*by, "sensor")
            .agg(guarded_abs_corr("value", target).alias("abs_corr")))


def select_degradation_sensors(long_df: DataFrame, per_regime: int = 3, max_sensors: int = 6,
                               regime: str | None = "regime_id", order: str = "sensor_order",
                               target: str = "rul") -> DataFrame:
    """Top-n sensors by |corr| inside each regime (ties: column order),
    concatenated in regime order with first-seen dedupe, cut to max_sensors.
    Without regimes: the global ranking. Result has (dataset, sensor, pick)
    with pick = 1.. in selection order. Its size is regimes x sensors."""
    if regime is None:
        corr = long_df.groupBy("dataset", "sensor", order).agg(guarded_abs_corr("value", target).alias("abs_corr"))
        rk = Window.partitionBy("dataset").orderBy(F.desc("abs_corr"), order)
        return (corr.withColumn("pick", F.row_number().over(rk)).filter(F.col("pick") <= max_sensors)
                .select("dataset", "sensor", "pick"))
    corr = (long_df.groupBy("dataset", regime, "sensor", order)
            .agg(guarded_abs_corr("value", target).alias("abs_corr")))
    rk = Window.partitionBy("dataset", regime).orderBy(F.desc("abs_corr"), order)
    top = corr.withColumn("rk", F.row_number().over(rk)).filter(F.col("rk") <= per_regime)
    first = top.groupBy("dataset", "sensor").agg(F.min(F.struct(regime, "rk")).alias("first"))
    pick = Window.partitionBy("dataset").orderBy(F.col(f"first.{regime}"), F.col("first.rk"))
    return (first.withColumn("pick", F.row_number().over(pick)).filter(F.col("pick") <= max_sensors)
            .select("dataset", "sensor", "pick"))


def causality_audit(df: DataFrame, sensors: Sequence[str], window: int = 5, cut: float = 0.5,
                    keys=KEYS, cycle: str = "cycle", second: bool = False, tol: float = 1e-9) -> DataFrame:
    """Features computed on a truncated prefix of every engine must equal
    the features of the full series on those rows. Returns one row per
    (dataset, feature) with the number of violations (must be 0)."""
    n = df.groupBy(*keys).agg(F.max(cycle).alias("_n"))
    prefix = df.join(n, list(keys)).filter(F.col(cycle) <= F.ceil(F.col("_n") * cut)).drop("_n")
    full = add_temporal(df, sensors, window, second, keys, cycle)
    part = add_temporal(prefix, sensors, window, second, keys, cycle)
    feats = [c for c in full.columns if c not in df.columns]
    joined = part.select(*keys, cycle, *[F.col(f).alias(f"p_{f}") for f in feats]).join(
        full.select(*keys, cycle, *feats), [*keys, cycle])
    checks = [F.sum(F.when(~(F.abs(F.col(f) - F.col(f"p_{f}")) <= tol)
                           | (F.col(f).isNull() != F.col(f"p_{f}").isNull()), 1).otherwise(0)).alias(f)
              for f in feats]
    wide = joined.groupBy("dataset").agg(*checks)
    return wide.unpivot(["dataset"], feats, "feature", "violations")


def degradation_features(df: DataFrame, sensors: Sequence[str], target: str = "rul", top_n: int = 6,
                         window: int = 5, per_regime: int = 3, second: bool = False,
                         regime: str | None = "regime_id", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Select sensors on the train split (T2), then add T3-T6 of them on
    every row. Returns (frame, selection); the selection has (dataset, sensor,
    pick), at most ``top_n`` sensors a dataset. A feature is NULL in the rows
    of a dataset that did not pick its sensor; a dataset without training rows
    picks none and keeps its rows."""
    train = df.filter(F.col(split) == "train")
    ids = ["dataset", target] + ([regime] if regime else [])
    long = train.unpivot(ids, list(sensors), "sensor", "value").withColumn(
        "sensor_order", F.array_position(F.array(*[F.lit(s) for s in sensors]), F.col("sensor")) - 1)
    sel = stage(select_degradation_sensors(long, per_regime, min(top_n, len(sensors)), regime, target=target))
    chosen = {r.sensor for r in sel.select("sensor").distinct().collect()}  # names among ``sensors``
    picked = [s for s in sensors if s in chosen]
    own = sel.groupBy("dataset").agg(F.collect_set("sensor").alias("_picked"))
    feats = add_temporal(df, picked, window, second).join(own, "dataset", "left")
    names = ["diff1", f"roll_mean{window}", f"roll_std{window}"] + (["diff2"] if second else [])
    masked = {f"{s}_{n}": F.when(F.array_contains("_picked", s), F.col(f"{s}_{n}")) for s in picked for n in names}
    return feats.withColumns(masked).drop("_picked"), sel
