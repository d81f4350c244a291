"""Profiling / EDA (E1-E12), pruning (F1, F2) and global scaling.

All per-sensor loops of the reference become one aggregate with one
expression per sensor, or one pass over the melted (long) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise.functions.exprs import guarded_corr
from cyclewise.functions.scan import ordered_scan

KEYS = ["dataset", "engine_id"]


def validate_dataset(df: DataFrame, by: Sequence[str] = ("dataset", "split")) -> DataFrame:
    """Rows, columns, missing values, duplicate rows (n - distinct), engines."""
    by = list(by)
    data_cols = [c for c in df.columns if c not in by]
    nulls = sum((F.col(c).isNull().cast("long") for c in data_cols), F.lit(0).cast("long"))
    main = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("missing_values"),
                               F.count_distinct("engine_id").alias("engines"))
    distinct = df.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_distinct"))
    return (main.join(distinct, by).select(
        *by, "rows", F.lit(len(df.columns)).alias("columns"), "missing_values",
        (F.col("rows") - F.col("_distinct")).alias("duplicate_rows"), "engines"))


def dataset_summary(df: DataFrame, by: Sequence[str] = ("dataset", "split")) -> DataFrame:
    """Rows / columns / engines per split."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                               F.count_distinct("engine_id").alias("engines"))


def sensor_statistics(long_df: DataFrame, digits: int = 3) -> DataFrame:
    """Mean, sample std, min, max per sensor (rounded)."""
    return long_df.groupBy("dataset", "sensor").agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_samp("value"), digits).alias("std"),
        F.round(F.min("value"), digits).alias("min"), F.round(F.max("value"), digits).alias("max"))


def constant_sensor_report(long_df: DataFrame) -> DataFrame:
    """Exactly one distinct non-null value (all-null sensors are kept)."""
    return long_df.groupBy("dataset", "sensor").agg(
        ((F.count("value") > 0) & (F.min("value") == F.max("value"))).alias("constant"))


def low_variance_report(long_df: DataFrame, threshold: float = 0.01, digits: int | None = 5) -> DataFrame:
    """E5/F2: sample variance and a strict ``< threshold`` flag (NULL never flags)."""
    v = F.var_samp("value")
    out = long_df.groupBy("dataset", "sensor").agg(v.alias("variance"))
    out = out.withColumn("low_variance", F.coalesce(F.col("variance") < threshold, F.lit(False)))
    if digits is not None:
        out = out.withColumn("variance", F.round("variance", digits))
    return out


def sensors_to_drop(train_long: DataFrame, low_variance: float = 0.001) -> DataFrame:
    """F1 then F2, both fitted on train: (dataset, sensor, constant, variance, drop).
    F2 runs on what F1 kept; a constant sensor has variance 0 and is dropped
    by F1 first, which is why the two reports are separate columns."""
    c = constant_sensor_report(train_long)
    v = low_variance_report(train_long, low_variance, None)
    return c.join(v, ["dataset", "sensor"]).select(
        "dataset", "sensor", "constant", "variance",
        F.when(F.col("constant"), "constant").when(F.col("low_variance"), "low_variance").alias("dropped_as"))


def prune(df: DataFrame, drop: DataFrame) -> DataFrame:
    """Apply a drop list (a handful of names, collected) to any split."""
    names = [r.sensor for r in drop.filter(F.col("dropped_as").isNotNull()).select("sensor").distinct().collect()]
    return df.drop(*names)


def correlation_matrix(df: DataFrame, sensors: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Pairwise Pearson (pairwise-complete rows), NULL when undefined;
    one aggregate with s*(s-1)/2 expressions, mirrored to a full matrix."""
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i:]]
    aggs = [guarded_corr(a, b).alias(f"{a}__{b}") for a, b in pairs]
    wide = df.groupBy(*by).agg(*aggs)
    rows = []
    for a, b in pairs:
        rows.append(F.struct(F.lit(a).alias("sensor_a"), F.lit(b).alias("sensor_b"), F.col(f"{a}__{b}").alias("corr")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("sensor_a"), F.lit(a).alias("sensor_b"), F.col(f"{a}__{b}").alias("corr")))
    return wide.select(*by, F.explode(F.array(*rows)).alias("p")).select(*by, "p.*")


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Equal-width counts between min and max (last bin closed)."""
    by = list(by)
    rng = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    return (df.filter(F.col(col).isNotNull()).join(F.broadcast(rng), by).withColumn("bin", b)
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"),
                                     F.first("_lo").alias("lo"), F.first("_hi").alias("hi")))


def engine_lengths(df: DataFrame, keys=KEYS, cycle: str = "cycle") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(cycle).alias("length"))


def representative_engines(df: DataFrame) -> DataFrame:
    """Shortest, middle (index n div 2) and longest engine by life, ties by id."""
    lengths = engine_lengths(df)
    ranked = ordered_scan(lengths, ["dataset"], ["length", "engine_id"], out="rank")
    n = lengths.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    picks = ranked.join(F.broadcast(n), "dataset")
    return picks.select("dataset", "engine_id", "length", F.explode(F.array_compact(F.array(
        F.when(F.col("rank") == 1, F.lit("shortest")),
        F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.lit("middle")),
        F.when(F.col("rank") == F.col("n"), F.lit("longest"))))).alias("role"))


def engine_trends(df: DataFrame, sensors: Sequence[str], with_rul: str | None = "rul") -> DataFrame:
    """The cycle-ordered curves of the E8 engines (semi join on 3 ids per dataset)."""
    reps = representative_engines(df)
    cols = ["dataset", "engine_id", "cycle", *sensors] + ([with_rul] if with_rul else [])
    return df.join(F.broadcast(reps.select("dataset", "engine_id", "role")), ["dataset", "engine_id"]).select(
        "role", *cols)


def window_count(n: F.Column, w: int, step: int = 1) -> F.Column:
    """Number of sliding windows of an engine of n rows (short engines: one padded)."""
    return F.when(n < w, F.lit(1)).otherwise(F.floor((n - w) / step) + 1).cast("long")


def data_summary(df: DataFrame, sensors: Sequence[str], settings: Sequence[str], w: int = 50,
                 step: int = 1) -> DataFrame:
    """Engines, sensors, settings, window size, rows and windows per (dataset, split),
    window counts in closed form without building windows."""
    lengths = df.groupBy("dataset", "split", "engine_id").agg(F.count(F.lit(1)).alias("n"))
    return lengths.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("engines"), F.lit(len(sensors)).alias("sensors"),
        F.lit(len(settings)).alias("settings"), F.lit(w).alias("window_size"),
        F.sum("n").alias("rows"), F.sum(window_count(F.col("n"), w, step)).alias("windows"))


def distinct_operating_conditions(df: DataFrame, settings: Sequence[str], by=("dataset",)) -> DataFrame:
    """Distinct settings triples; more than one enables regime clustering."""
    return df.groupBy(*by).agg(F.count_distinct(F.struct(*settings)).alias("operating_conditions")).withColumn(
        "clustering_enabled", F.col("operating_conditions") > 1)


def take_engines(df: DataFrame, n: int, keys=("dataset",), engine: str = "engine_id") -> DataFrame:
    """P5: all rows of the first n engines in id order (the --max-engines feature)."""
    pos = ordered_scan(df.select(*keys, engine).distinct(), list(keys), [engine], out="_pos")
    return df.join(pos.filter(F.col("_pos") <= n).select(*keys, engine), [*keys, engine], "left_semi")


# ---------------------------------------------------------------- Z1 / Z2

def fit_global_zscore(train_long: DataFrame) -> DataFrame:
    """Z1 fit: population mean / std per sensor on train only."""
    return train_long.groupBy("dataset", "sensor").agg(F.avg("value").alias("mean"),
                                                       F.stddev_pop("value").alias("std"))


def apply_zscore(df: DataFrame, params: DataFrame, sensors: Sequence[str], by=("dataset",)) -> DataFrame:
    """Z1 apply: (x - mean) / std, zero std divides by 1 (scikit-learn's
    StandardScaler behaviour). ``params`` is sensors-sized and broadcast as
    one wide row per ``by`` group."""
    by = list(by)
    wide = params.groupBy(*by).agg(*[F.max(F.when(F.col("sensor") == s, F.struct("mean", "std"))).alias(f"_p_{s}")
                                     for s in sensors])
    j = df.join(F.broadcast(wide), by)
    for s in sensors:
        std = F.col(f"_p_{s}.std")
        j = j.withColumn(s, (F.col(s) - F.col(f"_p_{s}.mean"))
                         / F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std))
    return j.drop(*[f"_p_{s}" for s in sensors])


def zscore_report(scaled_long: DataFrame) -> DataFrame:
    """Max |mean| and max |std - 1| over sensors after scaling train."""
    per = scaled_long.groupBy("dataset", "sensor").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return per.groupBy("dataset").agg(F.count(F.lit(1)).alias("sensors"),
                                      F.max(F.abs("m")).alias("max_abs_mean"),
                                      F.max(F.abs(F.col("s") - 1)).alias("max_std_error"))
