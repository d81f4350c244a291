"""Fixed-length windows (W1-W7), the window-weighted scaler (Z4) and
engine-wise splits (G1, G2).

* W1 every-row sliding windows use a trailing frame of w rows over cycle
  chunks with a halo of w-1 rows, so a long engine is spread over tasks.
* W3/W4/W5 need one window per (engine, cutoff): rows meet the ends by
  (engine, chunk of cycles), and each chunk hands on the part of a window it
  holds. No task gets a whole engine, no group exceeds w rows.
* Z4 and the window counts use closed forms instead of materialising the
  50x-larger window tensor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.functions.columns import feature_columns  # noqa: F401  (P3, re-exported)
from cyclewise.functions.scan import DEFAULT_CHUNK, chunk_frames, drop_halo, ordered_scan

KEYS = ["dataset", "engine_id"]
# cycles an engine's rows are cut into to meet the ends of windows
TAIL_CHUNK = 10_000


def _chunk_of(cycle: Column, chunk: int) -> Column:
    return F.floor((cycle - 1) / F.lit(chunk)).cast("long")


def _pad(rows: Column, n: Column, w: int, width: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.when(n < w, F.concat(F.array_repeat(zeros, (F.lit(w) - n).cast("int")), rows)).otherwise(rows)


def sliding_windows(df: DataFrame, features: Sequence[str], w: int = 50, step: int = 1, target: str = "rul",
                    keys=KEYS, cycle: str = "cycle", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """W1 + W2: (keys..., end_cycle, y, x ARRAY<ARRAY<DOUBLE>>) with x of
    w time steps; an engine shorter than w gives one window, zeros in front."""
    lengths = df.groupBy(*keys).agg(F.max(cycle).alias("_n"))
    c = chunk_frames(df.join(lengths, list(keys)), cycle, w - 1, chunk, keys)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(cycle).rowsBetween(-(w - 1), 0)
    row = F.array(*[F.col(f).cast("double") for f in features])
    x = c.withColumn("x", F.collect_list(row).over(frame))
    x = drop_halo(x)
    ends = ((F.col(cycle) >= w) & (((F.col(cycle) - w) % step) == 0)) | ((F.col("_n") < w) & (F.col(cycle) == F.col("_n")))
    return x.filter(ends).select(*keys, F.col(cycle).alias("end_cycle"), F.col(target).alias("y"),
                                 _pad(F.col("x"), F.col("_n"), w, len(features)).alias("x"))


def windows_at(df: DataFrame, ends: DataFrame, features: Sequence[str], w: int = 50, target: str = "rul",
               keys=KEYS, cycle: str = "cycle", extra: Sequence[str] = (), chunk: int = TAIL_CHUNK) -> DataFrame:
    """One window per row of ``ends`` (keys..., end_cycle, extra...): the last
    w rows up to end_cycle, zero-padded in front. An end asks the chunks of
    ``chunk`` cycles that its window meets; rows of other chunks leave in the
    join. Each chunk gives its part of a window (at most w rows), and the
    parts are put together in cycle order."""
    keys = list(keys)
    rows = df.select(*keys, _chunk_of(F.col(cycle), chunk).alias("_chunk"),
                     F.struct(F.col(cycle).alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"),
                              F.col(target).alias("t")).alias("_r"))
    asks = ends.select(*keys, "end_cycle", *extra, F.explode(F.sequence(
        _chunk_of(F.greatest(F.col("end_cycle") - (w - 1), F.lit(1)), chunk),
        _chunk_of(F.col("end_cycle"), chunk))).alias("_chunk"))
    j = rows.join(asks, [*keys, "_chunk"]).filter(
        (F.col("_r.c") <= F.col("end_cycle")) & (F.col("_r.c") > F.col("end_cycle") - w))
    parts = j.groupBy(*keys, "_chunk", "end_cycle", *extra).agg(F.collect_list("_r").alias("_part"))
    g = parts.groupBy(*keys, "end_cycle", *extra).agg(
        F.sort_array(F.flatten(F.collect_list("_part"))).alias("_rs"))
    last = F.element_at("_rs", -1)
    y = F.when(last["c"] == F.col("end_cycle"), last["t"])
    body = F.transform("_rs", lambda r: r["v"])
    return g.select(*keys, "end_cycle", *extra, y.alias("y"), _pad(body, F.size("_rs"), w, len(features)).alias("x"))


def last_windows(df: DataFrame, features: Sequence[str], w: int = 50, target: str = "rul", keys=KEYS,
                 cycle: str = "cycle") -> DataFrame:
    """The last w rows of every engine (padded)."""
    ends = df.groupBy(*keys).agg(F.max(cycle).alias("end_cycle"))
    return windows_at(df, ends, features, w, target, keys, cycle)


def truncation_ends(df: DataFrame, cutoffs: Sequence[float], w: int = 50, keys=KEYS,
                    cycle: str = "cycle") -> DataFrame:
    """W4/W5 cut points: min(n, max(w, floor(n * f))) per engine and cutoff."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.explode(F.array(*[F.lit(float(f)) for f in cutoffs])).alias("cutoff")
    return n.select(*keys, cut, "_n").select(
        *keys, "cutoff", F.least(F.col("_n"), F.greatest(F.lit(w), F.floor(F.col("_n") * F.col("cutoff")))).cast("int")
        .alias("end_cycle"))


def truncated_windows(df: DataFrame, features: Sequence[str], cutoffs: Sequence[float] = (0.6, 0.7, 0.8, 0.9),
                      w: int = 50, target: str = "rul", keys=KEYS, cycle: str = "cycle") -> DataFrame:
    """W4 (one cutoff) / W5 (several): last window of each truncated engine,
    target = RUL at the cut."""
    ends = truncation_ends(df, cutoffs, w, keys, cycle)
    return windows_at(df, ends, features, w, target, keys, cycle, extra=("cutoff",))


def flatten_window(x: str | Column = "x") -> Column:
    """Time-major flatten (t0f0, t0f1, ..., t1f0, ...)."""
    return F.flatten(F.col(x) if isinstance(x, str) else x)


def window_regime(x: str | Column = "x", index: int = 0) -> Column:
    """Regime of the last time step (feature ``index`` of the last row)."""
    return F.element_at(F.element_at(F.col(x) if isinstance(x, str) else x, -1), index + 1)


def window_checksum(x: str | Column = "x") -> Column:
    """Order-sensitive fingerprint sum_t sum_f (t+1)(f+1) x[t][f] (tests/oracle)."""
    xs = F.col(x) if isinstance(x, str) else x
    per_t = F.transform(xs, lambda row, t: (t + 1) * F.aggregate(
        F.transform(row, lambda v, f: (f + 1) * v), F.lit(0.0), lambda a, b: a + b))
    return F.aggregate(per_t, F.lit(0.0), lambda a, b: a + b)


# ---------------------------------------------------------------- Z4

def window_multiplicity(r: Column, n: Column, w: int, step: int = 1) -> Column:
    """How many sliding windows contain 0-based row r of an engine of n >= w rows."""
    m = n - w
    hi = F.floor(F.least(r, m) / step)
    lo = F.ceil(F.greatest(F.lit(0), r - w + 1) / step)
    return (hi - lo + 1).cast("long")


def window_scaler(df: DataFrame, features: Sequence[str], w: int = 50, step: int = 1, keys=KEYS,
                  cycle: str = "cycle") -> DataFrame:
    """Mean / population std per feature over the flattened training
    windows, each row weighted by the windows containing it; an engine with
    n < w rows adds (w - n) zero rows. Returns (dataset, feature, mean, std)."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(n, keys)
    r = F.col(cycle) - 1
    mult = F.when(F.col("_n") < w, F.lit(1).cast("long")).otherwise(window_multiplicity(r, F.col("_n"), w, step))
    long = j.select("dataset", mult.alias("_m"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p"))
    pad = n.groupBy("dataset").agg(F.sum(F.when(F.col("_n") < w, F.lit(w) - F.col("_n")).otherwise(0)).alias("_z"))
    # two passes (mean, then squared deviations) for numerical stability;
    # each padding zero adds (0 - mean)^2
    flat = long.select("dataset", "_m", F.col("p.feature").alias("feature"), F.col("p.v").alias("v"))
    first = (flat.groupBy("dataset", "feature").agg(F.sum("_m").alias("_w"), F.sum(F.col("_m") * F.col("v")).alias("_s1"))
             .join(pad, "dataset").withColumn("_tot", F.col("_w") + F.col("_z"))
             .withColumn("mean", F.col("_s1") / F.col("_tot")))
    means = first.select("dataset", "feature", F.col("mean").alias("_mu"))   # features x datasets rows
    dev = (flat.join(F.broadcast(means), ["dataset", "feature"]).groupBy("dataset", "feature")
           .agg(F.sum(F.col("_m") * (F.col("v") - F.col("_mu")) * (F.col("v") - F.col("_mu"))).alias("_ss")))
    out = first.join(dev, ["dataset", "feature"])
    var = (F.col("_ss") + F.col("_z") * F.col("mean") * F.col("mean")) / F.col("_tot")
    return out.select("dataset", "feature", "mean", F.sqrt(var).alias("std"))


# ---------------------------------------------------------------- G1 / G2

def group_kfold(df: DataFrame, k: int = 5, keys=KEYS, size_col: str | None = None) -> DataFrame:
    """G1: balanced engine folds. Engines by (size desc, id) are dealt
    snake-wise over k folds; an engine is never in two folds."""
    keys = list(keys)
    sizes = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")) if size_col is None
             else df.select(*keys, F.col(size_col).alias("size")))
    ranked = ordered_scan(sizes.withColumn("_neg", -F.col("size")), keys[:-1], ["_neg", keys[-1]], out="_pos")
    p = F.col("_pos") - 1
    rnd, idx = F.floor(p / k), p % k
    fold = F.when(rnd % 2 == 0, idx).otherwise(F.lit(k - 1) - idx).cast("int")
    return ranked.select(*keys, "size", fold.alias("fold"))


def group_holdout(df: DataFrame, share: float, seed: int = 42, keys=KEYS) -> DataFrame:
    """Hold out ceil(share * n) engines, ordered by md5(seed || id)."""
    keys = list(keys)
    eng = df.select(*keys).distinct().withColumn(
        "_h", F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(keys[-1]).cast("string"))))
    ranked = ordered_scan(eng, keys[:-1], ["_h"], out="_pos")
    n = eng.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(n, keys[:-1]).select(
        *keys, (F.col("_pos") <= F.ceil(F.col("_n") * share)).alias("holdout"))
