"""Drift monitoring as Spark jobs.

Data model (long form): reference rows ``(dataset, sensor, value)`` and batch
rows ``(dataset, severity, engine_id, sensor, value)``; a batch is one engine.

* D1 reference = ECDF of distinct values with prefix counts (``ordered_scan``,
  never a window over a whole sensor) plus n / mean / population std.
* D2 PSI edges = exact linear-interpolated deciles read off the ECDF ranks.
* D3 PSI with empty bins in closed form: bins a batch does not touch add a
  per-sensor constant, so no batch x bin expansion is needed.
* D4 KS statistic = max over batch points of |F_ref - F_b| at x and x-;
  bounds by bucket leave the few points that can be it, F_ref is looked up
  in the ECDF's buckets for those; p-value from ``ks_pvalue``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.sources import snapshots
from cyclewise.functions.exprs import count_le_small
from cyclewise.functions.ks import ks_pvalue
from cyclewise.functions.scan import ordered_scan
from cyclewise.session import stage

# fixed values of the reference detector and generator
PSI_BINS = 10
PSI_EPS = 1e-6
PSI_THRESHOLD = 0.20
KS_PVALUE = 0.05
CALIBRATION_QUANTILE = 0.995
MIN_BATCH_ROWS = 5
SMALL_BATCH_ROWS = 20
# reference rows a bucket of the ECDF stands for, and the bound of a sensor's bucket directory
BUCKET_ROWS = 100_000
MAX_BUCKETS = 4096
# distinct batch points looked up in one copy of a bucket
BUCKET_POINTS = 200_000
SEVERITY_MULTIPLIERS = {"normal": 1.00, "small": 1.05, "medium": 1.15, "severe": 1.30}

REF = ["dataset", "sensor"]
BATCH = ["dataset", "severity", "engine_id", "sensor"]


def to_long(df: DataFrame, sensors: Sequence[str],
            ids: Sequence[str] = ("dataset", "split", "engine_id", "cycle")) -> DataFrame:
    """Wide -> long, one row per (row, sensor); one pass for all sensors."""
    return df.unpivot(list(ids), list(sensors), "sensor", "value")


# ---------------------------------------------------------------- D1 / D2

def fit_reference(ref_long: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Returns (ecdf, stats).

    ecdf  = (dataset, sensor, value, cnt, cum_le, bucket)  distinct non-null values
    stats = (dataset, sensor, n, mean, std, starts, buckets)  population std

    A bucket holds the values that begin within one of a sensor's equal shares
    of reference rows, at most ``MAX_BUCKETS`` of them. ``starts`` has the first
    value of every bucket that is not empty, ``buckets`` their numbers."""
    vals = ref_long.filter(F.col("value").isNotNull())
    counts = stage(vals.groupBy(*REF, "value").agg(F.count(F.lit(1)).alias("cnt")))
    moments = stage(vals.groupBy(*REF).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                           F.stddev_pop("value").alias("std")))
    shares = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / bucket_rows)).cast("long")
    ranked = ordered_scan(counts, REF, ["value"], weight="cnt", out="cum_le")
    ecdf = stage(ranked.join(moments.select(*REF, "n", shares.alias("_k")), REF).select(
        *REF, "value", "cnt", "cum_le",
        F.floor((F.col("cum_le") - F.col("cnt")) * F.col("_k") / F.col("n")).cast("int").alias("bucket")))
    first = ecdf.groupBy(*REF, "bucket").agg(F.min("value").alias("start"))
    directory = first.groupBy(*REF).agg(F.sort_array(F.collect_list(F.struct("start", "bucket"))).alias("_d"))
    stats = stage(moments.join(directory, REF).select(
        *moments.columns, F.col("_d.start").alias("starts"), F.col("_d.bucket").alias("buckets")))
    return ecdf, stats


def _bucket_numbers(stats: DataFrame):
    """The sensors' bucket directory as (numbers, at): ``numbers`` has (dataset,
    sensor, _first), ``at(dataset, sensor, value)`` is ``_first`` plus the last
    bucket that starts at or below the value (the first one below all starts),
    null for a sensor without a directory. At most ``MAX_BUCKETS`` starts a
    sensor are carried to the tasks, so no row holds a copy of them."""
    found = stats.select(*REF, F.col("starts").cast("array<double>").alias("starts"), "buckets").collect()
    index = {(r[0], r[1]): (np.array(r.starts, dtype=float), np.array(r.buckets, dtype=np.int64) + i * MAX_BUCKETS)
             for i, r in enumerate(found)}
    numbers = stats.sparkSession.createDataFrame([(r[0], r[1], i * MAX_BUCKETS) for i, r in enumerate(found)],
                                                 "dataset string, sensor string, _first long")

    @F.arrow_udf("long")
    def at(dataset: pa.Array, sensor: pa.Array, value: pa.Array) -> pa.Array:
        names = [c.dictionary_encode() for c in (dataset, sensor)]
        code = [np.asarray(c.indices.fill_null(len(c.dictionary))) for c in names]
        x = np.asarray(value)
        out = np.full(len(x), -1, dtype=np.int64)
        for i, d in enumerate(names[0].dictionary.to_pylist()):
            for j, s in enumerate(names[1].dictionary.to_pylist()):
                if (d, s) in index:
                    starts, buckets = index[d, s]
                    mine = np.flatnonzero((code[0] == i) & (code[1] == j))
                    out[mine] = buckets[np.maximum(np.searchsorted(starts, x[mine], side="right") - 1, 0)]
        return pa.array(out, mask=out < 0)

    return numbers, at


def reference_ranks(points: DataFrame, ecdf: DataFrame, stats: DataFrame,
                    bucket_points: int = BUCKET_POINTS, counted: DataFrame | None = None) -> DataFrame:
    """``points`` (dataset, sensor, value not null, any other columns) with the
    reference rows at most (``le``) and below (``lt``) each row's value.

    A row goes to the last bucket that starts at or below its value and takes
    the counts of the greatest reference value there that is not above it;
    below the first bucket both are 0. Only buckets with rows are shuffled, and
    nothing of the reference is written. A bucket with many rows (a sensor with
    few values, batches beyond the reference's range) is copied once per
    ``bucket_points`` of them, and the rows are dealt to the copies by their hash.
    ``counted`` has the same rows where ``points`` are dear to make twice."""
    numbers, at = _bucket_numbers(stats)

    def locate(df):
        slot = at("dataset", "sensor", F.col("value").cast("double"))
        return df.withColumn("_slot", slot).filter(F.col("_slot").isNotNull())

    located = locate(points)
    copies = F.ceil(F.count(F.lit(1)) / bucket_points).cast("int")
    # one row a bucket, at most MAX_BUCKETS a sensor
    touched = F.broadcast(locate(points if counted is None else counted).groupBy("_slot").agg(copies.alias("_copies")))
    rest = [c for c in points.columns if c != "value"]
    asked = located.join(touched, "_slot").select(
        "_slot", F.pmod(F.xxhash64(*points.columns), F.col("_copies")).cast("int").alias("_copy"), "value",
        F.struct(*rest).alias("_row"), F.lit(None).cast("struct<value:double,cnt:bigint,cum_le:bigint>").alias("_ref"))
    held = ecdf.join(numbers, REF).withColumn("_slot", F.col("_first") + F.col("bucket")).join(touched, "_slot").select(
        "_slot", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), "value",
        F.struct(F.col("value").cast("double").alias("value"), "cnt", "cum_le").alias("_ref"))
    upto = (Window.partitionBy("_slot", "_copy").orderBy("value", F.col("_ref").isNull())
            .rowsBetween(Window.unboundedPreceding, 0))
    found = (held.unionByName(asked, allowMissingColumns=True)
             .withColumn("_at", F.last("_ref", ignorenulls=True).over(upto)).filter(F.col("_ref").isNull()))
    below = F.when(F.col("_at.value") == F.col("value"), F.col("_at.cum_le") - F.col("_at.cnt")).otherwise(
        F.col("_at.cum_le"))
    zero = F.lit(0).cast("long")
    each = [F.col("value") if c == "value" else F.col("_row")[c].alias(c) for c in points.columns]
    return found.select(*each, F.coalesce("_at.cum_le", zero).alias("le"), F.coalesce(below, zero).alias("lt"))


def _deciding(points: DataFrame, ecdf: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Those of the batch points (keys..., value, cb, cum_b, m) that can have the
    batch's largest distance to the reference. The counts at the first value of
    each bucket (at most ``MAX_BUCKETS`` a sensor are carried to the tasks) give
    every point a least and a greatest distance; one whose greatest is below the
    least of another point of its batch is out. Points are held against those
    beside them, so a batch is never brought together; as the scan leaves
    batches in order, a few points of each remain. Points of sensors without
    reference go."""
    first = ecdf.groupBy(*REF, "bucket").agg(
        F.min(F.struct(F.col("value").cast("double").alias("value"), "cnt", "cum_le")).alias("s"))
    sizes = {(r[0], r[1]): r.n for r in stats.select(*REF, "n").collect()}
    found: dict = {}
    for r in first.select(*REF, "s.*").collect():
        found.setdefault((r[0], r[1]), []).append((r.value, r.cum_le - r.cnt, r.cum_le))
    index = {}
    for key, rows in found.items():
        value, lt, le = (np.array(c) for c in zip(*rows))
        order = np.argsort(value)
        # in front: below all starts no row is below or at the value
        index[key] = (np.r_[np.nan, value[order].astype(float)], np.r_[0, lt[order]], np.r_[0, le[order]],
                      np.r_[0, lt[order][1:], sizes[key]], float(sizes[key]))
    names = list(keys)

    def run(batches):
        for batch in batches:
            codes = {}
            for c in names:
                d = batch.column(c).dictionary_encode()
                codes[c] = np.asarray(d.indices.fill_null(len(d.dictionary))), d.dictionary.to_pylist()
            value, cb, cum_b, m = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                                   for c in ("value", "cb", "cum_b", "m"))
            least, most = np.full(len(value), np.nan), np.full(len(value), np.nan)
            (at_d, ds), (at_s, ss) = codes["dataset"], codes["sensor"]
            for i, d in enumerate(ds):
                for j, s in enumerate(ss):
                    mine = np.flatnonzero((at_d == i) & (at_s == j)) if (d, s) in index else []
                    if len(mine):
                        starts, lt, le, upto, n = index[d, s]
                        v = value[mine]
                        b = np.searchsorted(starts[1:], v, side="right")
                        same, above = v == starts[b], v > starts[b]
                        upper, lower = [], []
                        for lo, hi, share in (
                                (le[b], np.where(same, le[b], upto[b]), cum_b[mine] / m[mine]),
                                (np.where(above, le[b], lt[b]), np.where(same, lt[b], upto[b]),
                                 (cum_b[mine] - cb[mine]) / m[mine])):
                            lo, hi = lo / n, hi / n
                            upper += [np.abs(lo - share), np.abs(hi - share)]
                            lower += [lo - share, share - hi]
                        most[mine], least[mine] = np.max(upper, axis=0), np.max(lower, axis=0)
            known = ~np.isnan(most)
            if not known.any():
                continue
            most, least = most[known], least[known]
            new = np.zeros(len(most), dtype=bool)
            new[0] = True
            for at, _ in codes.values():
                at = at[known]
                new[1:] |= at[1:] != at[:-1]
            begins = np.flatnonzero(new)
            best = np.maximum.reduceat(least, begins)[np.cumsum(new) - 1]
            known[known] = most >= best
            yield batch.filter(pa.array(known))

    return points.mapInArrow(run, points.schema)


def _lerp(a, b, t):
    """numpy's linear interpolation (stable form on both halves)."""
    return F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (F.lit(1.0) - t))


def rank_quantiles(ranked: DataFrame, sizes: DataFrame, keys: Sequence[str], qs: Sequence[float],
                   value: str = "value", cnt: str = "cnt", cum: str = "cum_le") -> DataFrame:
    """Exact ``np.quantile(..., method='linear')`` from prefix counts.

    ``ranked`` has one row per distinct value with its count and inclusive
    prefix count; ``sizes`` has (keys..., n). Returns (keys..., qi, q, quantile).
    The rank targets (keys x 2 x len(qs) rows) are broadcast, so the ranked
    table is never shuffled by key.
    """
    keys = list(keys)
    q_arr = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    # numpy's virtual index for the linear method: n*q + (1 - q) - 1
    t = (sizes.filter(F.col("n") > 0).select(*keys, "n", F.explode(q_arr).alias("qq"))
         .select(*keys, "n", F.col("qq.qi").alias("qi"), F.col("qq.q").alias("q"),
                 ((F.col("n") * F.col("qq.q") + (F.lit(1.0) - F.col("qq.q"))) - F.lit(1.0)).alias("h")))
    t = t.select("*", F.floor("h").cast("long").alias("lo"))
    t = t.withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1))
    tk = [f"_t_{k}" for k in keys]
    targets = t.select(*[F.col(k).alias(a) for k, a in zip(keys, tk)], "qi",
                       F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.col("lo").alias("r")),
                                         F.struct(F.lit("hi").alias("side"), F.col("hi").alias("r"))))
                       .alias("s")).select(*tk, "qi", "s.side", "s.r")
    base = ranked.select(*[F.col(k) for k in keys], F.col(value).alias("v"),
                         (F.col(cum) - F.col(cnt)).alias("_lo_rank"), F.col(cum).alias("_hi_rank"))
    cond = [F.col(k) == F.col(a) for k, a in zip(keys, tk)] + [
        F.col("r") >= F.col("_lo_rank"), F.col("r") < F.col("_hi_rank")]
    hits = base.join(F.broadcast(targets), cond).select(*keys, "qi", "side", "v")
    piv = hits.groupBy(*keys, "qi").agg(F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("v_lo"),
                                        F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("v_hi"))
    return (piv.join(t.select(*keys, "qi", "q", "h", "lo"), [*keys, "qi"])
            .select(*keys, "qi", "q", _lerp(F.col("v_lo"), F.col("v_hi"), F.col("h") - F.col("lo")).alias("quantile")))


def linspace_quantiles(bins: int) -> list[float]:
    """The quantile levels np.linspace(0, 1, bins + 1) produces (i * step, last = 1)."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def psi_edges(ecdf: DataFrame, stats: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(dataset, sensor, inner ARRAY<DOUBLE>, nbins). Deciles of the
    reference, made unique; fewer than 3 unique -> 11 points over
    mean +- 3*max(std, 1e-6). The outer edges are -inf/+inf, so only the inner
    edges are kept: bin(v) = number of inner edges <= v."""
    quant = rank_quantiles(ecdf, stats, REF, linspace_quantiles(bins))
    uniq = (quant.groupBy(*REF).agg(F.array_distinct(F.transform(
        F.sort_array(F.collect_list(F.struct("qi", "quantile"))), lambda s: s["quantile"])).alias("u")))
    spread = F.greatest(F.col("std"), F.lit(1e-6))
    start, stop = F.col("mean") - 3 * spread, F.col("mean") + 3 * spread
    lin = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)),
                      lambda i: i * ((stop - start) / bins) + start)
    inner = F.when(F.size("u") >= 3, F.slice("u", 2, F.size("u") - 2)).otherwise(lin)
    return (uniq.join(stats, REF).select(*REF, inner.alias("inner"))
            .withColumn("nbins", F.size("inner") + 1))


def reference_bins(ecdf: DataFrame, stats: DataFrame, edges: DataFrame, eps: float = PSI_EPS) -> tuple[DataFrame, DataFrame]:
    """Reference share per bin (floored at eps) and the per-sensor constant
    K = sum over all bins of (eps - r) * ln(eps / r) (bins without reference
    rows contribute 0 there)."""
    b = (ecdf.join(F.broadcast(edges), REF)
         .withColumn("bin", count_le_small("inner", "value", PSI_BINS - 1))
         .groupBy(*REF, "bin").agg(F.sum("cnt").alias("rc")))
    b = b.join(stats.select(*REF, "n"), REF).select(
        *REF, "bin", F.greatest(F.col("rc") / F.col("n"), F.lit(eps)).alias("r"))
    k = b.groupBy(*REF).agg(F.sum((F.lit(eps) - F.col("r")) * F.log(F.lit(eps) / F.col("r"))).alias("k_empty"))
    return b, k


# ---------------------------------------------------------------- D3 / D4

def batch_psi(batches: DataFrame, edges: DataFrame, ref_bins: DataFrame, k_empty: DataFrame,
              keys: Sequence[str] = BATCH, eps: float = PSI_EPS) -> DataFrame:
    """D3: PSI per batch x sensor. ``batches`` has (keys..., value) non-null."""
    bc = batches.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cb"))
    return psi_from_counts(bc, edges, ref_bins, k_empty, keys, eps)


def psi_from_counts(bc: DataFrame, edges: DataFrame, ref_bins: DataFrame, k_empty: DataFrame,
                    keys: Sequence[str] = BATCH, eps: float = PSI_EPS) -> DataFrame:
    """D3 on per-batch value counts (keys..., value, cb)."""
    keys = list(keys)
    cur = (bc.join(F.broadcast(edges), REF)
           .withColumn("bin", count_le_small("inner", "value", PSI_BINS - 1))
           .groupBy(*keys, "bin").agg(F.sum("cb").alias("cc")))
    # at most nbins rows per batch x sensor here, so this window is bounded
    cur = cur.withColumn("m", F.sum("cc").over(Window.partitionBy(*keys)))
    j = cur.join(F.broadcast(ref_bins), [*REF, "bin"], "left")
    c = F.greatest(F.col("cc") / F.col("m"), F.lit(eps))
    r = F.coalesce(F.col("r"), F.lit(eps))
    term = (c - r) * F.log(c / r) - (F.lit(eps) - r) * F.log(F.lit(eps) / r)
    return (j.groupBy(*keys).agg(F.sum(term).alias("psi_touched"))
            .join(F.broadcast(k_empty), REF)
            .select(*keys, (F.col("psi_touched") + F.col("k_empty")).alias("psi")))


def batch_ks(batches: DataFrame, ecdf: DataFrame, stats: DataFrame, keys: Sequence[str] = BATCH,
             points_in_reference: bool = False) -> DataFrame:
    """Two-sided KS statistic and p-value per batch x sensor.
    ``points_in_reference``: every batch value is a reference value (the
    calibration batches are the reference's own engines), so the ECDF already
    holds F_ref at every batch point."""
    bc = stage(batches.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cb")))
    return ks_from_counts(bc, ecdf, stats, keys, points_in_reference)


def ks_from_counts(bc: DataFrame, ecdf: DataFrame, stats: DataFrame, keys: Sequence[str] = BATCH,
                   points_in_reference: bool = False) -> DataFrame:
    """D4 on per-batch value counts (keys..., value, cb)."""
    keys = list(keys)
    # the scan has dealt the points by batch already: their sizes are joined where they lie
    sizes = bc.groupBy(*keys).agg(F.sum("cb").alias("m"))
    fb = ordered_scan(bc, keys, ["value"], weight="cb", out="cum_b").join(sizes, keys)
    if points_in_reference:
        ranked = fb.join(ecdf.select(*REF, "value", F.col("cum_le").alias("le"),
                                     (F.col("cum_le") - F.col("cnt")).alias("lt")), [*REF, "value"])
    else:
        ranked = reference_ranks(stage(_deciding(fb, ecdf, stats, keys)), ecdf, stats)
    j = ranked.join(stats.select(*REF, "n"), REF)
    n = F.col("n").cast("double")
    gap = F.greatest(F.abs(F.col("le") / n - F.col("cum_b") / F.col("m")),
                     F.abs(F.col("lt") / n - (F.col("cum_b") - F.col("cb")) / F.col("m")))
    d = j.groupBy(*keys).agg(F.max(gap).alias("ks_statistic"), F.first("m").alias("m"), F.first("n").alias("n"))
    return d.withColumn("ks_pvalue", ks_pvalue("ks_statistic", "n", "m")).withColumnRenamed("m", "sample_size")


# ---------------------------------------------------------------- D5-D8

def batch_tests(batches: DataFrame, ref, keys: Sequence[str] = BATCH,
                min_rows: int = MIN_BATCH_ROWS, points_in_reference: bool = False) -> DataFrame:
    """PSI + KS for every batch x sensor with at least ``min_rows`` non-null
    values (D7). ``ref`` is the tuple returned by :func:`reference_model`."""
    ecdf, stats, edges, ref_bins, k_empty = ref
    keys = list(keys)
    vals = batches.filter(F.col("value").isNotNull())
    # one pass over the batch rows: per-batch value counts feed both tests
    bc = stage(vals.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cb")))
    psi = psi_from_counts(bc, edges, ref_bins, k_empty, keys)
    ks = ks_from_counts(bc, ecdf, stats, keys, points_in_reference)
    return stage(psi.join(ks, keys).filter(F.col("sample_size") >= min_rows))


def reference_model(ref_long: DataFrame, bins: int = PSI_BINS):
    ecdf, stats = fit_reference(ref_long)
    edges = stage(psi_edges(ecdf, stats, bins))
    ref_bins, k_empty = reference_bins(ecdf, stats, edges)
    ref_bins, k_empty = stage(ref_bins), stage(k_empty)
    return ecdf, stats, edges, ref_bins, k_empty


def calibrate(train_long: DataFrame, ref, q: float = CALIBRATION_QUANTILE,
              psi_default: float = PSI_THRESHOLD, p_default: float = KS_PVALUE) -> DataFrame:
    """Every training engine vs the reference; thresholds
    psi = max(default, q-quantile of engine PSI), p = min(default,
    (1-q)-quantile of engine p-values); sensors with no usable engine keep
    the defaults. Returns (dataset, sensor, psi_threshold, ks_pvalue_threshold)."""
    eng = train_long.withColumn("severity", F.lit("calibration"))
    tests = batch_tests(eng, ref, points_in_reference=True)
    ones = F.lit(1).cast("long")
    psi_r = ordered_scan(tests.select(*REF, F.col("psi").alias("value")).withColumn("cnt", ones),
                         REF, ["value"], weight="cnt", out="cum_le")
    p_r = ordered_scan(tests.select(*REF, F.col("ks_pvalue").alias("value")).withColumn("cnt", ones),
                       REF, ["value"], weight="cnt", out="cum_le")
    sizes = tests.groupBy(*REF).agg(F.count(F.lit(1)).alias("n"))
    qp = rank_quantiles(psi_r, sizes, REF, [q]).select(*REF, F.col("quantile").alias("q_psi"))
    qk = rank_quantiles(p_r, sizes, REF, [1.0 - q]).select(*REF, F.col("quantile").alias("q_p"))
    sensors = ref[1].select(*REF)
    return stage(sensors.join(qp, REF, "left").join(qk, REF, "left").select(
        *REF,
        F.coalesce(F.greatest(F.lit(psi_default), F.col("q_psi")), F.lit(psi_default)).alias("psi_threshold"),
        F.coalesce(F.least(F.lit(p_default), F.col("q_p")), F.lit(p_default)).alias("ks_pvalue_threshold")))


def batch_id_col(severity: str = "severity", index: str = "batch_index") -> F.Column:
    """``<severity>_<index>``, index zero-padded to at least 4 digits (never cut)."""
    return F.format_string("%s_%04d", F.col(severity), F.col(index).cast("int"))


def detect(tests: DataFrame, thresholds: DataFrame, require_both: bool = True,
           run_ts=None) -> DataFrame:
    """Flags and the 16 result fields (timestamp = run time)."""
    j = tests.join(F.broadcast(thresholds), REF, "left")
    pt = F.coalesce(F.col("psi_threshold"), F.lit(PSI_THRESHOLD))
    kt = F.coalesce(F.col("ks_pvalue_threshold"), F.lit(KS_PVALUE))
    psi_flag = F.col("psi") > pt
    ks_flag = F.col("ks_pvalue") < kt
    drift = (psi_flag & ks_flag) if require_both else (psi_flag | ks_flag)
    ts = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    batch_id = batch_id_col() \
        if "batch_index" in tests.columns else F.lit(None).cast("string")
    return j.select(
        ts.alias("timestamp"), "dataset", batch_id.alias("batch_id"), "engine_id", "severity", "sensor",
        "psi", "ks_statistic", "ks_pvalue",
        F.when(drift, "drift").otherwise("stable").alias("status"),
        pt.alias("psi_threshold"), kt.alias("ks_pvalue_threshold"),
        psi_flag.alias("psi_flag"), ks_flag.alias("ks_flag"),
        F.lit("AND" if require_both else "OR").alias("decision_rule"),
        F.col("sample_size").cast("long").alias("sample_size"),
        (F.col("sample_size") < SMALL_BATCH_ROWS).alias("small_batch"))


def retraining_decision(results: DataFrame, keys=("dataset", "severity", "batch_id", "engine_id")) -> DataFrame:
    """Any drifted sensor triggers; sorted distinct drifted sensors."""
    drifted = F.when(F.col("status") == "drift", F.col("sensor"))
    return results.groupBy(*keys).agg(
        F.bool_or(F.col("status") == "drift").alias("drift_detected"),
        F.sort_array(F.collect_set(drifted)).alias("drifted_sensors")).select(
        "*", F.when(F.col("drift_detected"), "trigger_retraining").otherwise("continue_prediction").alias("action"))


# ---------------------------------------------------------------- D10-D14

def batch_rollup(results: DataFrame) -> DataFrame:
    """Per (dataset, batch_id, severity): median psi / ks, checks,
    drifted checks, drift rate; batch = position of batch_id in sorted order."""
    is_drift = (F.col("status") == "drift").cast("long")
    b = results.groupBy("dataset", "batch_id", "severity").agg(
        F.median("psi").alias("psi"), F.median("ks_statistic").alias("ks_statistic"),
        F.count(F.lit(1)).alias("sensor_checks"), F.sum(is_drift).alias("drifted_sensor_checks"),
        F.avg(is_drift.cast("double")).alias("drift_rate"))
    b = stage(b)
    ids = b.select("dataset", "batch_id").distinct()
    ids = ordered_scan(ids, ["dataset"], ["batch_id"], out="batch")
    return b.join(ids.select("dataset", "batch_id", (F.col("batch") - 1).alias("batch")), ["dataset", "batch_id"])


def detection_summary(results: DataFrame, rollup: DataFrame, quorum: int = 3) -> DataFrame:
    """Per (dataset, severity) sensor-level and batch-level rates."""
    s = results.groupBy("dataset", "severity").agg(
        F.count(F.lit(1)).alias("sensor_checks"),
        F.sum((F.col("status") == "drift").cast("long")).alias("sensor_drift_checks"))
    s = s.withColumn("sensor_drift_rate", F.col("sensor_drift_checks") / F.col("sensor_checks"))
    b = rollup.groupBy("dataset", "severity").agg(
        F.count_distinct("batch").alias("batches"),
        F.sum((F.col("drift_rate") > 0).cast("long")).alias("batches_with_drift"),
        F.sum((F.col("drifted_sensor_checks") >= quorum).cast("long")).alias("batches_meeting_sensor_quorum"))
    b = b.withColumn("batch_drift_rate", F.col("batches_with_drift") / F.col("batches"))
    return s.join(b, ["dataset", "severity"])


def sensitivity_by_severity(rollup: DataFrame) -> DataFrame:
    """Unweighted mean of per-batch drift rates."""
    return rollup.groupBy("dataset", "severity").agg(F.avg("drift_rate").alias("drift_rate"))


def drift_timeline(rollup: DataFrame, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """The tables behind the timeline plots."""
    return rollup.select("dataset", "severity", "batch", "batch_id", "psi", "ks_statistic", "drift_rate",
                         (F.col("psi") > threshold).alias("psi_above_threshold"))


def _uniform(h: F.Column, lo: int) -> F.Column:
    return (F.conv(F.substring(h, lo, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def what_if_shift(long_df: DataFrame, severities: Sequence[str] = tuple(SEVERITY_MULTIPLIERS),
                  noise_std: float = 0.0, seed: int = 42, normal_noise: bool = False) -> DataFrame:
    """One copy per severity, value * multiplier + N(0, noise) where the
    noise is keyed on (seed, severity, dataset, engine, cycle, sensor) (Box-Muller
    on md5 uniforms), so it does not depend on partitioning or batch order.
    As in the reference sweep, the 'normal' copy gets no noise."""
    unknown = [s for s in severities if s not in SEVERITY_MULTIPLIERS]
    if unknown:
        raise ValueError(f"Unknown severity: {unknown}")
    sev = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(SEVERITY_MULTIPLIERS[s]).alias("mult"))
                    for s in severities])
    x = long_df.select("*", F.explode(sev).alias("_s")).select(
        *long_df.columns, F.col("_s.severity").alias("severity"), F.col("_s.mult").alias("_mult"))
    shifted = F.col("value") * F.col("_mult")
    if noise_std:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), "severity", "dataset", F.col("engine_id").cast("string"),
                              F.col("cycle").cast("string"), "sensor"))
        z = F.sqrt(-2.0 * F.log(_uniform(h, 1))) * F.cos(2.0 * 3.141592653589793 * _uniform(h, 9))
        noisy = shifted + F.lit(noise_std) * z
        shifted = noisy if normal_noise else F.when(F.col("severity") == "normal", shifted).otherwise(noisy)
    return x.withColumn("value", shifted).drop("_mult")


REFERENCE_PARTS = ("ecdf", "stats", "edges", "ref_bins", "k_empty")


def save_reference(ref, path: str) -> str:
    """Publish every part of a fitted reference model as one new version; returns its name."""
    return snapshots.publish(ref[0].sparkSession, path, dict(zip(REFERENCE_PARTS, ref)))


def load_reference(spark, path: str, version: str | None = None):
    """Load the latest published reference model, or a given version."""
    parts = snapshots.load(spark, path, version)
    return tuple(parts[name] for name in REFERENCE_PARTS)


def reference_or_fit(spark, path: str, ref_long: DataFrame):
    """Auto-load the reference published at ``path``, else fit and publish it.
    A version that was not published (its writer was stopped) does not count."""
    if snapshots.latest(spark, path) is None:
        save_reference(reference_model(ref_long), path)
    return load_reference(spark, path)
