"""Operating regimes (R1-R16) and per-regime normalisation (Z3).

Cluster quality measures take labels and a feature vector given as columns;
they are aggregates over the data plus tiny k x k centroid tables, so they
are linear in the data (the reference's silhouette is O(n^2); R3 here is the
squared-Euclidean one in closed form - a documented deviation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.functions.exprs import one_hot
from cyclewise.functions.scan import ordered_scan
from cyclewise.operators.kmeans import fit_kmeans
from cyclewise.session import stage

SETTINGS = ["setting_1", "setting_2", "setting_3"]
ONE_HOT_WIDTH = 6
WEIGHT_CAP = 2.5


def regime_ids(df: DataFrame, key: str = "regime_key", by=("dataset",), out: str = "regime_id") -> DataFrame:
    """Dense ids 0.. for regime keys in sorted order (a handful of rows)."""
    keys = df.select(*by, key).filter(F.col(key).isNotNull()).distinct()
    ranked = ordered_scan(keys, list(by), [key], out="_r")
    return ranked.select(*by, key, (F.col("_r") - 1).cast("int").alias(out))


def with_regime_id(df: DataFrame, key: str = "regime_key", by=("dataset",)) -> DataFrame:
    # one row a regime: broadcast, since a shuffle by so few keys would put a regime's rows into one task
    return df.join(F.broadcast(regime_ids(df, key, by)), [*by, key], "left")


# ---------------------------------------------------------------- R1 / R8

def fit_settings_scaler(df: DataFrame, settings: Sequence[str] = SETTINGS, by=("dataset",)) -> DataFrame:
    """(by..., setting, mean, std) with population std."""
    long = df.unpivot(list(by), list(settings), "setting", "v")
    return long.groupBy(*by, "setting").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def scale_settings(df: DataFrame, params: DataFrame, settings: Sequence[str] = SETTINGS, by=("dataset",),
                   prefix: str = "z_") -> DataFrame:
    by = list(by)
    wide = params.groupBy(*by).agg(*[F.max(F.when(F.col("setting") == s, F.struct("mean", "std"))).alias(f"_p_{s}")
                                     for s in settings])
    j = df.join(F.broadcast(wide), by)
    for s in settings:
        std = F.col(f"_p_{s}.std")
        j = j.withColumn(f"{prefix}{s}", (F.col(s) - F.col(f"_p_{s}.mean"))
                         / F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std))
    return j.drop(*[f"_p_{s}" for s in settings])


def centroids_from_labels(df: DataFrame, features: Sequence[str], label: str, by=("dataset",)) -> DataFrame:
    """(by..., label, c ARRAY<DOUBLE>) mean feature vector per label."""
    return df.groupBy(*by, label).agg(F.array(*[F.avg(f) for f in features]).alias("c"))


def assign_regimes(df: DataFrame, centroids: DataFrame, features: Sequence[str], by=("dataset",),
                   label: str = "regime_id", out: str = "assigned") -> DataFrame:
    """Nearest centroid by squared Euclidean distance, ties to the lowest
    label. The centroid list (k per dataset) is collected into one array per
    dataset and broadcast; the data is never shuffled."""
    by = list(by)
    cents = centroids.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(label, "c"))).alias("_cents"))
    j = df.join(F.broadcast(cents), by, "left")
    x = F.array(*[F.col(f).cast("double") for f in features])
    d = F.transform("_cents", lambda c: F.struct(
        F.aggregate(F.zip_with(c["c"], x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"),
        c[label].alias("l")))
    return j.withColumn(out, F.array_min(d)["l"]).drop("_cents")


# ---------------------------------------------------------------- R3 / R4 / R5

def _sqdist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _weighted(df: DataFrame, features: Sequence[str], label: str, by, weight: str | None):
    """Keys, label, feature vector _x and weight _w (1 a row by default) alone,
    so that other columns cannot clash."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.select(*by, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), w.alias("_w"))


def _cluster_sums(df: DataFrame, n: int, label: str, by) -> DataFrame:
    """(by..., label, nk, c, q): weight, mean vector, weighted sum of squared norms."""
    norm = F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v)
    return df.groupBy(*by, label).agg(
        F.sum("_w").alias("nk"),
        F.array(*[F.sum(F.col("_w") * F.col("_x")[j]) / F.sum("_w") for j in range(n)]).alias("c"),
        F.sum(F.col("_w") * norm).alias("q"))


def silhouette(df: DataFrame, features: Sequence[str], label: str, by=("dataset",),
               weight: str | None = None) -> DataFrame:
    """R3 with squared Euclidean distances, linear in the data: the mean squared
    distance of x to a cluster is |x|^2 - 2 x.c + q / n. A row alone in its
    cluster scores 0. NULL for a single cluster."""
    by = list(by)
    rows = _weighted(df, features, label, by, weight)
    sums = _cluster_sums(rows, len(features), label, by)
    all_ = sums.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("l"), "nk", "c", "q")).alias("_cl"))
    norm = F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v)
    j = rows.join(F.broadcast(all_), by).withColumn("_n", norm)  # one row a dataset
    mean = F.transform("_cl", lambda c: F.struct(
        c["l"].alias("l"), c["nk"].alias("nk"),
        (F.col("_n") - 2 * F.aggregate(F.zip_with(c["c"], "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
         + c["q"] / c["nk"]).alias("d")))
    j = j.withColumn("_m", mean)
    own = F.filter("_m", lambda c: c["l"] == F.col(label))[0]
    a = F.greatest(F.lit(0.0), own["d"] * own["nk"] / (own["nk"] - 1))
    b = F.array_min(F.transform(F.filter("_m", lambda c: c["l"] != F.col(label)), lambda c: F.greatest(F.lit(0.0), c["d"])))
    s = F.when(own["nk"] <= 1, F.when(b.isNotNull(), 0.0)).when(F.greatest(a, b) == 0, F.when(b.isNotNull(), 0.0)) \
        .otherwise(F.try_divide(b - a, F.greatest(a, b)))
    j = j.withColumn("_s", F.when(b.isNotNull(), s))
    return j.groupBy(*by).agg((F.sum(F.col("_w") * F.col("_s")) / F.sum("_w")).alias("silhouette"))


def davies_bouldin(df: DataFrame, features: Sequence[str], label: str, by=("dataset",),
                   weight: str | None = None) -> DataFrame:
    """mean_i max_{j != i} (S_i + S_j) / d(c_i, c_j), S = mean distance to
    the own centroid. The k x k pairing is over the k centroid rows a dataset."""
    by = list(by)
    rows = _weighted(df, features, label, by, weight)
    cents = _cluster_sums(rows, len(features), label, by).drop("q", "nk")
    s = (rows.join(F.broadcast(cents), [*by, label])  # one row a cluster
         .groupBy(*by, label).agg((F.sum(F.col("_w") * F.sqrt(_sqdist(F.col("_x"), F.col("c")))) / F.sum("_w")).alias("s")))
    ci = cents.join(s, [*by, label]).select(*by, F.col(label).alias("i"), F.col("c").alias("ci"), F.col("s").alias("si"))
    cj = ci.select(*by, F.col("i").alias("j"), F.col("ci").alias("cj"), F.col("si").alias("sj"))
    pairs = ci.join(cj, by).filter(F.col("i") != F.col("j"))
    r = pairs.withColumn("r", (F.col("si") + F.col("sj")) / F.sqrt(_sqdist(F.col("ci"), F.col("cj"))))
    return r.groupBy(*by, "i").agg(F.max("r").alias("m")).groupBy(*by).agg(F.avg("m").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, features: Sequence[str], label: str, by=("dataset",),
                      weight: str | None = None) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)), and the within sum W (the inertia)."""
    by = list(by)
    rows = _weighted(df, features, label, by, weight)
    cents = _cluster_sums(rows, len(features), label, by).drop("q")
    mean = F.array(*[F.sum(F.col("nk") * F.col("c")[j]) / F.sum("nk") for j in range(len(features))])
    overall = cents.groupBy(*by).agg(F.sum("nk").alias("n"), mean.alias("g"))
    w = rows.join(F.broadcast(cents), [*by, label]).groupBy(*by).agg(F.sum(F.col("_w") * _sqdist(F.col("_x"), F.col("c"))).alias("W"))
    b = (cents.join(overall, by).groupBy(*by).agg(F.sum(F.col("nk") * _sqdist(F.col("c"), F.col("g"))).alias("B"),
                                                 F.count(F.lit(1)).alias("k"), F.first("n").alias("n")))
    score = F.try_divide(F.try_divide(F.col("B"), F.col("k") - 1), F.try_divide(F.col("W"), F.col("n") - F.col("k")))
    return b.join(w, by).select(*by, "k", score.alias("calinski_harabasz"), F.col("W").alias("within"))


# ---------------------------------------------------------------- R6 / R7

def elbow_k(metrics: DataFrame, by=("dataset",)) -> DataFrame:
    """The k before the largest inertia drop (ties: smallest k)."""
    w = Window.partitionBy(*by).orderBy("clusters")  # one row per k
    d = metrics.withColumn("drop", F.col("inertia") - F.lead("inertia").over(w)).filter(F.col("drop").isNotNull())
    return d.groupBy(*by).agg(F.min_by("clusters", F.struct(-F.col("drop"), F.col("clusters"))).alias("elbow"))


def vote_k(metrics: DataFrame, by=("dataset",)) -> DataFrame:
    """Best k by silhouette (max), Davies-Bouldin (min), Calinski-Harabasz
    (max) and elbow; majority vote, ties to the first voted in that order."""
    by = list(by)
    first = lambda col, asc: F.min_by("clusters", F.struct((F.col(col) if asc else -F.col(col)), F.col("clusters")))
    best = metrics.groupBy(*by).agg(first("silhouette", False).alias("v0"), first("davies_bouldin", True).alias("v1"),
                                    first("calinski_harabasz", False).alias("v2"))
    best = best.join(elbow_k(metrics, by), by)
    votes = best.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(c).alias("k"))
                                                  for i, c in enumerate(["v0", "v1", "v2", "elbow"])])).alias("v"))
    tally = votes.groupBy(*by, "v.k").agg(F.count(F.lit(1)).alias("votes"), F.min("v.o").alias("o"))
    pick = tally.groupBy(*by).agg(F.min_by("k", F.struct(-F.col("votes"), F.col("o"))).alias("recommended_k"))
    return best.join(pick, by).select(*by, F.col("v0").alias("silhouette"), F.col("v1").alias("davies_bouldin"),
                                      F.col("v2").alias("calinski_harabasz"), "elbow", "recommended_k")


# ---------------------------------------------------------------- R9-R14

def fit_regime_scalers(train_long: DataFrame, regime: str = "regime_id") -> DataFrame:
    """(dataset, regime, sensor, mean, std) with population std, train only."""
    return train_long.groupBy("dataset", regime, "sensor").agg(F.avg("value").alias("mean"),
                                                               F.stddev_pop("value").alias("std"))


def unseen_regimes(df: DataFrame, params: DataFrame, regime: str = "regime_id") -> DataFrame:
    return df.select("dataset", regime).distinct().join(params.select("dataset", regime).distinct(),
                                                         ["dataset", regime], "left_anti")


def apply_regime_scalers(df: DataFrame, params: DataFrame, sensors: Sequence[str], regime: str = "regime_id",
                         check: bool = True) -> DataFrame:
    """(x - mean) / std per regime; zero std divides by 1; a regime not
    seen in training is an error listing the regimes (regimes x sensors
    parameters, broadcast as one wide row per regime)."""
    if check:
        bad = [r[regime] for r in unseen_regimes(df, params, regime).collect()]
        if bad:
            raise ValueError(f"no scaler was fitted for the regimes {sorted(bad, key=str)}")
    wide = params.groupBy("dataset", regime).agg(
        *[F.max(F.when(F.col("sensor") == s, F.struct("mean", "std"))).alias(f"_p_{s}") for s in sensors])
    j = df.join(F.broadcast(wide), ["dataset", regime], "left")
    for s in sensors:
        std = F.col(f"_p_{s}.std")
        j = j.withColumn(s, (F.col(s) - F.col(f"_p_{s}.mean"))
                         / F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std))
    return j.drop(*[f"_p_{s}" for s in sensors])


def regime_one_hot(df: DataFrame, train_regimes: Sequence[int], regime: str = "regime_id") -> DataFrame:
    """One double column per training regime (sorted)."""
    return df.select("*", *[(F.col(regime) == r).cast("double").alias(f"regime_onehot_{r}")
                            for r in sorted(train_regimes)])


def regime_one_hot_fixed(regime: str = "regime_id", width: int = ONE_HOT_WIDTH) -> F.Column:
    """Fixed-width vector; out-of-range regimes give zeros."""
    return one_hot(regime, width)


def regime_weights(df: DataFrame, regime: str = "regime_id", cap: float = WEIGHT_CAP, by=("dataset",)) -> DataFrame:
    """Per-row weight min(max_count / count, cap) from regime frequencies."""
    by = list(by)
    counts = df.groupBy(*by, regime).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_mx", F.max("_c").over(Window.partitionBy(*by)))  # k rows per dataset
    w = counts.select(*by, regime, F.least(F.col("_mx") / F.col("_c"), F.lit(cap)).alias("regime_weight"))
    return df.join(F.broadcast(w), [*by, regime], "left")


def regime_distribution(df: DataFrame, regime: str = "regime_id") -> DataFrame:
    """Rows per regime per split."""
    return df.groupBy("dataset", "split", regime).agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- R2 / R15

def weighted_points(df: DataFrame, features: Sequence[str], by: str = "dataset") -> DataFrame:
    """Distinct feature vectors with their multiplicity ``w``: k-means cost and
    every quality measure are additive over equal rows."""
    return df.groupBy(by, *features).agg(F.count(F.lit(1)).cast("double").alias("w"))


def sweep_regimes(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11), restarts: int = 20,
                  by: str = "dataset", max_iter: int = 300, seed: int = 42) -> DataFrame:
    """For each k the best of ``restarts`` k-means runs, all fitted at
    once on the distinct weighted points, then inertia, silhouette (squared
    Euclidean), Davies-Bouldin and Calinski-Harabasz from the same points with
    the label of every k. One row per (dataset, k)."""
    points = stage(weighted_points(df, features, by))
    best = fit_kmeans(points, features, list(ks), restarts, by, max_iter=max_iter, seed=seed)
    cents = [(name, int(k), i, [float(v) for v in c]) for (name, k), (_, m) in best.items() for i, c in enumerate(m)]
    table = df.sparkSession.createDataFrame(cents, f"{by} string, clusters int, label int, c array<double>")
    each = points.join(table.select(by, "clusters").distinct(), by)
    lab = stage(assign_regimes(each, table, features, (by, "clusters"), "label", "label").drop("_cents"))
    keys = (by, "clusters")
    out = calinski_harabasz(lab, features, "label", keys, "w").drop("k")
    out = out.join(silhouette(lab, features, "label", keys, "w"), list(keys))
    out = out.join(davies_bouldin(lab, features, "label", keys, "w"), list(keys))
    return out.select(by, "clusters", F.col("within").alias("inertia"), "silhouette", "davies_bouldin",
                      "calinski_harabasz")


def fit_regimes(df: DataFrame, features: Sequence[str], ks: Sequence[int], restarts: int = 20, by: str = "dataset",
                seed: int = 42) -> DataFrame:
    """(dataset, clusters, kid, c) centroids of the best of ``restarts`` runs for each k."""
    points = stage(weighted_points(df, features, by))
    best = fit_kmeans(points, features, list(ks), restarts, by, seed=seed)
    rows = [(name, int(k), i, [float(v) for v in c]) for (name, k), (_, m) in best.items() for i, c in enumerate(m)]
    return df.sparkSession.createDataFrame(rows, f"{by} string, clusters int, kid int, c array<double>")


def recommend_k(df: DataFrame, settings: Sequence[str], metrics: DataFrame, by: str = "dataset") -> DataFrame:
    """R7 with the reference's first branch: a dataset with one operating
    condition gets one cluster, without a vote; the others the vote's k."""
    conditions = df.groupBy(by).agg(F.count_distinct(F.struct(*settings)).alias("_n"))
    voted = vote_k(metrics, (by,))
    k = F.when(F.col("_n") <= 1, F.lit(1)).otherwise(F.col("recommended_k"))
    return conditions.join(voted, by, "left").select(
        by, "silhouette", "davies_bouldin", "calinski_harabasz", "elbow", k.cast("int").alias("recommended_k"))


def regime_projection_2d(df: DataFrame, features: Sequence[str], label: str = "regime_id") -> DataFrame:
    """2-D PCA coordinates with the regime label."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    v = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    p = PCA(k=2, inputCol="_v", outputCol="_pc").fit(v).transform(v)
    a = vector_to_array("_pc")
    return p.select("dataset", "engine_id", "cycle", label, a[0].alias("pc1"), a[1].alias("pc2"))


def normalize(df: DataFrame, sensors: Sequence[str], mode: str = "regime_plus_global",
              regime: str = "regime_id", split: str = "split") -> DataFrame:
    """Z3: ``regime_only`` / ``regime_plus_global`` / ``global_zscore_only``;
    any other mode leaves the sensors as they are. Every scaler is fitted on
    the train split and applied to all rows."""
    from cyclewise.operators.profile import apply_zscore, fit_global_zscore

    def long(x, ids):
        return x.unpivot(list(ids), list(sensors), "sensor", "value")

    out = df
    if mode in ("regime_only", "regime_plus_global"):
        params = fit_regime_scalers(long(out.filter(F.col(split) == "train"), ("dataset", regime)), regime)
        out = stage(apply_regime_scalers(out, params, sensors, regime))
    if mode in ("regime_plus_global", "global_zscore_only"):
        g = fit_global_zscore(long(out.filter(F.col(split) == "train"), ("dataset",)))
        out = apply_zscore(out, g, sensors)
    return out
