"""Explainability as Spark jobs (H1-H8).

H1 estimates Shapley values by permutation sampling: for every explained
sample, background row and seeded permutation, features switch from the
background value to the sample's value one at a time; each switch's change
of the prediction is that feature's contribution. All coalitions are built
as array expressions, scored by ``model.transform`` in one distributed job,
and averaged with a group-by. Boosted trees score the coalitions of a batch
where they are built (NumPy), so none of them becomes a row. Per (sample, background, permutation) the
contributions telescope to f(x) - f(b), so sum(phi) = f(x) - mean f(b).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from cyclewise.functions.scan import ordered_scan
from cyclewise.operators.boosting import BoostedModel, array_rows

#: (sample, background, permutation) rows whose coalitions are scored at once
COALITION_ROWS = 4096


def shapley_sampling(model, samples: DataFrame, background: DataFrame, n_features: int,
                     permutations: int = 3, seed: int = 7, features: str = "features_arr") -> DataFrame:
    """H1: (sample_id, feature, phi, value). ``samples``: (sample_id, features_arr);
    ``background``: (bg_id, features_arr), a handful of rows picked by the
    caller (at most 20 in the registered queries)."""
    F_ = n_features
    perm = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm")
    # the background is a handful of rows (<= 20): carried as one literal array
    bgs = [(r["bg_id"], [float(v) for v in r[features]]) for r in background.select("bg_id", features).collect()]
    bg_arr = F.array(*[F.struct(F.lit(i).alias("bg_id"), F.array(*[F.lit(v) for v in vec]).alias("b")) for i, vec in bgs])
    pairs = samples.select("sample_id", F.col(features).alias("x"), F.explode(bg_arr).alias("bgr"))
    pairs = pairs.select("sample_id", "x", F.col("bgr.bg_id").alias("bg_id"), F.col("bgr.b").alias("b"), perm)
    # rank of each feature inside a seeded permutation of (sample, bg, perm)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(F_ - 1)), lambda j: F.struct(
        F.xxhash64(F.lit(seed), "sample_id", "bg_id", "perm", j).alias("h"), j.alias("j")))
    order = F.transform(F.array_sort(keyed), lambda s: s["j"])        # features in switch order
    if isinstance(model, BoostedModel):
        sums = _switched(model, pairs.select("sample_id", "x", "b", order.alias("order")), F_)
        return sums.groupBy("sample_id", "feature").agg((F.sum("d") / F.sum("n")).alias("phi"),
                                                        F.first("value").alias("value"))
    rank = F.transform(F.sequence(F.lit(0), F.lit(F_ - 1)), lambda j: F.array_position(order, j) - 1)
    steps = pairs.withColumn("rank", rank).select("*", F.explode(F.sequence(F.lit(0), F.lit(F_))).alias("step"))
    mixed = F.zip_with(F.col("x"), F.col("b"), lambda a, c: F.struct(a.alias("a"), c.alias("c")))
    coal = F.transform(F.sequence(F.lit(0), F.lit(F_ - 1)), lambda j: F.when(
        F.element_at("rank", j + 1) < F.col("step"), F.element_at(mixed, j + 1)["a"]).otherwise(F.element_at(mixed, j + 1)["c"]))
    scored = model.transform(steps.withColumn("features_arr", coal).withColumn("features", array_to_vector("features_arr")))
    w = Window.partitionBy("sample_id", "bg_id", "perm").orderBy("step")   # F + 1 rows per group
    delta = scored.select("sample_id", "bg_id", "perm", "step", "rank", "x",
                          (F.col("prediction") - F.lag("prediction").over(w)).alias("d")).filter(F.col("step") > 0)
    # the feature switched at step s is the one with rank s - 1
    per = delta.select("sample_id", "x", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(F_ - 1)).alias("j"),
                                                                 F.col("rank").alias("r"))).alias("z"), "step", "d") \
        .filter(F.col("z.r") == F.col("step") - 1)
    return per.groupBy("sample_id", F.col("z.j").alias("feature")).agg(
        F.avg("d").alias("phi"), F.first(F.element_at("x", F.col("z.j") + 1)).alias("value"))


def _switched(model: BoostedModel, pairs: DataFrame, n_features: int) -> DataFrame:
    """(sample_id, feature, d, n, value): contributions of a feature summed over
    the rows (sample_id, x, b, order) of one sample that lie in a batch, and their number."""
    fields = pa.schema([("sample_id", pa.int64()), ("feature", pa.int32()), ("d", pa.float64()), ("n", pa.int64()),
                        ("value", pa.float64())])
    n = n_features

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, COALITION_ROWS):
                batch = whole.slice(at, COALITION_ROWS)
                x, b, order = (array_rows(batch.column(c), n) for c in ("x", "b", "order"))
                order = order.astype(np.int64)
                rank = np.argsort(order, axis=1)
                taken = rank[:, None, :] < np.arange(n + 1)[None, :, None]
                scores = model.predict(np.where(taken, x[:, None, :], b[:, None, :]).reshape(-1, n))
                d = np.zeros((len(x), n))
                np.put_along_axis(d, order, np.diff(scores.reshape(-1, n + 1), axis=1), axis=1)
                names = batch.column("sample_id").dictionary_encode()
                ids = names.dictionary.to_pylist()
                code = np.asarray(names.indices.fill_null(len(ids)))
                total, first = np.zeros((len(ids) + 1, n)), np.zeros((len(ids) + 1, n))
                np.add.at(total, code, d)
                first[code[::-1]] = x[::-1]
                count = np.bincount(code, minlength=len(ids) + 1)
                for i in np.flatnonzero(count).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] if i < len(ids) else None] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                         pa.array(total[i]), pa.array(np.full(n, count[i])), pa.array(first[i])], schema=fields)

    pairs = pairs.withColumn("sample_id", F.col("sample_id").cast("long"))
    return pairs.mapInArrow(run, "sample_id long, feature int, d double, n long, value double")


def base_value(model, background: DataFrame, features: str = "features_arr") -> float:
    return model.transform(background.withColumn("features", array_to_vector(features))).agg(F.avg("prediction")).first()[0]


def aggregate_attributions(phi: DataFrame, names: Sequence[str], group_of: dict[str, str]) -> DataFrame:
    """H2: sum of attributions and mean of values per sensor (over the
    per-sensor window statistics or time steps)."""
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(group_of[n]))])
    return phi.withColumn("sensor", F.element_at(m, F.col("feature"))).groupBy("sample_id", "sensor").agg(
        F.sum("phi").alias("phi"), F.avg("value").alias("value"))


def attribution_importance(phi: DataFrame, key: str = "sensor") -> DataFrame:
    """H3: mean |phi| per feature, descending."""
    return phi.groupBy(key).agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(F.desc("mean_abs_phi"), key)


def local_explanation(phi: DataFrame, sample: int = 0, key: str = "sensor") -> DataFrame:
    """H4: one sample's attributions by |phi| descending."""
    return phi.filter(F.col("sample_id") == sample).orderBy(F.desc(F.abs("phi")), key)


def influences(phi: DataFrame, scored: DataFrame) -> DataFrame:
    """H5: long table with the direction of each attribution (phi > 0 strict)."""
    return phi.join(scored.select("sample_id", F.col("p").alias("prediction"), F.col("y").alias("actual")),
                    "sample_id").withColumn(
        "influence", F.when(F.col("phi") > 0, "increases predicted RUL").otherwise("decreases predicted RUL"))


def window_quantiles(rows: DataFrame, sensor: str, probs: Sequence[float], zeros: int = 0) -> list[float]:
    """Exact numpy-linear quantiles of a sensor over all time steps of a set of
    windows: ``rows`` are the readings in them with ``mult`` (how many of the
    windows hold the reading), ``zeros`` the number of padding steps. Distinct
    values with prefix counts; only the values at the wanted ranks come back."""
    values = rows.groupBy(F.coalesce(F.col(sensor).cast("double"), F.lit(0.0)).alias("v")).agg(
        F.sum("mult").cast("long").alias("c"))
    if zeros:
        pad = rows.sparkSession.createDataFrame([(0.0, int(zeros))], "v double, c long")
        values = values.unionByName(pad).groupBy("v").agg(F.sum("c").alias("c"))
    upto = ordered_scan(values.withColumn("_all", F.lit(0)), ["_all"], ["v"], weight="c", out="upto")
    total = values.agg(F.sum("c")).first()[0] or 0
    if not total:
        return [float("nan")] * len(probs)
    ranks = sorted({r for q in probs for r in (math.floor((total - 1) * q), math.ceil((total - 1) * q))})
    hit = F.array(*[F.lit(r).cast("long") for r in ranks])
    inside = F.filter(hit, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))
    at = {r: row.v for row in upto.select("v", inside.alias("hit")).filter(F.size("hit") > 0).collect() for r in row.hit}
    out = []
    for q in probs:
        h = (total - 1) * q
        lo, hi = at[math.floor(h)], at[math.ceil(h)]
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def ice_curves(model, samples: DataFrame, sensor_index: int, low: float, high: float, grid: int = 20,
               stats: int = 4) -> DataFrame:
    """H6: (sample_id, grid_i, grid_value, prediction) for ``grid`` values from
    ``low`` to ``high``. A sensor held at v over a whole window has the
    summary (v, v, 0, 0), so only those four features change and no window is
    rebuilt: ``samples`` are (sample_id, features_arr)."""
    pts = [low + (high - low) * i / (grid - 1) for i in range(grid)]
    g = F.explode(F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(float(v)).alias("gv")) for i, v in enumerate(pts)]))
    rep = samples.select("sample_id", F.col("features_arr").alias("_f"), g.alias("g"))
    at = sensor_index * stats
    held = F.array(F.col("g.gv"), F.col("g.gv"), F.lit(0.0), F.lit(0.0))
    arr = F.concat(F.slice("_f", 1, at), held, F.slice("_f", at + stats + 1, F.size("_f")))
    feats = rep.withColumn("features_arr", arr).withColumn("features", array_to_vector("features_arr"))
    return model.transform(feats).select("sample_id", F.col("g.gi").alias("grid_i"), F.col("g.gv").alias("grid_value"),
                                         "prediction")


def pdp(ice: DataFrame) -> DataFrame:
    """H7: mean ICE per grid point."""
    return ice.groupBy("grid_i", "grid_value").agg(F.avg("prediction").alias("mean_prediction"))


def dependence_table(phi: DataFrame, sensor: str, key: str = "sensor") -> DataFrame:
    """H8: (value, phi) pairs for one sensor."""
    return phi.filter(F.col(key) == sensor).select("sample_id", "value", "phi")
