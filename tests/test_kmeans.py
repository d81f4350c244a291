"""Batched k-means and the weighted quality measures against NumPy."""
import numpy as np
from pyspark.sql import functions as F

from cyclewise.operators import regimes as R
from cyclewise.operators.kmeans import fit_kmeans
from cyclewise.session import stage

F3 = ["a", "b", "c"]


def blobs(seed, k, n=40, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-5, 5, (k, 3))
    return np.concatenate([c + spread * rng.standard_normal((n, 3)) for c in centers]), np.repeat(np.arange(k), n)


def frame(spark, parts):
    rows = [(name, *map(float, x)) for name, xs in parts.items() for x in xs]
    return spark.createDataFrame(rows, "dataset string, a double, b double, c double")


def test_all_models_find_the_blobs_of_their_dataset(spark):
    one, l1 = blobs(1, 3)
    two, l2 = blobs(2, 5)
    df = frame(spark, {"one": np.concatenate([one, one[:30]]), "two": two})  # repeated rows weigh twice
    best = fit_kmeans(stage(R.weighted_points(df, F3)), F3, (3, 5), 6)
    assert set(best) == {(d, k) for d in ("one", "two") for k in (3, 5)}
    for name, x, lab, k in (("one", np.concatenate([one, one[:30]]), np.concatenate([l1, l1[:30]]), 3), ("two", two, l2, 5)):
        cost, centers = best[name, k]
        means = np.array([x[lab == i].mean(0) for i in range(k)])
        want = sum(((x[lab == i] - means[i]) ** 2).sum() for i in range(k))
        assert abs(cost - want) < 1e-6 * want
        assert np.allclose(sorted(map(tuple, centers)), sorted(map(tuple, means)))
    # more restarts never cost more; the same seed gives the same result
    assert fit_kmeans(stage(R.weighted_points(df, F3)), F3, (3, 5), 6)["one", 5][0] == best["one", 5][0]


def test_edges(spark):
    few = spark.createDataFrame([("d", 1.0, 1.0, 1.0)] * 3 + [("d", None, 1.0, 1.0), ("d", 2.0, 1.0, 1.0)],
                                "dataset string, a double, b double, c double")
    cost, centers = fit_kmeans(stage(R.weighted_points(few, F3)), F3, (4,), 2)["d", 4]
    assert cost == 0 and np.isfinite(centers).all(1).sum() == 2
    assert fit_kmeans(stage(R.weighted_points(few.limit(0), F3)), F3, (2,), 2) == {}


def test_measures_match_brute_force_and_weights_stand_for_repeats(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(0, 1, (90, 3)), 1)
    lab = rng.integers(0, 4, 90)
    rows = spark.createDataFrame([("d", int(i), *map(float, v)) for i, v in zip(lab, x)],
                                 "dataset string, label int, a double, b double, c double")
    weighted = rows.groupBy("dataset", "label", *F3).agg(F.count(F.lit(1)).alias("w"))
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(90):
        a = d2[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = min(d2[i][lab == j].mean() for j in range(4) if j != lab[i])
        s.append((b - a) / max(a, b))
    means = np.array([x[lab == j].mean(0) for j in range(4)])
    size = np.array([(lab == j).sum() for j in range(4)])
    within = sum(((x[lab == j] - means[j]) ** 2).sum() for j in range(4))
    between = (size * ((means - x.mean(0)) ** 2).sum(1)).sum()
    away = np.array([np.sqrt(((x[lab == j] - means[j]) ** 2).sum(1)).mean() for j in range(4)])
    db = np.mean([max((away[i] + away[j]) / np.linalg.norm(means[i] - means[j]) for j in range(4) if j != i)
                  for i in range(4)])
    for df, w in ((rows, None), (weighted, "w")):
        assert abs(R.silhouette(df, F3, "label", weight=w).first().silhouette - np.mean(s)) < 1e-9
        ch = R.calinski_harabasz(df, F3, "label", weight=w).first()
        assert abs(ch.calinski_harabasz - between / 3 / (within / 86)) < 1e-9 and abs(ch.within - within) < 1e-9
        assert abs(R.davies_bouldin(df, F3, "label", weight=w).first().davies_bouldin - db) < 1e-9


def test_one_condition_gets_one_cluster(spark):
    varied, _ = blobs(3, 2, 30)
    df = frame(spark, {"flat": np.ones((10, 3)), "varied": varied})
    sweep = R.sweep_regimes(df, F3, (2, 3), 4)
    got = {r.dataset: r.recommended_k for r in R.recommend_k(df, F3, sweep).collect()}
    assert got["flat"] == 1 and got["varied"] == 2


def test_points_are_read_once_for_all_iterations(spark):
    """every iteration read the table of points again."""
    x, _ = blobs(3, 4, spread=1.5)
    read = spark.sparkContext.accumulator(0)
    points = stage(R.weighted_points(frame(spark, {"d": x}), F3))

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    best = fit_kmeans(points.mapInArrow(counted, points.schema), F3, (4,), 3)
    assert best["d", 4][1].shape == (4, 3)
    assert read.value == 2 * len(x)  # the spread of the features, then the blocks
