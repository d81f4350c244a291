"""Shapley sampling: per-sample attributions add up to f(x) - mean f(background)."""
import math
import random

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Row

from cyclewise.operators import explain as H


def test_efficiency_property(spark):
    rnd = random.Random(2)
    rows = [Row(features_arr=[rnd.random(), rnd.random(), rnd.random()]) for _ in range(200)]
    df = spark.createDataFrame(rows)
    df = df.withColumn("features", array_to_vector("features_arr"))
    from pyspark.sql import functions as F
    df = df.withColumn("y", F.col("features_arr")[0] * 3 - F.col("features_arr")[1] + 0.5 * F.col("features_arr")[2])
    model = LinearRegression(featuresCol="features", labelCol="y").fit(df)
    samples = spark.createDataFrame([Row(sample_id=i, features_arr=r.features_arr) for i, r in enumerate(rows[:5])])
    bg = spark.createDataFrame([Row(bg_id=i, features_arr=r.features_arr) for i, r in enumerate(rows[100:110])])
    phi = H.shapley_sampling(model, samples, bg, 3, permutations=2).collect()
    base = H.base_value(model, bg)
    preds = {r.sample_id: r.prediction for r in model.transform(samples.withColumn("features", array_to_vector("features_arr"))).collect()}
    tot = {}
    for r in phi:
        tot[r.sample_id] = tot.get(r.sample_id, 0.0) + r.phi
    for i, s in tot.items():
        assert math.isclose(s, preds[i] - base, abs_tol=1e-9)
    # for a linear model phi_j = w_j (x_j - mean b_j) exactly, whatever the permutations
    w = model.coefficients
    bmean = [sum(r.features_arr[j] for r in rows[100:110]) / 10 for j in range(3)]
    for r in phi:
        x = rows[r.sample_id].features_arr
        assert math.isclose(r.phi, w[r.feature] * (x[r.feature] - bmean[r.feature]), abs_tol=1e-9)
