"""SURVEY §5 edge cases: all-null and constant sensors, zero std inside a
regime, tied correlations, tied k votes."""
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise.operators import profile as P
from cyclewise.operators import regimes as R
from cyclewise.operators.drift import to_long
from cyclewise.operators.temporal import select_degradation_sensors


def _flat(spark):
    schema = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("split", T.StringType()),
                           T.StructField("engine_id", T.LongType()), T.StructField("cycle", T.IntegerType()),
                           T.StructField("regime_id", T.IntegerType())] +
                          [T.StructField(s, T.DoubleType()) for s in ("s_const", "s_null", "s_low", "s_ok", "s_reg")])
    rows = []
    for i in range(40):
        reg = i % 2
        rows.append(("d", "train", 1 + i // 20, 1 + i % 20, reg, 5.0, None, 1.0 + (i % 2) * 0.01, float(i),
                     3.0 if reg == 0 else float(i)))
    return spark.createDataFrame(rows, schema)


def test_constant_null_low_variance(spark):
    df = _flat(spark)
    long = to_long(df, ["s_const", "s_null", "s_low", "s_ok", "s_reg"], ("dataset", "split"))
    got = {r.sensor: r.dropped_as for r in P.sensors_to_drop(long).collect()}
    assert got == {"s_const": "constant", "s_null": None, "s_low": "low_variance", "s_ok": None, "s_reg": None}


def test_zero_std_inside_one_regime_divides_by_one(spark):
    df = _flat(spark)
    params = R.fit_regime_scalers(to_long(df, ["s_reg"], ("dataset", "regime_id")))
    out = R.apply_regime_scalers(df, params, ["s_reg"]).filter("regime_id = 0").select("s_reg").collect()
    assert all(r.s_reg == 0.0 for r in out)           # (3 - 3) / 1, no division error


def test_unseen_regime_is_an_error(spark):
    df = _flat(spark)
    params = R.fit_regime_scalers(to_long(df.filter("regime_id = 0"), ["s_ok"], ("dataset", "regime_id")))
    try:
        R.apply_regime_scalers(df, params, ["s_ok"])
    except ValueError as e:
        assert "[1]" in str(e)
        return
    raise AssertionError("expected ValueError")


def test_tied_correlations_keep_column_order(spark):
    rows = []
    for c in range(1, 11):
        rows.append(Row(dataset="d", regime_id=0, rul=float(10 - c), a=float(c), b=float(c), c=float(-c), z=0.0))
    df = spark.createDataFrame(rows)
    sensors = ["z", "b", "a", "c"]
    long = to_long(df, sensors, ("dataset", "regime_id", "rul")).withColumn(
        "sensor_order", F.array_position(F.array(*[F.lit(s) for s in sensors]), F.col("sensor")) - 1)
    picks = [r.sensor for r in select_degradation_sensors(long, 3, 6).orderBy("pick").collect()]
    assert picks == ["b", "a", "c"]                    # |corr| ties -> table order; z (constant) -> 0


def test_tied_vote_goes_to_first_voter(spark):
    # silhouette -> 3, Davies-Bouldin -> 4, Calinski-Harabasz -> 4, elbow -> 3: tie 2-2, silhouette voted first
    rows = [Row(dataset="d", clusters=2, inertia=100.0, silhouette=0.1, davies_bouldin=0.9, calinski_harabasz=1.0),
            Row(dataset="d", clusters=3, inertia=90.0, silhouette=0.9, davies_bouldin=0.5, calinski_harabasz=9.0),
            Row(dataset="d", clusters=4, inertia=10.0, silhouette=0.5, davies_bouldin=0.1, calinski_harabasz=10.0),
            Row(dataset="d", clusters=5, inertia=9.0, silhouette=0.2, davies_bouldin=0.8, calinski_harabasz=2.0)]
    r = R.vote_k(spark.createDataFrame(rows)).collect()[0]
    assert (r.silhouette, r.davies_bouldin, r.calinski_harabasz, r.elbow) == (3, 4, 4, 3)
    assert r.recommended_k == 3
