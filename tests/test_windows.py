"""Windows on engines of 3, 50 and 53 cycles; closed-form multiplicity vs explode."""
import math

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from cyclewise.operators import windows as W


def _edge(spark):
    rows = [Row(dataset="d", engine_id=e, cycle=c, sensor_1=float(c), rul=n - c)
            for e, n in ((1, 3), (2, 50), (3, 53)) for c in range(1, n + 1)]
    return spark.createDataFrame(rows)


def test_window_counts_and_padding(spark):
    out = W.sliding_windows(_edge(spark), ["sensor_1"], 50, 1).collect()
    per = {}
    for r in out:
        per.setdefault(r.engine_id, []).append(r)
    assert len(per[1]) == 1 and len(per[2]) == 1 and len(per[3]) == 4
    short = per[1][0]
    assert len(short.x) == 50 and short.x[:47] == [[0.0]] * 47 and short.x[47:] == [[1.0], [2.0], [3.0]]
    assert short.y == 0
    last = sorted(per[3], key=lambda r: r.end_cycle)[-1]
    assert [v[0] for v in last.x] == [float(c) for c in range(4, 54)]


def test_last_and_truncated(spark):
    df = _edge(spark)
    lw = {r.engine_id: r for r in W.last_windows(df, ["sensor_1"], 50).collect()}
    assert lw[1].x[-1] == [3.0] and len(lw[1].x) == 50 and lw[3].end_cycle == 53
    tw = {(r.engine_id, r.cutoff): r for r in W.truncated_windows(df, ["sensor_1"], (0.8,), 50).collect()}
    assert tw[(3, 0.8)].end_cycle == 50 and tw[(1, 0.8)].end_cycle == 3


def test_scaler_weights_match_explode(spark):
    rows = []
    rnd = np.random.default_rng(0)
    for e, n in ((1, 4), (2, 9), (3, 12)):
        for c in range(1, n + 1):
            rows.append(Row(dataset="d", engine_id=e, cycle=c, sensor_1=float(rnd.normal())))
    df = spark.createDataFrame(rows)
    w, step = 5, 2
    got = W.window_scaler(df, ["sensor_1"], w, step).collect()[0]
    cells = []
    for e in (1, 2, 3):
        xs = [r.sensor_1 for r in sorted((r for r in rows if r.engine_id == e), key=lambda r: r.cycle)]
        if len(xs) < w:
            cells += [0.0] * (w - len(xs)) + xs
        else:
            for s in range(0, len(xs) - w + 1, step):
                cells += xs[s:s + w]
    assert math.isclose(got.mean, float(np.mean(cells)), abs_tol=1e-12)
    assert math.isclose(got.std, float(np.std(cells)), abs_tol=1e-12)


def test_group_kfold_balanced(spark):
    rows = [Row(dataset="d", engine_id=e, cycle=c) for e in range(1, 23) for c in range(1, 5 + e)]
    folds = W.group_kfold(spark.createDataFrame(rows), 5).collect()
    assert len({r.engine_id for r in folds}) == 22
    sizes = [0] * 5
    for r in folds:
        sizes[r.fold] += 1
    assert max(sizes) - min(sizes) <= 1


def test_sliding_windows_chunked_equal_unchunked(spark):
    rnd = np.random.default_rng(3)
    rows = [Row(dataset="d", engine_id=e, cycle=c, sensor_1=float(rnd.normal()), rul=n - c)
            for e, n in ((1, 130), (2, 20), (3, 61)) for c in range(1, n + 1)]
    df = spark.createDataFrame(rows)
    a = {(r.engine_id, r.end_cycle): r.x for r in W.sliding_windows(df, ["sensor_1"], 50, 1, chunk=60).collect()}
    b = {(r.engine_id, r.end_cycle): r.x for r in W.sliding_windows(df, ["sensor_1"], 50, 1).collect()}
    assert a == b and len(a) == 81 + 1 + 12


def test_hot_engine_is_split_after_a_keyed_join(spark):
    """Chunks of one engine lie in several tasks even where a join has dealt the rows by engine."""
    from cyclewise.functions.scan import chunk_frames
    from cyclewise.operators.temporal import add_temporal
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1, 401).selectExpr("'d' AS dataset", "7 AS engine_id", "cast(id AS int) AS cycle",
                                            "cast(id % 13 AS double) AS s1")
        n = df.groupBy("dataset", "engine_id").agg(F.max("cycle").alias("n"))
        joined = df.join(n, ["dataset", "engine_id"])
        tasks = chunk_frames(joined, "cycle", 4, 20).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
        feats = add_temporal(joined, ["s1"], chunk=20)
        assert feats.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        plain = add_temporal(joined, ["s1"], chunk=10_000)
        cols = ["cycle", "s1_diff1", "s1_roll_mean5", "s1_roll_std5"]
        assert sorted(map(tuple, feats.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tails_of_one_engine_meet_no_single_task(spark):
    """W3-W5 deal a hot engine by chunk, and a window over a chunk's border is put together."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1, 2001).selectExpr("'d' AS dataset", "7 AS engine_id", "cast(id AS int) AS cycle",
                                             "cast(id AS double) AS s1", "cast(2000 - id AS int) AS rul").unionByName(
            spark.range(1, 8).selectExpr("'d' AS dataset", "8 AS engine_id", "cast(id AS int) AS cycle",
                                         "cast(id AS double) AS s1", "cast(7 - id AS int) AS rul"))
        ends = spark.createDataFrame([("d", 7, e) for e in (30, 100, 125, 701, 1500, 2000)] + [("d", 8, 7)],
                                     "dataset string, engine_id int, end_cycle int")
        out = W.windows_at(df, ends, ["s1"], 50, chunk=100)
        got = {(r.engine_id, r.end_cycle): (r.y, [v[0] for v in r.x]) for r in out.collect()}
        assert len(got) == 7
        for (engine, end), (y, x) in got.items():
            want = [float(max(c, 0)) for c in range(end - 49, end + 1)]
            assert x == want and y == (2000 if engine == 7 else 7) - end
        assert out.filter("engine_id = 7").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        rows = df.select("dataset", "engine_id", "cycle", W._chunk_of(F.col("cycle"), 100).alias("_chunk"))
        asked = ends.select("dataset", "engine_id", W._chunk_of(F.col("end_cycle"), 100).alias("_chunk")).distinct()
        met = rows.join(asked, ["dataset", "engine_id", "_chunk"]).filter("engine_id = 7")
        assert met.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
