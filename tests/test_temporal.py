"""T3-T6 on hand-made engines; halo chunking equals plain windows."""
import math
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from cyclewise.operators.temporal import add_temporal, causality_audit, degradation_features


def _tiny(spark):
    # two engines, rows shuffled (the reference's unit-test frame)
    rows = [Row(dataset="d", engine_id=2, cycle=2, sensor_1=5.0), Row(dataset="d", engine_id=1, cycle=3, sensor_1=3.0),
            Row(dataset="d", engine_id=1, cycle=1, sensor_1=1.0), Row(dataset="d", engine_id=2, cycle=1, sensor_1=4.0),
            Row(dataset="d", engine_id=1, cycle=2, sensor_1=2.0), Row(dataset="d", engine_id=2, cycle=3, sensor_1=7.0)]
    return spark.createDataFrame(rows)


def test_first_rows_are_zero(spark):
    out = add_temporal(_tiny(spark), ["sensor_1"], 5, second=True).orderBy("engine_id", "cycle").collect()
    by = {(r.engine_id, r.cycle): r for r in out}
    assert len(out) == 6
    for e in (1, 2):
        assert by[(e, 1)].sensor_1_diff1 == 0.0
        assert by[(e, 1)].sensor_1_diff2 == 0.0
        assert by[(e, 2)].sensor_1_diff2 == 0.0
        assert by[(e, 1)].sensor_1_roll_std5 == 0.0
    assert by[(2, 3)].sensor_1_diff1 == 2.0
    assert by[(2, 3)].sensor_1_diff2 == 1.0
    assert math.isclose(by[(2, 3)].sensor_1_roll_mean5, 16.0 / 3)


def test_chunked_equals_single_chunk(spark):
    rnd = random.Random(3)
    rows = [Row(dataset="d", engine_id=e, cycle=c, sensor_1=rnd.random()) for e in (1, 2, 3)
            for c in range(1, 1 + (40 if e == 1 else 7))]
    df = spark.createDataFrame(rows)
    a = {(r.engine_id, r.cycle): r for r in add_temporal(df, ["sensor_1"], 5, True, chunk=6).collect()}
    b = {(r.engine_id, r.cycle): r for r in add_temporal(df, ["sensor_1"], 5, True).collect()}
    assert a.keys() == b.keys() and len(a) == len(rows)
    for k in a:
        for f in ("sensor_1_diff1", "sensor_1_roll_mean5", "sensor_1_roll_std5", "sensor_1_diff2"):
            assert math.isclose(a[k][f], b[k][f], abs_tol=1e-12), (k, f)


def test_causality_audit_passes(spark):
    rnd = random.Random(5)
    rows = [Row(dataset="d", engine_id=e, cycle=c, sensor_1=rnd.random()) for e in (1, 2) for c in range(1, 30)]
    out = causality_audit(spark.createDataFrame(rows), ["sensor_1"], 5, 0.5, second=True).collect()
    assert out and all(r.violations == 0 for r in out)


def test_each_dataset_gets_the_features_of_its_own_sensors(spark):
    rnd = random.Random(9)
    rows = []
    for d, good in (("a", "s1"), ("b", "s2"), ("only_test", "s1")):
        for split, e in (("train", 1), ("test", 2)):
            if d == "only_test" and split == "train":
                continue
            for c in range(1, 31):
                v = {s: rnd.random() for s in ("s1", "s2", "s3")}
                v[good] = float(c * c)
                rows.append(Row(dataset=d, split=split, engine_id=e, cycle=c, regime_id=0, rul=30 - c, **v))
    df = spark.createDataFrame(rows)
    out, sel = degradation_features(df, ["s1", "s2", "s3"], top_n=1, per_regime=1, second=True)
    assert sorted((r.dataset, r.sensor, r.pick) for r in sel.collect()) == [("a", "s1", 1), ("b", "s2", 1)]
    assert "s3_diff1" not in out.columns
    got = out.collect()
    assert len(got) == len(rows)
    plain = {(r.dataset, r.engine_id, r.cycle): r for r in add_temporal(df, ["s1", "s2"], 5, True).collect()}
    for r in got:
        p = plain[(r.dataset, r.engine_id, r.cycle)]
        for s in ("s1", "s2"):
            for n in ("diff1", "roll_mean5", "roll_std5", "diff2"):
                mine = {"a": "s1", "b": "s2"}.get(r.dataset) == s
                assert r[f"{s}_{n}"] == (p[f"{s}_{n}"] if mine else None)
