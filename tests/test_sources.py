"""Snapshots, truth files of several splits, missing truth, schema helpers."""
import os

import pytest
from pyspark.sql import functions as F

from cyclewise.functions import columns as C
from cyclewise.operators.labels import attach_truth
from cyclewise.sources import io, snapshots


def test_a_writer_stopped_between_parts_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.latest(spark, path) is None
    first = snapshots.publish(spark, path, {"a": spark.range(3), "b": spark.range(5)})
    pinned = snapshots.load(spark, path)
    broken = spark.range(1).select(F.raise_error(F.lit("stopped")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stopped"):
        snapshots.publish(spark, path, {"a": spark.range(30), "b": broken})
    assert snapshots.latest(spark, path) == first and snapshots.load(spark, path)["a"].count() == 3
    (tmp_path / "store" / "pointer-00000002").write_text("half a na")  # a pointer that was not finished
    assert snapshots.latest(spark, path) == first
    second = snapshots.publish(spark, path, {"a": spark.range(4), "b": spark.range(6)})
    assert snapshots.latest(spark, path) == second and (tmp_path / "store" / "pointer-00000003").exists()
    assert pinned["b"].count() == 5 and snapshots.load(spark, path, first)["b"].count() == 5
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, str(tmp_path / "none"))


def test_truth_lines_keep_their_numbers_over_splits(spark, tmp_path):
    values = [(i * 37) % 251 for i in range(4000)]
    path = tmp_path / "RUL.txt"
    path.write_text("".join(f"{v} \n" + ("\n" if i % 7 == 0 else "") for i, v in enumerate(values)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(path)).select("_metadata.file_block_start").distinct().count() > 10
        got = {r.position: r.rul for r in io.read_rul(spark, str(path), "d").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i + 1: v for i, v in enumerate(values)}
    empty = tmp_path / "empty.txt"
    empty.write_text("\n \n")
    assert io.read_rul(spark, str(empty), "d").collect() == []


def test_missing_truth_is_named(spark):
    test = spark.createDataFrame([("d", 3), ("d", 8)], "dataset string, engine_id long")
    truth = spark.createDataFrame([("d", 1, 40)], "dataset string, position long, rul int")
    assert sorted((r.engine_id, r.rul) for r in attach_truth(test, truth).collect()) == [(3, 40), (8, None)]
    with pytest.raises(Exception, match="no truth for engine d 8"):
        attach_truth(test, truth, required=True).collect()
    whole = truth.union(spark.createDataFrame([("d", 2, 7)], truth.schema))
    assert sorted((r.engine_id, r.rul) for r in attach_truth(test, whole, required=True).collect()) == [(3, 40), (8, 7)]


def test_schema_helpers(spark):
    names = ["engine_id", "regime_onehot_1", "sensor_2", "sensor_11_diff1", "sensor_11", "my_sensor_x", "sensor_2_roll_mean5",
             "sensor_2_diff2", "sensor_2_roll_other", "regime_onehot_0", "regime_id"]
    assert C.sensor_columns(names) == ["sensor_2", "sensor_11_diff1", "sensor_11", "sensor_2_roll_mean5", "sensor_2_diff2",
                                       "sensor_2_roll_other"]
    assert "my_sensor_x" in C.sensor_columns(names, substring=True)
    assert C.raw_sensor_columns(names) == ["sensor_2", "sensor_11"]
    assert C.base_sensor_columns(names) == ["sensor_2", "sensor_11", "sensor_2_roll_other"]
    assert C.feature_columns(names) == ["regime_id", *C.sensor_columns(names), "regime_onehot_0", "regime_onehot_1"]
    df = spark.createDataFrame([(1, 2, "3")], "engine_id int, sensor_2 int, sensor_11 string")
    cast = C.cast_sensors(df, C.raw_sensor_columns(df))
    assert cast.dtypes == [("engine_id", "int"), ("sensor_2", "double"), ("sensor_11", "double")]
    assert tuple(cast.first()) == (1, 2.0, 3.0)


def test_few_regimes_do_not_deal_the_readings(spark):
    """Joined by a shuffle on the regime, one task read all readings of a regime."""
    from cyclewise.operators import regimes as R
    df = spark.range(60).selectExpr("'d' AS dataset", "id % 20 AS engine_id", "concat('k', id % 3) AS regime_key",
                                    "double(id) AS z")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lab = R.with_regime_id(df)
        for out in (lab, R.silhouette(lab, ["z"], "regime_id"), R.calinski_harabasz(lab, ["z"], "regime_id")):
            assert "Broadcast" in out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in lab._jdf.queryExecution().executedPlan().toString()
        assert {(r.regime_key, r.regime_id) for r in lab.collect()} == {("k0", 0), ("k1", 1), ("k2", 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
