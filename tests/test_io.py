"""Blank-run separated telemetry text and positional truth files."""
import os
import tempfile

import pytest
from pyspark.sql import Row

from cyclewise.operators.labels import attach_truth
from cyclewise.sources import io


def test_read_telemetry_runs_of_blanks(spark):
    d = tempfile.mkdtemp(prefix="cw-raw-")
    with open(os.path.join(d, "train_X.txt"), "w") as f:
        f.write("1 1  -0.0007 -0.0004 100.0 518.67   641.82\n")
        f.write("1   2 0.0019 -0.0003 100.0 518.67 642.15  \n")
        f.write("\n")
        f.write(" 2 1 -0.0043 0.0003 100.0 518.67 642.35\n")
    cols = ["engine_id", "cycle", "setting_1", "setting_2", "setting_3", "sensor_1", "sensor_2"]
    rows = io.read_telemetry(spark, d, "X", "train", cols).orderBy("engine_id", "cycle").collect()
    assert [(r.engine_id, r.cycle) for r in rows] == [(1, 1), (1, 2), (2, 1)]
    assert rows[0].setting_1 == -0.0007 and rows[1].sensor_2 == 642.15 and rows[2].setting_1 == -0.0043


def test_truth_positions_and_alignment(spark):
    d = tempfile.mkdtemp(prefix="cw-rul-")
    with open(os.path.join(d, "RUL_X.txt"), "w") as f:
        f.write("112 \n98 \n69 \n")
    truth = io.read_rul(spark, d, "X")
    assert [(r.position, r.rul) for r in truth.orderBy("position").collect()] == [(1, 112), (2, 98), (3, 69)]
    test = spark.createDataFrame([Row(dataset="X", engine_id=e, cycle=1) for e in (7, 3, 11)])
    got = {r.engine_id: r.rul for r in attach_truth(test, truth).collect()}
    assert got == {3: 112, 7: 98, 11: 69}           # i-th smallest engine id gets line i
    io.assert_rul_alignment(test, truth)
    short = spark.createDataFrame([Row(dataset="X", engine_id=e, cycle=1) for e in (3, 7)])
    with pytest.raises(ValueError):
        io.assert_rul_alignment(short, truth)
