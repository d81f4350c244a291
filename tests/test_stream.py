"""Streaming: the gate step by step against the batch gate, windowed rollups."""
import random

from cyclewise.operators.gate import drift_gate
from cyclewise.streaming import engine_stream as K
from tests.test_gate import CASES


def test_gate_decides_as_soon_as_the_prefix_is_whole(spark):
    """After every step: decisions of just the whole prefix of each gate, equal to the batch gate's, and the
    rest waits. Batches come in any order, some twice, the gates side by side."""
    rnd = random.Random(4)
    rows = [("d", g, i, c) for g, (counts, _) in CASES.items() for i, c in enumerate(counts)]
    want = {(r.severity, r.batch_index): r for r in drift_gate(spark.createDataFrame(rows, K.GATE_WAITING)).select(
        *K._names(K.GATE_OUT)).collect()}
    rnd.shuffle(rows)
    state, waiting = spark.createDataFrame([], K.GATE_STATE), spark.createDataFrame([], K.GATE_WAITING)
    seen, got, sent = set(), {}, []
    for at in range(0, len(rows), 9):
        new = rows[at:at + 9] + rnd.sample(sent, min(2, len(sent)))
        sent += rows[at:at + 9]
        decided, state, waiting = K.gate_step(spark.createDataFrame(new, K.GATE_WAITING).unionByName(waiting), state)
        got |= {(r.severity, r.batch_index): r for r in decided.collect()}
        state, waiting = K.stage(state), K.stage(waiting)
        seen |= {(g, i) for _, g, i, _ in new}
        prefix = {(g, i) for g, i in seen if all((g, j) in seen for j in range(i))}
        assert set(got) == prefix
        assert {(r.severity, r.batch_index) for r in waiting.collect()} == seen - prefix
        assert all(got[k] == want[k] for k in got)
    assert got == want


def test_rollup_independent_of_session_time_zone(spark):
    import __spark_entry__ as entry
    q = entry.queries()["stream_rollup_tumbling"]
    tz = spark.conf.get("spark.sql.session.timeZone")
    try:
        a = q(spark, "/root/testdata/sf0.001").orderBy("engine_id", "window_start").collect()
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        b = q(spark, "/root/testdata/sf0.001").orderBy("engine_id", "window_start").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)
    assert a and a == b


def test_rollups_return_every_window_over_several_epochs(spark, tmp_path):
    from pyspark.sql import functions as F
    from cyclewise.streaming import engine_stream as K
    path = str(tmp_path / "events")
    rows = spark.range(60).select((F.col("id") % 3).alias("engine_id"), F.timestamp_seconds(F.col("id") * 900).alias("ts"),
                                  F.col("id").cast("double").alias("value"))
    for part in (rows.filter("value < 25"), rows.filter("value >= 25")):
        part.coalesce(1).write.mode("append").parquet(path)
    keys = ["engine_id", "window_start", "window_end"]
    for kind, mode in (("tumbling", "update"), ("sliding", "update"), ("session", "complete")):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = K.windows_to_table(K.stream_rollup(stream, kind), kind, keys, mode)
        assert sorted(got.collect()) == sorted(K.stream_rollup(rows, kind).collect())
        empty = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")).filter("value < 0")
        assert K.windows_to_table(K.stream_rollup(empty, kind), kind, keys, mode).isEmpty()
