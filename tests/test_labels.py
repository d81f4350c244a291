from cyclewise.operators.labels import with_rul
from cyclewise.session import stage


def test_rul_does_not_shuffle_the_readings_while_maxima_are_small(spark):
    """a task read all that one mapper had shuffled."""
    readings = stage(spark.range(1000).selectExpr("'d' AS dataset", "id % 7 AS engine_id", "CAST(id / 7 AS INT) AS cycle"))
    rul = with_rul(readings, max_rul=None)
    plan = rul._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert rul.count() == 1000
    assert rul.filter("rul + cycle <> 142 - CAST(engine_id = 6 AS INT)").count() == 0
