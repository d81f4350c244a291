"""ordered_scan = row_number / running sum, also with a hot key split over pieces."""
import random

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from cyclewise.functions.scan import ordered_scan


def test_scan_matches_window(spark):
    rnd = random.Random(11)
    rows = [Row(k=("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}"), t=i, w=rnd.randint(0, 3))
            for i in range(3000)]
    df = spark.createDataFrame(rows)
    got = {r.t: (r.seq, r.cum) for r in
           ordered_scan(ordered_scan(df, ["k"], ["t"], out="seq", pieces=16, hot_rows=500), ["k"], ["t"], weight="w",
                        out="cum", pieces=16, hot_rows=500).collect()}
    w = Window.partitionBy("k").orderBy("t")
    exp = {r.t: (r.seq, r.cum) for r in df.select(
        "t", F.row_number().over(w).alias("seq"),
        F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum")).collect()}
    assert got == exp


def test_hot_path_on_driver_table(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    got = ordered_scan(li, ["l_suppkey"], order, out="cycle", hot_rows=300)   # most suppliers are "hot"
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    exp = li.withColumn("cycle", F.row_number().over(w))
    key = ["l_suppkey", *order, "cycle"]
    assert got.select(*key).exceptAll(exp.select(*key)).count() == 0
    assert got.count() == exp.count() == 60000
