"""Texts that are not asked for do not pass the shuffle that finds the wanted ones."""

from pyspark.sql import functions as F

from cyclewise.llm import jaccard_join
from cyclewise.llm.common import documents
from cyclewise.llm.jaccard_join import maybe_wanted, shingles_of


def _docs(spark):
    # every tenth row lacks an id, every third repeats a text
    rows = spark.range(6000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("doc_id"),
                                    F.concat_ws(" ", F.lit("a b c"), F.floor(F.col("id") / 3).cast("string")).alias("text"))
    return documents(rows)


def test_all_wanted_rows_and_few_others_pass(spark):
    docs = _docs(spark)
    wanted = docs.filter(F.pmod("h", F.lit(20)) == 0).select(F.xxhash64("sid", "h").alias("set"), "sid", "h").distinct()
    wanted = spark.createDataFrame(wanted.collect(), wanted.schema)
    passed = maybe_wanted(docs.select("sid", "h", "text"), wanted)
    assert passed.columns == ["sid", "h", "text"]
    exact = docs.join(wanted, ["sid", "h"]).count()
    assert exact > 100 and passed.join(wanted, ["sid", "h"]).count() == exact
    assert passed.count() < exact + docs.count() / 10
    assert maybe_wanted(docs, wanted.limit(0)).count() == 0


def test_a_full_filter_loses_no_wanted_row(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 1 << 10)
    docs = _docs(spark)
    wanted = docs.select(F.xxhash64("sid", "h").alias("set"), "sid", "h").distinct()
    found = shingles_of(docs, spark.createDataFrame(wanted.collect(), wanted.schema), 3)
    assert found.count() == docs.count() and found.filter(F.size("shingles") != 2).isEmpty()
