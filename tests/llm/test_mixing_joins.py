"""Tables that grow with the corpus are never broadcast, however small they are."""

import re

from pyspark.sql import functions as F

from cyclewise.llm.mixing import Mix


def _broadcast_keys(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan
    return re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)


def test_blocks_and_documents_are_not_broadcast(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat("id", 30)).alias("text"),
                                   F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    mix = Mix(docs, block_words=8, shard_slots=64)
    for df in (mix.taken(), mix.texts(docs)):
        # only the names of the sources, at most MAX_SOURCES rows
        for keys in _broadcast_keys(df):
            assert not re.search(r"\b(block|bucket|span|copy|sid|_sid)#", keys), keys
