"""Queries of a family of texts just below the threshold ask its groups in several passes."""

import random

import pytest
from pyspark.sql import functions as F

from cyclewise.llm import jaccard_join


def _family(n=60, words=120, swapped=14, seed=5):
    """Texts that each swap some words of one text: alike, but few of them linked."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), swapped if i % 6 else 1):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    return rows + [rows[3], rows[7], (None, rows[9][1])]  # repeats


def _brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[(i, t)] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
    lead = {x: x for x in sets}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    keys = list(sets)
    for a in keys:
        for b in keys:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                lead[root(a)] = root(b)
    parts = {}
    for x in keys:
        parts.setdefault(root(x), []).append(1 << 60 if x[0] is None else x[0])
    return {x: min(parts[root(x)]) for x in keys}


@pytest.mark.parametrize("k, percent", [(3, 80), (2, 70)])
def test_passes_find_the_same_links(spark, monkeypatch, k, percent):
    rows = _family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, staged = [], jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name="llm": names.append(name) or staged(df, name))
    monkeypatch.setattr(jaccard_join, "ASK_ROWS", 1)
    monkeypatch.setattr(jaccard_join, "ASK_ROWS_EACH", 0.25)
    got = jaccard_join.jaccard_components(docs, k, percent).join(docs.distinct(), "doc_id").collect()
    want = _brute(rows, k, percent)
    assert names.count("asks") > 2  # the rows of one pass are bounded, not those of all
    assert {r.doc_id: r.component_id for r in got} == {i: c for (i, _), c in want.items() if i is not None}


def test_passes_grow_with_the_rows_of_the_queries(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ASK_ROWS", 100)
    for sets, passes in ((4, 1), (200, 34)):  # 10 tokens that all sets have, each set a group of its own
        tokens = spark.range(10).crossJoin(spark.range(sets).withColumnRenamed("id", "set")).withColumnRenamed("id", "token")
        found = jaccard_join.ask_passes(tokens, tokens.select("token", F.col("set").alias("q")), tokens)
        assert found == passes
