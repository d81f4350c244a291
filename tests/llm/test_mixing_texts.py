"""The texts of a mix: clashing names, repeated rows, long and empty texts, empty tables."""

from cyclewise.llm.mixing import Mix

NAMES = ("sid", "h", "copy", "parts", "_source", "_sid", "_h", "_doc", "_of", "times", "block")
ROWS = [(1, "one two three", "a"), (1, "one two three", "a"), (2, "w " * 5_000, "b"), (3, None, "a"), (4, "", None),
        (5, "alone", None), (None, "no id here", "a"), (None, "other text", "a")]


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(*r, *[i] * len(NAMES)) for i, r in enumerate(ROWS)],
                               "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES))
    mix = Mix(df, block_words=4, shard_slots=8)
    out = mix.texts(df)
    assert out.columns == df.columns
    rows = out.collect()
    taken = {}
    for r in mix.taken().collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    got = {}
    for r in rows:
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}
    assert all(ROWS[r.sid][0] == r.doc_id for r in rows)  # other columns come from a row of that document
    assert sorted(map(str, out.collect())) == sorted(map(str, mix.texts(df.repartition(3)).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Mix(df).texts(df).collect() == []
