"""Token alignment against a plain version over whole texts."""
import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as vocabulary

from cyclewise.llm import token_alignment as T

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain(text):
    """(ids of A, ids of B, groups) of one text by decoded bytes alone."""
    both = T.aligner(A, B)
    if not text:
        return [], [], []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    if not all(b"".join(t[i] for i in ids) == (" " + text).encode() for t, ids in ((both.a_bytes, a), (both.b_bytes, b))):
        return [], [], []
    groups, x, y, i, j, fa, fb = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            x += len(both.a_bytes[a[i]])
            i += 1
        else:
            y += len(both.b_bytes[b[j]])
            j += 1
        if x == y:
            groups.append((a[fa:i], b[fb:j]))
            fa, fb = i, j
    return a, b, groups


def expected(rows):
    each = [plain(t or "") for _, t in rows]
    counts = Counter((ga[-1], gb[-1]) for _, _, gs in each for ga, gb in gs)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (doc, _), (a, b, gs) in zip(rows, each):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        links = [(x[-1], y[-1]) for x, y in gs]
        out.append((-1 if doc is None else doc, len(a), len(b), len(gs), len(gs), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out)


ODD = st.text(alphabet=st.sampled_from(list("ab \n\t é😀ßñ中▁́ 　's<|>")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_chunks_give_what_whole_texts_give(texts):
    both = T.aligner(A, B)
    for text, entries in zip(texts, both.documents(texts)):
        a, b, gs = plain(text)
        if not entries or None in entries:
            assert gs == []
            continue
        assert (sum(e[0] for e in entries), sum(e[1] for e in entries)) == (len(a), len(b))
        assert b";".join(e[2] for e in entries).decode() == ";".join(
            f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)


def rows():
    texts = ["the same words " * 5, "the same words " * 5, "Señor ñandú, 中文 text 😀😀 and 12345", "", None, " ", "▁mark",
             "double  space and\ttab", " hard", "x", "<|endoftext|> <unk> </s> plain", "long word " * 30_000, "é" * 500]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (3, "an id twice")]


SCHEMA = "doc_id long, text string, block int, pair long, count int, idx string, n int, best int"


@pytest.mark.parametrize("size", [2, T.BLOCK_DOCS])
def test_table(spark, size):
    data = [(*r, 1, 2, 3, "x", 4, 5) for r in rows()]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = [tuple(-1 if v is None else v for v in r) for r in T.align_documents(df, A, B, block_docs=size).collect()]
    assert sorted(got) == expected(rows())


def test_empty_table_and_texts_without_tokens(spark):
    assert T.align_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    only = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(T.align_documents(only, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
