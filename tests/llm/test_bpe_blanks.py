"""Chunks with blanks other than ASCII at their ends, alone and among others."""

import numpy as np
import pytest
from public_tokenizers import path as vocabulary

from cyclewise.llm import bpe

PATH = vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("blank", ["\u00a0", "\u3000", "\u2003", "\u0085", "\u2028", "\x1c"])
def test_blanks_at_the_ends_of_chunks(blank):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(PATH), bpe.ForcedBoundaryBpe(PATH)
    odd = [f"{blank}abc", f"abc{blank}", f"{blank}abc{blank}", f"a{blank}b", blank]
    lists = [[o] for o in odd] + [[o, "foo"] for o in odd] + [["foo", o] for o in odd] + [["foo", o, "bar"] for o in odd] + [odd]
    for chunks in lists:
        got = enc._chunks([c.encode() for c in chunks])
        assert [g[0] for g in got] == [np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks]


def test_query_over_texts_that_begin_or_end_with_them(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    texts = ["\u3000\u3000日本 文章", "\u00a0abc", "foo abc\u00a0", "\u00a0", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode_decode(docs, PATH).collect()}
    assert got == {i: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in enumerate(texts)}
