"""Chunks of texts: a known one is looked up once, new ones go to the library together."""

import re

import numpy as np
from public_tokenizers import path as vocabulary

from cyclewise.llm.common import BatchMemo
from cyclewise.llm.token_files import OTHER_BLANKS, TextEncoder


def test_a_known_word_is_looked_up_once():
    class Counted(BatchMemo):
        lookups = 0

        def get(self, *a):
            Counted.lookups += 1
            return super().get(*a)

    memo = Counted(lambda words: [w.upper() for w in words], 2)
    assert memo.values_of([["a", "b", "a"], [], ["c"]]) == [["A", "B", "A"], [], ["C"]]
    assert len(memo.extra) == 1  # beyond the limit: kept for the batch alone
    assert memo.values_of([["c", "a"], ["d", "b"]]) == [["C", "A"], ["D", "B"]]
    Counted.lookups = 0
    assert memo.values_of([sorted(set(memo) - set(memo.extra)) * 3]) and Counted.lookups == 6


def test_blanks_are_all_but_space_and_line_feed():
    assert set(OTHER_BLANKS) == {c for c in map(chr, range(0x110000)) if re.fullmatch(r"[^\S \n]", c)}


def test_ids_are_those_of_the_library():
    enc = TextEncoder(vocabulary("byte_bpe_50k.json"))
    texts = ["one two,\nthree's don't 12 34", "", " x", "x ", "a  b", "a\tb c", "né\xa0 à la", f"a {enc.added[0]} b{enc.added[0]} c",
             f"{enc.added[0]}x y", "日本 語", "one", "a 　b", "one two, Ωx"]
    want = [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):
        assert enc.encode_many(texts) == want
    alone = []
    enc._ids = lambda t: alone.append(t) or b""
    enc.encode_many(["one two", "three four"])
    assert alone == []
