"""Chat formatting: round trips, masks against a plain version, edge rows."""
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as vocabulary

from cyclewise.llm import chat

BPE = vocabulary("byte_bpe_50k.json")
ODD = st.text(alphabet=st.sampled_from(list("ab \n\\<>/turn é😀\u2581")) | st.characters(codec="utf-8"), max_size=30) | \
    st.lists(st.sampled_from(["<turn>", "</turn>", "</turn>\n", "\\", "\\n", "\n", "x", "<|endoftext|>"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ODD | st.just("assistant"), ODD), max_size=5))
def test_any_role_and_text_survives_and_the_mask_is_exact(turns):
    text, spans = chat.render(turns)
    assert list(chat.parse(text)) == turns
    e = chat.encoder(BPE).encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    mask, shared = chat.align(offsets[:, 0], offsets[:, 1], spans)
    learnt = {i for s, t in spans for i in range(s, t)}
    assert mask.tolist() == [bool(learnt & set(range(a, b))) for a, b in e.offsets]
    assert [chat.unescape(text[a:b]) for a, b in shared] == [t for r, t in turns if r == "assistant" and t]


def expected(rows):
    out = {}
    for conv, _, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(),
                sum(len(x) for r, x in t if r == "assistant"),
                hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest(),
                len(chat.render(t)[0])) for c, t in out.items()}


SCHEMA = "conv_id long, turn long, role string, text string, c int, h string, part int, ids int, loss string"


@pytest.mark.parametrize("piece", [40, chat.PIECE_CHARS])
def test_table(spark, piece):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </turn>\n<turn>user\nb \\ <|endoftext|> é😀"), (1, 2, "user", None),
            (1, 3, "assistant", ""), (1, 4, "assistant", " lead and trail \n\n"),
            (2, None, None, "no turn, no role"), (2, 7, "assistant\n", "not learnt"), (2, 8, "assistant", "same"),
            (None, 1, "user", "no id"), (None, 2, "assistant", "none"),
            (3, 0, "assistant", "word " * 60_000), *[(4, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]]
    rows += [(5, 1, "assistant", "twice"), (5, 1, "assistant", "twice")]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA).repartition(5)
    formatted = chat.format_chats(df, BPE, piece_chars=piece)
    got = {r.conv_id: tuple(r)[1:6] for r in chat.chat_digests(formatted).collect()}
    assert got == expected(rows)
    if piece == 40:
        assert formatted.filter("conv_id = 4").select("part").distinct().count() > 1  # a long conversation is spread
    for r in formatted.filter("conv_id = 1").collect():
        assert len(r.ids) == len(r.loss)
        assert chat.encoder(BPE).decode(list(r.ids), skip_special_tokens=False) == r.text


def test_turns_with_one_number_and_empty_tables(spark):
    rows = [(1, 0, "user", x) for x in ("a", "b", "c")]
    one = chat.chat_digests(chat.format_chats(spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA), BPE))
    two = chat.chat_digests(chat.format_chats(spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows[::-1]], SCHEMA), BPE))
    assert one.collect() == two.collect() and one.first().n_turns == 3
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], SCHEMA), BPE)).collect() == []


def test_probe(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    got = chat.chat_digests(chat.format_chats(chat.probe(spark), BPE)).first()
    assert tuple(got)[1:6] == expected(rows)[-7]
