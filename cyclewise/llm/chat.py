"""Chat formatting with offset-aligned loss masks.

Conversations are rendered whole, encoded once, and the token offsets are
intersected with the spans of the turns: both are sorted, so two binary
searches a turn give its tokens. A token is under the loss mask if it shares
a character with an assistant's text; the shared characters are kept beside
it, so the masked text is exact even where a token also covers a marker.

Template, for each turn: ``<turn>`` role line-feed text ``</turn>`` line-feed.
Inside roles and texts a backslash and the two markers get a backslash in
front, and a line feed inside a role becomes a backslash and ``n``; reading
takes these back, so any role and text survives.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.llm.common import shared_folder

# Fixed strings of the template.
OPEN, CLOSE = "<turn>", "</turn>"
LEARNT_ROLES = ("assistant",)
#: characters of a rendered piece; a longer conversation takes several pieces, cut between turns
PIECE_CHARS = 1 << 20
#: rows an Arrow batch may hold; texts can be long
BATCH_ROWS = 512

_SPECIAL = re.compile(r"\\|</?turn>")
_ESCAPED = re.compile(r"\\(\\|</?turn>|n)")
_MARK = re.compile(r"\\(?:\\|</?turn>)|<turn>|</turn>\n")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text) if "\\" in text or "turn>" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def render(turns: list[tuple[str, str]], learnt=LEARNT_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans of the texts to learn, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role in learnt and body:
            spans.append((at, at + len(body)))
        out += [head, body, f"{CLOSE}\n"]
        at += len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of a rendered piece."""
    start = None
    for m in _MARK.finditer(text):
        if m[0] == OPEN:
            start = m.end()
        elif m[0][0] != "\\":
            role, _, body = text[start:m.start()].partition("\n")
            yield unescape(role), unescape(body)


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]):
    """Mask of the tokens that share a character with a span, and the shared
    characters as sorted intervals (adjoining ones of a span are joined).
    Token starts and ends ascend, as do the spans."""
    mask, shared = np.zeros(len(starts), dtype=bool), []
    if not spans:
        return mask, shared
    lows = np.searchsorted(ends, [s for s, _ in spans], side="right")
    highs = np.searchsorted(starts, [e for _, e in spans], side="left")
    for (s, e), lo, hi in zip(spans, lows.tolist(), highs.tolist()):
        mask[lo:hi] = True
        a, b = np.maximum(starts[lo:hi], s), np.minimum(ends[lo:hi], e)
        cuts = np.flatnonzero(a[1:] > np.maximum.accumulate(b)[:-1]) + 1
        for part_a, part_b in zip(np.split(a, cuts), np.split(b, cuts)):
            if len(part_a):
                shared.append((int(part_a[0]), int(part_b.max())))
    return mask, shared


@lru_cache(maxsize=2)
def encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    tok.no_truncation()
    tok.no_padding()
    return tok


FORMATTED = ("conv_id long, part int, seq int, text string, ids array<int>, loss array<boolean>, "
             "loss_start array<int>, loss_end array<int>")
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("text", pa.string()),
                        ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
                        ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])


def format_chats(conversations: DataFrame, tokenizer_path: str, folder: str | None = None, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text", learnt=LEARNT_ROLES,
                 piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Render, encode and mask all conversations; the result is a Parquet table
    in ``folder`` (a new one in the shared folder), read back: conv_id, (part,
    seq) as the order of its pieces, text, ids, loss (one flag a token),
    loss_start and loss_end (the characters under the mask).

    Rows are dealt by ranges of (conversation, turn), so a conversation with
    many turns is spread over tasks and split into pieces; so is one of more
    than ``piece_chars`` characters. Pieces are cut between turns.

    A null role or text is empty. Null turns come first; turns with one number
    are ordered by a hash of role and text, and equal rows all count. Rows
    without a conversation id form one conversation with a null id. Only the
    four named columns are read. An empty table gives an empty result."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    rows = rows.withColumn("h", F.xxhash64("r", "x"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "c", "t", "h").sortWithinPartitions("c", "t", "h").select("c", "r", "x")

    def encode(pieces, part):
        tok = encoder(tokenizer_path)
        rendered = [render(turns, learnt) for _, _, turns in pieces]
        out = {n: [] for n in _FORMATTED.names}
        for (c, seq, _), (body, spans), e in zip(
                pieces, rendered, tok.encode_batch([b for b, _ in rendered], add_special_tokens=False)):
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            mask, shared = align(offsets[:, 0], offsets[:, 1], spans)
            for n, v in zip(out, (c, part, seq, body, e.ids, mask, [a for a, _ in shared], [b for _, b in shared])):
                out[n].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _FORMATTED], schema=_FORMATTED)

    def write(batches):
        part = TaskContext.get().partitionId()
        ready, held, current, turns, size, seq = [], 0, None, [], 0, 0
        for batch in batches:
            for c, r, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if turns and (c != current or size >= piece_chars):
                    ready.append((current, seq, turns))
                    held, seq, turns, size = held + size, seq + 1, [], 0
                    if len(ready) >= BATCH_ROWS or held >= piece_chars:
                        yield encode(ready, part)
                        ready, held = [], 0
                current = c
                turns.append((r, x))
                size += len(r) + len(x)
        if turns:
            ready.append((current, seq, turns))
        if ready:
            yield encode(ready, part)

    folder = folder or shared_folder(spark, "chats")
    ordered.mapInArrow(write, FORMATTED).write.parquet(folder)
    return spark.read.schema(FORMATTED).parquet(folder)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, n_loss_tokens long")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted table alone: turns parsed back from
    the text and the unescaped text under the mask. Pieces of a conversation
    pass through one task in order, one at a time (a digest of a whole text
    is sequential)."""
    pieces = formatted.select("conv_id", "part", "seq", "text", F.size("ids").alias("n"),
                              F.expr("size(filter(loss, x -> x))").alias("m"), "loss_start", "loss_end")
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def digest(batches):
        key, state = None, None

        def row():
            return {"conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_tokens": state[5],
                    "n_loss_tokens": state[6]}

        for batch in batches:
            done = []
            for b in batch.to_pylist():
                if state is None or b["conv_id"] != key:
                    if state is not None:
                        done.append(row())
                    key, state = b["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(b["text"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, e in zip(b["loss_start"], b["loss_end"]):
                    text = unescape(b["text"][a:e])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(b["text"])
                state[5] += b["n"]
                state[6] += b["m"]
            if done:
                yield pa.RecordBatch.from_pylist(done, _DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], _DIGEST)

    return dealt.mapInArrow(digest, DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                     ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are made of control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")
