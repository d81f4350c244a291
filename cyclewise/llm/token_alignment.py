"""Alignment of two tokenizers' tokens of the same texts.

A text is encoded by both tokenizers with their spans: character offsets of
the tokenizers library, byte spans of the pieces in sentencepiece's proto.
A span that covers whole characters gives a token's end at once (the coarse
cuts); tokens that hold part of a character, and byte-fallback pieces, are
placed by the lengths of their decoded bytes. Byte positions at which tokens
of both end cut the text into groups; the two tokens that end there are linked.

Both tokenizers start a new token at a single space between two non-blanks,
so there every text is cut into chunks, and a chunk that a worker has met
before is not encoded again; new chunks of a batch are encoded as one text.

Corpus-wide counts of linked id pairs come from Spark: documents are written
in blocks that carry a dictionary of their pairs, the dictionaries are summed
by pair, and the sums go back to the blocks. A pair has one row a block, so a
frequent one is no hot key.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.llm.common import BatchMemo, slices, staged
from cyclewise.llm.token_files import TextEncoder

#: chunks whose alignment a worker keeps, some 300 bytes each
MEMO_CHUNKS = 300_000
#: documents and links of a block
BLOCK_DOCS = 4096
BLOCK_LINKS = 1 << 20


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def char_bytes(text: str) -> np.ndarray:
    """UTF-8 bytes before each character, and in all."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)])


def token_ends(start: np.ndarray, end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Byte end of each token: that of its span, or by the decoded bytes where
    the span is not as long as the token."""
    return np.where(end - start == length, end, np.cumsum(length))


class Aligner:
    """Aligns texts; both vocabularies are given by their files."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        table = byte_of_char()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
            if "▁" in p.lstrip("▁"):
                raise ValueError("the piece vocabulary joins words")
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.memo = BatchMemo(self._entries, MEMO_CHUNKS)

    def tokens(self, text: str):
        """(ids, byte ends) of both in space + text; None if a tokenizer does not give its bytes."""
        whole = " " + text
        raw = whole.encode()
        e = self.a.encode(whole, add_special_tokens=False)
        ids_a = np.array(e.ids, dtype=np.int64)
        if b"".join([self.a_bytes[i] for i in e.ids]) != raw:
            return None
        span = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        if not whole.isascii():
            span = char_bytes(whole)[span]
        pieces = [(p.id, p.begin, p.end) for p in self.b.encode(text, return_type="proto").pieces]
        ids_b, begin, end = np.array(pieces, dtype=np.int64).reshape(-1, 3).T
        if b"".join([self.b_bytes[i] for i in ids_b.tolist()]) != raw:
            return None
        begin = begin + 1
        begin[:1] = 0  # the space in front belongs to the first piece
        return ids_a, token_ends(span[:, 0], span[:, 1], self.a_len[ids_a]), ids_b, \
            token_ends(begin, end + 1, self.b_len[ids_b])

    def align(self, chunks: list[str]) -> list[tuple | None]:
        """For each chunk of the text `` ``.join(chunks): (tokens of A, tokens of
        B, groups as text, links as packed ids), None where the bytes differ."""
        got = self.tokens(" ".join(chunks))
        if got is None:
            return [None] if len(chunks) == 1 else [x for c in chunks for x in self.align([c])]
        ids_a, ends_a, ids_b, ends_b = got
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        bounds = np.cumsum([1 + len(c.encode()) for c in chunks])
        last = np.searchsorted(cuts, bounds)
        if len(cuts) == 0 or last[-1] >= len(cuts) or (cuts[last] != bounds).any():
            return [x for c in chunks for x in self.align([c])]
        links = (ids_a[at_a] << 32) | ids_b[at_b]
        name_a, name_b = [str(i) for i in ids_a.tolist()], [str(i) for i in ids_b.tolist()]
        out, i, j, g = [], 0, 0, 0
        to_a, to_b = (at_a + 1).tolist(), (at_b + 1).tolist()
        for end in (last + 1).tolist():
            first_a, first_b, first, parts = i, j, g, []
            for g in range(first, end):
                parts.append(f"{','.join(name_a[i:to_a[g]])}|{','.join(name_b[j:to_b[g]])}")
                i, j = to_a[g], to_b[g]
            g = end
            out.append((i - first_a, j - first_b, ";".join(parts).encode(), links[first:end].tobytes()))
        return out

    def _entries(self, chunks: list[str]) -> list[tuple | None]:
        out = []
        for at in range(0, len(chunks), 2000):
            out += self.align(chunks[at:at + 2000])
        return out

    def documents(self, texts: list[str]) -> list[list[tuple | None]]:
        """Entries of the chunks of each text; a text with other blanks is one chunk."""
        cut = [t.split(" ") if TextEncoder.separable(t) else None for t in texts]
        self.memo.learn([c for c in cut if c])
        known = self.memo.__getitem__
        return [list(map(known, c)) if c else (self.align([t]) if t else []) for t, c in zip(texts, cut)]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


ROWS = ("block long, is_block boolean, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "idx array<int>, cnt array<int>, pairs array<long>, totals array<long>")
_ROWS = pa.schema([("block", pa.int64()), ("is_block", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                   ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                   ("idx", pa.list_(pa.int32())), ("cnt", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())),
                   ("totals", pa.list_(pa.int64()))])
OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
_OUT = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in OUT.split(", ")])


def _block(number: int, docs: list) -> pa.RecordBatch:
    """Rows of a block: its dictionary, and documents that name links by place in it."""
    links = [np.frombuffer(d[-1], np.int64) for d in docs]
    pairs, place = np.unique(np.concatenate([*links, np.zeros(0, np.int64)]), return_inverse=True)
    cols = {n: [] for n in _ROWS.names}
    at = 0
    for (doc_id, n_a, n_b, digest, _), x in zip(docs, links):
        idx, cnt = np.unique(place[at:at + len(x)], return_counts=True)
        at += len(x)
        for n, v in zip(cols, (number, False, doc_id, n_a, n_b, len(x), digest, idx, cnt, None, None)):
            cols[n].append(v)
    if len(pairs):
        for n, v in zip(cols, (number, True, None, 0, 0, 0, "", None, None, pairs, np.bincount(place))):
            cols[n].append(v)
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _ROWS], schema=_ROWS)


def align_blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                 block_docs: int = BLOCK_DOCS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """The alignment of every document in written blocks (schema ``ROWS``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def write(batches):
        part, seq, held, links = TaskContext.get().partitionId(), 0, [], 0
        both = aligner(byte_path, piece_path)
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, entries in zip(batch.column(0).to_pylist(), both.documents(texts)):
                if not entries or None in entries:
                    held.append((doc_id, 0, 0, "", b""))
                else:
                    n_a, n_b, groups, packed = zip(*entries)
                    held.append((doc_id, sum(n_a), sum(n_b), hashlib.sha256(b";".join(groups)).hexdigest(), b"".join(packed)))
                    links += len(held[-1][-1]) // 8
                if len(held) >= block_docs or links >= block_links:
                    yield _block(part << 32 | seq, held)
                    seq, held, links = seq + 1, [], 0
        if held:
            yield _block(part << 32 | seq, held)

    return staged(rows.mapInArrow(write, ROWS), "alignment")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): how many links of the corpus join ids a and b,
    and whether no other id is linked with b more often."""
    entries = _dictionary(blocks).groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    entries = entries.withColumn("b", b).withColumn("a", F.shiftright("pair", 32))
    top = F.max("count").over(Window.partitionBy("b"))  # at most one row for each id of A
    return entries.select("pair", "a", "b", "count", (F.col("count") == top).alias("best"))


def _dictionary(blocks: DataFrame) -> DataFrame:
    own = blocks.filter("is_block").select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("pos", "e"))
    return own.select("block", "pos", F.col("e.pairs").alias("pair"), F.col("e.totals").alias("n"))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                    block_docs: int = BLOCK_DOCS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. Texts that are null, empty, or that a tokenizer does not
    give back byte for byte have no tokens: zeros and an empty digest. A null
    id stays null; every row counts, repeated ones too. Only the id and the
    text are read. An empty table gives no row."""
    blocks = align_blocks(docs, byte_path, piece_path, id_col, text_col, block_docs, block_links)
    back = _dictionary(blocks).join(pair_counts(blocks).select("pair", "count", "best"), "pair").select(
        "block", "pos", "count", "best")
    own = blocks.filter("not is_block").select(F.col("block").alias("own_block"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "idx", "cnt")

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        pos = found.column("pos").to_numpy()
        count, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        count[pos] = found.column("count").to_numpy()
        best[pos] = found.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        idx = rows.column("idx").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False))])
        flat = idx.flatten().to_numpy()
        cnt = rows.column("cnt").combine_chunks().flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (cnt * best[flat], cnt * count[flat])]
        n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
        return pa.table([rows.column("doc_id"), rows.column("n_a"), rows.column("n_b"), rows.column("n_groups"),
                         rows.column("n_groups"), pa.array(n_best), pa.array(count_sum), rows.column("groups_sha256")],
                        schema=_OUT)

    return own.groupBy("own_block").cogroup(back.groupBy("block")).applyInArrow(score, OUT)
