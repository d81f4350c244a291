"""BPE encoding and decoding by forced boundaries.

A merge only ever builds a vocabulary token, so two neighbouring bytes that
never stand next to each other inside any token can never end up in one:
between them a cut is certain. Each word is cut at such pairs, the fragments
are merged on their own, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cyclewise.llm.common import (BatchMemo, Memo, batch_of, byte_column, documents, hand_back, handing_back,
                                  slices)


#: chunks whose result a worker keeps, some 400 bytes each: the workers of an
#: executor share its memory with a JVM that earlier stages have filled
MEMO_CHUNKS = 150_000
#: words and fragments of them that a worker keeps, some 250 bytes each
MEMO_PARTS = 60_000


class ForcedBoundaryBpe:
    """Encoder and decoder for a BPE vocabulary file of the tokenizers library
    that marks word ends by a suffix. The file's normaliser and splitter are
    applied through the library; the merging is done here."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        self.inner = {pair for t in self.vocab for s in [self.symbols(t)] for pair in zip(s, s[1:])}
        by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.chunks = BatchMemo(self._chunks, MEMO_CHUNKS)
        self.word_ids = Memo(self._word, MEMO_PARTS)
        self.fragment_ids = Memo(self._fragment, MEMO_PARTS)

    def symbols(self, token: str) -> list[str]:
        """One symbol per byte; the last carries the word-end mark if the token does."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        s, inner = self.symbols(word + self.suffix), self.inner
        cuts = [i for i, p in enumerate(zip(s, s[1:]), 1) if p not in inner]
        return [tuple(s[a:b]) for a, b in zip([0, *cuts], [*cuts, len(s)])]

    def merge(self, s: Sequence[str]) -> list[str]:
        """Apply the merges in order of rank, leftmost first: by scanning, in a
        long fragment by a heap over a linked list."""
        n, ranks = len(s), self.ranks
        if n <= 64:
            none, s = len(ranks), list(s)
            r = [ranks.get(p, none) for p in zip(s, s[1:])]
            while r and (best := min(r)) < none:
                i = r.index(best)
                s[i] += s.pop(i + 1)
                r.pop(i)
                if i < len(r):
                    r[i] = ranks.get((s[i], s[i + 1]), none)
                if i:
                    r[i - 1] = ranks.get((s[i - 1], s[i]), none)
            return s
        s, after, before = list(s), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], s[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[k]))
            if (p := before[i]) >= 0 and (r := ranks.get((s[p], s[i]))) is not None:
                heapq.heappush(heap, (r, p, s[p], s[i]))
        return [x for x in s if x]

    def _fragment(self, s: tuple[str, ...]) -> list[int]:
        vocab = self.vocab
        return [vocab[t] for t in self.merge(s) if t in vocab]

    def _word(self, word: str) -> list[int]:
        return [i for f in self.fragments(word) for i in self.fragment_ids[f]]

    def _plain(self, text: str) -> list[int]:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [i for w, _ in self.splitter.pre_tokenize_str(text) for i in self.word_ids[w]]

    def ids(self, text: str) -> list[int]:
        """ids of any text; strings of added tokens are those tokens."""
        if self.special_at is None:
            return self._plain(text)
        return [i for k, part in enumerate(self.special_at.split(text)) if part
                for i in ([self.special[part]] if k % 2 else self._plain(part))]

    def _finish(self, ids: list[int]) -> tuple[bytes, str, int]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.token[i] for i in ids]), len(ids)

    def _chunks(self, chunks: list[bytes]) -> list[tuple[bytes, str, int]]:
        """Results of many chunks; they pass the normaliser and the splitter
        as one text, but for those with an added token or another blank, which
        the normaliser makes a common one, at an end of the chunk too."""
        texts = [c.decode() for c in chunks]
        out = [self._finish(self.ids(t)) if t.split() != [t] or any(a in t for a in self.special) else None
               for t in texts]
        joint = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(joint), 2000):
            part = joint[at:at + 2000]
            text = " ".join([texts[k] for k in part])
            text = self.normalizer.normalize_str(text) if self.normalizer else text
            ends = [m.start() for m in re.finditer(" ", text)] + [len(text)]
            if len(ends) != len(part):
                raise ValueError("the normaliser changed the number of blanks")
            ids: list[list[int]] = [[] for _ in part]
            k = 0
            for word, (start, _) in self.splitter.pre_tokenize_str(text):
                while start >= ends[k]:
                    k += 1
                ids[k].extend(self.word_ids[word])
            for j, x in zip(part, ids):
                out[j] = self._finish(x)
        return out

    def encode_many(self, texts: list[bytes]) -> list[list[tuple[bytes, str, int]]]:
        """(ids, decoded text, token count) of each chunk between blanks, for
        each text; no token of such a vocabulary spans a blank."""
        cut = [t.split() for t in texts]
        self.chunks.learn(cut)
        return [list(map(self.chunks.__getitem__, c)) for c in cut]


@lru_cache(maxsize=2)
def bpe(path: str) -> ForcedBoundaryBpe:
    enc = ForcedBoundaryBpe(path)
    hand_back()  # the parsed file takes more than the encoder
    return enc


ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                           ("decoded", pa.string())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                          ("decoded_sha256", pa.string())])


def _map(docs: DataFrame, path: str, id_col: str, text_col: str, arrow: pa.Schema, ddl: str, finish) -> DataFrame:
    def run(batches):
        enc = bpe(path)
        for batch in slices(batches, 128):
            out = {f.name: [] for f in arrow}
            texts = enc.encode_many([t or b"" for t in byte_column(batch)])
            for doc_id, chunks in zip(batch.column("doc_id").to_pylist(), texts):
                row = (doc_id, sum(c[2] for c in chunks), *finish(b"".join([c[0] for c in chunks]),
                                                                    " ".join([c[1] for c in chunks if c[2]])))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield batch_of(arrow, out)

    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(handing_back(run), ddl)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: token count, ids (little-endian unsigned 32 bits) and the text
    decoded from them. A null text is empty; every row gives one row, ids and
    nulls in the id column unchanged; an empty table gives no rows."""
    return _map(docs, path, id_col, text_col, ENCODED_ARROW, ENCODED, lambda ids, text: (ids, text))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and text."""
    return _map(docs, path, id_col, text_col, DIGEST_ARROW, DIGEST,
                lambda ids, text: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
