"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that start a word and
one for pieces that continue it. A failure link leads from a node to the node
reached after the longest pieces at its front are taken off; the number of
those pieces is stored with the link. Reading a word follows each character
once and adds up popped counts, so its greedy longest-match length comes out
without building a piece. The word-start mark alone is a piece too: the root of
the opening pieces then links to that of the others. Where no piece begins, a
character is spelled by its byte pieces.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from cyclewise.llm.common import Memo, batch_of, byte_column, documents, slices

WORD_START = "▁"
START, CONTINUE = 0, 1


class LongestMatch:
    """``starts`` and ``continues``: the pieces that may open a word and those
    that may follow; an empty start is the word-start mark alone. With
    ``spelled`` a character at which no piece begins counts as its UTF-8 bytes.
    ``count(word)`` is the number of pieces of the greedy longest-match split,
    or None if there is none."""

    def __init__(self, starts, continues, spelled: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]
        self.spelled = spelled
        piece = [0, 0]  # pieces that a node stands for
        for root, pieces in ((START, starts), (CONTINUE, continues)):
            for p in filter(None, pieces):
                at = root
                for c in p:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(0)
                    at = self.next[at][c]
                piece[at] = 1
        if spelled:
            for c in {c for edges in self.next for c in edges}:
                v = self.next[CONTINUE].setdefault(c, len(self.next))
                if v == len(self.next):
                    self.next.append({})
                    piece.append(0)
                piece[v] = piece[v] or len(c.encode())
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        if "" in starts:
            self.link[START], self.popped[START] = CONTINUE, 1
        queue = deque((root, c, v) for root in (START, CONTINUE) for c, v in self.next[root].items())
        while queue:
            parent, c, v = queue.popleft()
            if piece[v]:
                self.link[v], self.popped[v] = CONTINUE, piece[v]
            else:
                z, pops = self.link[parent], self.popped[parent]
                while z >= 0 and c not in self.next[z]:
                    pops += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.next[z][c], pops
            queue.extend((v, d, w) for d, w in self.next[v].items())

    def count(self, word: str) -> int | None:
        step, link, popped = self.next, self.link, self.popped
        at, n = START, 0
        for c in word:
            while c not in step[at]:
                if link[at] < 0:
                    break
                n += popped[at]
                at = link[at]
            if c in step[at]:
                at = step[at][c]
            elif at == CONTINUE and self.spelled:
                n += len(c.encode())
            else:
                return None
        while at != CONTINUE:
            if link[at] < 0:
                return None
            n += popped[at]
            at = link[at]
        return n


def pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-opening and continuing pieces of a sentencepiece file, its ordinary
    ones: the word-start mark is taken off the opening ones, which leaves an
    empty string of the mark alone; a mark that a text itself holds can be
    inside any piece."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in usual if p.startswith(WORD_START)], usual


def has_bytes(path: str) -> bool:
    """Whether a sentencepiece file has a piece for every byte."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(map(sp.is_byte, range(sp.get_piece_size()))) == 256


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*pieces(path), has_bytes(path))


COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"
COUNTS_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_tokens", "n_unknown")])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words (runs without space, tab or line ends), word pieces, and
    words without a split, each of which counts as one piece (none where the
    vocabulary has the mark alone and all bytes). A null text has none; each row
    gives one row; an empty table gives no rows."""

    def run(batches):
        match = automaton(vocabulary_path)
        memo = Memo(lambda w: match.count(w.decode()) or 0)
        for batch in slices(batches, 256):
            out = {f.name: [] for f in COUNTS_ARROW}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_column(batch)):
                counts = list(map(memo.__getitem__, (text or b"").split()))
                unknown = counts.count(0)
                for k, v in zip(out, (doc_id, len(counts), sum(counts) + unknown, unknown)):
                    out[k].append(v)
            yield batch_of(COUNTS_ARROW, out)

    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, COUNTS)
