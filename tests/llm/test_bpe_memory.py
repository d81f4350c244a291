"""What a worker of the word encoder keeps in memory."""

import sys

from public_tokenizers import path

from cyclewise.llm import bpe as B


def test_memos_of_a_worker_are_small():
    """pipeline: six workers' memos and the JVM's heap went beyond an executor's memory."""
    enc = B.ForcedBoundaryBpe(path("word_bpe_49k.json"))
    whole = B.ForcedBoundaryBpe(path("word_bpe_49k.json"))
    for at in range(0, 200_000, 20_000):
        words = [f"w{i:x}q".encode() for i in range(at, at + 20_000)]
        enc.encode_many([b" ".join(words)])
    held = sum(map(sys.getsizeof, (enc.chunks, enc.word_ids, enc.fragment_ids)))
    held += sum(sys.getsizeof(k) + sum(map(sys.getsizeof, v[:2])) for k, v in enc.chunks.items())
    held += sum(sys.getsizeof(k) + sys.getsizeof(v) for m in (enc.word_ids, enc.fragment_ids) for k, v in m.items())
    assert held < 80 << 20
    # beyond the bounds the results are the same
    text = b" ".join(f"w{i:x}q".encode() for i in (5, 150_001, 199_999, 250_000))
    assert enc.encode_many([text]) == whole.encode_many([text])
