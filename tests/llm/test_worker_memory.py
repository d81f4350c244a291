"""Workers give memory back that a finished task or the parsed vocabulary no longer needs."""

import subprocess
import sys

import pytest

from cyclewise.llm import common

CODE = """
import resource
import numpy as np
from public_tokenizers import path
from cyclewise.llm.bpe import bpe
def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() >> 20
import tokenizers
before = resident()
enc = bpe(path("word_bpe_49k.json"))
print(resident() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_the_parsed_vocabulary_is_handed_back():
    out = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 50


def test_memory_is_handed_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "hand_back", lambda: seen.append("back"))

    def run(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert list(common.handing_back(run)(iter([1, 2]))) == [1, 2]
    assert seen == [1, 2, "back"]


HASHES = """
import sys, tracemalloc
import numpy as np
from cyclewise.llm.common import word_hashes
tracemalloc.start()
for k in range(20):
    word_hashes([b"word-%d-%d" % (k, i) for i in range(10_000)])
print(tracemalloc.get_traced_memory()[0] >> 10)
"""


def test_hashed_words_are_not_kept():
    out = subprocess.run([sys.executable, "-c", HASHES], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500  # KB
    assert common.word_hashes([b"", b"a", "é".encode()]).tolist() == [common.xxhash.xxh3_64_intdigest(w) for w in
                                                                      (b"", b"a", "é".encode())]
