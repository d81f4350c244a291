"""Collocations against a plain version over whole texts."""
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cyclewise.llm import collocations as C

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=C.LEAST, longest=C.LONGEST, best=C.BEST):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(100 * b >= 100 * a and lang == l2 and len(q) > len(p)
               and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(xs)[:best]))


SCHEMA = "doc_id long, lang string, text string, phrase long, n string, f int, word int, size int, range int, a string"


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, t, 1, "x", 2, 3, 4, 5, "y") for i, (lang, t) in enumerate(rows)], SCHEMA)


def data():
    import random
    rnd = random.Random(5)
    words = ["New", "York", "city", "of", "the", "Ärger", "été", "a\x01", "a", "x'y", "中文"]
    rows = [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choices(words, k=rnd.randint(0, 30)))
             + rnd.choice([". ", "\n", "\t", "!"]) + "New York city  of, the\x0b") for _ in range(400)]
    return rows + [("en", None), ("en", ""), ("fr", "only here"), ("en", "big apple pie " * 20_000), ("en", "x x x x x x")] * 2


def test_matches_the_plain_version(spark):
    rows = data()
    for least, longest in ((100, 5), (25, 3)):
        got = sorted(map(tuple, C.collocations(frame(spark, rows).repartition(7), least, longest).collect()))
        assert got == plain(rows, least, longest) and len(got) > 10
    # a filter with hardly a bit lets everything pass: same counts
    assert sorted(map(tuple, C.collocations(frame(spark, rows), filter_bits=1).collect())) == plain(rows)


def test_best_and_exact_arithmetic(spark):
    got = sorted(map(tuple, C.collocations(frame(spark, data()), 25, best=3).collect()))
    assert got == plain(data(), 25, best=3)
    big = 3 * 10 ** 12
    row = spark.sql(f"SELECT (cast(1000 as decimal(38,0)) * cast({big}L as decimal(38,0)) * cast({big}L as decimal(38,0))) "
                    f"div (cast({big - 7}L as decimal(38,0)) * cast({big - 3}L as decimal(38,0))) AS s").first()
    assert row.s == 1000 * big * big // ((big - 7) * (big - 3))


def test_empty(spark):
    assert C.collocations(frame(spark, []).limit(0)).collect() == []
    assert C.collocations(frame(spark, [("en", None), ("en", "too few words")])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5).map(tuple), st.integers(1, 5)), max_size=30),
       st.sets(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5).map(tuple), max_size=20))
def test_automata(items, wanted):
    total = Counter()
    for words, n in items:
        total[words] += n
    auto = C.Automaton.load(C.Automaton.of(items).dump())
    assert len(set(auto.states)) == len(auto.states)
    got = dict(C.Automaton.of([(w, 1) for w in wanted]).compose(auto))
    assert got == {" ".join(w): total[w] for w in wanted if w in total}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, (1 << C.HASH_BITS) - 1), st.integers(1, 1 << 40), min_size=1, max_size=50))
def test_packed_blocks(counts):
    import numpy as np
    h = np.array(sorted(counts), dtype=np.uint64)
    n = np.array([counts[x] for x in h.tolist()], dtype=np.uint64)
    out = {}
    for r, block in C._packed(h, n, 34):
        keys, values = C._unpacked(block)
        assert set((keys >> np.uint64(34)).tolist()) == {r}
        out.update(zip(keys.tolist(), values.tolist()))
    assert out == counts
