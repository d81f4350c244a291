"""Every operator against a brute-force version, on one small table with the
awkward rows: nulls, empty and long texts, repeated rows, repeated ids, other
blanks, and extra columns whose names the operators use themselves."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F

from cyclewise.llm import bpe, fingerprints, jaccard_join, mixing, quality, substring_dedup, token_counts, token_files
from cyclewise.llm import topk, url_filter
from cyclewise.llm.common import Memo, shared_folder

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(400)] + ["The", "the", "don't", "naïve", "ÉTÉ", "!!", "日本"]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    passage, base = prose(70), prose(120)
    out = [(i, prose(rng.choice([3, 20, 80, 150])), f"s{i % 3}") for i in range(12)]
    out += [(20 + i, f"{prose(30)} {passage} {prose(i)}", "s1") for i in range(4)]
    for i in range(6):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(120)] = f"x{i}"
        out.append((30 + i, " ".join(w), None))
    out += [(40, base, "s0"), (40, base, "s0"), (40, passage, "s2"), (None, base, "s0"), (None, None, None),
            (41, "", "s1"), (42, None, "s1"), (43, " \t a\n\n b  c d <|endoftext|>x ", "s2"),
            (44, "z" * 3000, "s2"), (45, prose(5000), "s0"), (46, "one two", "s9"), (47, "ONE  two", "s9"),
            (48, "same " * 200, "s1"), (49, "same " * 130, "s1")]
    return out


@pytest.fixture(scope="module")
def table():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)
    clash = {c: F.lit(7) for c in ("sid", "h", "set", "token", "block", "range", "next", "label", "start", "n", "tie")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(text):
    return (text or "").encode().split()


def test_token_files_round_trip(spark, docs, table, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    folder = shared_folder(spark, "token-files")
    manifest = token_files.write_token_files(docs, folder, vocabulary("byte_bpe_50k.json"), frame_tokens=100,
                                             file_bytes=500)
    got = sorted(token_files.document_digests(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([d for d, _, _ in table if d is not None]) + [None, None]
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in table}
    want = sorted((d or 1 << 60, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t, _ in table)
    assert sorted((r.doc_id or 1 << 60, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got]))[:-1]
    some = token_files.read_documents(manifest, [45, 3, 999]).collect()
    assert {r.doc_id: r.ids for r in some} == {d: ids[t] for d, t, _ in table if d in (45, 3)}
    assert token_files.token_file_digests(spark, empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_files_are_plain_zstandard_and_checked(spark, docs):
    import zstandard
    manifest = token_files.write_token_files(docs, shared_folder(spark, "token-files"),
                                             vocabulary("byte_bpe_50k.json"))
    row = manifest.filter("n_docs > 0").first()
    path = row.path.removeprefix("file:")
    with open(path, "rb") as f:
        whole = f.read()
    plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert len(plain) == 2 * row.n_tokens
    damaged = path + ".damaged"
    with open(damaged, "wb") as f:  # another checksum for the first frame
        at = len(whole) - 9 - 12 * len(token_files.FileReader(path).frames) + 8
        f.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1:])
    with pytest.raises(ValueError, match="frame 0 is damaged"):
        list(token_files.FileReader(damaged).document(0))


def test_token_counts(docs, table, empty):
    path = vocabulary("piece_bpe_32k.model")
    opening, following = map(set, token_counts.pieces(path))

    def greedy(word):
        """Longest pieces from the left: the first one opens the word (the bare
        mark, the empty string here, may), then following ones, or one a byte."""
        end = max(e for e in range(len(word) + 1) if word[:e] in opening)
        n = 1
        while end < len(word):
            to = next((e for e in range(len(word), end, -1) if word[end:e] in following), None)
            n += 1 if to else len(word[end].encode())
            end = to or end + 1
        return n

    assert "" in opening
    want = []
    for d, t, _ in table:
        counts = [greedy(w.decode()) for w in split(t)]
        want.append((-1 if d is None else d, len(counts), sum(counts), 0))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in token_counts.token_counts(docs, path).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_longest_match_links():
    match = token_counts.LongestMatch(["a", "abcd", "ab"], ["b", "c", "cd", "bcx", "e"])
    assert [match.count(w) for w in ("abcd", "abce", "abcx", "abcdcd", "abx", "b")] == [1, 3, None, 2, None, None]


def test_bpe(docs, table, empty):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for d, t, _ in table:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((d is None, d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = [(r[0] is None, r[0] or 0, *r[1:]) for r in bpe.encode_digests(docs, path).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_long_fragment_merges_alike():
    enc = bpe.bpe(vocabulary("word_bpe_49k.json"))
    word = "".join(rng.choice("thean") for _ in range(300))
    assert [t for f in enc.fragments(word) for t in enc.merge(f)] == [enc.token[i] for i in enc.ids(word)]


def test_substring_dedup(docs, table, empty):
    first = {}
    for d, t, _ in table:
        w = split(t)
        for i in range(len(w) - 49):
            k = tuple(w[i:i + 50])
            first[k] = min(first.get(k, math.inf), math.inf if d is None else d)
    want = []
    for d, t, _ in table:
        w, keep = split(t), [True] * len(split(t))
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < (math.inf if d is None else d):
                keep[i:i + 50] = [False] * 50
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        want.append((d is None, d or 0, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()))
    got = [(r[0] is None, r[0] or 0, *r[1:]) for r in substring_dedup.dedup_digests(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[3] for r in want) > 500
    texts = substring_dedup.kept_texts(docs)
    assert texts.columns == docs.columns
    assert {r.text for r in texts.filter("doc_id = 43").collect()} == {t for d, t, _ in table if d == 43}
    assert substring_dedup.dedup_substrings(empty).count() == 0 and substring_dedup.kept_texts(empty).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, table, empty, k, percent):
    sets = []
    for _, t, _ in table:
        w = split((t or ""))
        w = [x.lower() for x in w]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(b)] = find(a)
    small = {}
    for i, (d, _, _) in enumerate(table):
        small[find(i)] = min(small.get(find(i), math.inf), math.inf if d is None else d)
    want = sorted((-1 if d is None else d, len(sets[i]), -1 if small[find(i)] == math.inf else small[find(i)])
                  for i, (d, _, _) in enumerate(table))
    got = jaccard_join.jaccard_components(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == want
    if k == 3:
        assert jaccard_join.jaccard_components(empty).count() == 0


def test_linked_sets_share_a_token():
    draw = np.random.default_rng(4)
    for percent in (80, 90):
        for _ in range(1500):
            n = int(draw.integers(1, 120))
            a = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.1],
                                          draw.integers(0, 1 << 62, int(draw.integers(0, 1 + n // 8))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            ta, fa = jaccard_join.tokens_of(a, percent)
            tb, fb = jaccard_join.tokens_of(b, percent)
            shared = len(np.intersect1d(ta, tb))
            assert shared >= 1
            apart = (len(a) + len(b)) * (100 - percent) // (100 + percent)
            assert shared >= max(fa, fb) - apart


def test_fingerprints(docs, table, empty):
    got = fingerprints.fingerprint_edits(docs, scale=1).collect()
    assert len(got) == len(table)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    ids = sorted(d for d, _, _ in table if d is not None)
    text = {d: t or "" for d, t, _ in table}
    prints = {r.doc_id: r for r in got}
    for a, b in zip(ids, ids[1:]):
        if ids.count(a) > 1 or ids.count(b) > 1:
            continue
        n, half = len(text[a]), len(text[a]) // 2
        edited = text[a][:n - half] + text[b][:half]
        assert prints[a].n_chars == n
        assert prints[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def shingles(t):
            w = split(t)
            return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

        x, y = shingles(text[a]), shingles(edited)
        if x or y:
            assert prints[a].near_edited == pytest.approx(len(x & y) / len(x | y))
        by_text.setdefault(text[a], set()).add(prints[a].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint_edits(empty).count() == 0
    sole = fingerprints.fingerprint_edits(docs.filter("doc_id = 46")).first()
    assert sole.near_next == 1.0


def test_top_k(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, draw.normal(size=8).tolist()) for i in range(200)] + [(300 + i, [1.0] * 8) for i in range(30)]
    vectors += [(None, [1.0] * 8), (400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [2.0, 1.0]),
                (20, [0.5] * 8), (320, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("block", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).filter("query_id <> 20").collect()
    fine = [(i, np.array([math.floor(64 * x) for x in v] + [0] * (8 - len(v)))) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in fine if i % 20 == 0} - {20}):
        v = next(v for i, v in fine if i == q)
        want = sorted((-int(v @ c), i) for i, c in fine if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id = 300"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e7])
def test_top_k_of_large_vectors_is_exact(spark, size):
    draw = np.random.default_rng(3)
    vectors = [(i, (size * draw.normal(size=8)).tolist()) for i in range(150)] + [(200, [size] * 8), (201, [size] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()
    exact = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors]
    for q, v in exact:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in exact if i != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    if size == 1e7:
        with pytest.raises(Exception, match="does not fit 64 bits"):
            topk.top_k(df.union(spark.createDataFrame([(300, [1e8] * 8)], df.schema)), F.col("vec_id") == 300).collect()


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    html = "<p>fresh news daily bread " * 30 + "</p>"
    pages = [(1, "http://A.Example.com/en/x?q#f"), (2, "https://www.example.com/en/x"), (3, "http://notexample.com/en/"),
             (4, "http://example.com"), (5, None), (6, "no scheme"), (7, "http://freshnews.org/daily/12"),
             (8, "http://casinonews.org/a"), (9, "ftp://mycasino.net?x/"), (None, "http://freshbread.org/b"), (3, "://")]
    df = spark.createDataFrame([(i, u, html) for i, u in pages], "page_id long, url string, html string")
    got = {(r.page_id, r.host): r for r in url_filter.filter_urls(df.withColumn("word", F.lit(1)), rules).collect()}
    assert len(got) == len(pages)
    assert (got[1, "a.example.com"].path, got[1, "a.example.com"].rule) == ("/en/x", "example.com/en/")
    assert got[2, "www.example.com"].verdict == "allow" and got[3, "notexample.com"].rule == "com/"
    assert got[4, "example.com"].rule is None and got[5, ""].path == "" and got[6, ""].path == ""
    assert got[7, "freshnews.org"].words[:2] == ["fresh", "news"] and got[7, "freshnews.org"].verdict == "allow"
    assert got[8, "casinonews.org"].verdict == "block" and got[9, "mycasino.net"].verdict == "block"
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.classify_quality(docs, labels).join(labels, "doc_id")
    held = scored.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held >= 0.95
    known = scored.select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in known)


def test_quality_edge_rows(docs, table, empty):
    labels = docs.filter("doc_id < 12").select("doc_id", F.lit(1).alias("quality"))
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 and r.predicted == 1 for r in got)
    assert quality.classify_quality(empty, labels).count() == 0
    assert quality.classify_quality(docs, labels.limit(0)).filter("score = 0.5").count() == len(table)


def test_mixing(docs, table, empty):
    got = mixing.mix_sources(docs, block_words=8, shard_slots=64).collect()
    again = mixing.mix_sources(docs.repartition(5), block_words=8, shard_slots=64).collect()
    assert len(got) == len(table)
    key = lambda r: tuple((x is None, x or 0) for x in (r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert all(r.taken <= 2 * r.size for r in got)
    names = sorted({s for _, _, s in table if s}) + [None]
    sizes = [sum(len(split(t)) for _, t, s in table if s == n) for n in names]
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert sum(want) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(want, sizes))
    for n, s, t in zip(names, sizes, want):
        mine = [r for r in got if r.source == n]
        assert {r.source_size for r in mine} == {s} and mine[0].target == pytest.approx(t)
        assert sum(r.taken for r in mine) == pytest.approx(t, abs=max(16, 0.03 * t))
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_shards_and_permutation():
    totals = np.array([500, 30, 0, 170])
    parts = [mixing.shard_counts(s, 11, 64, totals, 5) for s in range(11)]
    assert sum(p[1] for p in parts).tolist() == totals.tolist()
    assert [int(p[1].sum()) for p in parts] == [64] * 10 + [60]
    assert all((a[0] + a[1] == b[0]).all() for a, b in zip(parts, parts[1:]))
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_memo_is_bounded():
    memo = Memo(len, 2)
    assert [memo[w] for w in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1] and len(memo) == 2
