"""Phrase collocations from weighted acyclic automata.

* Every task turns its documents into count transducers: the word n-grams of a
  batch, sorted, become automaton states level by level (a state is a prefix
  and a next word, its weight a count), batches are united, and the shard is
  written as sorted n-grams with weights.
* Shards are united by prefix range: the n-grams are dealt by ranges of
  (language, phrase), weights of equal n-grams are summed, those below the
  least count go. From the sorted rest each range builds its automaton
  incrementally, sharing equal suffix states.
* The counts of all parts of all candidates come from composing an automaton
  of the wanted parts of a range with the range's count automaton.

A phrase with the least count has only parts with the least count. So the
words are counted first, then the pairs whose words both pass, by a 64-bit
hash alone, and at last, exactly, the phrases whose pairs all pass. The tests
are bit sets of fixed size that tasks carry; a false pass, or pairs that share
a hash, cost work, never a count.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.llm.common import mix64, slices, staged

LEAST = 100
LONGEST = 5
BEST = 2000
NO_LANG = "und"
#: bits of the filter that tasks carry (2 MB)
FILTER_BITS = 24
#: n-grams a task unites before it writes them
SHARD_STATES = 300_000
#: pair hashes a task unites before it sends them, 16 bytes each
SHARD_PAIRS = 3_000_000
#: bits of a pair's hash; pairs that share them are counted together and may pass for nothing
HASH_BITS = 40
#: leading bits of a hash that name its range; a task sends one block a range, whatever the cluster's size
RANGE_BITS = 11
BATCH_ROWS = 512

BREAK = b"\xff"  # a byte that UTF-8 never uses


def _folding() -> bytes:
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    table[0x09] = 0x20
    for end in b".,;:!?\x0a\x0b\x0c\x0d":
        table[end] = BREAK[0]
    return bytes(table)


FOLD = _folding()


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Lower-cased words of texts, BREAK between pieces and texts."""
    return BREAK.join(texts).translate(FOLD).replace(BREAK, b" \xff ").split()


# -- filter ---------------------------------------------------------------------

def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of each word and the next one."""
    return mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes[1:]))


class Filter:
    """A bit set of hashes, by their low bits."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        s = hashes & np.uint64((1 << self.bits) - 1)
        return (self.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> "Filter":
        """The filter of the rows' ``h``; its words, at most 2^bits / 64, come to the driver."""
        slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
        got = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 & {(1 << bits) - 1}L as int))")
                            .alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toPandas()
        words = np.zeros(max(1, (1 << bits) >> 6), dtype=np.uint64)
        words[got["word"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).view(np.uint64)
        return cls(bits, words)


def hashed_words(counts: DataFrame) -> DataFrame:
    """``h`` of the (lang, phrase) rows, all of one word."""

    def hashes(batches):
        for b in batches:
            rows: dict = {}
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.setdefault(lang, []).append(word.encode())
            for lang, words in rows.items():
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(lang.encode(), words).view(np.int64))], names=["h"])

    return counts.select("lang", "phrase").mapInArrow(hashes, "h long")


# -- shards ---------------------------------------------------------------------

class Tokens:
    """The words of some texts of a language by number, in byte order; ``fine``
    marks the positions whose word passes."""

    def __init__(self, texts: list[bytes], lang: bytes, words: Filter | None = None):
        tokens = tokens_of(texts)
        self.vocabulary = sorted(set(tokens))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        fine = np.array([w != BREAK for w in self.vocabulary], dtype=bool)
        self.hashes = None
        if words is not None:
            each = word_hashes(lang, self.vocabulary)
            fine &= words.passes(each)
            self.hashes = each[self.ids] if len(self.ids) else each
        self.fine = fine[self.ids] if len(self.ids) else fine

    def pairs(self) -> np.ndarray:
        """Where a pair of words that pass starts."""
        return np.flatnonzero(self.fine[:-1] & self.fine[1:])


def transducer(tokens: Tokens, sizes: tuple[int, ...], pairs: Filter | None = None
               ) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """States of the wanted sizes with their weights, one level after the other.

    Words are numbered in byte order, so the sorted codes (prefix state, next
    word) of a level are its n-grams in order. Longer n-grams are followed
    where all their pairs pass."""
    ids, vocabulary = tokens.ids, tokens.vocabulary
    v = len(vocabulary)
    if 1 in sizes:
        weights = np.bincount(ids[tokens.fine], minlength=v)
        keep = np.flatnonzero(weights)
        yield [vocabulary[i] for i in keep.tolist()], weights[keep]
    if max(sizes) < 2 or len(ids) < 2:
        return
    at = tokens.pairs()
    if pairs is not None:
        at = at[pairs.passes(pair_hashes(tokens.hashes)[at])]
    fits = np.zeros(len(ids), bool)
    fits[at] = True
    state, names = ids, vocabulary
    for size in range(2, max(sizes) + 1):
        if size > 2:  # the pair at its end must pass too
            at = at[at + size - 2 < len(ids)]
            at = at[fits[at + size - 2]]
        codes, inverse = np.unique(state[at] * v + ids[at + size - 1], return_inverse=True)
        names = [names[c // v] + b" " + vocabulary[c % v] for c in codes.tolist()]
        state = np.zeros(len(ids), np.int64)
        state[at] = inverse
        if size in sizes:
            yield names, np.bincount(inverse, minlength=len(names))


SHARD = "lang string, phrase string, n long"


def by_language(batch: pa.RecordBatch) -> dict[bytes, list[bytes]]:
    texts: dict[bytes, list[bytes]] = {}
    for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        if text:
            texts.setdefault(lang, []).append(text)
    return texts


def shard_counts(docs: DataFrame, sizes: tuple[int, ...], words: Filter | None = None, pairs: Filter | None = None,
                 states: int = SHARD_STATES) -> DataFrame:
    """(lang, phrase, n): the united count transducers of each task as sorted
    n-grams with weights; a task writes them whenever it holds ``states``."""

    def rows(held: dict):
        for lang, counts in sorted(held.items()):
            names = sorted(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.decode()] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                 pa.array([counts[x] for x in names], pa.int64())], names=["lang", "phrase", "n"])

    def count(batches):
        held: dict = {}
        for batch in slices(batches, BATCH_ROWS):
            for lang, mine in by_language(batch).items():
                for names, weights in transducer(Tokens(mine, lang, words), sizes, pairs):
                    counts = held.setdefault(lang, {})
                    for name, n in zip(names, weights.tolist()):
                        counts[name] = counts.get(name, 0) + n
                    if sum(map(len, held.values())) >= states:
                        yield from rows(held)
                        held = {}
        yield from rows(held)

    return docs.mapInArrow(count, SHARD)


def _packed(h: np.ndarray, n: np.ndarray, shift: int) -> Iterator[tuple[int, bytes]]:
    """(range, block) of sorted hashes and their counts; a block holds the
    gaps between hashes and the counts, byte plane by byte plane."""
    starts = np.flatnonzero(np.diff(h >> np.uint64(shift), prepend=np.uint64(1) << np.uint64(63)))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
        both = np.stack([np.diff(h[i:j], prepend=np.uint64(0)), n[i:j].astype(np.uint64)])
        yield int(h[i] >> np.uint64(shift)), zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(8, -1)
    gaps, n = np.ascontiguousarray(planes.T).view(np.uint64).reshape(2, -1)
    return np.cumsum(gaps, dtype=np.uint64), n


def _united(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    n = np.zeros(len(h), np.uint64)
    np.add.at(n, inverse, np.concatenate([y for _, y in held]))
    return h, n


def frequent_pairs(docs: DataFrame, words: Filter, least: int, states: int = SHARD_PAIRS) -> DataFrame:
    """``h`` of the pairs that may have ``least`` occurrences: pairs of passing
    words counted by HASH_BITS of their hash. Each task unites its pairs and
    sends them as packed blocks, one a hash range; a range's blocks are summed
    one range after the other."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = HASH_BITS - RANGE_BITS
    kept = np.uint64((1 << HASH_BITS) - 1)

    def blocks(h, n):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_packed(h, n, shift)), (pa.int64(), pa.binary()))],
                                          names=["range", "block"])

    def count(batches):
        held, size = [], 0
        for batch in slices(batches, BATCH_ROWS):
            for lang, mine in by_language(batch).items():
                tokens = Tokens(mine, lang, words)
                at = tokens.pairs() if len(tokens.ids) > 1 else ()
                if len(at):
                    h, n = np.unique(pair_hashes(tokens.hashes)[at] & kept, return_counts=True)
                    held.append((h, n.astype(np.uint64)))
                    size += len(h)
            if size >= states:
                held = [_united(held)]
                size = len(held[0][0])
                if size >= states // 2:
                    yield blocks(*held[0])
                    held, size = [], 0
        if held:
            yield blocks(*_united(held))

    def add(batches):
        held, now = [], None

        def frequent():
            h, n = _united(held)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64))], names=["h"])

        for batch in batches:
            for r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and r != now:
                    yield frequent()
                    held = []
                now = r
                held.append(_unpacked(block))
                if len(held) == 64:
                    held = [_united(held)]
        if held:
            yield frequent()

    sent = docs.mapInArrow(count, "range long, block binary").repartition(parts, "range").sortWithinPartitions("range")
    return sent.mapInArrow(add, "h long")


def united(shards: DataFrame) -> DataFrame:
    """Weights of equal n-grams summed by prefix range; the sum needs no other shuffle."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartitionByRange(parts, "lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang",
                  text_col: str = "text", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): (lang, phrase, size, f) of every phrase of 1 to
    ``longest`` words with f >= ``least``, and (lang, n) word occurrences."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    words = staged(united(staged(shard_counts(rows, (1,)), "words")), "words")
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counts = words.filter(F.col("n") >= least)
    if longest > 1:
        known = Filter.of(hashed_words(counts), filter_bits)
        pairs = Filter.of(frequent_pairs(rows, known, least), filter_bits)
        shards = staged(shard_counts(rows, tuple(range(2, longest + 1)), known, pairs), "phrases")
        counts = counts.unionByName(united(shards).filter(F.col("n") >= least))
    return counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), F.col("n").alias("f")), totals


# -- automata -------------------------------------------------------------------

class Automaton:
    """Deterministic acyclic automaton over words with weights at final states.
    Equal states (same weight, same arcs) exist once. State 0 is the empty end."""

    def __init__(self):
        self.states: list[tuple[int | None, tuple]] = []
        self.register: dict = {}
        self.root = -1

    def _state(self, weight, arcs) -> int:
        key = (weight, tuple(arcs))
        if key not in self.register:
            self.register[key] = len(self.states)
            self.states.append(key)
        return self.register[key]

    @classmethod
    def of(cls, items: list[tuple[tuple[str, ...], int]]) -> "Automaton":
        """Built incrementally: once the next item leaves a path, its states are final."""
        out = cls()
        path: list[list] = [[None, []]]  # weight, arcs of the states along the last item
        labels: list[str] = []

        def close(depth):
            while len(labels) > depth:
                weight, arcs = path.pop()
                path[-1][1].append((labels.pop(), out._state(weight, arcs)))

        for words, weight in sorted(items):
            same = 0
            while same < min(len(words), len(labels)) and words[same] == labels[same]:
                same += 1
            close(same)
            for w in words[same:]:
                labels.append(w)
                path.append([None, []])
            path[-1][0] = weight if path[-1][0] is None else path[-1][0] + weight
        close(0)
        out.root = out._state(path[0][0], path[0][1])
        return out

    def dump(self) -> bytes:
        return zlib.compress(json.dumps([self.root, self.states]).encode())

    @classmethod
    def load(cls, blob: bytes) -> "Automaton":
        out = cls()
        out.root, states = json.loads(zlib.decompress(blob))
        out.states = [(w, tuple((label, t) for label, t in arcs)) for w, arcs in states]
        return out

    def compose(self, other: "Automaton") -> Iterator[tuple[str, int]]:
        """(phrase, weight in ``other``) of the phrases that both accept."""
        arcs = {}
        stack = [(self.root, other.root, "")]
        while stack:
            s, t, phrase = stack.pop()
            if self.states[s][0] is not None and other.states[t][0] is not None:
                yield phrase, other.states[t][0]
            if t not in arcs:
                arcs[t] = dict(other.states[t][1])
            for label, to in self.states[s][1]:
                if label in arcs[t]:
                    stack.append((to, arcs[t][label], f"{phrase} {label}" if phrase else label))


def automata(counts: DataFrame) -> DataFrame:
    """(range, lang, low_lang, low, blob): the count automaton of each prefix range and language."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.select("lang", "phrase", "f").repartitionByRange(parts, "lang", "phrase") \
        .sortWithinPartitions("lang", "phrase")

    def build(batches):
        part, low, held = TaskContext.get().partitionId(), None, {}
        for b in batches:
            for lang, phrase, f in zip(*(b.column(i).to_pylist() for i in range(3))):
                low = low or (lang, phrase)
                held.setdefault(lang, []).append((tuple(phrase.split(" ")), f))
        out = [(part, lang, *low, Automaton.of(items).dump()) for lang, items in held.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)],
                                             names=["range", "lang", "low_lang", "low", "blob"])

    return staged(ordered.mapInArrow(build, "range long, lang string, low_lang string, low string, blob binary"), "automata")


def look_up(parts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lang, part, f) of the distinct ``parts`` (lang, part): each range's
    automaton of wanted parts composed with its count automaton. A range holds
    no more wanted parts than counted phrases."""
    lows = sorted((r.low_lang.encode(), r.low.encode(), r.range)
                  for r in ranges.select("low_lang", "low", "range").distinct().collect())  # one row a range

    @F.pandas_udf("long")
    def home(lang: pd.Series, part: pd.Series) -> pd.Series:
        from bisect import bisect_right
        keys = [(a, b) for a, b, _ in lows]
        return pd.Series([lows[max(0, bisect_right(keys, (l.encode(), p.encode())) - 1)][2] for l, p in zip(lang, part)],
                         dtype="int64")

    def compose(wanted: pa.Table, count: pa.Table) -> pa.Table:
        out = []
        by_lang: dict = {}
        for lang, part in zip(wanted.column("lang").to_pylist(), wanted.column("part").to_pylist()):
            by_lang.setdefault(lang, []).append((tuple(part.split(" ")), 1))
        for lang, blob in zip(count.column("lang").to_pylist(), count.column("blob").to_pylist()):
            if lang in by_lang:
                out += [(lang, p, f) for p, f in Automaton.of(by_lang[lang]).compose(Automaton.load(blob))]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                        names=["lang", "part", "f"])

    if not lows:
        return parts.select("lang", "part", F.lit(0).cast("long").alias("f")).limit(0)
    routed = parts.select(home("lang", "part").alias("home"), "lang", "part")
    return routed.groupBy("home").cogroup(ranges.select("range", "lang", "blob").groupBy("range")).applyInArrow(
        compose, "lang string, part string, f long")


# -- the operator ---------------------------------------------------------------

def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, lang_col: str = "lang",
                 text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``longest`` words: lang, rank,
    phrase, a, l, r, n, score (numbers long).

    a, l and r are the counts of the phrase and of the two parts at its
    weakest cut, n the words of the language; score floor(1000 a n / (l r)) in
    exact decimals, the lowest over all cuts (the smallest cut on ties). A
    phrase inside a longer candidate with the same count goes. Rank by score,
    a (both descending) and phrase (ascending, UTF-8 bytes).

    A null text is empty, a null language ``und``; repeated rows all count;
    only the language and the text are read; an empty table, or one without a
    phrase of that count, gives no row."""
    counts, totals = phrase_counts(docs, least, longest, lang_col, text_col, filter_bits)
    counts = staged(counts, "counts")
    candidates = counts.filter("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "size", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cuts = staged(cuts, "cuts")
    wanted = cuts.select("lang", F.col("left").alias("part")).union(cuts.select("lang", "right")).distinct()
    found = staged(look_up(wanted, automata(counts)), "parts")
    scored = (cuts.join(found.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(found.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .join(totals, "lang"))
    big = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {big}) * cast(a as {big}) * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))")
    weakest = scored.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("w"), F.first("a").alias("a"), F.first("n").alias("n"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda length: F.transform(
        F.sequence(F.lit(1), F.col("size") - length + 1), lambda at: F.array_join(F.slice(words, at, length), " "))))
    held = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("in_longer")) \
        .groupBy("lang", "phrase").agg(F.max("in_longer").alias("in_longer"))
    kept = weakest.join(held, ["lang", "phrase"], "left").filter("in_longer is null or 100 * in_longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("w.l").alias("l"),
                         F.col("w.r").alias("r"), "n", F.col("w.score").cast("long").alias("score"))
