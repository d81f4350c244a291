"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard likeness
reaches a percentage. Equal sets are one set from the start. The rest is done
in two rounds:

1.  Groups. Each set is cut into parts by the hash of its shingles, into more
    parts than shingles can differ between two linked sets of such sizes, so
    linked sets agree in at least one whole part. The hash of a part is a
    token of the set. Sets that share a token follow the smallest set that has
    it, and those that follow one leader form its group (groups of many sets
    are dealt into bounded ones); sets that link with a leader are joined. The
    token-group matrix has a row for every token and group that holds it: the
    union of the tokens of the group's sets.

2.  Queries. Two sets of different components that share a token are not both
    in the largest component that has it, so one of them asks: it counts its
    tokens in every group that holds one. Linked sets share at least as many
    tokens as parts are left when every differing shingle spoils one, and the
    overlap with the group's tokens bounds that with each set of the group;
    only groups that reach it are opened. In an open group the query is held
    against each set's signature (one byte of each part's hash): parts that
    differ are at most as many as differing shingles. What passes is compared
    shingle by shingle.

Sets that one component already joins are never compared, so copies cost one
comparison each and not one for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise.llm.common import (NO_ID, U64, byte_column, documents, handing_back, mix64, release, shingle_hashes,
                                  signed, slices, staged, word_hashes)

SHINGLE, PERCENT = 3, 90
#: row numbers from here on stand for rows without an id of their own
EXTRA = 1 << 62
#: sets in a group, about
GROUP_SETS = 64
#: rows that the queries of one pass make in asking the groups, for each row of
#: the tokens they ask by, and at least: more queries take more passes, not more disk
ASK_ROWS_EACH, ASK_ROWS = 6, 1 << 20
#: ratio of the sizes that share a number of parts
CLASS_RATIO = 1.5
#: bits of the filter in front of a shuffle of texts: so many a wanted row, and 8 MB at most
FILTER_BITS_EACH, FILTER_BITS = 16, 1 << 26


# -- sizes, parts and tokens --------------------------------------------------

def size_class(n: int) -> int:
    """Classes of set sizes; class c reaches to ``class_top(c)``."""
    c = max(0, int(np.log(max(n, 1)) / np.log(CLASS_RATIO)) - 1)
    while class_top(c) < n:
        c += 1
    return c


def class_top(c: int) -> int:
    return int(CLASS_RATIO ** (c + 1))


def most_apart(top: int, percent: int) -> int:
    """How many shingles linked sets of at most ``top`` can differ by:
    100 I >= p U gives a + b - 2 I <= (100 - p)(a + b) / (100 + p)."""
    return (100 - percent) * 2 * top // (100 + percent)


def parts_for(top: int, percent: int) -> int:
    """Parts of a class: more than linked sets can differ by, with room for
    the parts that will be empty."""
    d = most_apart(top, percent)
    return d + 3 + math.ceil(1.5 * d * math.exp(-top / CLASS_RATIO / max(d, 1)))


def part_hashes(shingles: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(class, hash of each part, shingles in each part) of a set (its sorted
    shingle hashes): for its size class and, as the smaller partner, for those
    above that a linked set can lie in."""
    n, out = len(shingles), []
    for c in range(size_class(n), size_class(n * 100 // percent) + 1):
        parts = parts_for(class_top(c), percent)
        part = (mix64(shingles + U64(c)) % U64(parts)).astype(np.int64)
        sums = np.zeros(parts, dtype=U64)
        np.add.at(sums, part, mix64(shingles))
        counts = np.bincount(part, minlength=parts)
        out.append((c, mix64(mix64(sums + counts.astype(U64)) + U64(c << 40) + np.arange(parts, dtype=U64)), counts))
    return out


def tokens_of(shingles: np.ndarray, percent: int, hashes: list | None = None) -> tuple[np.ndarray, int]:
    """Tokens of a set: the hashes of its filled parts; and the least number
    of filled parts in a class.

    Of two linked sets, as many parts as differing shingles can be spoilt and
    the empty ones agree in nothing. While one of the sets has fewer empty
    parts than the class has parts to spare, a filled part must agree; a set
    with more empty ones gives a token for each of those too."""
    out, filled = [], len(shingles)
    for c, token, counts in hashes or part_hashes(shingles, percent):
        empty = int((counts == 0).sum())
        out.append(token if empty >= len(counts) - most_apart(class_top(c), percent) else token[counts > 0])
        filled = min(filled, len(counts) - empty)
    return np.concatenate(out), filled


def signatures_of(hashes: list) -> list[bytes]:
    """A byte of the hash of every part, for each class of ``part_hashes``."""
    return [(token & U64(255)).astype(np.uint8).tobytes() for _, token, _ in hashes]


SETS = ("sid long, h long, n_shingles long, parts long, ka long, kb long, tokens array<long>, size_class int, "
        "signatures array<binary>")
SETS_ARROW = pa.schema([("sid", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("parts", pa.int64()),
                        ("ka", pa.int64()), ("kb", pa.int64()), ("tokens", pa.list_(pa.int64())),
                        ("size_class", pa.int32()), ("signatures", pa.list_(pa.binary()))])


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words = [(t or b"").lower().split() for t in byte_column(batch)]
    joined = word_hashes([x for w in words for x in w])
    ends = np.cumsum([len(w) for w in words])
    return [np.unique(shingle_hashes(joined[e - len(w):e], k)) for e, w in zip(ends.tolist(), words)]


def sets_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: the number of shingles, a 128-bit hash of the set, its tokens and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = shingle_sets(batch, k)
            key = [(0, 0) if not len(s) else (int(mix64(s).sum(dtype=U64)), int(mix64(s + U64(1)).sum(dtype=U64)))
                   for s in sets]
            hashes = [part_hashes(s, percent) if len(s) else [] for s in sets]
            found = [tokens_of(s, percent, x) if len(s) else (s, 0) for s, x in zip(sets, hashes)]
            tokens = [t for t, _ in found]
            offsets = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
            flat = signed(np.concatenate([*tokens, np.zeros(0, U64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([n for _, n in found], pa.int64()),
                 pa.array(signed(np.array([a for a, _ in key], dtype=U64))),
                 pa.array(signed(np.array([b for _, b in key], dtype=U64))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.array([size_class(len(s)) for s in sets], pa.int32()),
                 pa.array([signatures_of(x) for x in hashes], pa.list_(pa.binary()))], schema=SETS_ARROW)

    return docs.select("sid", "h", "text").mapInArrow(handing_back(run), SETS)


def maybe_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of ``docs`` whose (sid, h) is ``wanted`` and few others: a bitmap
    of hashes, of bounded size, goes to the tasks, so that the other texts need
    not pass the shuffle that finds the wanted ones."""
    bits = 1 << 15
    while bits < min(FILTER_BITS, FILTER_BITS_EACH * wanted.count()):
        bits *= 2
    hashed = F.xxhash64("sid", "h").bitwiseAND(F.lit(bits - 1))
    page, at = F.floor(F.col("_bit") / (1 << 15)).alias("_page"), F.col("_bit") % (1 << 15)
    pages = (wanted.select(hashed.alias("_bit")).groupBy(page).agg(F.bitmap_construct_agg(at).alias("_bits")))
    found = docs.withColumn("_bit", hashed).withColumn("_page", page).join(F.broadcast(pages), "_page")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*docs.columns)


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set, shingles) for the ``wanted`` (set, sid, h) documents."""

    def run(batches):
        for batch in slices(batches, 256):
            sets = shingle_sets(batch, k)
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = signed(np.concatenate([*sets, np.zeros(0, U64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("set"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["set", "shingles"])

    one = maybe_wanted(docs.select("sid", "h", "text"), wanted).join(wanted, ["sid", "h"])
    return one.select("set", "text").mapInArrow(handing_back(run), "set long, shingles array<long>")


# -- comparing ------------------------------------------------------------------

def links(a: Column, b: Column, percent: int) -> Column:
    """Whether two shingle arrays reach the likeness."""
    inter = F.size(F.array_intersect(a, b))
    return F.lit(100) * inter >= F.lit(percent) * (F.size(a) + F.size(b) - inter)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.lit(100) * a >= F.lit(percent) * b) & (F.lit(100) * b >= F.lit(percent) * a)


def compared(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Those of the ``pairs`` (a, b) of sets that link, by their shingles."""
    pairs = staged(pairs.distinct(), f"{name}-pairs")
    named = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    wanted = staged(firsts.join(named, "set", "left_semi"), f"{name}-sets")
    # rows that repeat id and text give the same shingles
    arrays = staged(shingles_of(docs, wanted, k).dropDuplicates(["set"]), f"{name}-shingles")
    one = arrays.select(F.col("set").alias("a"), F.col("shingles").alias("one"))
    other = arrays.select(F.col("set").alias("b"), F.col("shingles").alias("other"))
    out = staged(pairs.join(one, "a").join(other, "b").filter(links(F.col("one"), F.col("other"), percent))
                 .select("a", "b"), name)
    release(pairs, wanted, arrays)
    return out


def signatures_near(opened: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a query ``q`` and those of its ``others`` (set, size,
    signature) that may link: parts differ by no more than shingles can.
    ``own`` has the query's signature for each of them."""

    def run(batches):
        for batch in batches:
            others = batch.column("others").flatten()
            lengths = np.diff(batch.column("others").offsets.to_numpy())
            if not len(others):
                continue
            q, q_n = (np.repeat(batch.column(c).to_numpy(), lengths) for c in ("q", "q_n"))
            own, other = batch.column("own").flatten(), others.field("signature")
            ends = np.cumsum([len(x) for x in own.to_pylist()])
            apart = (np.frombuffer(b"".join(own.to_pylist()), np.uint8)
                     != np.frombuffer(b"".join(other.to_pylist()), np.uint8))
            differ = np.add.reduceat(apart.astype(np.int64), np.r_[0, ends[:-1]])
            near = differ <= (q_n + others.field("n").to_numpy()) * (100 - percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([pa.array(q[near]), others.field("set").filter(pa.array(near))],
                                             names=["a", "b"])

    return opened.select("q", "q_n", "own", "others").mapInArrow(run, "a long, b long")


# -- connected components -------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(set, component) of the sets of ``edges`` (a, b): the smallest set that
    can be reached. Large-star and small-star steps by turns; each row count
    stays that of the edges, whatever the size of a component."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a <> b").distinct(), "edges-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        small = staged(small, "edges-small")
        # settled when every set has one edge, to a set that has none
        settled = (small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
                   and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty())
        release(edges, large)
        edges = small
        if settled:
            return edges.select(F.col("a").alias("set"), F.col("b").alias("component"))


# -- asking the groups ----------------------------------------------------------

def ask_passes(tokens: DataFrame, asking: DataFrame, holding: DataFrame) -> int:
    """Passes that the queries are dealt to, so that one pass makes a bounded
    number of rows for each row of ``tokens``, however many ask the same groups."""
    asked = asking.groupBy("token").agg(F.count(F.lit(1)).alias("asked"))
    held = holding.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rows = asked.join(held, "token").agg(F.sum(F.col("asked") * F.col("held"))).first()[0] or 0
    return max(1, math.ceil(rows / max(ASK_ROWS, ASK_ROWS_EACH * tokens.count())))


def asks_near(asking: DataFrame, holding: DataFrame, about: DataFrame, outline: DataFrame, gkey: list[str],
              percent: int) -> DataFrame:
    """The queries of ``asking`` (token, q) with the groups that share as many
    tokens with them as a linked set would."""
    asks = asking.join(holding, "token").groupBy("q", *gkey).agg(F.count(F.lit(1)).alias("shared"))
    # linked sets differ in at most `apart` shingles, each of which spoils one filled part of the set
    largest = F.least(F.col("hi_n"), F.floor(F.col("q_n") * 100 / percent))
    apart = F.floor((F.col("q_n") + largest) * (100 - percent) / (100 + percent))
    near = ((F.lit(100) * F.col("q_n") >= F.lit(percent) * F.col("lo_n"))
            & (F.lit(100) * F.col("hi_n") >= F.lit(percent) * F.col("q_n"))
            & (F.col("shared") >= F.col("q_parts") - apart)
            & ((F.col("lo") != F.col("q_component")) | (F.col("hi") != F.col("q_component"))))
    return asks.join(about, "q").join(outline, gkey).filter(near).select("q", "q_component", "q_n", *gkey)


def opened_groups(asks: DataFrame, query: DataFrame, groups: DataFrame, gkey: list[str], percent: int) -> DataFrame:
    """The asks with the sets of their groups that fit the query's size, and the signatures to compare."""
    fits = F.filter("sets", lambda m: (m["component"] != F.col("q_component"))
                    & sizes_fit(F.col("q_n"), m["n_shingles"], percent))
    opened = asks.join(query, "q").join(groups.select(*gkey, "sets"), gkey).withColumn("sets", fits)
    # the larger size class has a signature of both
    top = lambda m: F.greatest(m["size_class"], F.col("q_class"))
    return opened.filter(F.size("sets") > 0).select(
        "q", "q_n", F.transform("sets", lambda m: F.get("q_signatures", top(m) - F.col("q_class"))).alias("own"),
        F.transform("sets", lambda m: F.struct(
            m["set"].alias("set"), m["n_shingles"].alias("n"),
            F.get(m["signatures"], top(m) - m["size_class"]).alias("signature"))).alias("others"))


# -- the join -------------------------------------------------------------------

def set_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(sid, h, n_shingles, node, component) of every different row of ``docs``;
    node is a number of the component's own, component its smallest sid, which
    others have too where rows lack an id or repeat one."""
    sets = staged(sets_of(docs, k, percent), "sets")
    rows = sets.select("sid", "h", "n_shingles", "parts", "ka", "kb").distinct()
    # a number for each row: its id, but for null and repeated ids one above all ids
    lowest = rows.groupBy("sid").agg(F.min("h").alias("h0"))
    extra = F.lit(EXTRA) + F.xxhash64("sid", "h").bitwiseAND(F.lit(EXTRA - 1))
    rows = rows.join(lowest, "sid").withColumn(
        "node", F.when((F.col("sid") < EXTRA) & (F.col("h") == F.col("h0")), F.col("sid")).otherwise(extra))
    # equal sets: the smallest number stands for all
    rows = staged(rows, "rows")
    first = staged(rows.filter("n_shingles > 0").groupBy("ka", "kb", "n_shingles").agg(F.min("node").alias("first")),
                   "equal-sets")
    named = staged(rows.join(first, ["ka", "kb", "n_shingles"], "left")
                   .select("sid", "h", "n_shingles", "parts", "node", F.coalesce("first", "node").alias("set")),
                   "sets-named")
    release(rows, first)
    firsts = named.filter((F.col("set") == F.col("node")) & (F.col("n_shingles") > 0))
    sizes = firsts.select("set", "n_shingles", "parts")
    firsts = firsts.select("sid", "h", "set")
    # the tokens are by far the largest table: dealt by document once, and those of copies left behind
    leading = staged(sets.select("sid", "h", "tokens", "size_class", "signatures").join(firsts, ["sid", "h"])
                     .select("set", "tokens", "size_class", "signatures"), "sets-first")
    release(sets)
    token = leading.select("set", F.explode("tokens").alias("token"))
    shared = staged(token.groupBy("token").agg(F.min("set").alias("leader"), F.max("set").alias("last"))
                    .filter("leader < last").select("token", "leader"), "tokens-shared")
    # rows that repeat id and text give their tokens once
    matrix = staged(token.join(shared, "token").select("token", "set", "leader").distinct(), "token-sets")
    alike = leading.select("set", "size_class", "signatures").join(matrix.select("set").distinct(), "set", "left_semi")
    alike = staged(alike.dropDuplicates(["set"]), "signatures")
    release(leading, shared)

    # round 1: every set against the leaders it follows
    pairs = staged(matrix.filter(F.col("set") != F.col("leader")).groupBy("set", "leader")
                   .agg(F.count(F.lit(1)).alias("led")), "star-all")
    size = sizes.select(F.col("set").alias("leader"), F.col("n_shingles").alias("leader_n"))
    # only leaders that already share the tokens a link needs; round 2 finds every other link
    spoilt = F.floor((F.col("n_shingles") + F.col("leader_n")) * (100 - percent) / (100 + percent))
    star = staged(pairs.join(sizes, "set").join(size, "leader")
                  .filter(sizes_fit(F.col("n_shingles"), F.col("leader_n"), percent)
                          & (F.col("led") >= F.col("parts") - spoilt)), "star")
    release(pairs)
    edges = compared(star.select(F.col("set").alias("a"), F.col("leader").alias("b")), docs, firsts, k, percent,
                     "edges-star")
    comp = components(edges)

    # round 2: the sets outside a token's largest component ask the groups that hold the token
    follows = staged(matrix.groupBy("set").agg(F.min("leader").alias("family")), "families").join(sizes, "set")
    follows = follows.join(comp, "set", "left").withColumn("component", F.coalesce("component", "set"))
    weight = follows.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    family = follows.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    part = F.pmod(F.xxhash64("set"), F.ceil(F.col("members") / GROUP_SETS))
    placed = staged(follows.join(weight, "component").join(family, "family")
                    .select("set", "n_shingles", "parts", "component", "weight", "family", part.alias("part")), "placed")
    tokens = matrix.select("token", "set").join(placed, "set")
    split = staged(tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                               F.max(F.struct("weight", "component")).alias("main"))
                   .filter("lo < hi").select("token", F.col("main.component").alias("main")), "tokens-split")
    tokens = staged(tokens.join(split, "token"), "tokens-open")
    gkey = ["family", "part"]
    members = placed.join(tokens.select("set").distinct(), "set", "left_semi")
    groups = staged(members.join(alike, "set").groupBy(*gkey).agg(
        F.collect_list(F.struct("set", "component", "n_shingles", "size_class", "signatures")).alias("sets"),
        F.min("n_shingles").alias("lo_n"), F.max("n_shingles").alias("hi_n"), F.min("component").alias("lo"),
        F.max("component").alias("hi")), "groups")
    outline = groups.select(*gkey, "lo_n", "hi_n", "lo", "hi")
    asking = tokens.filter(F.col("component") != F.col("main")).select("token", F.col("set").alias("q"))
    holding = tokens.select("token", *gkey).distinct()
    about = placed.select(F.col("set").alias("q"), F.col("component").alias("q_component"),
                          F.col("n_shingles").alias("q_n"), F.col("parts").alias("q_parts"))
    query = alike.select(F.col("set").alias("q"), F.col("size_class").alias("q_class"),
                         F.col("signatures").alias("q_signatures"))
    passes, pairs = ask_passes(tokens, asking, holding), []
    for i in range(passes):
        mine = asking.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == i)
        asks = staged(asks_near(mine, holding, about, outline, gkey, percent), "asks")
        pairs.append(staged(signatures_near(opened_groups(asks, query, groups, gkey, percent), percent), "pairs-near"))
        release(asks)
    release(matrix, split, tokens)
    more = compared(reduce(DataFrame.union, pairs), docs, firsts, k, percent, "edges-more")
    release(alike, groups, *pairs)
    if not more.isEmpty():
        comp = components(edges.union(more))
    out = staged(named.join(comp, "set", "left")
                 .select("sid", "h", "n_shingles", F.coalesce("component", "set").alias("node")), "components")
    smallest = staged(out.groupBy("node").agg(F.min("sid").alias("component")), "smallest")
    return out.join(smallest, "node").select("sid", "h", "n_shingles", "node", "component")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    A set is the distinct ``k``-word shingles of the text, A-Z lower-cased;
    with fewer words the whole sequence is the one shingle; without words, or
    for a null text, it is empty and links with nothing. Equal sets link.
    component_id is the smallest doc_id that links lead to, its own included;
    a null id comes after all others, so component_id is null where no other id
    is reached. Rows that share an id with other texts are different documents.
    Every row gives one row; an empty table gives none."""
    base = documents(docs, id_col, text_col)
    found = set_components(base, k, percent)
    return (base.select("doc_id", "sid", "h").join(found, ["sid", "h"])
            .select("doc_id", "sid", "h", "n_shingles",
                    F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id")))
