"""Mixing sources to target weights.

The words of a source are packed into blocks of a fixed length. The output is
a row of shards with a fixed number of slots; each shard draws how many slots
every source fills, multinomially and given the corpus totals. The slots of a
source are numbered through all shards, and slot j takes block
perm(j mod n) of pass j div n, where perm is a pseudorandom permutation of the
source's n blocks that differs in every pass. Slots and blocks meet in a join
on the block's index.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.llm.common import NO_ID, U64, documents, mix64, staged, words_of

BLOCK_WORDS = 64
SHARD_SLOTS = 16_384
#: documents laid out one after another before packing starts anew
BUCKET_DOCS = 64
#: buckets whose block counts are summed in one task
SPAN = 4096
#: sources the driver works out targets for, at most
MAX_SOURCES = 100_000


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words to take from each source: ``share`` of all words, dealt by
    weight; no source gives over ``cap`` times its size, and what is cut off
    is dealt again among the others."""
    total, full = share * sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, f in zip(sizes, full) if f)
        open_weight = sum(w for w, f in zip(weights, full) if not f)
        out = [cap * s if f else rest * w / open_weight for s, w, f in zip(sizes, weights, full)]
        over = [not f and t > cap * s for t, s, f in zip(out, sizes, full)]
        if not any(over):
            return out
        full = [f or o for f, o in zip(full, over)]


def draw_left(rng: np.random.Generator, totals: np.ndarray, left: int) -> np.ndarray:
    """How a random ``left`` of ``sum(totals)`` slots fall on the sources."""
    out, rest = np.zeros_like(totals), int(totals.sum())
    for i, t in enumerate(totals.tolist()):
        others = rest - t
        low, high = max(0, left - others), min(t, left)
        if low == high:
            k = low
        elif max(t, others) < 10 ** 9:
            k = int(rng.hypergeometric(t, others, left))
        else:
            mean = left * t / rest
            k = round(rng.normal(mean, math.sqrt(mean * (others / rest) * (rest - left) / max(rest - 1, 1))))
        out[i] = k = min(max(k, low), high)
        left, rest = left - k, others
    return out


def shard_counts(shard: int, shards: int, slots: int, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot number, count) of each source in one shard: the corpus
    totals are halved again and again down to the shard, every halving drawn
    from a generator seeded by its place, so shards agree without meeting."""
    lo, hi, start = 0, shards, np.zeros_like(totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw_left(np.random.default_rng([seed, lo, hi]), totals, min((mid - lo) * slots, int(totals.sum())))
        if shard < mid:
            hi, totals = mid, left
        else:
            lo, start, totals = mid, start + left, totals - left
    return start, totals


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at ``j``: a Feistel network on the
    next even number of bits, repeated while the value is n or more."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = U64((1 << half) - 1), U64(half)
    out = j.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            f = mix64(right + U64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
            left, right = right, left ^ (f & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


SLOTS = "shard long, slot int, source_id int, block long, pass int"
SLOTS_ARROW = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_id", pa.int32()),
                         ("block", pa.int64()), ("pass", pa.int32())])


def slot_table(spark, blocks: list[int], slots: list[int], shard_slots: int, seed: int) -> DataFrame:
    """Every slot of every shard with the source and block it takes."""
    total = sum(slots)
    shards = -(-total // shard_slots)

    def fill(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, count = shard_counts(shard, shards, shard_slots, np.array(slots, np.int64), seed)
                source = np.repeat(np.arange(len(slots)), count)
                j = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
                n = np.array(blocks, np.int64)[source]
                turn, block = j // np.maximum(n, 1), np.zeros(len(j), np.int64)
                for s in np.flatnonzero(count):
                    at = np.flatnonzero(source == s)
                    for t in np.unique(turn[at]):
                        k = at[turn[at] == t]
                        block[k] = permuted(j[k] % blocks[s], blocks[s], seed * 1_000_003 + int(s) * 8191 + int(t))
                # places within the shard are dealt at random too
                place = np.argsort(mix64(np.arange(len(j)).astype(U64) + U64(shard * 7919 + seed)), kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), shard)), pa.array(place.astype(np.int32)),
                     pa.array(source.astype(np.int32)), pa.array(block), pa.array(turn.astype(np.int32))],
                    schema=SLOTS_ARROW)

    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, shards, 1, parts).mapInArrow(fill, SLOTS)


def kept_apart(df: DataFrame) -> DataFrame:
    """``df`` for a join whose both sides grow with the corpus: the driver never
    collects one to broadcast it, however small its shuffle files look."""
    return df.hint("merge")


class Mix:
    """A mix of ``docs``; the tables are in the attributes.

    rows     one row per input row: doc_id, source, size, sid, h, copy
    sources  list of (source, size, weight, target, blocks, slots)
    pieces   the part of a document that lies in a block
    slots    the output: shard, slot -> source_id, block, pass

    Words are runs without space, tab or line ends. A null text has none and a
    null id is its own value; a null source is a source, after all others in
    code point order. Rows that repeat id, source and text are laid out one
    after another. An empty table has no slots."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                 block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 11,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = docs.sparkSession
        sized = documents(docs, id_col, text_col, F.col(source_col).cast("string").alias("source")).select(
            "doc_id", "sid", "h", "source",
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
        grouped = staged(sized.groupBy("doc_id", "sid", "h", "source", "size").agg(F.count(F.lit(1)).alias("copies")),
                         "mix-sizes")
        per_source = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"),
                                                   F.count(F.lit(1)).alias("n"))
        found = per_source.limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"over {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        size = [r["size"] for r in found]
        weight = [float(weights[i % len(weights)]) for i in range(len(found))]
        target = targets(size, weight, share, cap) if sum(size) else [0.0] * len(found)
        names = spark.createDataFrame(
            [(i, r["source"], -(-r["n"] // BUCKET_DOCS), size[i], target[i]) for i, r in enumerate(found)],
            "source_id int, source string, buckets long, source_size long, target double")
        self.names = names  # one row per source, MAX_SOURCES at most; joins broadcast it while it is small
        laid = grouped.join(self.names, grouped["source"].eqNullSafe(names["source"])).drop(names["source"])
        laid = laid.withColumn("bucket", F.pmod(F.xxhash64("sid", "h"), F.col("buckets")))
        w = Window.partitionBy("source_id", "bucket").orderBy("sid", "h")
        before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        laid = laid.withColumn("offset", before)
        blocks = self._block_numbers(laid, block_words)
        counted = {r["source_id"]: r["n"] for r in
                   blocks.groupBy("source_id").agg(F.sum("blocks").alias("n")).collect()}
        n_blocks = [counted.get(i) or 0 for i in range(len(found))]
        n_slots = [min(round(t * b / s), math.floor(cap * b)) if s else 0
                   for t, b, s in zip(target, n_blocks, size)]
        self.sources = list(zip([r["source"] for r in found], size, weight, target, n_blocks, n_slots))
        self.rows = (laid.join(kept_apart(blocks.select("source_id", "bucket", "first_block")), ["source_id", "bucket"])
                     .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
                     .withColumn("offset", F.col("offset") + F.col("copy") * F.col("size")))
        self.slots = slot_table(spark, n_blocks, n_slots, shard_slots, seed)
        self.block_words = block_words

    @staticmethod
    def _block_numbers(laid: DataFrame, block_words: int) -> DataFrame:
        """Buckets with the number of their first block in the source, by sums over spans and then of spans."""
        per = laid.groupBy("source_id", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        per = staged(per.select("source_id", "bucket", F.floor(F.col("bucket") / SPAN).alias("span"),
                                F.ceil(F.col("words") / block_words).cast("long").alias("blocks")), "mix-blocks")
        spans = per.groupBy("source_id", "span").agg(F.sum("blocks").alias("in_span"))

        def before(c, *keys, order):
            w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return F.coalesce(F.sum(c).over(w), F.lit(0))

        spans = spans.select("source_id", "span", before("in_span", "source_id", order="span").alias("span_first"))
        return (per.withColumn("within", before("blocks", "source_id", "span", order="bucket"))
                .join(kept_apart(spans), ["source_id", "span"])
                .select("source_id", "bucket", "blocks", (F.col("span_first") + F.col("within")).alias("first_block")))

    def pieces(self) -> DataFrame:
        """doc (sid, h, source_id, copy), block, and the words [from, to) of the document in it."""
        n = self.block_words
        rows = self.rows.filter("size > 0").select("sid", "h", "source_id", "copy", "size", "offset", "first_block")
        inside = F.explode(F.sequence(F.floor(F.col("offset") / n),
                                      F.floor((F.col("offset") + F.col("size") - 1) / n))).alias("b")
        rows = rows.select("*", inside)
        return rows.select(
            "sid", "h", "source_id", "copy", (F.col("first_block") + F.col("b")).alias("block"),
            F.greatest(F.lit(0), F.col("b") * n - F.col("offset")).alias("from"),
            F.least(F.col("size"), (F.col("b") + 1) * n - F.col("offset")).alias("to"))

    def taken_pieces(self) -> DataFrame:
        """Pieces with the number of slots that take their block."""
        times = self.slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
        return self.pieces().join(kept_apart(times), ["source_id", "block"])

    def taken(self) -> DataFrame:
        """Per input row: size, its source's size and target, words taken (repeats counted)."""
        sums = (self.taken_pieces().groupBy("sid", "h", "source_id", "copy")
                .agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken")))
        return (self.rows.join(kept_apart(sums), ["sid", "h", "source_id", "copy"], "left")
                .select("doc_id", "source", "size", "source_size", "target",
                        F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
        """``docs`` with the text that the mix takes of each: its taken pieces
        in order, the second helping after the first. A document of which it
        takes nothing goes."""
        helpings = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("helping")
        parts = (self.taken_pieces().select("sid", "h", "source_id", "copy", "from", "to", helpings)
                 .groupBy("sid", "h", "source_id", "copy")
                 .agg(F.sort_array(F.collect_list(F.struct("helping", "from", "to"))).alias("parts")))
        parts = parts.join(self.names.select("source_id", F.col("source").alias("_source")), "source_id")
        parts = parts.select("sid", "h", "_source", "copy", "parts")
        # the document in one column, so that none of its columns can clash
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_sid"),
                            F.xxhash64(F.col(text_col).cast("string")).alias("_h"),
                            F.col(source_col).cast("string").alias("_of"))
        # rows that repeat id, text and source share one text; the other columns are those of one row, by a hash
        keyed = keyed.groupBy("_sid", "_h", "_of").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
        joined = keyed.join(kept_apart(parts), (F.col("_sid") == F.col("sid")) & (F.col("_h") == F.col("h"))
                            & F.col("_of").eqNullSafe(F.col("_source")))
        words = words_of(F.col("_doc").getField(text_col))
        text = F.array_join(F.flatten(F.transform(
            "parts", lambda p: F.slice(words, p["from"].cast("int") + 1, (p["to"] - p["from"]).cast("int")))), " ")
        return joined.select(*[text.alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns])


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Words taken of each document: see ``Mix`` for options and edge cases."""
    return Mix(docs, **options).taken()
