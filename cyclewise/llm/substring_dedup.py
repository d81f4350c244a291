"""Substring dedup: words of long passages that an earlier document has too.

A window is 50 consecutive words. Windows are counted in a count-min sketch
whose hash keeps neighbours together: the cell of a window is that of its
smallest 8-word shingle hash, a function of the window's words alone, so equal
windows always meet and a run of neighbouring windows with the same smallest
hash is added to the sketch once. Every partition adds up its own sketch
(the map side of the aggregation) and the partitions' sketches are merged; a
cell's count is never below the number of runs that hold a window of it.

The second pass looks only at runs whose estimate is two or more in every row
of the sketch, and groups exactly: first whole runs, because copies of a
passage have the same runs but at its ends, then the single windows of the
runs that are left in a cell with another run. Exact grouping compares
128-bit hashes of the word sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise.llm.common import (NO_ID, U64, batch_of, byte_column, documents, handing_back, mix64, signed, slices,
                                  staged, word_hashes)

WINDOW = 50
SHINGLE = 8
#: cells of a sketch row for each run it counts
CELLS_PER_RUN = 4
#: odd multipliers of the two polynomial hashes
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class RollingHash:
    """Hashes of word ranges [a, b) of one array of word hashes, 64 bits a lane."""

    def __init__(self, h: np.ndarray):
        self.lanes = []
        for k, base in enumerate(LANES):
            powers = np.full(len(h) + 1, base, dtype=U64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=U64)
            inverse = np.full(len(h) + 1, pow(base, -1, 1 << 64), dtype=U64)
            inverse[0] = 1
            inverse = np.cumprod(inverse, dtype=U64)
            word = h if k == 0 else mix64(h + U64(k))
            sums = np.zeros(len(h) + 1, dtype=U64)
            np.cumsum(word * powers[:-1], dtype=U64, out=sums[1:])
            self.lanes.append((sums, inverse))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64)) for sums, inverse in self.lanes]


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def windows_of(hashes: np.ndarray, lengths: np.ndarray, window: int, shingle: int):
    """(start of each window in the joined documents, its document, its cell hash)."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    start = np.flatnonzero(np.arange(n) + window <= ends[doc[:n]])
    g = np.zeros(len(hashes) - shingle + 1, dtype=U64)
    for j in range(shingle):
        g = mix64(g + hashes[j:len(g) + j])
    return start, doc[start], mix64(smallest(g, window - shingle + 1)[start] + U64(1))


RUNS = "sid long, h long, start int, n int, cell long, ra long, rb long"
RUNS_ARROW = pa.schema([("sid", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
                        ("cell", pa.int64()), ("ra", pa.int64()), ("rb", pa.int64())])
KEYS = "sid long, h long, pos int, ka long, kb long"
KEYS_ARROW = pa.schema([("sid", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("ka", pa.int64()),
                        ("kb", pa.int64())])


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = [(t or b"").split() for t in byte_column(batch)]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return word_hashes([x for w in words for x in w]), lengths


def runs_of(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """Runs: neighbouring windows of a document with one cell hash, and the
    hash of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            hashes, lengths = _hashed(batch)
            start, doc, cell = windows_of(hashes, lengths, window, shingle)
            if not len(start):
                continue
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])])
            n = np.diff(np.r_[new, len(start)])
            a, d = start[new], doc[new]
            ra, rb = RollingHash(hashes)(a, a + n + window - 1)
            first = np.cumsum(lengths) - lengths
            sid, h = (np.asarray(batch.column(c)) for c in ("sid", "h"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid[d]), pa.array(h[d]), pa.array((a - first[d]).astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(signed(cell[new])), pa.array(signed(ra)),
                 pa.array(signed(rb))], schema=RUNS_ARROW)

    return docs.select("sid", "h", "text").mapInArrow(handing_back(run), RUNS)


def repeated_cells(runs: DataFrame, n_runs: int) -> tuple[DataFrame, int]:
    """Cells of the merged sketch with a count of two or more, and the width of its rows."""
    width = 1 << max(10, (CELLS_PER_RUN * max(n_runs, 1)).bit_length())
    cells = F.array(F.struct(F.lit(0).alias("row"), F.pmod(F.col("cell"), F.lit(width)).alias("at")),
                    F.struct(F.lit(1).alias("row"), F.pmod(F.xxhash64("cell"), F.lit(width)).alias("at")))
    counts = runs.select(F.explode(cells).alias("c")).groupBy("c.row", "c.at").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n >= 2"), width


def estimated_repeated(runs: DataFrame, n_runs: int) -> DataFrame:
    cells, width = repeated_cells(runs, n_runs)
    keyed = runs.withColumn("at0", F.pmod(F.col("cell"), F.lit(width))).withColumn(
        "at1", F.pmod(F.xxhash64("cell"), F.lit(width)))
    for row in (0, 1):
        keyed = keyed.join(cells.filter(F.col("row") == row).select(F.col("at").alias(f"at{row}")), f"at{row}",
                           "left_semi")
    return keyed.drop("at0", "at1")


def window_keys(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """128-bit keys of the windows in the ``spans`` (start, n) of ``wanted`` documents."""

    def run(batches):
        for batch in slices(batches, 128):
            hashes, lengths = _hashed(batch)
            first = np.cumsum(lengths) - lengths
            spans = batch.column("spans").to_pylist()
            a = [s["start"] + int(f) for f, row in zip(first, spans) for s in row]
            n = np.array([s["n"] for row in spans for s in row], dtype=np.int64)
            doc = np.repeat(np.arange(len(spans)), [len(row) for row in spans])
            pos = np.repeat(np.array(a, dtype=np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            ka, kb = RollingHash(hashes)(pos, pos + window)
            sid, h = (np.asarray(batch.column(c)) for c in ("sid", "h"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid[doc]), pa.array(h[doc]), pa.array((pos - first[doc]).astype(np.int32)),
                 pa.array(signed(ka)), pa.array(signed(kb))], schema=KEYS_ARROW)

    return docs.select("sid", "h", "text").join(wanted, ["sid", "h"]).mapInArrow(handing_back(run), KEYS)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(sid, h, ranges): word ranges of a document that windows cover which
    start in a document with a smaller id too."""
    runs = staged(runs_of(docs, window, shingle), "runs")
    maybe = estimated_repeated(runs, runs.count())
    whole = ["cell", "ra", "rb", "n"]
    # one row per distinct run of the cells, with the smallest id that has it
    distinct = staged(maybe.groupBy(*whole).agg(F.min("sid").alias("first"), F.max("sid").alias("last")), "runs-distinct")
    per_cell = distinct.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell"))
    known = (distinct.join(per_cell, "cell").filter((F.col("first") < F.col("last")) | (F.col("in_cell") > 1))
             .drop("last"))
    marked = staged(runs.join(known, whole).select("sid", "h", "start", "n", "first", "in_cell"), "runs-marked")
    copies = marked.filter(F.col("sid") > F.col("first")).select(
        "sid", "h", F.col("start").alias("a"), (F.col("start") + F.col("n") + (window - 1)).alias("b"))
    mixed = (marked.filter((F.col("sid") == F.col("first")) & (F.col("in_cell") > 1)).groupBy("sid", "h")
             .agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    keys = staged(window_keys(docs, mixed, window), "windows")
    # written first, so that the join below is one of two exchanges, which Spark splits where a key is frequent
    firsts = staged(keys.groupBy("ka", "kb").agg(F.min("sid").alias("first"), F.max("sid").alias("last"))
                    .filter("first < last").select("ka", "kb", "first"), "windows-first")
    single = (keys.join(firsts, ["ka", "kb"]).filter(F.col("sid") > F.col("first"))
              .select("sid", "h", F.col("pos").alias("a"), (F.col("pos") + window).alias("b")))
    return copies.unionByName(single).groupBy("sid", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept", pa.string()), ("kept_sha256", pa.string())])


def kept_words(words: list[bytes], spans) -> list[bytes]:
    """``words`` without those in any of the spans (a, b)."""
    kept, at = [], 0
    for a, b in sorted((s["a"], s["b"]) for s in ([] if spans is None else spans)):
        kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def _kept(docs: DataFrame, window: int, shingle: int, digest: bool) -> DataFrame:
    ranges = repeated_ranges(docs, window, shingle)
    arrow = pa.schema([f for f in KEPT_ARROW if f.name != ("kept" if digest else "kept_sha256")])

    def run(batches):
        for batch in slices(batches, 128):
            out = {f.name: [] for f in arrow}
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), byte_column(batch),
                                           batch.column("ranges").to_pylist()):
                words = (text or b"").split()
                kept = kept_words(words, spans)
                joined = b" ".join(kept)
                for k, v in zip(out, (doc_id, len(words), len(words) - len(kept),
                                      hashlib.sha256(joined).hexdigest() if digest else joined.decode())):
                    out[k].append(v)
            yield batch_of(arrow, out)

    ddl = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string")
    return docs.select("sid", "h", "doc_id", "text").join(ranges, ["sid", "h"], "left").select(
        "doc_id", "text", "ranges").mapInArrow(handing_back(run), ddl)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the kept words joined by a space.

    A word goes if a window over it also starts in a document with a smaller
    id. Windows are judged on the input. Words are runs without space, tab or
    line ends. A null text has no words. A null id comes after every other;
    rows with the same id (or null) never remove words of one another. Every
    row gives one row; an empty table gives none."""
    return _kept(documents(docs, id_col, text_col), window, shingle, False)


def kept_texts(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text. Texts that lose no
    word stay as they are; rows that lose every word go; rows without words
    stay."""
    ranges = repeated_ranges(documents(docs, id_col, text_col), window, shingle)
    keyed = docs.withColumns({"_sid": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
                              "_h": F.xxhash64(F.col(text_col).cast("string"))})
    ranges = ranges.select(F.col("sid").alias("_sid"), F.col("h").alias("_h"), F.col("ranges").alias("_ranges"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else b" ".join(kept_words((t or "").encode().split(), s)).decode()
                          for t, s in zip(texts, spans)], dtype=object)

    hit = keyed.join(ranges, ["_sid", "_h"], "left")
    out = hit.withColumn(text_col, cut(F.col(text_col).cast("string"), F.col("_ranges")))
    return out.filter(F.col("_ranges").isNull() | (F.col(text_col) != "")).select(*docs.columns)


def dedup_digests(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """As ``dedup_substrings``, with the SHA-256 of the kept words."""
    return _kept(documents(docs, id_col, text_col), window, shingle, True)
