"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from itertools import compress, count, filterfalse, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.session import checkpoint_dir

#: stands for a missing document id in comparisons: after every real id
NO_ID = (1 << 63) - 1
#: most words a worker keeps in a memo table; words met later are computed each time
MEMO_WORDS = 300_000
#: rows an Arrow batch may hold; texts can be long
BATCH_ROWS = 512
U64 = np.uint64
MASK = (1 << 64) - 1


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, sid, text, h) and ``more``: of the input only the named columns,
    so others cannot clash. ``sid`` is the id with NO_ID for null, ``h`` a hash of the
    text; (sid, h) names a row's document in joins, so rows that repeat an id
    with another text stay apart and exact repeats share one result."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    *more)
    return out.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("sid"), F.xxhash64("text").alias("h"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: lets Spark remove the shuffle files of an execution at its end
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage).
    ``df`` itself must not be executed again: its shuffle files go at once."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of ``staged`` frames that nothing reads any more:
    everything made from them is itself a written table by then."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Memo(dict):
    """word -> value, filled on demand up to MEMO_WORDS entries.
    ``list(map(memo.__getitem__, words))`` runs at C speed on known words."""

    def __init__(self, fn, limit: int = MEMO_WORDS):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) < self.limit:
            self[key] = value
        return value


class BatchMemo(dict):
    """word -> value, where ``fill(words)`` computes the values of many words
    at once. ``learn`` makes sure that the given words are present; what goes
    beyond ``limit`` is kept for the current batch only."""

    def __init__(self, fill, limit: int = MEMO_WORDS):
        super().__init__()
        self.fill, self.limit, self.extra = fill, limit, []

    def learn(self, words) -> None:
        for w in self.extra:
            del self[w]
        # set.difference would walk the whole memo: it is no plain dict
        new = list(filterfalse(self.__contains__, set().union(*words)))
        room = max(0, self.limit - len(self))
        self.extra = new[room:]
        if new:
            self.update(zip(new, self.fill(new)))

    def values_of(self, lists: list[list]) -> list[list]:
        """The values (never None) of each list's words, as after ``learn``; a known word is looked up once."""
        for w in self.extra:
            del self[w]
        self.extra = []
        found = [list(map(self.get, words)) for words in lists]
        gaps = [list(compress(count(), map(is_, values, repeat(None)))) for values in found]
        self.learn([map(words.__getitem__, at) for words, at in zip(lists, gaps)])
        for words, values, at in zip(lists, found, gaps):
            for i in at:
                values[i] = self[words[i]]
        return found


def hand_back() -> None:
    """Return memory that is freed already to the system. Arrow and the C library
    keep it, and an idle worker would go on holding it beside its executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def handing_back(run):
    """``run`` for mapInArrow; what it held is handed back at the end of the task."""

    def whole(batches):
        yield from run(batches)
        hand_back()

    return whole


def byte_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def batch_of(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hash of each word; hashing one anew is faster than finding it in a table, and keeps no words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (wraps modulo 2**64)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive word hashes; a shorter
    document is one shingle, an empty one has none."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return shingle_hashes(h, n) ^ U64(n)
    acc = np.zeros(n - k + 1, dtype=U64)
    for j in range(k):
        acc = mix64(acc + h[j:n - k + 1 + j] + U64(j + 1))
    return acc


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def words_of(c: str | Column) -> Column:
    """Words of a text, JVM-side: maximal runs without space, tab or line ends."""
    return F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")),
                                F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
