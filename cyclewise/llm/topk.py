"""Exact top-k search by pivot-table elimination.

Components are scaled to integers and the score is the inner product. A table
keeps the distance of every vector to many pivots. By the triangle inequality
the largest difference of two rows of it is a lower bound of the distance, and
with the norms an upper bound of the score:
2 <q, c> = |q|^2 + |c|^2 - |q - c|^2.

Rows lie in blocks of near vectors (same nearest pivot, dealt by a hash), and in
cells of nearer ones there. Each query is answered in its own block first; with
the k-th score found there, blocks whose bound stays below it are never opened,
and in opened ones cells whose bound does are not scored. The queries that meet
in a block are held against it together, by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.llm.common import staged

PIVOTS = 24
#: rows the pivots are picked from, at most
PIVOT_SAMPLE = 2048
BLOCK_ROWS = 2048
#: rows of a block that are ruled out together
CELL_ROWS = 128
#: scores of queries and rows that a task holds at a time
SCORES = 1 << 20


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Rows without id or vector,
    or with a null or non-finite component, are left out."""
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.transform(x, lambda e: F.floor(F.lit(scale) * e)).alias("v"))


def matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones end in zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def pick_pivots(rows: DataFrame, width: int, n: int, sample: int) -> np.ndarray:
    """Far-apart vectors of a sample taken by a hash of the id."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()
    vectors = np.unique(matrix([r.v for r in some], width), axis=0).astype(float)
    chosen, gap = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        gap = np.minimum(gap, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
        chosen.append(int(gap.argmax()))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


class Block:
    """Vectors of one block with their ids, in cells of near rows: ``low``, ``high`` and ``norm`` are a
    cell's smallest and largest pivot distances and its largest squared norm. Integers whose scores a
    narrower type holds exactly are kept in it (``exact``)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, exact: type):
        order = np.argsort(table[:, table.var(0).argmax()], kind="stable") if table.shape[1] else np.arange(len(ids))
        table = table[order]
        self.ids, self.i = ids[order], vectors[order]
        self.v = self.i.astype(float if exact is np.int64 else exact)
        self.exact = exact
        self.starts = np.arange(0, len(ids), CELL_ROWS)
        self.low, self.high = (f.reduceat(table, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.norm = np.maximum.reduceat((self.i.astype(float) ** 2).sum(1), self.starts)


def safe_gap(gap, q_norm, norm, far: float):
    """A distance bound less what rounding may have added to it; ``far`` is the largest pivot's norm."""
    return np.maximum(gap - 1e-6 * (1 + gap) - 1e-7 * (q_norm ** 0.5 + norm ** 0.5 + far), 0)


def upper(q_norm, norm, gap):
    """Bound of the inner product, with room for rounding."""
    return (q_norm + norm - gap ** 2) / 2 + 1e-6 + 1e-12 * (q_norm + norm)


def reaches(table: np.ndarray, q_norm: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray,
            norm: np.ndarray, far: float) -> np.ndarray:
    """Whether the bound between each query and each outline (``low``, ``high`` and ``norm`` of some rows)
    reaches the query's ``least``."""
    gap = np.zeros((len(table), len(norm)))
    for p in range(table.shape[1]):
        np.maximum(gap, np.maximum(low[:, p] - table[:, p, None], table[:, p, None] - high[:, p]), out=gap)
    bound = upper(q_norm[:, None], norm, safe_gap(gap, q_norm[:, None], norm, far))
    return bound >= (least - 1e-12 * np.where(np.isfinite(least), np.abs(least), 0))[:, None]


def search(q: np.ndarray, q_ids: np.ndarray, q_table: np.ndarray, least: np.ndarray, block: Block, k: int,
           far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vec_id, score) of each query's best k of the block among scores of at least ``least``.
    Cells whose bound stays below it are not scored. Scores beyond the integers that doubles hold are
    summed in 64-bit integers; one that does not fit them is an error."""
    found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    n, ids = len(block.ids), np.sort(block.ids)
    for at in range(0, len(q), step := max(1, SCORES // n)):
        part = q[at:at + step]
        qf = part.astype(block.v.dtype)
        floor = least[at:at + step]
        live = reaches(q_table[at:at + step], (part.astype(float) ** 2).sum(1), floor, block.low, block.high,
                       block.norm, far)
        none = np.iinfo(np.int64).min if block.exact is np.int64 else -np.inf
        scores = np.full((len(part), n), none, block.exact)
        for cells, some in _alike(live):
            rows = np.concatenate([np.arange(s, min(s + CELL_ROWS, n)) for s in block.starts[cells]])
            near = qf[some] @ block.v[rows].T
            if block.exact is np.int64:
                if (np.abs(near) >= 2.0 ** 63 * (1 - 1e-9)).any():
                    raise ValueError("a score of these vectors does not fit 64 bits; use a smaller scale")
                near = part[some] @ block.i[rows].T
            scores[np.ix_(some, rows)] = near
        mine = np.flatnonzero(np.searchsorted(ids, q_ids[at:at + step], "right")
                              > np.searchsorted(ids, q_ids[at:at + step]))
        scores[mine] = np.where(block.ids == q_ids[at:at + step][mine, None], none, scores[mine])
        hit = (scores >= (floor - 1e-12 * np.where(np.isfinite(floor), np.abs(floor), 0))[:, None]) & (scores > none)
        for i in np.flatnonzero(hit.sum(1) > k):
            values = scores[i][hit[i]]
            kth = np.partition(values, len(values) - k)[len(values) - k]
            above, level = np.flatnonzero(scores[i] > kth), np.flatnonzero(hit[i] & (scores[i] == kth))
            hit[i] = False
            hit[i, above] = True
            # of equal scores the smaller ids
            hit[i, level[np.argsort(block.ids[level], kind="stable")[:k - len(above)]]] = True
        rows, columns = np.nonzero(hit)
        found.append((rows + at, block.ids[columns], scores[rows, columns].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _alike(live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, queries) that cover each pair of ``live`` once: queries of the same cells together where most
    cells are live, else cell by cell."""
    if live.mean() > 0.5:
        yield np.arange(live.shape[1]), np.flatnonzero(live.any(1))
        return
    for c in np.flatnonzero(live.any(0)):
        yield np.array([c]), np.flatnonzero(live[:, c])


def queries_of(batch: pa.RecordBatch, width: int, pivots: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The queries of all rows of a batch as arrays, and where each row's begin and end."""
    lists, q = batch.column("queries"), batch.column("queries").flatten()
    offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    out = {c: q.field(c).to_numpy() for c in ("vec_id", "variant")}
    out["vector"] = np.frombuffer(b"".join(q.field("vector").to_pylist()), np.int64).reshape(len(q), width)
    out["tab"] = np.frombuffer(b"".join(q.field("tab").to_pylist())).reshape(len(q), pivots)
    known = q.type.get_field_index("least") >= 0
    least = q.field("least").to_numpy(zero_copy_only=False) if known else np.full(len(q), np.nan)
    out["least"] = np.where(np.isnan(least.astype(float)), -np.inf, least.astype(float))
    return out, offsets


PACKED = "block int, ids binary, vectors binary, tab binary, low binary, high binary, norm double"
FOUND = "query_id long, variant long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query row.

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows with
    another id; equal scores go to the smaller id. Vectors of unequal length
    count as ended by zeros. Rows that repeat a query's id and vector ask once;
    repeated candidates each count. A query with no candidate, and an empty
    table, give no rows. Scores are exact as far as they fit 64 bits, and an
    error beyond."""
    spark = vectors.sparkSession
    rows = staged(integer_vectors(vectors, scale, id_col, vector_col), "vectors")
    n, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform(
        "v", lambda e: F.abs(e))))).first()
    width = width or 0
    most = width * float(largest or 0) ** 2 * 2
    exact = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivot = pick_pivots(rows, width, pivots, PIVOT_SAMPLE)
    n_pivots, far = len(pivot), float(np.sqrt((pivot ** 2).sum(1).max()))

    def place(batches):
        for b in batches:
            v = matrix(b.column("v").to_pylist(), width)
            d = distances(v.astype(float), pivot)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([packed(x) for x in v]), pa.array([packed(x) for x in d]),
                 pa.array(d.argmin(1).astype(np.int32))], names=["vec_id", "vector", "tab", "nearest"])

    placed = staged(rows.mapInArrow(place, "vec_id long, vector binary, tab binary, nearest int"), "placed")
    counts = dict(placed.groupBy("nearest").count().collect())  # one row a pivot
    deal = [max(1, -(-counts.get(p, 0) // BLOCK_ROWS)) for p in range(n_pivots)]
    first = np.concatenate([[0], np.cumsum(deal)]).tolist()
    lists = F.array(*[F.lit(x) for x in deal]), F.array(*[F.lit(x) for x in first])
    block = (F.get(lists[1], F.col("nearest"))
             + F.pmod(F.xxhash64("vec_id"), F.get(lists[0], F.col("nearest")))).cast("int")
    placed = placed.withColumn("block", block)

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tab = np.frombuffer(b"".join(t.column("tab").to_pylist()), np.float64).reshape(t.num_rows, n_pivots)
        v = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.int64).reshape(t.num_rows, width).astype(float)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                         "ids": [packed(t.column("vec_id").to_numpy())], "vectors": [b"".join(t.column("vector").to_pylist())], "tab": [packed(tab)],
                         "low": [packed(tab.min(0))], "high": [packed(tab.max(0))],
                         "norm": [float((v ** 2).sum(1).max())]})

    blocks = staged(placed.groupBy("block").applyInArrow(pack, PACKED), "blocks")
    asked = placed.filter(is_query).select("vec_id", "vector", "tab", "block").distinct()
    asked = staged(asked.groupBy("block").agg(
        F.collect_list(F.struct("vec_id", F.xxhash64("vector").alias("variant"), "vector", "tab")).alias("queries")),
        "queries")

    def answer(batches):
        """Searches of the queries of each row in the row's block."""
        for b in batches:
            asked, offsets = queries_of(b, width, n_pivots)
            for i, (u, v) in enumerate(zip(offsets, offsets[1:])):
                ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
                blk = Block(ids, np.frombuffer(b.column("vectors")[i].as_buffer(), np.int64).reshape(len(ids), width),
                            np.frombuffer(b.column("tab")[i].as_buffer()).reshape(len(ids), n_pivots), exact)
                rows, found, score = search(asked["vector"][u:v], asked["vec_id"][u:v], asked["tab"][u:v],
                                            asked["least"][u:v], blk, k, far)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (asked["vec_id"][u:v][rows], asked["variant"][u:v][rows], found, score)],
                    names=["query_id", "variant", "vec_id", "score"])

    payload = blocks.select("block", "ids", "vectors", "tab")
    own = staged(asked.join(payload, "block").select("queries", "ids", "vectors", "tab").mapInArrow(answer, FOUND),
                 "own-block")
    kth = (own.groupBy("query_id", "variant")
           .agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(
               F.col("query_id").alias("vec_id"), "variant",
               F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).cast("double").alias("least")))
    one = asked.select(F.col("block").alias("home"), F.explode("queries").alias("q")).select("home", "q.*")
    known = staged(one.join(kth, ["vec_id", "variant"], "left").groupBy("home").agg(
        F.collect_list(F.struct("vec_id", "variant", "vector", "tab", "least")).alias("queries")), "queries-known")
    # every query block against every other block: first the blocks' outlines alone
    outlines = blocks.select("block", "low", "high", "norm")
    meet = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(first[-1] - 1)))).filter("block <> home")

    def open_blocks(batches):
        for b in batches:
            asked, offsets = queries_of(b, width, n_pivots)
            q_norm = (asked["vector"].astype(float) ** 2).sum(1)
            live = np.zeros(len(q_norm), bool)
            for i, (u, v) in enumerate(zip(offsets, offsets[1:])):
                low, high = (np.frombuffer(b.column(c)[i].as_buffer()).reshape(1, n_pivots) for c in ("low", "high"))
                live[u:v] = reaches(asked["tab"][u:v], q_norm[u:v], asked["least"][u:v], low, high,
                                    np.array([b.column("norm")[i].as_py()]), far)[:, 0]
            kept = np.r_[0, np.cumsum(live)][offsets]
            queries = pa.ListArray.from_arrays(pa.array(kept, pa.int32()),
                                               b.column("queries").flatten().filter(pa.array(live)))
            yield pa.RecordBatch.from_arrays([b.column("block"), queries], names=["block", "queries"]).filter(
                pa.array(np.diff(kept) > 0))

    opened = meet.join(outlines, "block").select("block", "queries", "low", "high", "norm").mapInArrow(
        open_blocks, OPEN)
    others = opened.join(payload, "block").select("queries", "ids", "vectors", "tab").mapInArrow(answer, FOUND)
    best = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return (own.unionByName(others).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


OPEN = ("block int, queries array<struct<vec_id: long, variant: long, vector: binary, tab: binary, least: double>>")
