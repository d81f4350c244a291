"""Skew-proof ordered scans.

A plain ``Window.partitionBy(key).orderBy(x)`` puts every row of a key into a
single task. Telemetry keys (one engine, one sensor of the drift reference)
can hold a large share of all rows, so the two helpers here never do that:

* ``ordered_scan`` computes running sums (row numbers, ECDF prefix counts)
  with a range partitioning on ``(keys, order)``: a hot key is split across
  range partitions, each piece is scanned locally, and per-piece totals
  (one row per key x partition) supply the offsets.
* ``chunk_frames`` cuts a dense per-key sequence (``cycle``) into fixed-size
  chunks and copies ``halo`` rows of the previous chunk in front of each chunk,
  so any bounded trailing frame (lag, rolling mean, 50-row window) can run
  inside ``partitionBy(key, chunk)`` and give exactly the per-key result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise.functions.exprs import count_le_sorted

# rows per chunk for bounded trailing frames; an engine shorter than this
# stays in one chunk, a hot engine is spread over many tasks
DEFAULT_CHUNK = 200_000
# a key with more rows than this is split across tasks by ordered_scan
DEFAULT_HOT_ROWS = 2_000_000
# upper bound on the sampled piece bounds carried in the plan
MAX_PIECES = 8192


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def scan_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def piece_bounds(df: DataFrame, cols: Sequence[str | Column], pieces: int, seed: int = 17,
                 per_piece: int = 20) -> Column:
    """Sorted composite-key bounds cutting ``df`` into ~``pieces`` ranges,
    taken from a seeded sample (only the bounds reach the driver). Returns
    the bounds as one literal array of structs; it is small by construction."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_cols(cols))])
    total = df.count()
    frac = min(1.0, per_piece * pieces / max(total, 1))
    sample = df.select(key.alias("k")).sample(False, frac, seed)
    step = max(1, per_piece)
    rn = F.row_number().over(Window.orderBy("k"))  # sample-sized, bounded
    rows = [r.k for r in sample.withColumn("rn", rn).filter(F.col("rn") % step == 0).select("k").collect()]
    if not rows:
        return F.array().cast(T.ArrayType(df.select(key.alias("k")).schema["k"].dataType))
    ktype = df.select(key.alias("k")).schema["k"].dataType
    lits = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, ktype.fields)]) for r in rows]
    return F.array(*lits)


def hot_rows_threshold(df: DataFrame) -> int:
    """Rows a single key may hold before its scan is split (per task sort size)."""
    return int(df.sparkSession.conf.get("cyclewise.scan.hotRows", str(DEFAULT_HOT_ROWS)))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 weight: str | Column | None = None, out: str = "seq",
                 pieces: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``weight`` (default 1 per row)
    within ``keys`` in ``order``. With the default weight and a unique order
    this is ``row_number()``; with a count column it is an ECDF prefix count.

    One partial aggregate finds the hot keys (more than ``hot_rows`` rows;
    at most rows/hot_rows of them, so the list is small). Ordinary keys are
    scanned by a plain window. Rows of hot keys are cut into ranges of
    (keys, order) by sampled bounds - a row's piece is a pure function of its
    values, so the piece scan and the per-piece totals agree in every branch
    and on recomputation - and per-piece offsets are added back.
    """
    keys = list(keys)
    order_cols = _cols(order)
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if hot_rows is None:
        # hot = more rows than an average task of this job, and at least the floor
        total, biggest = counts.agg(F.sum("_n"), F.max("_n")).first()
        hot_rows = max(hot_rows_threshold(df), -(-(total or 0) // scan_partitions(df)))
        hot = [] if (biggest or 0) <= hot_rows else [
            r.asDict() for r in counts.filter(F.col("_n") > hot_rows).collect()]
    else:
        hot = [r.asDict() for r in counts.filter(F.col("_n") > hot_rows).collect()]
    if not hot:
        win = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(w).over(win))
    spark = df.sparkSession
    hot_total = sum(h["_n"] for h in hot)
    n = pieces or min(MAX_PIECES, max(2, -(-hot_total // hot_rows) * 2))
    hot_df = spark.createDataFrame([{k: h[k] for k in keys} for h in hot], df.select(*keys).schema)
    marked = df.join(F.broadcast(hot_df.withColumn("_hot", F.lit(True))), keys, "left")
    sort_cols = [F.col(k) for k in keys] + order_cols
    bounds = piece_bounds(marked.filter(F.col("_hot")), sort_cols, n)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_cols)])
    pid = F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(count_le_sorted(bounds, key, max_len=n + 1))
    # dealt by piece too: an earlier partitioning by the keys alone would do for the window below
    base = marked.withColumn("_w", w).withColumn("_pid", pid).drop("_hot").repartition(*keys, "_pid")
    local = Window.partitionBy(*keys, "_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    scanned = base.withColumn("_local", F.sum("_w").over(local))
    totals = base.filter(F.col("_pid") >= 0).groupBy(*keys, "_pid").agg(F.sum("_w").alias("_tot"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_pid", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    return (scanned.join(F.broadcast(offsets), [*keys, "_pid"], "left")
            .withColumn(out, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local"))
            .drop("_w", "_pid", "_local", "_off"))


def chunk_frames(df: DataFrame, seq_col: str, halo: int, chunk: int = DEFAULT_CHUNK,
                 keys: Sequence[str] = ("dataset", "engine_id")) -> DataFrame:
    """Assign ``_chunk`` from a dense 1-based sequence and duplicate the last
    ``halo`` rows of every chunk into the next one (``_halo`` = True there).
    Run windows over ``partitionBy(keys + ['_chunk'])`` and drop halo rows.

    The rows are dealt anew by (keys, _chunk): after a join on the keys alone
    the data would count as partitioned well enough for those windows, and a
    hot key would stay in one task whatever its chunks."""
    if halo >= chunk:
        raise ValueError("halo must be smaller than the chunk size")
    c = F.floor((F.col(seq_col) - 1) / F.lit(chunk)).cast("long")
    tail = ((F.col(seq_col) - 1) % F.lit(chunk)) >= F.lit(chunk - halo)
    home = F.struct(c.alias("c"), F.lit(False).alias("h"))
    spill = F.struct((c + 1).alias("c"), F.lit(True).alias("h"))
    exploded = df.withColumn("_ch", F.explode(F.when(tail, F.array(home, spill)).otherwise(F.array(home))))
    return (exploded.withColumn("_chunk", F.col("_ch.c")).withColumn("_halo", F.col("_ch.h"))
            .drop("_ch").repartition(*keys, "_chunk"))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk")
