"""Targets: piecewise-linear RUL (L1), positional truth (L2), clipping (L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise.functions.scan import ordered_scan
from cyclewise.session import stage

KEYS = ["dataset", "engine_id"]


def with_rul(df: DataFrame, max_rul: int | None = 125, keys=KEYS, cycle: str = "cycle",
             out: str = "rul") -> DataFrame:
    """RUL = min(max(cycle) of the engine - cycle, max_rul).

    The engine maximum is a partial (map-side) aggregate joined back on the
    engine key, so a very long engine is never held by one window task;
    AQE's skew join splits a hot engine on the big side. The maxima are a
    stage of known size: while Spark can broadcast them, the readings are not
    shuffled (else it would see that only after their shuffle, and a task would
    read all that one mapper wrote).
    """
    last = stage(df.groupBy(*keys).agg(F.max(cycle).alias("_last")))
    rul = F.col("_last") - F.col(cycle)
    if max_rul is not None:
        rul = F.least(rul, F.lit(max_rul))
    return df.join(last, list(keys)).withColumn(out, rul.cast("int")).drop("_last")


def engine_positions(df: DataFrame, keys=("dataset",), engine: str = "engine_id",
                     out: str = "position") -> DataFrame:
    """Distinct engines numbered 1..n in id order within ``keys`` (scan, no global window)."""
    engines = df.select(*keys, engine).distinct()
    return ordered_scan(engines, list(keys), [engine], out=out)


def attach_truth(test: DataFrame, truth: DataFrame, keys=("dataset",), engine: str = "engine_id",
                 required: bool = False) -> DataFrame:
    """L2: line i of the truth file belongs to the i-th smallest engine id.

    ``truth`` has (dataset, position, rul). Returns (dataset, engine_id, rul)
    for every test engine; an engine without a truth line keeps rul NULL and is
    reported by :func:`missing_truth`; with ``required`` it ends the query with
    an error that names it, as in the reference.
    """
    pos = engine_positions(test, keys, engine)
    rul = F.col("rul")
    if required:
        name = F.concat_ws(" ", *[F.col(k).cast("string") for k in (*keys, engine)])
        rul = F.coalesce(rul, F.raise_error(F.concat(F.lit("no truth for engine "), name)).cast("int")).alias("rul")
    return pos.join(truth, [*keys, "position"], "left").select(*keys, engine, "position", rul)


def missing_truth(test: DataFrame, truth: DataFrame, keys=("dataset",), engine: str = "engine_id") -> DataFrame:
    pos = engine_positions(test, keys, engine)
    return pos.join(truth, [*keys, "position"], "left_anti")


def clip_prediction(col: Column | str, lo: float = 0.0, hi: float = 125.0) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))
