"""Schema helpers (P1, P2, P3, P6): pure functions of ``df.columns``, no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DERIVED_TOKENS = ("_diff1", "_diff2", "_roll_mean", "_roll_std")


def sensor_columns(df_or_cols, substring: bool = False) -> list[str]:
    """Sensor columns by prefix (the profiling reports match a substring)."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else list(df_or_cols)
    return [c for c in cols if ("sensor_" in c if substring else c.startswith("sensor_"))]


def raw_sensor_columns(df_or_cols) -> list[str]:
    """Sensors without derived temporal columns (drift works on these)."""
    return [c for c in sensor_columns(df_or_cols) if not any(t in c for t in ("_diff", "_roll_"))]


def base_sensor_columns(df_or_cols) -> list[str]:
    """P2 (feature derivation variant): excludes exactly the derived tokens."""
    return [c for c in sensor_columns(df_or_cols) if not any(t in c for t in DERIVED_TOKENS)]


def feature_columns(df_or_cols) -> list[str]:
    """regime_id, sensors in table order (derived included), one-hots sorted."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else list(df_or_cols)
    out = ["regime_id"] if "regime_id" in cols else []
    out += [c for c in cols if c.startswith("sensor_")]
    out += sorted(c for c in cols if c.startswith("regime_onehot_"))
    return out


def cast_sensors(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Sensors to double before scaling."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in sensors else F.col(c) for c in df.columns])
