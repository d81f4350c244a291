"""DuckDB SQL for the telemetry views, shared by every oracle query.

Mirrors ``cyclewise.sources.tables.fleet``; queries prepend ``with_fleets()``.
"""

from __future__ import annotations

FLEET_EVENTS = """
fleet_events AS (
  SELECT 'events' AS dataset,
         CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CAST(user_id AS BIGINT) AS engine_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS cycle,
         CAST(0.0 AS DOUBLE) AS setting_1, CAST(0.0 AS DOUBLE) AS setting_2, CAST(0.0 AS DOUBLE) AS setting_3,
         event_type AS regime_key,
         CAST(value AS DOUBLE) AS sensor_1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sensor_2,
         CAST(1.0 AS DOUBLE) AS sensor_3
  FROM events)"""


def _lineitem_fleet(name: str, engine: str) -> str:
    return f"""
fleet_{name} AS (
  SELECT '{name}' AS dataset,
         CASE WHEN {engine} % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CAST({engine} AS BIGINT) AS engine_id,
         CAST(row_number() OVER (PARTITION BY {engine}
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS cycle,
         CAST(l_discount AS DOUBLE) AS setting_1, CAST(l_tax AS DOUBLE) AS setting_2,
         CAST(l_quantity AS DOUBLE) AS setting_3,
         l_returnflag || l_linestatus AS regime_key,
         CAST(l_quantity AS DOUBLE) AS sensor_1, CAST(l_extendedprice AS DOUBLE) AS sensor_2,
         CAST(l_discount AS DOUBLE) AS sensor_3, CAST(l_tax AS DOUBLE) AS sensor_4
  FROM lineitem)"""


FLEET_SQL = {
    "events": FLEET_EVENTS,
    "lineitem": _lineitem_fleet("lineitem", "l_suppkey"),
    "parts": _lineitem_fleet("parts", "l_partkey"),
}

SENSORS_SQL = {
    "events": ["sensor_1", "sensor_2", "sensor_3"],
    "lineitem": ["sensor_1", "sensor_2", "sensor_3", "sensor_4"],
    "parts": ["sensor_1", "sensor_2", "sensor_3", "sensor_4"],
}


def with_fleets(*names: str, extra: str = "") -> str:
    parts = [FLEET_SQL[n] for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",".join(parts) + "\n"


def long_sql(name: str, src: str | None = None, value_cols=None, keep="dataset, split, engine_id, cycle") -> str:
    """UNPIVOT as a UNION ALL (portable), one row per (row, sensor)."""
    src = src or f"fleet_{name}"
    cols = value_cols or SENSORS_SQL[name]
    return "\nUNION ALL\n".join(
        f"SELECT {keep}, '{c}' AS sensor, {c} AS value FROM {src}" for c in cols)
