"""Queries: labels and temporal features."""

from __future__ import annotations


from cyclewise.functions.exprs import r6
from cyclewise.operators.labels import with_rul
from cyclewise.operators.temporal import add_temporal, causality_audit
from cyclewise.plans.catalog import register
from cyclewise.plans.oracle import with_fleets
from cyclewise.sources.tables import fleet

W_ENGINE = "PARTITION BY dataset, engine_id ORDER BY cycle"


def temporal_sql(sensors, window=5, second=False, src="lab", rnd=True):
    def r(x):
        return f"round({x}, 6)" if rnd else x
    cols = []
    for s in sensors:
        cols.append(f"{r(f'coalesce({s} - lag({s}) OVER w, 0)')} AS {s}_diff1")
        cols.append(f"{r(f'avg({s}) OVER wr')} AS {s}_roll_mean{window}")
        cols.append(f"{r(f'coalesce(stddev_pop({s}) OVER wr, 0)')} AS {s}_roll_std{window}")
        if second:
            cols.append(f"{r(f'coalesce({s} - 2 * lag({s}, 1) OVER w + lag({s}, 2) OVER w, 0)')} AS {s}_diff2")
    return (", ".join(cols), f" FROM {src} WINDOW w AS ({W_ENGINE}), "
            f"wr AS ({W_ENGINE} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)")


RUL_SQL = ("lab AS (SELECT *, CAST(LEAST(max(cycle) OVER (PARTITION BY dataset, engine_id) - cycle, 125) "
           "AS INTEGER) AS rul FROM {src})")


def _rul_temporal(spark, sf, which, sensors, second=False):
    df = with_rul(fleet(spark, sf, which))
    out = add_temporal(df, sensors, 5, second)
    feats = [c for c in out.columns if c not in df.columns]
    return out.select("dataset", "engine_id", "cycle", "rul", *[r6(c).alias(c) for c in feats])


def _rul_temporal_sql(which, sensors, second=False):
    cols, tail = temporal_sql(sensors, 5, second)
    return (with_fleets(which, extra=RUL_SQL.format(src=f"fleet_{which}"))
            + f"SELECT dataset, engine_id, cycle, rul, {cols}{tail}")


@register("rul_temporal_events", _rul_temporal_sql("events", ["sensor_1", "sensor_2"]))
def rul_temporal_events(spark, sf):
    """Flagship slice: RUL labels + diff1 / rolling mean / rolling std."""
    return _rul_temporal(spark, sf, "events", ["sensor_1", "sensor_2"])


@register("rul_temporal_lineitem",
          _rul_temporal_sql("lineitem", ["sensor_1", "sensor_2", "sensor_3", "sensor_4"], True))
def rul_temporal_lineitem(spark, sf):
    return _rul_temporal(spark, sf, "lineitem", ["sensor_1", "sensor_2", "sensor_3", "sensor_4"], True)


@register("rul_labels_parts",
          with_fleets("parts", extra=RUL_SQL.format(src="fleet_parts"))
          + "SELECT dataset, split, engine_id, cycle, rul FROM lab")
def rul_labels_parts(spark, sf):
    """L1 on 20k short engines (every engine shorter than the 125 cap)."""
    return with_rul(fleet(spark, sf, "parts")).select("dataset", "split", "engine_id", "cycle", "rul")


def _audit_sql():
    sensors = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]
    feats = [f"{s}_{k}" for s in sensors for k in ("diff1", "roll_mean5", "roll_std5", "diff2")]
    cols_f, tail_f = temporal_sql(sensors, 5, True, src="fleet_lineitem", rnd=False)
    cols_p, tail_p = temporal_sql(sensors, 5, True, src="pre", rnd=False)
    checks = ", ".join(
        f"sum(CASE WHEN abs(f.{c} - p.{c}) <= 1e-9 OR (f.{c} IS NULL AND p.{c} IS NULL) THEN 0 ELSE 1 END) AS {c}"
        for c in feats)
    unp = "\nUNION ALL\n".join(f"SELECT dataset, '{c}' AS feature, CAST({c} AS BIGINT) AS violations FROM agg"
                                for c in feats)
    return (with_fleets("lineitem", extra=(
        "n AS (SELECT dataset, engine_id, max(cycle) AS n FROM fleet_lineitem GROUP BY dataset, engine_id), "
        "pre AS (SELECT fl.* FROM fleet_lineitem fl JOIN n USING (dataset, engine_id) WHERE cycle <= ceil(n * 0.6)), "
        f"ff AS (SELECT dataset, engine_id, cycle, {cols_f}{tail_f}), "
        f"pf AS (SELECT dataset, engine_id, cycle, {cols_p}{tail_p}), "
        f"agg AS (SELECT f.dataset, {checks} FROM pf p JOIN ff f USING (dataset, engine_id, cycle) GROUP BY f.dataset)"))
        + unp)


@register("causality_audit_lineitem", _audit_sql())
def causality_audit_lineitem(spark, sf):
    """Features on truncated engines equal the full-series features."""
    df = fleet(spark, sf, "lineitem")
    return causality_audit(df, ["sensor_1", "sensor_2", "sensor_3", "sensor_4"], 5, 0.6, second=True)
