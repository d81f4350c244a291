"""Spark session defaults used by tests, the bench and the CLI entry points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # parameter tables (sensor x regime, sensor x bin, ...) are tiny; anything
    # data-sized is never broadcast on purpose, AQE decides from real sizes.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "cyclewise") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CYCLEWISE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: scratch folder of each local application that names none
_SCRATCH: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session may leave it unset (tests, local runs); it gets a
    scratch folder of its own. On a cluster that is an error, because the
    executors do not share the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="cyclewise-ckpt-")
        spark.sparkContext.setCheckpointDir(_SCRATCH[app])
    return _SCRATCH[app]


def _storable(kind: T.DataType) -> bool:
    """Whether Parquet holds the type."""
    if isinstance(kind, T.StructType):
        return all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType))


def stage(df):
    """Materialise a stage boundary as a Parquet table in the shared
    checkpoint folder (never localCheckpoint). Cuts the lineage so later
    branches neither re-run nor re-plan the upstream, a lost executor only
    re-reads files, and readers get column pruning and filter pushdown.
    Types Parquet cannot hold go to a reliable ``checkpoint()``."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not _storable(df.schema):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return df.checkpoint(eager=True)
    path = os.path.join(folder, "stage-" + uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job to read it from the files


cut_lineage = stage
