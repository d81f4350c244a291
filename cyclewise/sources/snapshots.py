"""Sets of tables that change together (S8): versions and a pointer.

``publish`` writes all parts to a folder of their own and then one small
pointer file that names it. Pointers are numbered and created only if absent,
so two writers never share one and the highest complete pointer is the current
version. A writer that stops between the parts leaves the old version current;
readers name the version that they opened, so later ones do not disturb them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "pointer-"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[len(POINTER):]) for n in names if n.startswith(POINTER))


def latest(spark: SparkSession, path: str) -> str | None:
    """Name of the current version; None if nothing was published. A pointer
    without its final line end was not finished and does not count."""
    for number in reversed(_pointers(spark, path)):
        name = _read(spark, f"{path}/{POINTER}{number:08d}")
        if name.endswith("\n"):
            return name.strip()
    return None


def publish(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> str:
    """Write the parts as a new version and make it current."""
    version = f"version-{uuid.uuid4().hex}"
    for name, part in parts.items():
        part.write.parquet(f"{path}/{version}/{name}")
    number = max(_pointers(spark, path), default=0) + 1
    while True:
        fs, at = _fs(spark, f"{path}/{POINTER}{number:08d}")
        try:
            out = fs.create(at, False)
        except Exception:
            if not fs.exists(at):
                raise
            number += 1  # another writer took this number
            continue
        out.write(bytearray(f"{version}\n".encode()))
        out.close()
        return version


def load(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The parts of the current version, or of a given one."""
    version = version or latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    fs, at = _fs(spark, f"{path}/{version}")
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in names}
