"""Sources and sinks.

Every writer goes through Spark's output committer (no temp-file/rename
dance), every reader declares its schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed column layout of the raw telemetry text files
RAW_COLUMNS = (["engine_id", "cycle"] + [f"setting_{i}" for i in range(1, 4)]
               + [f"sensor_{i}" for i in range(1, 22)])


def raw_schema(columns: Sequence[str] = RAW_COLUMNS) -> T.StructType:
    fields = [T.StructField("engine_id", T.LongType()), T.StructField("cycle", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in columns[2:]]
    return T.StructType(fields)


def read_telemetry(spark: SparkSession, path: str, dataset: str, split: str,
                   columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Whitespace-delimited, headerless rows; runs of blanks are one
    separator (a ' '-separated CSV reader would shift columns). A missing
    path raises (Spark's path check)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    schema = raw_schema(columns)
    cols = [parts.getItem(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    return (spark.read.text(path).filter(F.length(F.trim("value")) > 0)
            .select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), *cols))


def write_telemetry_text(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Inverse of S1 (used to stage raw files): blank-separated values."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")) \
        .write.mode("overwrite").text(path)


def read_rul(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """One value per line, line i belongs to the i-th smallest engine; blank
    lines do not count. A line's number is its rank in its file split plus the
    lines of the splits before (by file, then offset), so a truth file of any
    size is read in parallel and only the splits, not the lines, are ordered
    together."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = lines.filter(F.length("line") > 0)
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))
    ranked = lines.withColumn("rank", rank).join(splits, ["file", "start"])
    return ranked.select(F.lit(dataset).alias("dataset"), (F.col("before") + F.col("rank")).cast("long").alias("position"),
                         F.col("line").cast("int").alias("rul"))


def write_rul(truth: DataFrame, path: str) -> None:
    """Inverse of S2: one ordered text file, line i = position i, a trailing
    blank per line. The single writer sorts its rows (streamed, no array)."""
    (truth.select("position", F.concat(F.col("rul").cast("string"), F.lit(" ")).alias("value"))
     .coalesce(1).sortWithinPartitions("position").select("value")
     .write.mode("overwrite").text(path))


def check_rul_alignment(test: DataFrame, truth: DataFrame) -> DataFrame:
    """S3: number of truth rows vs number of test engines per dataset;
    ``aligned`` is false where they differ (the reference raises)."""
    e = test.groupBy("dataset").agg(F.count_distinct("engine_id").alias("engines"))
    r = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("rul_rows"))
    return e.join(r, "dataset", "full").select(
        "dataset", F.coalesce("engines", F.lit(0)).alias("engines"), F.coalesce("rul_rows", F.lit(0)).alias("rul_rows"),
        (F.coalesce("engines", F.lit(0)) == F.coalesce("rul_rows", F.lit(0))).alias("aligned"))


def assert_rul_alignment(test: DataFrame, truth: DataFrame) -> None:
    bad = check_rul_alignment(test, truth).filter(~F.col("aligned")).collect()
    if bad:
        b = bad[0]
        raise ValueError(f"{b.dataset}: {b.engines} test engines, but {b.rul_rows} truth rows")


def write_processed(df: DataFrame, path: str) -> None:
    """Overwrite processed splits, partitioned by dataset and split."""
    df.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def read_processed(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Processed table; a dataset filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if dataset is None else df.filter(F.col("dataset") == dataset)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", reset: bool = False) -> None:
    """Append result rows (``reset`` overwrites at run start)."""
    df.write.mode("overwrite" if reset else "append").format(fmt).save(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist parameter tables (reference statistics, scalers, centroids)."""
    df.write.mode("overwrite").format(fmt).save(path)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Small report tables as one CSV (header) or JSON file."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    r = spark.read.schema(schema)
    return r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)
