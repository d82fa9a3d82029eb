"""Scans of alert, sensor and packet logs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertmill.schemas import SENSOR_SCHEMA


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or of the first file in a folder."""
    return _csv(spark).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, typed by name; columns not in ``schema`` stay text.

    Column order and extra or missing optional columns do not matter.
    """
    types = {f.name: f.dataType for f in schema.fields}
    names = header(spark, path)
    read = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    return _csv(spark).schema(read).csv(path)


def _csv(spark: SparkSession):
    """Header, and quotes doubled inside quoted text."""
    return spark.read.option("header", True).option("escape", '"')


def read_alerts(spark: SparkSession, path: str, stream: str | None = None) -> DataFrame:
    """One capture: timestamp (UTC), type, and topic and message where present.

    Fails on an empty input or without ``timestamp``. Rows are not sorted here;
    every operator orders what it needs.
    """
    names = header(spark, path)
    if "timestamp" not in names:
        raise ValueError(f"no timestamp column in {path}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = _csv(spark).schema(text).csv(path)
    known = [c for c in ("type", "topic", "message") if c in names]
    extra = [narrow(F.col(f"`{c}`")).alias(c) for c in names if c not in ("timestamp", *known)]
    out = raw.select(parse_time(F.col("timestamp")).alias("timestamp"), *known, *extra)
    if out.isEmpty():
        raise ValueError(f"empty input: {path}")
    return out.withColumn("stream", F.lit(stream)) if stream else out


def parse_time(c: Column) -> Column:
    """ISO text with or without zone to TIMESTAMP, else NULL."""
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


def narrow(c: Column) -> Column:
    """Numbers as float; text that is no number becomes NULL."""
    return c.try_cast("float")


def downcast(df: DataFrame) -> DataFrame:
    """All double columns as float."""
    return df.withColumns({n: F.col(n).cast("float") for n, t in df.dtypes if t == "double"})


def land(df: DataFrame, path: str, by: str = "stream") -> DataFrame:
    """Store a scan once as Parquet, partitioned, and read it from there."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def landed_or_read(spark: SparkSession, csv_path: str, parquet_path: str, stream: str) -> DataFrame:
    """The stored copy if it is at least as new as the CSV, else read and store it."""
    if _newest(spark, parquet_path) >= _newest(spark, csv_path) > 0:
        return spark.read.parquet(parquet_path)
    return land(read_alerts(spark, csv_path, stream), parquet_path)


def _newest(spark: SparkSession, path: str) -> int:
    """Latest change of the files below a path in ms, 0 if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        row = files.load(path).select("modificationTime").agg(F.max(F.unix_millis("modificationTime")).alias("t")).first()
    except Exception as error:  # a path that does not exist yet
        if "PATH_NOT_FOUND" in str(error):
            return 0
        raise
    return row["t"] or 0


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files below ``path`` by their first line. One pass; as many rows as files reach the driver."""
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    found: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("first")).orderBy("file").collect():
        found.setdefault(r["first"].strip("\r"), []).append(r["file"])
    return found


def read_many(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every CSV of a folder, each by its own header; ``dataset`` is the file name without ending.

    Files with the same header are one scan; the scans are united by name, and
    a column that a file does not have is NULL in its rows.
    """
    scans = []
    types = {f.name: f.dataType for f in schema.fields}
    for files in headers(spark, path).values():
        names = _csv(spark).csv(files[0]).columns
        read = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        scans.append(_csv(spark).schema(read).option("basePath", path).csv(files))
    if not scans:
        raise ValueError(f"no files below {path}")
    df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_named(s) for s in scans])
    return df


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1))


def sensor_time(df: DataFrame) -> DataFrame:
    """``timestamp`` from date and time, or from the first time column there is; bad rows dropped.

    In a union of unlike files each row uses the first of these that it has.
    """
    stamps = []
    if {"date", "time"} <= set(df.columns):
        joined = F.concat_ws(" ", F.trim("date"), F.trim("time"))
        both = F.col("date").isNotNull() & F.col("time").isNotNull()
        stamps.append(F.when(both, F.try_to_timestamp(joined, F.lit("d-MMM-yy HH:mm:ss"))))
    single = [c for c in ("ts", "timestamp", "Time", "time") if c in df.columns]
    if not stamps and not single:
        raise ValueError("no time column in the sensor log")
    if single:
        value = F.coalesce(*[F.col(c).cast("string") for c in single])
        dated = F.col("date").isNotNull() if stamps else F.lit(False)
        stamps.append(F.when(~dated, parse_time(value)))
    stamp = F.coalesce(*stamps)
    return df.withColumn("timestamp", stamp).filter(F.col("timestamp").isNotNull())


RESERVED = {"date", "time", "ts", "timestamp", "Time", "label", "type", "dataset"}


def value_column(df: DataFrame) -> str | None:
    """The first numeric column that is not reserved."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return next((n for n, t in df.dtypes if n not in RESERVED and (t in numeric or t.startswith("decimal"))), None)


def read_sensors(spark: SparkSession, path: str, schema: T.StructType = SENSOR_SCHEMA) -> DataFrame:
    """Sensor logs of a folder with dataset, timestamp, label, type and the value columns."""
    df = sensor_time(read_many(spark, path, schema))
    if "label" not in df.columns:
        raise ValueError("no label column in the sensor log")
    return df if "type" in df.columns else df.withColumn("type", F.lit("unknown"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet log, all text; ``seq`` struct keeps the capture order over file splits."""
    df = read_csv(spark, path, T.StructType([]))
    where = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn("seq", where)


def catalogued(df: DataFrame, catalogue: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows of datasets that the catalogue lists."""
    return df.join(catalogue.select(key).distinct(), key, "left_semi")


