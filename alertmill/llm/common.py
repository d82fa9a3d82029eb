"""Small helpers of the pipeline operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.session import scratch_path, settle

#: A side is broadcast only if it has been counted to hold no more rows than this.
BROADCAST_ROWS = 200_000
#: The same for a side of one column of row numbers.
BROADCAST_IDS = 2_000_000


def join_small(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table of one row per key: broadcast if counted to be small, else by a shuffle.

    In the shuffle a hot key of ``left`` is split by adaptive execution, as
    ``right`` holds a single row for it.
    """
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def rows_of(own: DataFrame, ids: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The rows of ``own``, whose ``_row`` is never null, that ``ids``, distinct row numbers, name.

    Texts are shuffled only if there are more than ``BROADCAST_IDS`` of them. With ``every``,
    all row numbers of ``own``, those that are not named may be broadcast instead.
    """
    column = ids.columns[0]
    names = ids.select(F.col(column).alias("_named"))
    on = F.col("_row") == F.col("_named")
    if every is not None:
        others = settle(every.join(names, on, "left_anti").select(F.col("_row").alias("_named")), "others")
        if others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            return own.join(F.broadcast(others), on, "left_anti")
    return join_small(own, names, on, "left_semi", BROADCAST_IDS)


def packed(df: DataFrame) -> DataFrame:
    """Each row as one struct ``_doc``, so that no column of the caller can clash with one of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str) -> Column:
    """128 bits that stand for a text: two hashes with different seeds. Null counts as empty."""
    text = text_or_empty(name)
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def numbered(df: DataFrame) -> DataFrame:
    """The rows written once with a number of their own in ``_row``, the same for every later reader.

    This holds whole texts, so it is written with the denser codec.
    """
    rows, path = df.withColumn("_row", F.monotonically_increasing_id()), scratch_path(df.sparkSession, "numbered")
    rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Remove the files of a table that ``settle`` has written, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
