"""Byte counts of payloads, without a row per byte."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes counted at a time, so that the indexes of a batch stay small.
BLOCK = 1 << 21


def _cells(group: np.ndarray, groups: int, payload: pa.Array) -> np.ndarray:
    """Groups by 256 counts."""
    bounds = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1]
    data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
    found = np.zeros(groups * 256, np.int64)
    for low in range(int(bounds[0]), int(bounds[-1]), BLOCK):
        high = min(low + BLOCK, int(bounds[-1]))
        owner = np.searchsorted(bounds, np.arange(low, high), "right") - 1
        found += np.bincount(group[owner] * 256 + data[low:high], minlength=len(found))
    return found.reshape(groups, 256)


def byte_counts(df: DataFrame, keys: Sequence[str], payload: str, lead: bool = False) -> DataFrame:
    """(keys, byte, n): how often each byte (0 to 255) occurs in the binary column ``payload`` of a key.

    ``lead`` counts one more zero byte per payload. Null payloads count nothing;
    a key of empty payloads alone has no row. Batches are counted by numpy and
    summed in the task, so at most 256 rows per key and task are shuffled.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(payload).alias("_payload")).filter(F.col("_payload").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = pa.array(np.arange(batch.num_rows))
            own = pa.Table.from_arrays([*batch.columns[:-1], at], [*keys, "_at"]).group_by(keys, use_threads=False)
            lists = own.aggregate([("_at", "list")])
            sizes = np.diff(lists["_at_list"].combine_chunks().offsets.to_numpy())
            group = np.empty(batch.num_rows, np.int64)
            group[lists["_at_list"].combine_chunks().flatten().to_numpy()] = np.repeat(np.arange(len(sizes)), sizes)
            cells = _cells(group, len(sizes), batch.column(len(keys)).cast(pa.large_binary()))
            if lead:
                cells[:, 0] += sizes
            where, byte = np.nonzero(cells)
            named = [lists[k].combine_chunks().take(pa.array(where)) for k in keys]
            numbers = [pa.array(byte.astype(np.int32)), pa.array(cells[where, byte])]
            yield pa.RecordBatch.from_arrays([*named, *numbers], [*keys, "byte", "n"])

    counted = rows.mapInArrow(count, f"{schema}, byte int, n bigint")
    return counted.groupBy(*keys, "byte").agg(F.sum("n").alias("n"))
