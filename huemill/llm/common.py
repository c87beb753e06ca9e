"""What several operators share: shared-folder checkpoints, Arrow rows to numpy, packed exchange rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Null document ids sort before all others.
NULL_ID = -(2**63)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Materialises df in the folder that all executors share (spark.checkpoint.dir); the result outlives a lost executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions as the cluster's operator sized them for the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as tell it from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64, null as NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    """The inverse of ids_of."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def texts_of(column: pa.Array) -> list[str]:
    """Texts, null as the empty string."""
    return [t or "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes as one array, and the bounds of each text in it (n + 1 numbers); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The ranges of data one after the other, copied block by block, as indices take eight times the room of bytes."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    a = 0
    while a < len(ends):
        done = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, done + block, side="right")))
        out[done : int(ends[b - 1])] = data[ragged(starts[a:b], lengths[a:b])]
        a = b
    return out


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one have about limit bytes at most; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            to = max(at + 1, min(to, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to
