"""Shared plumbing: fresh column names, shared-folder paths, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a Python worker; bounds its temporaries.
SLICE_BYTES = 2 << 20


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of df has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        n = name
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting (tests on one machine) a local
    folder is chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "corvia-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the
    lineage that outlives any executor."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with large batches cut to about `limit` bytes."""

    def run(batches):
        release()
        for batch in batches:
            for part in sliced(batch, limit):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give back what the worker's earlier tasks left: it serves one after another,
    and allocators keep freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    sizes = np.full(n, 64, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
            sizes += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < n:
        base = total[begin - 1] if begin else 0
        end = int(np.searchsorted(total, base + limit, side="right"))
        end = max(end, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def strings(col: pa.Array) -> pa.Array:
    """Null-free utf8 array."""
    return pc.fill_null(col.cast(pa.string()), "")


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a null-free string array, without copying."""
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0])
    return raw[lo : int(offsets[-1])], offsets - lo


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]]; empty segments give 0."""
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["F", "T", "fresh", "map_batches", "release", "segment_sum", "shared_dir", "sliced", "stored", "strings", "table", "utf8_view"]
