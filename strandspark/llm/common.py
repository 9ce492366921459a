"""What several operators share: the shared folder, written tables, and words of an Arrow column as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared as shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder, which cuts its lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those with the smallest hashes of ``key``: a bounded sample that no partitioning changes.

    Keys are chosen first, without their rows, so that tasks send nothing but keys to choose from.
    """
    chosen = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most)
    return df.join(F.broadcast(chosen), key, "left_semi").orderBy(F.xxhash64(key), key).limit(most)


def parts(batches: Iterable[pa.RecordBatch], *columns: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches with about ``most`` bytes in these text columns; a longer row is one of its own.

    Spark bounds what it hands to Python at once by spark.sql.execution.arrow.maxBytesPerBatch; work arrays and results are
    larger than texts, so they are made for a part at a time. No setting of the session is changed.
    """
    for batch in batches:
        size = np.ones(batch.num_rows, np.int64)
        for k in columns:
            size += pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False)
        for row, end in slices(np.append(0, np.cumsum(size)), most):
            yield batch.slice(row, end - row)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, so that work arrays stay small; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers in which every bit depends on all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spans(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes without ``gap``, never across rows, and the offsets of the rows in them."""
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(gap))]
    first[edges] = ~gap[edges]
    last[edges - 1] = ~gap[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial modulo 2**64."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
