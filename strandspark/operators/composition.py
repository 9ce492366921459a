"""Counting bytes and symbols: histograms, classes, details and shares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import AMBIGUOUS, BASES, IGNORED, UNKNOWN, byte_name, either, symbol_class
from .arrays import rows_of_bytes


def _bins(keys: int):
    def run(batches):
        for batch in batches:
            for row, end, raw, offsets in rows_of_bytes(batch.column(keys)):
                part = batch.slice(row, end - row)
                names: dict[tuple, int] = {}
                if keys:
                    owner = np.array([names.setdefault(k, len(names)) for k in zip(*(part.column(c).to_pylist() for c in range(keys)), strict=True)])
                    place = np.repeat(owner * 256, np.diff(offsets)) + raw
                else:
                    names[()], place = 0, raw
                bins = np.bincount(place, minlength=256 * len(names))
                found = np.flatnonzero(bins)
                rows = list(names)
                arrays = [pa.array([rows[k][c] for k in (found >> 8).tolist()], batch.schema.field(c).type) for c in range(keys)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found & 255, pa.int32()), pa.array(bins[found], pa.int64())], [*batch.schema.names[:keys], "byte", "n"])

    return run


def byte_histogram(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, byte, n): how often each byte value occurs. Bytes are counted where they are read; only bins are shuffled."""
    slim = df.select(*by, F.col(text).cast("binary").alias("raw"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema if f.name in by)
    return slim.mapInArrow(_bins(len(by)), f"{schema}byte int, n long").groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def merged_histograms(*parts: DataFrame) -> DataFrame:
    """Histograms (byte, n) added bin by bin."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("byte").agg(F.sum("n").alias("n"))


def significant(histogram: DataFrame) -> DataFrame:
    """The bins that count when histograms are compared: all but line ends."""
    return histogram.where(~F.col("byte").isin(*IGNORED))


COUNTED = ("n_a", "n_c", "n_g", "n_t", "n_unknown", "n_ambiguous", "n_invalid")


def _classes() -> np.ndarray:
    """The place in COUNTED of each byte value; one more for those that mean nothing."""
    place = np.full(256, 6, np.int64)
    for k, letters in enumerate([*BASES, UNKNOWN, AMBIGUOUS]):
        place[[ord(c) for c in either(letters)]] = k
    place[list(IGNORED)] = 7
    return place


def _counted(keys: int):
    place = _classes()

    def run(batches):
        for batch in batches:
            parts = []
            for row, end, raw, offsets in rows_of_bytes(batch.column(keys)):
                owner = np.repeat(np.arange(end - row) * 8, np.diff(offsets))
                parts.append(np.bincount(owner + place[raw], minlength=8 * (end - row)).reshape(-1, 8))
            counts = np.concatenate(parts) if parts else np.zeros((0, 8), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *(pa.array(counts[:, k], pa.int64()) for k in range(7))], [*batch.schema.names[:keys], *COUNTED])

    return run


def symbol_counts(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, n_a, n_c, n_g, n_t, n_unknown, n_ambiguous, n_invalid) of each row, counted in one pass over its bytes."""
    slim = df.select(*by, F.col(text).cast("binary").alias("_raw"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in by] + [f"{c} long" for c in COUNTED])
    return slim.mapInArrow(_counted(len(by)), schema)


def nucleotide_count(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group with the sums of ``symbol_counts`` and n_bases; nulls count nothing. Only counts are shuffled."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED}
    out = symbol_counts(df, text, by).groupBy(*by).agg(*sums.values())
    return out.withColumn("n_bases", F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t"))


def ambiguous_detail(histogram: DataFrame) -> DataFrame:
    """(letter, n) for each ambiguity code, both cases together."""
    return histogram.where(symbol_class(F.col("byte")) == "ambiguous").groupBy(F.upper(F.chr("byte")).alias("letter")).agg(F.sum("n").alias("n"))


def invalid_detail(histogram: DataFrame) -> DataFrame:
    """(byte, name, n) for each invalid byte, cases apart."""
    return histogram.where(symbol_class(F.col("byte")) == "invalid").select("byte", byte_name(F.col("byte")).alias("name"), "n")


def class_totals(histogram: DataFrame) -> DataFrame:
    """(class, n, kinds): bytes and distinct byte values of each class."""
    return histogram.groupBy(symbol_class(F.col("byte")).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def base_shares(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, base, n, pct): the share of each base among all bases of its group, 0 where there are none."""
    wide = nucleotide_count(df, text, by)
    long = wide.select(*by, "n_bases", F.expr("stack(4, 'A', n_a, 'C', n_c, 'G', n_g, 'T', n_t) as (base, n)"))
    return long.select(*by, "base", "n", F.when(F.col("n_bases") > 0, F.round(100 * F.col("n") / F.col("n_bases"), 6)).otherwise(0.0).alias("pct"))


def against(measured: DataFrame, expected: DataFrame, key: str = "byte") -> DataFrame:
    """(key, measured, expected, matches) of two tables (key, n): a missing row counts as 0."""
    a, b = measured.select(key, F.col("n").alias("measured")), expected.select(key, F.col("n").alias("expected"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("measured", F.lit(0)).cast("long").alias("measured"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return both.withColumn("matches", F.col("measured") == F.col("expected"))


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, total, pct): each group's part of the whole; null where the whole is 0."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("total"))
    whole = totals.agg(F.sum("total").alias("whole"))
    joined = totals.join(F.broadcast(whole))  # one row
    return joined.select(*by, "total", F.when(F.col("whole") != 0, F.round(100 * F.col("total") / F.col("whole"), 6)).alias("pct"))


def census(df: DataFrame, value: Column) -> DataFrame:
    """(part, total): what each partition of a job worked on."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(value).alias("total"))
