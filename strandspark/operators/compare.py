"""Position-wise comparison of pairs of sequences: exact totals, first differences, density."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import column_of, difference_class, row_of, similarity
from .arrays import points
from .sequences import CHUNK, chunks


def paired_pieces(pairs: DataFrame) -> DataFrame:
    """(pair, start, a, b) of pairs (pair, text_a, text_b): both texts up to the shorter one's end. Where a row holds both, no join is needed.

    Texts that don't fit a row are tables of chunks: ``joined_chunks``.
    """
    n = F.least(F.length("text_a"), F.length("text_b"))
    return pairs.where(n > 0).select("pair", F.lit(0).cast("long").alias("start"), F.substring("text_a", F.lit(1), n).alias("a"), F.substring("text_b", F.lit(1), n).alias("b"))


def joined_chunks(a: DataFrame, b: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """The same of two tables (key, text) whose sequences don't fit a row together: an equi-join on key and chunk."""
    left, right = chunks(a, key, text, size), chunks(b, key, text, size)
    both = left.select(key, "chunk", "start", F.col("bases").alias("a")).join(right.select(key, "chunk", F.col("bases").alias("b")), [key, "chunk"])
    n = F.least(F.length("a"), F.length("b"))
    return both.select(F.col(key).alias("pair"), "start", F.substring("a", F.lit(1), n).alias("a"), F.substring("b", F.lit(1), n).alias("b"))


def _unequal(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, a, b) of every differing place of the pieces (pair, start, a, b) of a batch, in order; both sides are equally long."""
    x, y = (points("".join(batch.column(k).to_pylist())) for k in (2, 3))
    ends = np.append(0, np.cumsum(pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)))
    at = np.flatnonzero(x != y)
    row = np.searchsorted(ends, at, "right") - 1
    return row, at - ends[row] + batch.column(1).to_numpy()[row], x[at], y[at]


def _limited(batches, column: int = 2, most: int = 1 << 20):
    """Batches of about ``most`` symbols of a text column: code points take four bytes each, on both sides."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _letters(codes: np.ndarray) -> pa.Array:
    if (codes == 0).any():  # numpy's texts can't end in this symbol
        return pa.array(list(map(chr, codes.tolist())), pa.string())
    return pa.array(codes.astype("<u4").view("<U1"), pa.string())


def _located(first: int | None):
    def run(batches):
        for batch in _limited(batches):
            row, pos, a, b = _unequal(batch)
            if first is not None:
                begin = np.searchsorted(row, row, "left")
                kept = np.arange(len(row)) - begin < first
                row, pos, a, b = row[kept], pos[kept], a[kept], b[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos, pa.int64()), _letters(a), _letters(b)], ["pair", "pos", "a", "b"])

    return run


def _tallied(batches):
    """(pair, length_a, length_b, a, b), a and b null where they are equal: how often they differ, and where first."""
    for batch in _limited(batches, 3):
        sides = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(3).fill_null(""), batch.column(4).fill_null("")], ["pair", "start", "a", "b"])
        row, pos, _, _ = _unequal(sides)
        rows, at = np.unique(row, return_index=True)
        first = np.full(batch.num_rows, -1)
        first[rows] = pos[at]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64()), pa.array(first, pa.int64(), mask=first < 0)], ["pair", "length_a", "length_b", "differences", "first_pos"])


def _bucketed(bucket: int):
    def run(batches):
        for batch in _limited(batches):
            row, pos, _, _ = _unequal(batch)
            found, n = np.unique(np.stack([row, pos // bucket]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[0])), pa.array(found[1], pa.int64()), pa.array(n, pa.int64())], ["pair", "_k", "n"])

    return run


def _sorted_out(batches):
    for batch in _limited(batches):
        row, _, a, b = _unequal(batch)
        a, b = (np.where((x >= 97) & (x <= 122), x - 32, x) for x in (a, b))
        kind = np.where(a == b, 0, np.where((a == 78) | (b == 78), 1, 2))
        found, n = np.unique(row * 3 + kind, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found // 3)), pa.array([KINDS[k] for k in (found % 3).tolist()], pa.string()), pa.array(n, pa.int64())], ["pair", "kind", "n"])


def _counted(batches):
    for batch in _limited(batches):
        row, pos, _, _ = _unequal(batch)
        found, at, n = np.unique(row, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found)), pa.array(n, pa.int64()), pa.array(pos[at], pa.int64())], ["pair", "differences", "first_pos"])


def counted(pieces: DataFrame) -> DataFrame:
    """(pair, differences, first_pos) of pairs with a difference: pieces are counted where they are, only counts leave them."""
    found = _unlike(pieces).mapInArrow(_counted, _typed(pieces, "differences long, first_pos long"))
    return found.groupBy("pair").agg(F.sum("differences").alias("differences"), F.min("first_pos").alias("first_pos"))


#: What a difference can be: the first of these that holds.
KINDS = ("case_only", "with_unknown", "real")


def _unlike(pieces: DataFrame) -> DataFrame:
    return pieces.where("a <> b").select("pair", "start", "a", "b")


def _typed(pieces: DataFrame, rest: str) -> str:
    return f"pair {pieces.schema['pair'].dataType.simpleString()}, {rest}"


def differences(pieces: DataFrame, width: int = 80, first: int | None = None) -> DataFrame:
    """(pair, pos, row, col, a, b, kind) of the differing positions: pos from 0, row and col from 1. Equal pieces are skipped.

    ``first``: only so many of each piece leave it, the first ones; a report of the first ones needs no others.
    """
    found = _unlike(pieces).mapInArrow(_located(first), _typed(pieces, "pos long, a string, b string"))
    pos = F.col("pos")
    return found.select("pair", "pos", row_of(pos, width).alias("row"), column_of(pos, width).alias("col"), "a", "b", difference_class(F.col("a"), F.col("b")).alias("kind"))


def kinds(pieces: DataFrame) -> DataFrame:
    """(pair, kind, n): how many differences of each kind, counted in the piece; only counts leave it."""
    return _unlike(pieces).mapInArrow(_sorted_out, _typed(pieces, "kind string, n long")).groupBy("pair", "kind").agg(F.sum("n").alias("n"))


def first_differences(pieces: DataFrame, k: int | None = 1000, width: int = 80) -> DataFrame:
    """The first ``k`` differences of each pair, by position; all of them for None. Totals never come from this."""
    found = differences(pieces, width, k)
    if k is None:
        return found
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("pair").orderBy("pos"))).where(F.col("_n") <= k).drop("_n")


def summary(pairs: DataFrame) -> DataFrame:
    """One row for each pair: compared, equal, differences, first_pos, similarity_pct, length_a, length_b, offset. One pass, no shuffle.

    Texts that are equal up to the shorter one's end stay in Spark.
    """
    n = F.least(F.length("text_a"), F.length("text_b"))
    a, b = F.substring("text_a", F.lit(1), n), F.substring("text_b", F.lit(1), n)
    sides = pairs.select("pair", F.coalesce(F.length("text_a"), F.lit(0)).cast("long").alias("length_a"), F.coalesce(F.length("text_b"), F.lit(0)).cast("long").alias("length_b"), a.alias("_a"), b.alias("_b"))
    unlike = F.col("_a") != F.col("_b")
    sides = sides.select("pair", "length_a", "length_b", F.when(unlike, F.col("_a")).alias("a"), F.when(unlike, F.col("_b")).alias("b"))
    out = sides.mapInArrow(_tallied, _typed(pairs, "length_a long, length_b long, differences long, first_pos long")).withColumn("compared", F.least("length_a", "length_b"))
    return out.select("pair", "compared", (F.col("compared") - F.col("differences")).alias("equal"), "differences", "first_pos", similarity(F.col("differences"), F.col("compared")).alias("similarity_pct"), "length_a", "length_b", (F.col("length_a") - F.col("length_b")).alias("offset"))


def _spread_out(bucket: int):
    def run(batches):
        for batch in _limited(batches, 2):
            sides = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(2).fill_null(""), batch.column(3).fill_null("")], ["pair", "start", "a", "b"])
            row, pos, _, _ = _unequal(sides)
            many = -(-batch.column(1).to_numpy() // bucket)
            first = np.cumsum(many) - many
            n = np.bincount(first[row] + pos // bucket, minlength=int(many.sum()))
            owner = np.repeat(np.arange(batch.num_rows), many)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array((np.arange(len(owner)) - first[owner]) * bucket, pa.int64()), pa.array(n, pa.int64())], ["pair", "bucket_start", "n"])

    return run


def pair_density(pairs: DataFrame, bucket: int) -> DataFrame:
    """(pair, bucket_start, n) of differences in each bucket of positions, empty buckets too, of pairs that a row holds. One pass, no shuffle."""
    n = F.least(F.length("text_a"), F.length("text_b"))
    sides = pairs.where("text_a is not null and text_b is not null").where(n > 0).select("pair", n.cast("long").alias("n"), F.substring("text_a", F.lit(1), n).alias("_a"), F.substring("text_b", F.lit(1), n).alias("_b"))
    unlike = F.col("_a") != F.col("_b")
    return sides.select("pair", "n", F.when(unlike, F.col("_a")).alias("a"), F.when(unlike, F.col("_b")).alias("b")).mapInArrow(_spread_out(bucket), _typed(pairs, "bucket_start long, n long"))


def density(pieces: DataFrame, compared: DataFrame, bucket: int) -> DataFrame:
    """The same of pieces, several of a pair; ``compared`` has (pair, compared).

    Differences are counted in their piece; only counts leave it.
    """
    spine = compared.where("compared > 0").select("pair", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("compared") - 1) / bucket).cast("long"))).alias("_k"))
    counted = _unlike(pieces).mapInArrow(_bucketed(bucket), _typed(pieces, "_k long, n long")).groupBy("pair", "_k").agg(F.sum("n").alias("n"))
    return spine.join(counted, ["pair", "_k"], "left").select("pair", (F.col("_k") * bucket).alias("bucket_start"), F.coalesce("n", F.lit(0)).alias("n"))


def totals(results: DataFrame) -> DataFrame:
    """One row over all pairs: sums of valid results only, in the numerator and the denominator, and how many are invalid."""
    valid = F.col("differences").between(0, F.col("compared"))
    out = results.agg(F.count("*").alias("pairs"), F.count_if(~valid).alias("invalid"), F.sum(F.when(valid, F.col("compared"))).alias("compared"), F.sum(F.when(valid, F.col("differences"))).alias("differences"))
    return out.withColumn("similarity_pct", similarity(F.col("differences"), F.col("compared")))
