"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of doc_id, whatever the partitioning. A keyed permutation of these numbers is the shuffle;
a row's shard and slot are the remainder and the quotient of its place, so both can be computed from the number alone,
and shards differ by one row at most. The permutation is a Feistel network on pairs (left, right) of a rectangle barely
larger than the number of rows; a place outside is permuted again until it falls inside.

DataFrame functions only. What goes to the driver is one count for each partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ROUNDS = 4


def rectangle(rows: int) -> tuple[int, int]:
    """The sides of the smallest near-square rectangle with at least ``rows`` places."""
    a = max(1, math.isqrt(max(1, rows)))
    return a, -(-max(1, rows) // a)


def feistel(place: Column, a: int, b: int, seed: int) -> Column:
    """The image of ``place`` in 0 .. a * b - 1 under the permutation that ``seed`` names."""
    def turn(pair: Column, k: Column) -> Column:
        left = F.pmod(pair["left"] + F.pmod(F.xxhash64(pair["right"], k, F.lit(2 * seed)), F.lit(a)), F.lit(a))
        right = F.pmod(pair["right"] + F.pmod(F.xxhash64(left, k, F.lit(2 * seed + 1)), F.lit(b)), F.lit(b))
        return F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))

    start = F.struct(F.floor(place / b).cast("long").alias("left"), F.pmod(place, F.lit(b)).cast("long").alias("right"))
    start = F.struct(F.expr("0L").alias("left"), F.expr("0L").alias("right")) if a * b == 1 else start
    return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), start, turn, lambda pair: pair["left"] * F.lit(b).cast("long") + pair["right"])


def shuffled(number: Column, rows: int, seed: int) -> Column:
    """The place of row ``number`` of ``rows`` in the shuffle: the walk along the permutation's cycle until it is inside.

    A cycle meets at most as many places outside as there are, so that many further steps always suffice.
    """
    a, b = rectangle(rows)
    outside = a * b - rows
    first = feistel(number, a, b, seed)
    if outside == 0:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda place, _: F.when(place < rows, place).otherwise(feistel(place, a, b, seed)))
    return F.when(first < rows, first).otherwise(walk)


def numbered(docs: DataFrame, rows_each: int = 200_000) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, number) with global row numbers from 0 in the order of doc_id, and the number of rows.

    Rows are dealt to ranges of doc_id and sorted there; numbers are places in a range plus the rows of those before it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = written(slim, "sizes")
    parts = max(1, -(-slim.count() // rows_each))
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    # Rows that are equal in all of this are dealt by their place, so that one row repeated is no task's alone.
    dealt = slim.repartitionByRange(parts, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")
    low = F.lit((1 << 33) - 1)
    part = F.shiftright("at", 33)
    before, rows = {}, 0
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():
        before[r["part"]], rows = rows, rows + r["count"]
    if not before:
        return dealt.withColumn("number", F.col("at")).drop("at"), 0
    starts = docs.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    out = dealt.withColumn("part", part.cast("long")).join(F.broadcast(starts), "part")
    return out.select("doc_id", "size", "text_crc32", (F.col("before") + F.col("at").bitwiseAND(low)).alias("number")), rows


def sharded(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id, text, ...).

    The law is ``rows``: counts of shards differ by one at most, slots run from 0 without gaps. Null texts count as empty
    (size 1); null doc_ids come first in the numbering; rows that are equal in doc_id, size and crc32 are exchangeable.
    An empty table gives an empty result. Equal texts are rows like all others and spread over the shards.
    """
    frame, rows = numbered(docs)
    frame = frame.withColumn("place", shuffled(F.col("number"), max(1, rows), seed))
    return frame.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
