"""Pairing records of two files: by key, then by unique length; what stays alone is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import natural_order


def by_key(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of records (rec, key, length, start) with one key: the first of A, if the key occurs once in B. Null keys pair with none."""
    first = a.where("key is not null").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("start"))).where("_n = 1")
    once = b.where("key is not null").withColumn("_n", F.count("*").over(Window.partitionBy("key"))).where("_n = 1")
    return _pairs(first, once, "key", "key")


def by_length(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of records whose length occurs once in A and once in B."""
    alone = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy("length"))).where("_n = 1")
    return _pairs(alone(a), alone(b), "length", "length")


def _pairs(a: DataFrame, b: DataFrame, on: str, criterion: str) -> DataFrame:
    left = a.select(F.col(on).alias("_on"), F.col("rec").alias("rec_a"), "key", F.col("length").alias("length_a"), F.col("start").alias("start_a"))
    right = b.select(F.col(on).alias("_on"), F.col("rec").alias("rec_b"), F.col("length").alias("length_b"))
    both = left.join(right, "_on")
    return both.select("rec_a", "rec_b", "key", F.lit(criterion).alias("criterion"), F.least("length_a", "length_b").alias("length"), (F.col("length_a") - F.col("length_b")).alias("offset"), "start_a")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs by key, then by length among what is left.

    One outer join tells pairs by key from what is left on either side; a length that is left once on each side makes a
    pair, found by counting, without another join.
    """
    # Records without a key are keys of their own: they are many, and pair with none by key.
    own = Window.partitionBy("key", F.when(F.col("key").isNull(), F.col("rec")))
    first, once = F.row_number().over(own.orderBy("start")) == 1, F.count("*").over(own) == 1
    record = F.struct("rec", "key", "length", "start")

    def keyed(records: DataFrame, fit: Column, side: str) -> DataFrame:
        marked = records.withColumn("_fit", F.col("key").isNotNull() & fit)
        alone = F.concat(F.lit(side), F.coalesce(F.col("rec").cast("string"), F.lit("")))
        return marked.select(F.when(F.col("_fit"), F.col("key").cast("string")).otherwise("").alias("_on"), F.when(F.col("_fit"), "").otherwise(alone).alias("_own"), record.alias(f"_{side}"))

    both = keyed(a, first, "a").join(keyed(b, once, "b"), ["_on", "_own"], "full_outer")
    matched = both.where("_a is not null and _b is not null").select("_a", "_b", F.lit("key").alias("criterion"))
    rest = both.where("_a is null or _b is null").groupBy(F.coalesce("_a.length", "_b.length").alias("_length"))
    alone = rest.agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_na = 1 and _nb = 1 and _length is not null")
    found = matched.unionByName(alone.select("_a", "_b", F.lit("length").alias("criterion")))
    return found.select(F.col("_a.rec").alias("rec_a"), F.col("_b.rec").alias("rec_b"), "_a.key", "criterion", F.least("_a.length", "_b.length").alias("length"), (F.col("_a.length") - F.col("_b.length")).alias("offset"), F.col("_a.start").alias("start_a"))


def unpaired(records: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The records that are in no pair; they are never compared."""
    return records.join(pairs.select(F.col(side).alias("rec")), "rec", "left_anti")


def in_order(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``rank``, what they are ordered by: pairs by key first, numeric keys by value, then X, Y, MT, then other keys, then pairs by length, all by start in A.

    A struct compares by its fields in turn: sort by it, or write ranges of it, without one task for all.
    """
    keyed = F.when(F.col("criterion") == "key", natural_order(F.coalesce("key", F.lit("")))[0]).otherwise(9)
    number = F.when(F.col("criterion") == "key", natural_order(F.coalesce("key", F.lit("")))[1]).otherwise(0)
    name = F.when((F.col("criterion") == "key") & (keyed == 4), F.coalesce("key", F.lit(""))).otherwise("")
    return pairs.withColumn("rank", F.struct(keyed.alias("kind"), number.alias("number"), name.alias("name"), "start_a", "rec_a"))


def overview(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(criterion, pairs, covered) and, under ``alone_a`` and ``alone_b``, how many records have no partner."""
    counted = pairs.groupBy("criterion").agg(F.count("*").alias("pairs"), F.sum("length").cast("long").alias("covered"))
    alone = [unpaired(df, pairs, side).agg(F.lit(name).alias("criterion"), F.count("*").alias("pairs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("covered")) for df, side, name in ((a, "rec_a", "alone_a"), (b, "rec_b", "alone_b"))]
    return counted.unionByName(alone[0]).unionByName(alone[1])
