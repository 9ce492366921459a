"""Prepared tables of chunks: laid out once, then compared and cut without moving or reading what isn't asked for.

Chunks are dealt to buckets by (key, chunk) and sorted in them, one file a bucket. Two tables with the same number of buckets
meet chunk by chunk without an exchange, as often as they are compared; a slice reads the row groups whose statistics hold
its chunks. Each chunk keeps its digest, so equal chunks are told apart without their symbols.
"""

from __future__ import annotations

import uuid

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import similarity
from ..operators.compare import counted
from ..operators.sequences import CHUNK
from .folders import shared

#: Bytes of a row group: some hundred chunks of the default size, so that a slice of one sequence reads little else.
GROUP = 1 << 18
#: Bytes of text of a bucket: a task that compares two tables reads one of each.
BUCKET = 32 << 20


def buckets_for(*texts: DataFrame, text: str = "text") -> int:
    """How many buckets tables of these texts that are to meet need: one for each BUCKET bytes of the largest, 8 at least. Counts when it is called."""
    most = max(t.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] for t in texts)
    return max(8, -(-most // BUCKET))


def laid_out(chunks: DataFrame, key: str, buckets: int = 8, path: str | None = None, group_bytes: int = GROUP) -> DataFrame:
    """``chunks`` (key, chunk, start, bases) as a bucketed table with ``n`` (symbols) and ``digest``, in ``path`` or the shared folder, written when it is called.

    Tables that are to meet need the same number of buckets: ``buckets_for`` says how many. The table
    lives on in the folder; the session's catalog names it. Null keys and repeated chunks are rows like others; an empty
    table has no files.
    """
    spark = chunks.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    rows = chunks.select(F.col(key).alias("key"), F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.col("bases").cast("string").alias("bases"), F.length("bases").cast("long").alias("n"), F.xxhash64("bases", F.lit(1)).alias("digest"))
    dealt = rows.repartition(buckets, "key", "chunk")
    writer = dealt.write.bucketBy(buckets, "key", "chunk").sortBy("key", "chunk").option("parquet.block.size", group_bytes).option("parquet.page.size", group_bytes // 4)
    writer.saveAsTable(name, path=path or f"{shared(spark)}/{name}")
    return spark.table(name)


def joined(a: DataFrame, b: DataFrame, unequal: bool = False) -> DataFrame:
    """(pair, start, a, b) of two prepared tables: chunk by chunk up to the shorter one, where they lie; ``unequal``: only what differs.

    Chunks with other digests differ; those with equal ones are taken as equal (64 bits a chunk).
    """
    left = a.select("key", "chunk", "start", F.col("bases").alias("a"), F.col("digest").alias("_a"))
    right = b.select("key", "chunk", F.col("bases").alias("b"), F.col("digest").alias("_b"))
    both = left.hint("merge").join(right, ["key", "chunk"])
    both = both.where(F.col("_a") != F.col("_b")) if unequal else both
    n = F.least(F.length("a"), F.length("b"))
    return both.select(F.col("key").alias("pair"), "start", F.substring("a", F.lit(1), n).alias("a"), F.substring("b", F.lit(1), n).alias("b"))


def unlike_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, chunk) where two prepared tables differ or only one has a chunk: digests alone are read."""
    left, right = a.select("key", "chunk", F.col("digest").alias("_a")), b.select("key", "chunk", F.col("digest").alias("_b"))
    both = left.hint("merge").join(right, ["key", "chunk"], "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("key", "chunk")


#: So many branches of a tree are looked into one by one; where more differ, tables are read as wholes.
BRANCHES, FAN = 256, 64


def branches(table: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, branch, digest): a digest of each ``fan`` chunks, from theirs; write it beside a table that is compared often."""
    own = F.xxhash64("chunk", "digest")
    return table.groupBy("key", F.floor(F.col("chunk") / fan).alias("branch")).agg(F.bit_xor(own).alias("_x"), F.sum(F.shiftright(own, 8)).alias("_s"), F.count("*").alias("_c")).select("key", "branch", F.xxhash64("_x", "_s", "_c").alias("digest"))


def differing(a: DataFrame, b: DataFrame, branches_a: DataFrame, branches_b: DataFrame, fan: int = FAN, most: int = BRANCHES) -> DataFrame:
    """(pair, start, a, b): the unequal chunks that both prepared tables have; symbols are read of unequal branches alone.

    Digests of branches are compared first, when this is called. At most ``most`` that differ become conditions by which row
    groups are left out; where more differ, both tables are read as wholes. Either way chunks are told apart by their digests.
    """
    left, right = branches_a.select("key", "branch", F.col("digest").alias("_a")), branches_b.select("key", "branch", F.col("digest").alias("_b"))
    apart = left.join(right, ["key", "branch"]).where("_a <> _b").select("key", "branch")
    found = apart.limit(most + 1).collect()
    if len(found) > most:
        return joined(a, b, unequal=True)
    inside = reduce(or_, ((F.col("key") == r["key"]) & F.col("chunk").between(r["branch"] * fan, (r["branch"] + 1) * fan - 1) for r in found), F.lit(False))
    return joined(a.where(inside), b.where(inside), unequal=True)


def summary(a: DataFrame, b: DataFrame, unequal: DataFrame) -> DataFrame:
    """What ``compare.summary`` gives for texts, of the sequences that both prepared tables have; ``unequal`` is from ``differing`` or ``joined``.

    Lengths come from the column ``n``; symbols are compared in unequal chunks only.
    """
    both = a.select("key", "chunk", F.col("n").alias("_a")).hint("merge").join(b.select("key", "chunk", F.col("n").alias("_b")), ["key", "chunk"], "full_outer")
    sizes = both.groupBy(F.col("key").alias("pair")).agg(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.least("_a", "_b")).otherwise(0)).alias("compared"), F.sum("_a").alias("length_a"), F.sum("_b").alias("length_b"))
    known = sizes.where("length_a is not null and length_b is not null").join(counted(unequal), "pair", "left").withColumn("differences", F.coalesce("differences", F.lit(0)).cast("long"))
    return known.select("pair", "compared", (F.col("compared") - F.col("differences")).alias("equal"), "differences", "first_pos", similarity(F.col("differences"), F.col("compared")).alias("similarity_pct"), "length_a", "length_b", (F.col("length_a") - F.col("length_b")).alias("offset"))


def sliced(table: DataFrame, key, start: int, length: int, size: int = CHUNK) -> DataFrame:
    """(key, chunk, bases): ``length`` symbols from ``start`` of one sequence; statistics of row groups leave the rest unread."""
    held = table.where((F.col("key") == F.lit(key)) & F.col("chunk").between(start // size, max(start, start + length - 1) // size))
    low = F.greatest(F.lit(start), F.col("start")) - F.col("start")
    high = F.least(F.lit(start + length), F.col("start") + F.length("bases")) - F.col("start")
    return held.select("key", "chunk", F.substring("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("bases")).where(F.length("bases") > 0)
