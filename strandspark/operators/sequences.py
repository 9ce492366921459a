"""Long sequences as tables of chunks, and running positions that need no single task."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.folders import shared

CHUNK = 2048


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk, start, bases): each text cut into pieces of ``size`` characters; empty and null texts have none."""

    def run(batches):
        for batch in batches:
            rows, numbers, parts, held = [], [], [], 0
            for row, whole in enumerate(batch.column(1).to_pylist()):
                for at in range(0, len(whole or ""), size):
                    rows.append(row)
                    numbers.append(at // size)
                    parts.append(whole[at : at + size])
                    held += size
                    if held > 1 << 22:
                        yield made(batch, rows, numbers, parts)
                        rows, numbers, parts, held = [], [], [], 0
            yield made(batch, rows, numbers, parts)

    def made(batch, rows, numbers, parts):
        chunk = pa.array(numbers, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), chunk, pc.multiply(chunk.cast(pa.int64()), size), pa.array(parts, pa.string())], [batch.schema.names[0], "chunk", "start", "bases"])

    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, chunk int, start long, bases string")


def running_start(df: DataFrame, order: str, length: Column, rows_each: int = 200_000) -> DataFrame:
    """``df`` with ``start``: the sum of ``length`` over all rows before it in ``order``; of rows with equal order values the shorter ones come first.

    Rows are dealt to even ranges of the order, whatever its values, sorted there and written with the sum of those before
    them in their range. Sums of ranges, of which there is one in ``rows_each`` rows, then add up, and a broadcast of one row
    a range tells each row the rest: rows are shuffled once, and no task orders the whole table. Counts and writes the rows
    when it is called.
    """
    spark = df.sparkSession
    sized = df.withColumn("_length", length.cast("long"))
    parts = max(1, -(-df.count() // rows_each))
    keys = [F.col(order).asc_nulls_first(), F.col("_length").asc_nulls_first()]
    dealt = sized.repartitionByRange(parts, *keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    at = dealt.columns.index("_length")

    def run(batches):
        held = 0
        for batch in batches:
            own = pc.fill_null(batch.column(at), 0).to_numpy(zero_copy_only=False)
            ends = held + np.cumsum(own)
            if len(ends):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - own, pa.int64())], [*batch.schema.names, "_inside"])
                held = int(ends[-1])

    schema = StructType([*dealt.schema.fields, StructField("_inside", LongType())])
    path = f"{shared(spark)}/running-{uuid.uuid4().hex}"
    dealt.mapInArrow(run, schema).write.parquet(path)
    ranged = spark.read.schema(schema).parquet(path)
    totals = ranged.groupBy("_range").agg(F.max(F.col("_inside") + F.coalesce("_length", F.lit(0))).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = ranged.join(F.broadcast(totals), "_range")  # one row a range
    return joined.withColumn("start", (F.col("_before") + F.col("_inside")).cast("long")).select(*df.columns, "start")


def sliced(chunks: DataFrame, key: str, start: int, length: int, size: int = CHUNK) -> DataFrame:
    """(key, bases): ``length`` symbols from ``start`` of every sequence in a table of chunks that is long enough; shorter ones have none.

    Chunks outside are pruned by number; only those of one slice meet in a row.
    """
    held = chunks.where(F.col("chunk").between(start // size, (start + length - 1) // size))
    low = F.greatest(F.lit(start), F.col("start")) - F.col("start")
    high = F.least(F.lit(start + length), F.col("start") + F.length("bases")) - F.col("start")
    part = F.struct("chunk", F.substring("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    whole = held.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "").alias("bases"))
    return whole.where(F.length("bases") == length)


def records_at(positions: DataFrame, records: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Each position (pos, ...) with the record (rec, start, length) that holds it, and its place in the record.

    Both sides meet in buckets of ``width`` positions by an equi-join; a record is in every bucket that it touches.
    """
    last = F.floor((F.col("start") + F.col("length") - 1) / width).cast("long")
    spread = records.where("length > 0").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), last)))
    keyed = positions.withColumn("_bucket", F.floor(F.col("pos") / width).cast("long"))
    held = keyed.join(spread, "_bucket").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("length")))
    return held.withColumn("pos_in_record", F.col("pos") - F.col("start")).drop("_bucket")


def units(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk, start, n, crc32): the checksum of each unit of a text."""
    return chunks(df, key, text, size).select(key, "chunk", "start", F.length("bases").alias("n"), F.crc32(F.col("bases").cast("binary")).alias("crc32"))


def failed_units(measured: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, chunk, known, measured) of units whose checksum is missing or another: what must be done again."""
    a = measured.select(key, "chunk", F.col("crc32").alias("measured"))
    b = known.select(key, "chunk", F.col("crc32").alias("known"))
    return b.join(a, [key, "chunk"], "left").where(~F.col("known").eqNullSafe(F.col("measured"))).select(key, "chunk", "known", "measured")


def coverage(units: DataFrame, key: str) -> DataFrame:
    """(key, covered, gaps, overlaps) of units (key, start, n): whether they lie end to end from 0."""
    end = F.lag(F.col("start") + F.col("n")).over(Window.partitionBy(key).orderBy("start"))
    edges = units.withColumn("_end", F.coalesce(end, F.lit(0)))
    return edges.groupBy(key).agg(F.sum("n").cast("long").alias("covered"), F.count_if(F.col("start") > F.col("_end")).alias("gaps"), F.count_if(F.col("start") < F.col("_end")).alias("overlaps"))


def interleaved(pairs: DataFrame, width: int = 80) -> DataFrame:
    """(pair, row, side, line) of pairs (pair, text_a, text_b): row i of A, row i of B, up to the shorter one's rows.

    A line is the side, a space, the row number right-aligned to the width of the largest, a colon, a space, the symbols.
    """

    def run(batches):
        for batch in batches:
            pairs_, rows, sides, lines = [], [], [], []
            for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                many = min(-(-len(a or "") // width), -(-len(b or "") // width))
                wide = len(str(many))
                for row in range(many):
                    for side, text in (("A", a), ("B", b)):
                        pairs_.append(k)
                        rows.append(row + 1)
                        sides.append(side)
                        lines.append(f"{side} {row + 1:>{wide}}: {text[row * width : (row + 1) * width]}")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs_, pa.int64())), pa.array(rows, pa.int64()), pa.array(sides, pa.string()), pa.array(lines, pa.string())], ["pair", "row", "side", "line"])

    return pairs.select("pair", F.col("text_a").cast("string"), F.col("text_b").cast("string")).mapInArrow(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, row long, side string, line string")
