"""Sequence files read by ranges of bytes: a line, however long, is read by as many tasks as ranges it lies in.

Two passes over the bytes, and no byte is shuffled. In the first, each range says in one row what it holds: symbols, headers,
and whether its last line is a header. What a range must know of those before it (inside which line it begins, the position and
the record there) and after it (where the next record begins) follows from these rows, of which a file of 100 TB has some
800,000 at the default size. In the second, each range is read with that knowledge: symbols, whole chunks and records come
with their places.

Only line feeds end lines; carriage returns are no symbols wherever they stand. What a line's first byte says holds for all of
it: > begins a header. A symbol belongs to the range in which it lies, a header and a chunk to that in which they begin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.symbols import header_fields
from .folders import opened, shared

RANGE = 128 << 20
#: Bytes read at once inside of a range, and first beyond its end.
BLOCK, BEYOND = 1 << 20, 1 << 12
PLACED = "file string, number int, first long, last long, header boolean, start long, rec long, in_rec long, next_start long"


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, number, first, last): the bytes of each file in ranges of ``size``, each of them a partition; empty files have none."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("_size"))
    cut = listed.where("_size > 0").select("file", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / size).cast("long"))).alias("_k"))
    each = cut.select("file", F.col("_k").cast("int").alias("number"), (F.col("_k") * size).alias("first"), F.least("_size", (F.col("_k") + 1) * size).alias("last"))
    return _dealt(each)


def _dealt(each: DataFrame) -> DataFrame:
    """Ranges (file, number, first, last, ...) dealt to tasks: as many as hold RANGE bytes each, or a few for each core where these are more.

    Small ranges share a task, so that tasks grow in number with the bytes and not with the ranges. Ranges that follow each
    other go to tasks that do.
    """
    many, held = each.agg(F.count("*"), F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0))).first()
    tasks = max(1, min(many, max(-(-held // RANGE), 4 * each.sparkSession.sparkContext.defaultParallelism)))
    return each.repartitionById(tasks, F.pmod(F.xxhash64("file") + F.col("number"), F.lit(tasks)).cast("int"))


def _runs(f, first: int, last: int, header: bool | None, beyond: bool = True) -> Iterator[tuple[str, int, np.ndarray]]:
    """(kind, place, bytes) of a file from ``first`` on, ``beyond`` last too, as long as more is asked for: little at first.

    ``header`` says what the line is in which the range begins. Kinds are header (one begins), more (of it), line (symbols
    and line ends), lead (as line, where it isn't known what the line is). No run reaches over ``last``.
    """
    f.seek(max(0, first - 1))
    fresh = first == 0 or f.read(1) == b"\n"
    at, more = first, BEYOND
    while at < last or beyond:
        raw = f.read(min(BLOCK, last - at) if at < last else more)
        if not raw:
            return
        if at >= last:
            more = min(BLOCK, 4 * more)
        block = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(block == 10)
        begin = np.append([0] if fresh else [], ends[ends + 1 < len(block)] + 1).astype(np.int64)
        heads = begin[block[begin] == 62]
        place = 0
        if not fresh and header is not False:
            place = int(ends[0]) + 1 if len(ends) else len(block)
            yield ("lead" if header is None else "more"), at, block[:place]
            if len(ends):
                header = False
        for head in heads.tolist():
            if head > place:
                yield "line", at + place, block[place:head]
            k = int(np.searchsorted(ends, head))
            place = int(ends[k]) + 1 if k < len(ends) else len(block)
            yield "header", at + head, block[head:place]
            header = place == len(block) and block[-1] != 10
        if place < len(block):
            yield "line", at + place, block[place:]
            header = False
        fresh = bool(block[-1] == 10)
        at += len(block)


def _symbols(data: np.ndarray) -> np.ndarray:
    return data[(data != 10) & (data != 13)]


def _summed(batches):
    """(..., lead, body, headers, before_first, before_last, header): what each range holds by itself."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for file, first, last in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            lead, body, headers, before_first, before_last, header = 0, 0, 0, None, None, None
            source, own = opened(file)
            with source.open_input_file(own) as f:
                for kind, at, data in _runs(f, first, last, None, False):
                    if kind == "lead":
                        lead += len(_symbols(data))
                        if data[-1] == 10 and at + len(data) < last:
                            header = False
                    elif kind == "header":
                        headers, before_last, header = headers + 1, body, True
                        before_first = body if before_first is None else before_first
                    elif kind == "line":
                        body, header = body + len(_symbols(data)), False
            for column, x in zip(out, (lead, body, headers, before_first, before_last, header), strict=True):
                column.append(x)
        kinds = (pa.int64(),) * 5 + (pa.bool_(),)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], [*batch.schema.names, "lead", "body", "headers", "before_first", "before_last", "ends_in"])


def placed(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, number, first, last, header, start, rec, in_rec, next_start): ranges with what is known at their first byte.

    header: whether it lies inside a header; start: symbols of the file before it; rec: headers before it; in_rec: symbols of
    the record before it; next_start: where the record after this range's last one begins, at the file's end if there is none.
    Reads all bytes once, when it is called; the result is one row a range, written to the shared folder.
    """
    schema = "file string, number int, first long, last long, lead long, body long, headers long, before_first long, before_last long, ends_in boolean"
    rows = ranges(spark, path, size).mapInArrow(_summed, schema)
    own = Window.partitionBy("file").orderBy("number")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    known = rows.withColumn("header", F.coalesce(F.last("ends_in", ignorenulls=True).over(before), F.lit(False)))
    known = known.withColumn("_lead", F.when(F.col("header"), 0).otherwise(F.col("lead"))).withColumn("_n", F.col("_lead") + F.col("body"))
    known = known.withColumn("start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("rec", F.coalesce(F.sum("headers").over(before), F.lit(0)))
    known = known.withColumn("_from", F.col("start") + F.col("_lead") + F.col("before_last")).withColumn("_next", F.col("start") + F.col("_lead") + F.col("before_first"))
    known = known.withColumn("in_rec", F.col("start") - F.coalesce(F.last("_from", ignorenulls=True).over(before), F.lit(0)))
    known = known.withColumn("next_start", F.coalesce(F.first("_next", ignorenulls=True).over(after), F.sum("_n").over(Window.partitionBy("file"))))
    known_at = f"{shared(spark)}/ranges-{uuid.uuid4().hex}"
    known.select(*(c.split()[0] for c in PLACED.split(", "))).write.parquet(known_at)
    return _dealt(spark.read.schema(PLACED).parquet(known_at))


def _each(batches, columns: list[tuple[str, pa.DataType]], read, most: int = 1 << 22):
    """Batches of what ``read`` gives for each range: (row, bytes that it holds)."""
    waiting: list[tuple] = []
    held = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*waiting, strict=True), columns, strict=True)], [n for n, _ in columns])

    for batch in batches:
        for own in batch.to_pylist():
            source, name = opened(own["file"])
            with source.open_input_file(name) as f:
                for row, size in read(f, own):
                    waiting.append(row)
                    held += size + 64
                    if held >= most:
                        yield flush()
                        waiting, held = [], 0
    if waiting:
        yield flush()


def _pieces(f, own):
    start, rec, in_rec = own["start"], own["rec"], own["in_rec"]
    for kind, _, data in _runs(f, own["first"], own["last"], own["header"], False):
        if kind == "header":
            rec, in_rec = rec + 1, 0
        elif kind == "line":
            symbols = _symbols(data)
            if len(symbols):
                yield (own["file"], rec, start, in_rec, symbols.tobytes()), len(symbols)
                start, in_rec = start + len(symbols), in_rec + len(symbols)


def pieces(placed_ranges: DataFrame) -> DataFrame:
    """(file, rec, start, in_rec, bases): all symbols, a megabyte or less a row, with their place in the file and in the record.

    ``bases`` are bytes. Symbols before the first header have rec 0.
    """
    columns = [("file", pa.string()), ("rec", pa.int64()), ("start", pa.int64()), ("in_rec", pa.int64()), ("bases", pa.binary())]
    return placed_ranges.mapInArrow(lambda b: _each(b, columns, _pieces), "file string, rec long, start long, in_rec long, bases binary")


def _records(f, own):
    start, rec = own["start"], own["rec"]
    waiting: tuple | None = None  # number, start, bytes of the header
    done = True

    def row(end):
        number, begin, parts = waiting
        text = b"".join(parts)[1:].rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
        return (own["file"], number, text, begin, end - begin), len(text)

    for kind, at, data in _runs(f, own["first"], own["last"], own["header"]):
        if at >= own["last"] and (done or kind != "more"):
            break
        if kind == "header":
            if waiting:
                yield row(start)
            rec += 1
            waiting, done = (rec, start, [data.tobytes()]), bool(data[-1] == 10)
        elif kind == "more" and waiting and not done:
            waiting[2].append(data.tobytes())
            done = bool(data[-1] == 10)
        elif kind == "line":
            start += len(_symbols(data))
    if waiting:
        yield row(own["next_start"])


def records(placed_ranges: DataFrame) -> DataFrame:
    """(file, rec, header, identifier, description, chromosome, start, length) of each header: nothing is shuffled.

    A header at the very end has length 0; what stands before the first header belongs to no record, but counts in starts.
    """
    columns = [("file", pa.string()), ("rec", pa.int64()), ("header", pa.string()), ("start", pa.int64()), ("length", pa.int64())]
    found = placed_ranges.mapInArrow(lambda b: _each(b, columns, _records), "file string, rec long, header string, start long, length long")
    return found.select("file", "rec", "header", *(c.alias(k) for k, c in header_fields(F.col("header")).items()), "start", "length")


def _chunks(size: int):
    def read(f, own):
        rec, place = own["rec"], own["in_rec"]
        skip = -place % size  # of a chunk that begins in a range before
        waiting: list[np.ndarray] = []
        held = 0

        def row():
            raw = b"".join(x.tobytes() for x in waiting)
            return (own["file"], rec, (place - held) // size, place - held, raw), len(raw)

        for kind, at, data in _runs(f, own["first"], own["last"], own["header"]):
            if at >= own["last"] and not held:
                return
            if kind == "header":
                if held:
                    yield row()
                if at >= own["last"]:
                    return
                rec, place, skip, waiting, held = rec + 1, 0, 0, [], 0
            elif kind == "line":
                symbols = _symbols(data)
                left = min(skip, len(symbols))
                symbols, skip, place = symbols[left:], skip - left, place + left
                while len(symbols):
                    part = symbols[: size - held]
                    symbols = symbols[len(part) :]
                    waiting.append(part)
                    held, place = held + len(part), place + len(part)
                    if held == size:
                        yield row()
                        waiting, held = [], 0
                        if at >= own["last"]:
                            return
        if held:
            yield row()

    return read


def chunks(placed_ranges: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(file, rec, chunk, start, bases): each record in chunks of ``size`` symbols, places in the record; ``bases`` are bytes.

    A chunk is read by the range in which it begins, over its end; nothing is shuffled.
    """
    columns = [("file", pa.string()), ("rec", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("bases", pa.binary())]
    return placed_ranges.mapInArrow(lambda b: _each(b, columns, _chunks(size)), "file string, rec long, chunk long, start long, bases binary")
