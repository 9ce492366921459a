"""FASTA files: lines, slices of chunks, checks of an input, and writers. Symbols, records and chunks with their places: ``ranges``."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.composition import nucleotide_count
from .folders import opened


class InputError(ValueError):
    """A file that can't be what it should be, said in words for its user."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, number, is_header, line): number ascends within a split of a file, which has its full path; a header begins with >."""
    seen = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))
    return seen.select("file", "split", "number", F.coalesce(F.col("line").startswith(">"), F.lit(False)).alias("is_header"), F.regexp_replace("line", "\r$", "").alias("line"))


def slice_of(chunks: DataFrame, file: str, rec: int, start: int, length: int, total: int, size: int = 1 << 16) -> DataFrame:
    """(file, rec, chunk, bases) of ``length`` symbols of a record from ``start``: whole chunks are pruned by number, the edges cut."""
    if start < 0 or length < 0 or start + length > total:
        raise InputError(f"a slice from {start} of {length} doesn't fit into {total} symbols")
    held = chunks.where((F.col("file") == file) & (F.col("rec") == rec) & F.col("chunk").between(start // size, max(start, start + length - 1) // size))
    low = F.greatest(F.lit(start), F.col("chunk") * size) - F.col("chunk") * size
    high = F.least(F.lit(start + length), (F.col("chunk") + 1) * size) - F.col("chunk") * size
    return held.select("file", "rec", "chunk", F.substring("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("bases"))


def validated(spark: SparkSession, path: str, sample: int = 50) -> None:
    """Raises InputError unless the first lines look like a sequence file with at least one base."""
    try:
        first = [r["value"] or "" for r in spark.read.text(path).limit(sample).collect()]
    except Exception as e:
        raise InputError(f"{path} can't be read: {type(e).__name__}") from e
    text = "".join(x for x in first if not x.startswith(">"))
    if not any(first):
        raise InputError(f"{path} is empty")
    if "\0" in text:
        raise InputError(f"{path} is a binary file")
    if not first[0].startswith(">") and sum(c in "ACGTNRYSWKMBDHVacgtnryswkmbdhv" for c in text) <= 0.9 * len(text):
        raise InputError(f"{path} doesn't look like a sequence")
    if not nucleotide_count(lines(spark, path).where(~F.col("is_header")), "line").first()["n_bases"]:
        raise InputError(f"{path} holds no bases")


def written(records: DataFrame, path: str, width: int | None = 80, in_order: bool = True, line_end: str = "\n") -> None:
    """Writes records (rec, header, text) as FASTA files with lines of ``width`` symbols, None: one line a record.

    In the order of rec, which sorts all texts, or else as they come. ``line_end`` can be that of other systems.
    """

    def run(batches):
        for batch in batches:
            for header, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step = width or max(1, len(text or ""))
                yield pa.RecordBatch.from_pydict({"value": pa.array([line_end.join([f">{header or ''}", *((text or "")[k : k + step] for k in range(0, len(text or ""), step))])], pa.string())})

    rows = records.repartitionByRange("rec").sortWithinPartitions("rec") if in_order else records
    rows.select("header", "text").mapInArrow(run, "value string").write.option("lineSep", line_end).text(path)


def prefix(placed_lines: DataFrame, symbols: int, first: int = 0) -> DataFrame:
    """The lines that begin before ``symbols`` and not before ``first``: a truncated copy that ends with a whole line."""
    return placed_lines.where((F.col("start") < symbols) & (F.col("start") >= first))


#: What an index of records has in a row.
INDEX = "file string, rec long, start long, length long, header string"


def write_index(records: DataFrame, path: str) -> None:
    """The place of each record as tab-separated text, the header last; files ascend with file and record."""
    rows = records.select("file", "rec", "start", "length", "header")
    rows.repartitionByRange("file", "rec").sortWithinPartitions("file", "rec").write.csv(path, sep="\t", quote="", escape="\\")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, start, length, header) of an index; headers may have quotes, not tabs."""
    return spark.read.schema(INDEX).csv(path, sep="\t", quote="", escape="\\")


def expected(spark: SparkSession, path: str) -> DataFrame:
    """(tag, fields) of an expected-answer file: tab-separated, # begins a comment, spaces in fields stay."""
    cut = F.split("value", "\t")
    return spark.read.text(path).where("value is not null and value <> '' and not startswith(value, '#')").select(cut[0].alias("tag"), F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))).alias("fields"))


def write_expected(rows: DataFrame, path: str) -> None:
    """Writes rows (tag, fields) in that form, in one file: answers are few."""
    rows.select(F.concat_ws("\t", "tag", F.array_join("fields", "\t")).alias("value")).coalesce(1).write.text(path)


def runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark tables with a fixed schema; blank cells are null, not 0."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="")


def write_runs(df: DataFrame, columns: list[str], path: str) -> None:
    """Writes exactly ``columns`` as one CSV file with a header, for the few runs of a benchmark; others are left out, missing ones are blank."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).coalesce(1).write.csv(path, header=True)


def fingerprint(spark: SparkSession, path: str, ends: int = 1 << 20) -> DataFrame:
    """(file, size, changed, ends): what must be the same for tables made from ``path`` to be up to date.

    ``ends`` is a hash of a file's first and last bytes, so many each: two files can share a name, a size and a date. Files
    are listed by Spark; tasks read nothing but these bytes.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))

    def run(batches):
        for batch in batches:
            found = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, own = opened(name)
                with source.open_input_file(own) as f:
                    head = f.read(min(size, ends))
                    f.seek(max(0, size - ends))
                    found.append(hashlib.sha256(head + f.read(ends)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["file", "size", "changed", "ends"])

    return listed.mapInArrow(run, "file string, size long, changed timestamp, ends string")


def up_to_date(current: DataFrame, known: DataFrame) -> DataFrame:
    """(file, fresh): whether what is known of each file still holds; false for files that are new or gone."""
    same = F.struct("size", "changed", "ends")
    both = current.select("file", same.alias("_now")).join(known.select("file", same.alias("_then")), "file", "full_outer")
    return both.select("file", F.coalesce(F.col("_now") == F.col("_then"), F.lit(False)).alias("fresh"))
