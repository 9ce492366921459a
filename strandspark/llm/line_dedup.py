"""Removal of lines that many documents share: keep bitmaps instead of texts.

Every line long enough becomes a row of hashes with its document and position. Rows are partitioned by ranges of the line's hash
and sorted in them by document and position, so that the first occurrence of a line streams past before all others and tells
them to go. What comes back for a document is a bitmap of its lines, compressed: words of 64 lines in which all lines stay
are left out. Texts are neither sorted nor hashed twice; they meet their bitmap once, where lines are dropped.

A line that a large part of all rows holds would make one range too large. Such lines are found in a bounded sample; their
first document is an aggregate that tasks prepare, and it goes to all their rows instead. Which lines these are changes
nothing in the result.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

# What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the sample that finds frequent lines, and how often a line is in it at least: at most 8192 lines are frequent.
SAMPLE, OFTEN = 1 << 20, 128
WORD = 64


def _text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): ``row`` tells rows that share a doc_id apart; equal rows are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("text"))


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """(h1, h2, doc_id, row, pos): 128 bits of the key of every line with at least ``least`` code points."""
    each = _text(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = each.select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANK)).alias("bare")).where(F.length("bare") >= least)
    keyed = bare.withColumn("key", F.translate("bare", UPPER, LOWER))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "pos")


def frequent_lines(hashes: DataFrame, rows: int, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """(h1, h2) of lines that are often in a sample of about ``sample`` rows, sample / often of them at most."""
    every = max(1, rows // sample)
    drawn = hashes.where(F.pmod(F.xxhash64("h1", "doc_id", "row", "pos"), F.lit(every)) == 0)
    return drawn.groupBy("h1", "h2").agg(F.count("*").alias("_c")).where(F.col("_c") >= often).select("h1", "h2")


def dropped_lines(hashes: DataFrame, rows: int, rows_each: int = 400_000, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """(doc_id, row, pos) of the lines in ``hashes`` whose key is in a smaller doc_id too; null doc_ids are the smallest."""
    frequent = frequent_lines(hashes, rows, sample, often)
    of_frequent = hashes.join(F.broadcast(frequent), ["h1", "h2"])  # at most sample / often rows
    heads = written(of_frequent.groupBy("h1", "h2").agg(F.min(F.struct("doc_id")).alias("_first")), "frequent-lines")
    frequent_rows = hashes.join(F.broadcast(heads), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("_first.doc_id")))
    others = hashes.join(F.broadcast(heads), ["h1", "h2"], "left_anti")
    order = ["h1", "h2", F.col("doc_id").asc_nulls_first(), "pos"]
    dealt = others.repartitionByRange(max(1, -(-rows // rows_each)), "h1", "h2").sortWithinPartitions(*order)
    first = F.first("doc_id").over(Window.partitionBy("h1", "h2").orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, 0))
    other_rows = dealt.withColumn("_first", first).where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    columns = ["doc_id", "row", "pos"]
    return frequent_rows.select(*columns).unionByName(other_rows.select(*columns))


def keep_bitmaps(docs: DataFrame, least: int = 10, rows_each: int = 400_000, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """(doc_id, row, keep) of the documents that lose a line: ``keep`` has (word, bits), in order, of words with such a line.

    Bit k of word w is 1 where line 64 w + k stays; ``row`` is the xxhash64 of the text. Lines are what newlines part, and
    they are the same where their keys are: A-Z in lower case, without white space at both ends. Keys of at least ``least``
    code points that several doc_ids have stay in the smallest one, everywhere in it. Null and empty texts have one empty
    line, which stays. Rows that share a doc_id are one document, none of whose lines goes for the sake of the others; null
    doc_ids are one document too, the smallest. Other columns are ignored; an empty table has no bitmaps.
    """
    hashes = written(line_hashes(docs, least), "lines")
    gone = dropped_lines(hashes, hashes.count(), rows_each, sample, often)
    one = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = gone.groupBy("doc_id", "row", F.expr(f"cast(pos div {WORD} as int)").alias("word")).agg(F.bitwise_not(F.bit_or(one)).alias("bits"))
    return words.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def without_dropped(text: Column, keep: Column) -> Column:
    """``text`` without the lines that its bitmap drops: each array is gone through once."""
    number = F.transform(keep, lambda w: w["word"])
    before = F.concat(F.array(F.lit(-1)), F.slice(number, F.lit(1), F.size(keep) - 1))
    filled = F.flatten(F.zip_with(keep, before, lambda w, b: F.concat(F.array_repeat(F.expr("-1L"), w["word"] - b - 1), F.array(w["bits"]))))
    bits = F.flatten(F.transform(filled, lambda w: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit(w, k))))
    lines = F.zip_with(F.split(text, "\n", -1), bits, lambda line, bit: F.when(bit == 0, F.lit(None).cast("string")).otherwise(line))
    return F.when(keep.isNull(), text).otherwise(F.array_join(lines, "\n"))


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of ``docs``: what its bitmap leaves of the text, how many lines it had and lost.

    Without a bitmap a text stays as it is; a text that loses all its lines is empty, null texts become empty.
    """
    other = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "keep")
    own = _text(docs)
    both = own.join(other, own["doc_id"].eqNullSafe(other["_doc"]) & (own["row"] == other["_row"]), "left")
    lost = F.aggregate("keep", F.expr("0L"), lambda n, w: n + WORD - F.bit_count(w["bits"]))
    return both.select("doc_id", without_dropped(F.col("text"), F.col("keep")).alias("text"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(lost, F.expr("0L")).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = deduplicated(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
