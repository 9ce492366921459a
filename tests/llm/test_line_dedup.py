"""op13: lines that documents share, against plain sets."""

import hashlib
import io
from collections import defaultdict
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from strandspark.llm import line_dedup

LONG = "\n".join(f"line number {k % 977} of a long text" for k in range(3000))
ROWS = [(None, "Same line here\nx"), (None, "same LINE here \nother line of null"), (-5, "\tsame line here\x0b"), (-4, None), (-3, ""), (-2, LONG), (-1, LONG), (-1, LONG), (-6, "line number 3 of a long text\n\n" + LONG + "\nÀÉ accented LINE"), (-7, "àÉ accented line\nÀÉ accented line"), (-7, "second text of -7\nÀÉ ACCENTED LINE"), (3, "\n\n"), (4, "nine char\nnine char\nten  chars"), (5, "nine char\nTEN  CHARS\r")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows):
    held, cut = defaultdict(set), []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keys = [lower(x).strip(" \t\n\x0b\x0c\r") for x in lines]
        cut.append((doc_id, lines, keys))
        for k in keys:
            if len(k) >= 10:
                held[k].add((doc_id is not None, doc_id or 0))
    out = []
    for doc_id, lines, keys in cut:
        kept = [x for x, k in zip(lines, keys, strict=True) if k not in held or min(held[k]) == (doc_id is not None, doc_id or 0)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(docs, **how):
    return sorted((tuple(r) for r in line_dedup.deduplicated(docs, line_dedup.keep_bitmaps(docs, **how)).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"often": 2, "rows_each": 300}, {"sample": 50, "often": 3, "rows_each": 5000}])
def test_lines_against_plain_sets(spark, small, how):
    """With all lines rare, and with many of them frequent; the sample decides nothing."""
    own = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = own.unionByName(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert found(docs, **how) == plain([tuple(r) for r in docs.collect()])


def test_one_line_in_every_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Licensed to all of you\nown "), F.col("id").cast("string")).alias("text"))
    got = found(docs)
    assert sum(r[3] for r in got) == 2999 and got == plain([tuple(r) for r in docs.collect()])


def test_bitmaps_leave_out_words_that_stay(spark):
    text = "\n".join(f"own line number {k}" for k in range(640))
    docs = spark.createDataFrame([(1, "the line of both"), (2, text + "\nthe line of both")], "doc_id long, text string")
    (r,) = line_dedup.keep_bitmaps(docs).collect()
    assert (r["doc_id"], [tuple(w) for w in r["keep"]]) == (2, [(10, ~1)])


def test_clashing_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "one line of text", 1, 2, "k"), (2, "ONE line of text", 1, 2, "k")], "doc_id long, text string, row int, h1 int, keep string")
    assert found(docs) == [(1, "one line of text", 1, 0), (2, "", 1, 1)]
    assert found(docs.limit(0)) == []


def test_ranges_are_sorted_where_they_are(spark):
    """Hashes of lines are shuffled once, by range; the window needs no exchange of its own."""
    docs = spark.createDataFrame([(k, f"line {k} of text") for k in range(50)], "doc_id long, text string")
    plan = io.StringIO()
    with redirect_stdout(plan):
        line_dedup.dropped_lines(line_dedup.line_hashes(docs), 10_000_000).explain()
    window = plan.getvalue().split("Window")[1]
    assert "rangepartitioning(h1" in window and "hashpartitioning" not in window and "Python" not in window
