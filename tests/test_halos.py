"""Patterns, places and windows of sequences in chunks of any size are those of whole texts."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from strandspark.operators import halos, patterns
from strandspark.operators.sequences import chunks

PATTERNS = ["A", "ATA", "GAT", "CAN", "GATTACA"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = [(k, "".join(r.choice("ACGTacgtN" if k % 3 else "CGCGA") for _ in range(r.randrange(90)))) for k in range(25)]
    rows += [(100, ""), (101, None), (102, "GATTACA" * 9), (103, "A"), (104, "ATATATATATAT"), (105, "ñGATñTACñA" * 4), (None, "GATTACAGATTACA")]
    return spark.createDataFrame(rows, "doc long, text string").cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [1, 3, 5, 64])
def test_counts_places_and_windows(texts, size):
    """Chunks of one symbol are shorter than any halo; those of 64 hold most texts whole."""
    cut = chunks(texts, "doc", "text", size)
    some = texts.where("length(text) > 0 and doc is not null")
    known = cut.where("doc is not null")
    whole = patterns.pattern_counts(some, "text", PATTERNS, ("doc",))
    assert rows(halos.chunk_pattern_counts(known, "doc", PATTERNS, size)) == rows(whole)
    for p in ("GAT", "GATTACA", "A"):
        assert rows(halos.chunk_pattern_positions(known, "doc", p, 4, size)) == rows(patterns.pattern_positions(some, "doc", "text", p, 4))
    for width, step in ((6, 4), (11, 3), (1, 1)):
        windows = patterns.windows(some, "doc", "text", width, step)
        assert rows(halos.chunk_windows(known, "doc", width, step, size)) == rows(windows)
        assert rows(halos.chunk_zone_density(known, "doc", width, step, size)) == rows(patterns.zone_density(windows, "doc"))
    assert rows(halos.chunk_first_invalid(known, "doc", 2)) == rows(patterns.first_invalid(some, "doc", "text", 2))


def test_a_null_key_is_a_sequence_like_others(texts):
    cut = chunks(texts.where("doc is null"), "doc", "text", 4)
    assert {(r["doc"], r["n"]) for r in halos.chunk_pattern_counts(cut, "doc", ["GATTACA"], 4).where("strand = '+'").collect()} == {(None, 2)}


def test_chunks_behind_a_gap_are_not_joined(spark):
    cut = spark.createDataFrame([(1, 0, 0, "GA"), (1, 2, 4, "TT")], "doc long, chunk int, start long, bases string")
    assert halos.borders(cut, "doc", 3, 2).collect() == []
    with pytest.raises(ValueError):
        halos.borders(cut, "doc", 0)


def test_only_edges_are_shuffled(spark):
    """What moves of a chunk are its edges: of 4 MB in chunks of 64 KB a few kilobytes."""
    cut = spark.range(64).select((F.col("id") * 0).alias("doc"), F.col("id").alias("chunk"), (F.col("id") * 65536).alias("start"), F.repeat(F.lit("ACGTTGCA"), 8192).alias("bases"))
    moved = halos.borders(cut, "doc", 6, 65536).select(F.sum(F.length("last") + F.length("next")).alias("n")).first()["n"]
    assert moved == 63 * 12
    plan = io.StringIO()
    with redirect_stdout(plan):
        halos.chunk_pattern_counts(cut, "doc", ["GATTACA"], 65536).explain()
    for line in plan.getvalue().splitlines():
        assert "Exchange" not in line or "bases" not in line
