"""Prepared tables of chunks: met without an exchange, cut without reading the rest."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F
from strandspark.operators import compare, sequences
from strandspark.sources import tables


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows_scanned(df):
    """Rows that the scan gave, after the row groups that statistics exclude were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def made(spark, n, change):
    """Ten sequences of n chunks of 64 symbols; ``change``: chunks of which one symbol is another."""
    text = F.concat(F.repeat(F.lit("ACGT"), 15), F.when(F.expr(change), "ACGA").otherwise("ACGT"))
    return spark.range(10 * n).select(F.floor(F.col("id") / n).alias("k"), (F.col("id") % n).alias("chunk"), (F.col("id") % n * 64).alias("start"), text.alias("bases"))


def test_tables_meet_without_an_exchange(spark):
    a, b = (tables.laid_out(made(spark, 300, change), "k", 4) for change in ("false", "id % 977 = 5"))
    both = tables.joined(a, b)
    assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
    assert both.count() == 3000
    some = tables.joined(a, b, unequal=True)
    assert "Exchange" not in plan_of(some)
    found = {(r["pair"], r["pos"], r["a"], r["b"]) for r in compare.differences(some).collect()}
    assert found == {(i // 300, i % 300 * 64 + 63, "T", "A") for i in range(3000) if i % 977 == 5}
    apart = tables.unlike_chunks(a, b)
    assert "bases" not in plan_of(apart) and {(r["key"], r["chunk"]) for r in apart.collect()} == {(i // 300, i % 300) for i in range(3000) if i % 977 == 5}


def test_a_slice_reads_a_fraction(spark):
    """Of 40,000 chunks of ten sequences a slice of 20 scans a few row groups."""
    table = tables.laid_out(made(spark, 4000, "id % 7 = 0"), "k", 4, group_bytes=1 << 14)
    held = tables.sliced(table, 3, 64 * 1000 + 10, 64 * 20, 64)
    text = "".join(r["bases"] for r in held.orderBy("chunk").collect())
    whole = "".join(r["bases"] for r in table.where("key = 3").orderBy("chunk").collect())
    assert text == whole[64_010 : 64_010 + 1280]
    assert 0 < rows_scanned(held) < 40_000 / 4


def test_chunks_on_one_side_nulls_and_nothing(spark):
    a = tables.laid_out(sequences.chunks(spark.createDataFrame([(1, "ACGTAC"), (2, "AC"), (None, "A")], "k long, text string"), "k", "text", 4), "k", 2)
    b = tables.laid_out(sequences.chunks(spark.createDataFrame([(1, "ACGT"), (2, "AG"), (3, "")], "k long, text string"), "k", "text", 4), "k", 2)
    assert sorted((tuple(r) for r in tables.unlike_chunks(a, b).collect()), key=str) == sorted([(1, 1), (2, 0), (None, 0)], key=str)
    assert sorted(map(tuple, tables.joined(a, b).collect())) == [(1, 0, "ACGT", "ACGT"), (2, 0, "AC", "AG")]
    none = tables.laid_out(sequences.chunks(spark.createDataFrame([], "k long, text string"), "k", "text", 4), "k", 2)
    assert tables.joined(a, none).count() == 0 and tables.sliced(none, 1, 0, 5, 4).count() == 0


def test_only_unequal_branches_are_read(spark):
    """Of 40,000 chunks ten differ in three branches: what is scanned of each table is a few row groups; the summary is that of texts."""
    change = "id in (7, 8, 9, 20001, 20002, 39990, 39991, 39992, 39993, 39999)"
    a, b = (tables.laid_out(made(spark, 4000, c), "k", 4, group_bytes=1 << 14) for c in ("false", change))
    branches = [tables.branches(t) for t in (a, b)]
    found = tables.differing(a, b, *branches)
    assert "Exchange" not in plan_of(found)
    assert {(r["pair"], r["start"] // 64) for r in found.collect()} == {(i // 4000, i % 4000) for i in (7, 8, 9, 20001, 20002, 39990, 39991, 39992, 39993, 39999)}
    for side in (a, b):
        spans = [((0, 0), (0, 63)), ((5, 0), (5, 63)), ((9, 3968), (9, 4031))]
        own = side.where(" or ".join(f"key = {low[0]} and chunk between {low[1]} and {high[1]}" for low, high in spans))
        assert rows_scanned(own) < 40_000 / 4
    got = {r["pair"]: r.asDict() for r in tables.summary(a, b, found).collect()}
    texts = [t.groupBy(F.col("key").alias("pair")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda p: p["bases"]), "").alias(n)) for t, n in ((a, "text_a"), (b, "text_b"))]
    assert got == {r["pair"]: r.asDict() for r in compare.summary(texts[0].join(texts[1], "pair")).collect()}
    every = tables.differing(a, b, *branches, most=2)  # more branches differ than are looked into one by one
    assert every.count() == 10 and {r["differences"] for r in tables.summary(a, b, every).collect()} == {r["differences"] for r in got.values()}
    assert tables.differing(a, a, branches[0], branches[0]).count() == 0
