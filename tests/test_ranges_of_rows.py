"""Ranges by quantile, running sums and medians: even in spite of bursts, and exact."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from strandspark.operators import intervals, measurement, sequences


def test_a_burst_is_parted_evenly(spark):
    """90 % of the rows of ten years begin within one minute; values are microseconds, whose product with a number of ranges passes 2**63."""
    log = spark.range(20_000).select(F.when(F.col("id") < 18_000, 10**15 + F.col("id") * 3000).otherwise(F.col("id") * 10**10 * 16).cast("long").alias("start"))
    ranged, several = intervals.in_ranges(log, "start", rows_each=500)
    sizes = [r["count"] for r in ranged.groupBy("_b").count().collect()]
    assert several and len(sizes) >= 35 and max(sizes) < 1200
    edges = ranged.groupBy("_b").agg(F.min("start").alias("low"), F.max("start").alias("high")).orderBy("_b").collect()
    assert all(a["high"] < b["low"] for a, b in zip(edges[:-1], edges[1:], strict=True))


def test_one_range_needs_no_join(spark):
    log = spark.createDataFrame([("a", 1, 5), ("a", 4, 9), ("a", 20, 21), ("b", 1, 2)], "w string, start long, end long")
    out = io.StringIO()
    union = intervals.union(log, ["w"])
    with redirect_stdout(out):
        union.explain()
    assert sorted(map(tuple, union.collect())) == [("a", 1, 9), ("a", 20, 21), ("b", 1, 2)]
    assert "Join" not in out.getvalue() and out.getvalue().count("Exchange") == 1


@pytest.mark.parametrize("rows_each", [7, 50, 10_000])
def test_running_sums_shuffle_rows_once(spark, rows_each):
    r = random.Random(rows_each)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(9)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "n long, size long")
    got = sequences.running_start(df, "n", F.col("size"), rows_each)
    out = io.StringIO()
    with redirect_stdout(out):
        got.explain()
    assert "BroadcastHashJoin" in out.getvalue() and "hashpartitioning(_range" in out.getvalue()  # of one row a range
    kept = got.collect()
    assert len(kept) == 300
    place = 0
    for x in sorted(kept, key=lambda x: (x["start"], x["n"] is not None, x["n"] or 0, x["size"] or 0)):
        assert x["start"] == place
        place += x["size"] or 0


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_medians_are_exact(spark, accuracy):
    """Groups of every size around the border between few and many, with repeated times, nulls and a first run that is removed."""
    r = random.Random(accuracy)
    rows = [(g, k, r.choice([None, 1.5, 2.5, r.random() * 9, r.random() * 9])) for g in range(60) for k in range(g * 5 + 1)]
    rows += [(100, k, float(k % 50)) for k in range(2000)] + [(101, k, 7.0) for k in range(500)]
    got = {x["g"]: x["median"] for x in measurement.median_of_repeats(spark.createDataFrame(rows, "g int, k int, t double"), ["g"], "k", "t", accuracy).collect()}
    for g in {g for g, _, _ in rows}:
        own = [t for h, _, t in sorted(rows, key=lambda x: x[:2]) if h == g]
        rest = sorted(t for t in (own[1:] if own[0] is not None else own) if t is not None)
        n = sum(t is not None for t in own)
        assert got.get(g) == (rest[(n - 1) // 2] if n > 1 and (n - 1) // 2 < len(rest) else None), g


def test_only_what_lies_between_is_ordered(spark):
    """Of 200,000 distinct times of one group a few dozen reach the window."""
    runs = spark.range(200_000).select(F.lit("g").alias("g"), "id", F.pmod(F.col("id") * 7919, F.lit(200_003)).cast("double").alias("t"))
    found = measurement.median_of_repeats(runs, ["g"], "id", "t")
    times = sorted((k * 7919) % 200_003 for k in range(1, 200_000))
    assert found.first()["median"] == times[199_999 // 2]
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain()
    assert "percentile_approx" in out.getvalue()
