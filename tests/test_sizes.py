"""What a task holds, reads and makes doesn't grow with the input."""

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from strandspark.operators import generators
from strandspark.operators import patterns
from strandspark.operators import quantised
from strandspark.plans import queries
from strandspark.sources import planted, tables
from strandspark.sources import ranges


def test_units_made_side_by_side_are_those_made_alone(spark):
    """Remainders without a division, and units of one part of several keys and lengths."""
    at = np.concatenate([np.arange(3000), np.arange(2**31 - 20, 2**31 + 20), np.arange(2**40, 2**40 + 50)])
    x = (at + 1234 * 7919 + 4 * 104_729) % generators.PRIME
    for _ in range(3):
        x = (x * generators.FACTOR + 12_345) % generators.PRIME
    assert (generators.draws(at, 1234, 4) == x).all()
    assert generators.texts_of(np.frombuffer(b"ACGTN", np.uint8), np.array([0, 2, 2, 5])).to_pylist() == ["AC", "", "GTN"]
    rows = [(-7, 700_000), (2**40, 1), (3, 1030)]
    together = generators.sequences(spark.createDataFrame(rows, "k long, n long").coalesce(1), "k", "n", 300).collect()
    alone = [r for row in rows for r in generators.sequences(spark.createDataFrame([row], "k long, n long"), "k", "n", 300).collect()]
    assert sorted(together) == sorted(alone) and sum(len(r["bases"]) for r in together) == 701_031


def batch_of_chunks(many):
    text = pa.array(["ACGTTGCAACCGGNTT" * 64] * many)
    return pa.RecordBatch.from_arrays([pa.array(range(many), pa.int64()), text, pa.array([0] * many, pa.int64()), pa.nulls(many, pa.int64())], ["key", "t", "first", "border"])


def test_zones_are_counted_in_parts():
    """Of 2000 chunks no more than 256 KB are worked on at once; before, all that Spark hands over."""
    parts = list(patterns.zoned(40, 20)([batch_of_chunks(2000)]))
    assert len(parts) > 4 and max(p.num_rows for p in parts) <= 256 and sum(p.num_rows for p in parts) == 2000


def test_windows_leave_in_parts():
    """What a worker holds of windows follows from 256 KB of text, not from the rows that Spark hands over."""
    parts = list(patterns.windowed(40, 20)([batch_of_chunks(2000)]))
    assert len(parts) > 4 and max(p.num_rows for p in parts) <= 256 * 50 and sum(p.num_rows for p in parts) == 2000 * 50


def made_windows(spark):
    docs = spark.createDataFrame([(k, 3000) for k in range(40)], "doc long, n long")
    return patterns.windows(generators.sequences(docs, "doc", "n").selectExpr("doc", "bases as text"), "doc", "text", 40, 20)


def test_a_census_stands_for_all_windows(spark):
    windows = made_windows(spark)
    known = patterns.census(windows, 40)
    assert known.count() < windows.count() / 2
    count = lambda df, n: sorted(map(tuple, df.groupBy("label", "gc", "obs_exp").agg(n).collect()))
    assert count(known, F.sum("n")) == count(windows, F.count("*"))


def test_a_network_decides_each_composition_once(spark):
    """The same network, windows and predictions, from two passes over all windows instead of three and without sorting them."""
    windows = made_windows(spark)
    each = patterns.classified(windows, 40, sample=200).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    once = patterns.classified_census(windows, 40, sample=200).groupBy("label", "predicted").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect()))
    chosen = patterns.fitted(windows, 40, sample=200)[3]
    order = windows.where("evaluable").orderBy(F.xxhash64("doc", "start"), "doc", "start")
    for truth, label in ((0.0, "background"), (1.0, "zone")):
        smallest = order.where(F.col("label") == label).limit(100).selectExpr("n_c / 40", "n_g / 40", "n_cg / 40").collect()
        assert sorted(map(tuple, smallest)) == sorted(map(tuple, chosen.where(F.col("truth") == truth).select("_n_c", "_n_g", "_n_cg").collect()))


def test_integers_and_network_decide_compositions(spark):
    windows = made_windows(spark)
    _, net, _, chosen = patterns.fitted(windows, 40, 200, known=patterns.census(windows, 40))
    layers = quantised.layers_of(np.array(net.weights.toArray()), [4, 8, 2])
    rows = lambda df: np.array([tuple(r) for r in df.select(*patterns.FEATURES).collect()])
    x, integers = rows(patterns._featured(windows, 40)), quantised.Int8(layers, rows(chosen))
    got = {tuple(r)[:3]: r["n"] for r in quantised.three_ways(windows, 40, 200).collect()}
    said = lambda k, name: sum(n for key, n in got.items() if key[k] == name)
    assert said(1, "zone") == quantised.decided(layers, x).sum() and said(2, "zone") == integers.decided(x).sum() and sum(got.values()) == len(x)


def test_buckets_follow_from_the_size(spark, small, monkeypatch):
    """A task that compares two prepared tables reads a bucket of each, as large as before where there is more text."""
    monkeypatch.setattr(tables, "BUCKET", 1 << 12)
    sides = queries._sides(spark, small)
    assert all(8 < len({f.rsplit("_", 1)[1] for f in side.inputFiles()}) for side in sides)
    few = spark.createDataFrame([(1, "ab"), (2, None)], "k long, text string")
    assert tables.buckets_for(few) == tables.buckets_for(few.where("false")) == 8


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_ranges_share_tasks_and_are_read_once(spark, tmp_path):
    """Small ranges beyond a few a core don't make more tasks, and no megabyte is read behind each."""
    raw = b">a\n" + b"ACGT" * 100_000 + b"\n>b x\nAC\nGT\n"
    (tmp_path / "in.fa").write_bytes(raw)
    placed = ranges.placed(spark, str(tmp_path / "in.fa"), 1000)
    assert placed.count() == 401 and placed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    sizes = [len(x) for x in placed.rdd.glom().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert b"".join(bytes(r["bases"]) for r in ranges.pieces(placed).orderBy("start").collect()) == b"ACGT" * 100_001
    f = Counted(raw)
    assert sum(len(x) for _, _, x in ranges._runs(f, 1000, 2000, None, False)) == 1000 and f.taken <= 1001
    f = Counted(raw)
    read = ranges._chunks(64)(f, {"file": "", "rec": 1, "in_rec": 997, "first": 1000, "last": 2000, "header": False})
    assert sum(n for _, n in read) == 1024 - 64 + 64 and f.taken < 1001 + 2 * ranges.BEYOND


def test_answers_read_chunks_three_times(spark, tmp_path):
    """Counts and the number of records come from one pass, the pattern from two: its edges are shuffled."""
    planted.content(planted.weighted(spark.createDataFrame([(1, 5000), (2, 30)], "k long, n long"), "k", "n")).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    answer = planted.answers(chunks)
    scans = answer._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans == 3 and answer.first()["n_records"] == 10


def test_content_of_many_units_is_that_of_each(spark):
    rows = [(k, n) for k, n in ((1, 3000), (2, 700), (9, 7))]
    each = lambda some: sorted(planted.content(planted.weighted(spark.createDataFrame(some, "k long, n long").coalesce(1), "k", "n"), 256).collect())
    assert each(rows) == sorted(r for row in rows for r in each([row]))
