import pytest
from strandspark.functions import checks
from strandspark.operators import sequences
from strandspark.sources import fasta, ranges, sinks


def test_reasons():
    assert checks.clamped(5, 1, 9, 3, "k") == (5, None)
    assert checks.clamped(0, 1, 9, 3, "k")[0] == 1 and checks.clamped(99, 1, 9, 3, "k")[1] and checks.clamped(None, 1, 9, 3, "k")[0] == 3
    assert checks.useful_workers(12, 10 << 20, cores=8)[0] == 2 and checks.useful_workers(2, 1 << 30, cores=8) == (2, None)
    assert checks.pair_warnings(5, 5) == [] and "4" in checks.pair_warnings(5, 9)[0]
    with pytest.raises(ValueError):
        checks.pair_warnings(0, 9)


def test_files(spark, tmp_path):
    pairs = spark.createDataFrame([(k, "A" * 9, "C" * 9) for k in range(3)], "pair long, text_a string, text_b string")
    sinks.write_interleaved(sequences.interleaved(pairs, 4), str(tmp_path / "mixed"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "mixed").glob("part-*"))).splitlines()
    assert lines == ["A 1: AAAA", "B 1: CCCC", "A 2: AAAA", "B 2: CCCC", "A 3: A", "B 3: C"] * 3
    facts = spark.createDataFrame([("x", 1.5, None)], "label string, time double, gpu double")
    sinks.write_run(str(tmp_path / "run"), facts, {"pairs": pairs})
    assert spark.read.json(str(tmp_path / "run/facts")).first()["time"] == 1.5 and '"gpu":null' in next((tmp_path / "run/facts").glob("part-*")).read_text()
    assert spark.read.csv(str(tmp_path / "run/pairs"), header=True).count() == 3
    assert [r["line"] for r in sinks.summary_lines(facts, ["label", "time", "gpu"], 6).collect()] == [" label  time   gpu", "     x   1.5      "]


def test_room(spark, tmp_path):
    assert sinks.check_room(spark, str(tmp_path), 1) > 1
    with pytest.raises(OSError):
        sinks.check_room(spark, str(tmp_path), 1 << 62)


def test_index_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b'>one "quoted" \\ header\nACGT\nAC\n>two\n\n>three\nA\n')
    found = ranges.records(ranges.placed(spark, str(tmp_path / "x.fa")))
    fasta.write_index(found, str(tmp_path / "index"))
    back = fasta.read_index(spark, str(tmp_path / "index")).orderBy("rec").collect()
    assert [(r["rec"], r["start"], r["length"], r["header"]) for r in back] == [(1, 0, 6, 'one "quoted" \\ header'), (2, 6, 0, "two"), (3, 6, 1, "three")]
