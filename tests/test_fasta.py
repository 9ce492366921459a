import io
import os
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from strandspark.operators.composition import nucleotide_count
from strandspark.sources import fasta, ranges

RAW = b"ACG\n>r1 chromosome 1, x primary assembly\r\nACGTN>\r\nacg\n>r2 tail\n\n>r3\nUUAC-*R\n>r4 last"


@pytest.mark.parametrize("size", [5, 13, 1 << 20])
def test_any_range_gives_the_same(spark, tmp_path, size):
    (tmp_path / "x.fa").write_bytes(RAW)
    placed = ranges.placed(spark, str(tmp_path), size)
    recs = sorted((r["rec"], r["identifier"], r["chromosome"], r["start"], r["length"]) for r in ranges.records(placed).collect())
    assert recs == [(1, "r1", "1", 3, 9), (2, "r2", None, 12, 0), (3, "r3", None, 12, 7), (4, "r4", None, 19, 0)]
    chunks = ranges.chunks(placed, 4).withColumn("bases", F.col("bases").cast("string"))
    assert [(r["rec"], r["chunk"], r["start"], r["bases"]) for r in chunks.orderBy("rec", "chunk").collect()] == [(0, 0, 0, "ACG"), (1, 0, 0, "ACGT"), (1, 1, 4, "N>ac"), (1, 2, 8, "g"), (3, 0, 0, "UUAC"), (3, 1, 4, "-*R")]
    file = chunks.first()["file"]
    assert "".join(r["bases"] for r in fasta.slice_of(chunks, file, 1, 2, 6, 9, 4).orderBy("chunk").collect()) == "GTN>ac"
    n = nucleotide_count(ranges.pieces(placed), "bases").first()
    assert (n["n_bases"], n["n_unknown"], n["n_ambiguous"], n["n_invalid"]) == (12, 1, 1, 5)


def read_plainly(raw):
    """(records (rec, header, start, length), symbols by record) of a file's bytes, line by line."""
    heads, symbols, place = [], {0: b""}, 0
    for line in raw.split(b"\n"):
        if line.startswith(b">"):
            heads.append((len(heads) + 1, line[1:].removesuffix(b"\r").decode(), place))
            symbols[len(heads)] = b""
        else:
            clean = line.replace(b"\r", b"")
            symbols[len(heads)] += clean
            place += len(clean)
    ends = [h[2] for h in heads[1:]] + [place]
    return [(*h, e - h[2]) for h, e in zip(heads, ends, strict=False)], {k: v for k, v in symbols.items() if v}


@pytest.mark.parametrize("size", [1, 7])
def test_ranges_of_random_files(spark, tmp_path, size):
    """Headers, empty lines, carriage returns and marks inside lines, cut by ranges anywhere."""
    r = random.Random(size)
    files = {f"{k:02d}.fa": bytes(r.choice(b"ACGT\n\n\r>>N") for _ in range(r.randrange(4 * size + 12))) for k in range(12)}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    placed = ranges.placed(spark, str(tmp_path), size).coalesce(8)
    recs, chunks, pieces = ({n: [] for n in files} for _ in range(3))
    for row in ranges.records(placed).collect():
        recs[row["file"].split("/")[-1]].append((row["rec"], row["header"], row["start"], row["length"]))
    for row in ranges.chunks(placed, 4).collect():
        chunks[row["file"].split("/")[-1]].append((row["rec"], row["chunk"], row["start"], bytes(row["bases"])))
    for row in ranges.pieces(placed).orderBy("start").collect():
        pieces[row["file"].split("/")[-1]].append((row["rec"], row["in_rec"], bytes(row["bases"])))
    for name, raw in files.items():
        heads, symbols = read_plainly(raw)
        assert sorted(recs[name]) == heads
        assert sorted(chunks[name]) == [(k, j // 4, j, v[j : j + 4]) for k, v in sorted(symbols.items()) for j in range(0, len(v), 4)]
        for k, v in symbols.items():
            own = [(at, x) for rec, at, x in pieces[name] if rec == k]
            assert b"".join(x for _, x in own) == v and all(v[at : at + len(x)] == x for at, x in own)


def test_one_line_of_100_megabytes(spark, tmp_path):
    """A line is read by 13 tasks; chunks reach over their ranges."""
    (tmp_path / "x.fa").write_bytes(b">one\n" + b"ACGTN" * 20_000_000)
    placed = ranges.placed(spark, str(tmp_path), 8 << 20)
    assert placed.count() == 12
    n = nucleotide_count(ranges.pieces(placed), "bases").first()
    assert (n["n_a"], n["n_bases"], n["n_unknown"], n["n_invalid"]) == (20_000_000, 80_000_000, 20_000_000, 0)
    assert [(r["header"], r["start"], r["length"]) for r in ranges.records(placed).collect()] == [("one", 0, 100_000_000)]
    held = ranges.chunks(placed, 999_999).select("chunk", F.octet_length("bases").alias("n")).collect()
    assert sorted((r["chunk"], r["n"]) for r in held) == [(k, min(999_999, 100_000_000 - k * 999_999)) for k in range(101)]


def test_no_line_is_shuffled(spark, tmp_path):
    """Exchanges move rows of ranges alone: none stands over the tasks that read."""
    (tmp_path / "x.fa").write_bytes(RAW)
    placed = ranges.placed(spark, str(tmp_path), 16)
    for df in (ranges.records(placed), ranges.chunks(placed), nucleotide_count(ranges.pieces(placed), "bases", ("rec",))):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        above = out.getvalue().split("MapInArrow")
        assert len(above) > 1 and ("Exchange" not in above[0] or len(above) > 2)
        assert "Exchange" not in above[0] or "HashAggregate" in above[0]


def test_slices_must_fit(spark, tmp_path):
    with pytest.raises(fasta.InputError):
        fasta.slice_of(spark.createDataFrame([], "file string, rec long, chunk long, bases string"), "x", 1, 2, 9, 10)


def test_line_ends_and_widths(spark, tmp_path):
    """One line a record, and line ends of other systems, hold the same records."""
    df = spark.createDataFrame([(0, "a", "ACGT" * 50), (1, "b", ""), (2, "c", None), (3, "d", "N")], "rec long, header string, text string")
    want = [("a", 200), ("b", 0), ("c", 0), ("d", 1)]
    for name, how in (("one", {"width": None}), ("crlf", {"line_end": "\r\n"}), ("loose", {"in_order": False})):
        fasta.written(df, str(tmp_path / name), **how)
        assert sorted((r["header"], r["length"]) for r in ranges.records(ranges.placed(spark, str(tmp_path / name), 32)).collect()) == want


@pytest.mark.parametrize("raw", [b"", bytes(range(256)) * 20, b"this is prose, not a sequence at all", b">only a header"])
def test_traps_are_refused(spark, tmp_path, raw):
    (tmp_path / "x.fa").write_bytes(raw)
    with pytest.raises(fasta.InputError):
        fasta.validated(spark, str(tmp_path))


def test_missing_path_is_refused(spark, tmp_path):
    with pytest.raises(fasta.InputError):
        fasta.validated(spark, str(tmp_path / "none"))


def test_round_trip_and_answers(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "ACGT" * 50), (1, "b", ""), (2, "c", "N")], "rec long, header string, text string")
    fasta.written(df, str(tmp_path / "f"))
    fasta.validated(spark, str(tmp_path / "f"))
    got = sorted((r["header"], r["length"]) for r in ranges.records(ranges.placed(spark, str(tmp_path / "f"))).collect())
    assert got == [("a", 200), ("b", 0), ("c", 1)]
    fasta.write_expected(spark.createDataFrame([("A", ["3"]), ("INV", [" ", "2"])], "tag string, fields array<string>"), str(tmp_path / "e"))
    assert {(r["tag"], tuple(r["fields"])) for r in fasta.expected(spark, str(tmp_path / "e")).collect()} == {("A", ("3",)), ("INV", (" ", "2"))}
    fasta.write_runs(spark.createDataFrame([("x", 1.5)], "label string, time double"), ["label", "time", "gpu"], str(tmp_path / "r"))
    row = fasta.runs(spark, str(tmp_path / "r"), "label string, time double, gpu double").first()
    assert (row["label"], row["time"], row["gpu"]) == ("x", 1.5, None)
    assert fasta.fingerprint(spark, str(tmp_path / "f")).count() >= 1


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    """Two sequences, and what is known of one of them doesn't hold for the other."""
    for folder, raw in (("one", b">a\nACGT\n"), ("two", b">a\nTTTT\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.fa").write_bytes(raw)
        os.utime(tmp_path / folder / "x.fa", (1_700_000_000, 1_700_000_000))
    chunks = ranges.chunks(ranges.placed(spark, f"{tmp_path}/*"), 4)
    assert {r["file"].split("/")[-2]: bytes(r["bases"]).decode() for r in chunks.collect()} == {"one": "ACGT", "two": "TTTT"}
    now = fasta.fingerprint(spark, f"{tmp_path}/*")
    known = {r["file"].split("/")[-2]: r for r in now.collect()}
    assert known["one"]["size"] == known["two"]["size"] and known["one"]["changed"] == known["two"]["changed"] and known["one"]["ends"] != known["two"]["ends"]
    then = spark.createDataFrame([tuple(r) for r in now.collect()], now.schema)
    assert {r["fresh"] for r in fasta.up_to_date(fasta.fingerprint(spark, f"{tmp_path}/*"), then).collect()} == {True}
    (tmp_path / "two" / "x.fa").write_bytes(b">a\nTTTA\n")
    os.utime(tmp_path / "two" / "x.fa", (1_700_000_000, 1_700_000_000))
    (tmp_path / "one" / "y.fa").write_bytes(b">b\nA\n")
    fresh = {"/".join(r["file"].split("/")[-2:]): r["fresh"] for r in fasta.up_to_date(fasta.fingerprint(spark, f"{tmp_path}/*"), then).collect()}
    assert fresh == {"one/x.fa": True, "one/y.fa": False, "two/x.fa": False}
