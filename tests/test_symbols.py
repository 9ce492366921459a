import random

from pyspark.sql import functions as F
from strandspark.functions import symbols, texts
from strandspark.operators import compare, composition, generators, intervals, measurement, pairing, patterns, sequences


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_classes_and_names(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("byte")).select("byte", symbols.symbol_class(F.col("byte")).alias("c"), symbols.byte_name(F.col("byte")).alias("n")).collect()
    by = {r["byte"]: (r["c"], r["n"]) for r in rows}
    assert by[ord("a")][0] == "base" and by[ord("n")][0] == "unknown" and by[ord("V")][0] == "ambiguous"
    assert by[ord("U")] == ("invalid", "U") and by[62] == ("invalid", ">") and by[10][0] == by[13][0] == "ignored"
    assert by[9] == ("invalid", "\\x09") and by[255] == ("invalid", "\\xff") and by[32] == ("invalid", " ")
    assert sum(c == "invalid" for c, _ in by.values()) == 256 - 8 - 2 - 20 - 2


def test_rows_and_columns(spark):
    golden = {0: (1, 1), 1: (1, 2), 79: (1, 80), 80: (2, 1), 159: (2, 80), 160: (3, 1), 1945577269: (24319716, 70)}
    df = spark.createDataFrame([(p,) for p in golden], "pos long")
    for r in df.select("pos", symbols.row_of(F.col("pos")).alias("r"), symbols.column_of(F.col("pos")).alias("c")).collect():
        assert (r["r"], r["c"]) == golden[r["pos"]]


def test_short_pair(spark):
    pair = spark.createDataFrame([(1, "ACGTACGTAC", "ACGTTCGTAGTTTT"), (2, "", "A"), (3, "ac", "AC"), (4, None, "A")], "pair long, text_a string, text_b string")
    by = {r["pair"]: r for r in compare.summary(pair).collect()}
    assert (by[1]["compared"], by[1]["differences"], by[1]["first_pos"], by[1]["offset"]) == (10, 2, 4, -4)
    assert by[2]["compared"] == 0 and by[2]["similarity_pct"] == 0.0 and by[4]["compared"] == 0
    found = compare.differences(compare.paired_pieces(pair)).orderBy("pair", "pos").collect()
    assert [(r["pair"], r["pos"], r["row"], r["col"], r["kind"]) for r in found] == [(1, 4, 1, 5, "real"), (1, 9, 1, 10, "real"), (3, 0, 1, 1, "case_only"), (3, 1, 1, 2, "case_only")]
    assert compare.first_differences(compare.paired_pieces(pair), None).count() == 4


def test_invalid_results_leave_both_sums(spark):
    rows = spark.createDataFrame([(10, 2), (10, 11), (5, 0)], "compared long, differences long")
    r = compare.totals(rows).first()
    assert (r["pairs"], r["invalid"], r["compared"], r["differences"]) == (3, 1, 15, 2)


def test_headers(spark):
    h = lambda text, k: one(spark, symbols.header_fields(F.col("h"))[k], h=text)
    assert h("NC_1 Homo chromosome 1, GRCh38 primary assembly", "chromosome") == "1"
    assert h("NC_1 chromosome x, GRCh38 Primary Assembly", "chromosome") == "X"
    assert h("NT_1 chromosome 1 unlocalized contig", "chromosome") is None
    assert h("NC_2 mitochondrion, complete genome", "chromosome") == "MT"
    assert h("NC_2 mitochondrion, complete", "identifier") == "NC_2" and h("NC_2", "description") == ""


def test_pairing_rules(spark):
    schema = "rec long, key string, length long, start long"
    a = spark.createDataFrame([(0, "1", 80, 0), (1, "1", 70, 80), (2, None, 20, 150), (3, "2", 9, 170), (4, None, 20, 180)], schema)
    b = spark.createDataFrame([(0, "2", 9, 0), (1, "1", 60, 9), (2, "2", 8, 69), (3, None, 70, 77)], schema)
    got = {(r["rec_a"], r["rec_b"], r["criterion"]) for r in pairing.paired(a, b).collect()}
    # A's first "1" wins; "2" occurs twice in B, so only the length 9 pairs it; both 20s of A are ambiguous and absent in B.
    assert got == {(0, 1, "key"), (1, 3, "length"), (3, 0, "length")}
    assert [r["rec"] for r in pairing.unpaired(a, pairing.paired(a, b), "rec_a").orderBy("rec").collect()] == [2, 4]
    keys = spark.createDataFrame([(k,) for k in ("X", "10", "2", "MT", "Y", "z")], "key string")
    assert [r["key"] for r in keys.orderBy(*symbols.natural_order(F.col("key"))).collect()] == ["2", "10", "X", "Y", "MT", "z"]


def test_patterns(spark):
    df = spark.createDataFrame([("r", "aaaacgt"), ("s", ""), ("s", None)], "rec string, text string")
    got = {(r["rec"], r["pattern"], r["strand"]): r["n"] for r in patterns.pattern_counts(df, "text", ["AA", "ANG", "ACGT"], ("rec",)).collect()}
    assert got["r", "AA", "+"] == 3 and got["r", "ANG", "+"] == 1 and got["r", "ACGT", "+"] == got["r", "ACGT", "-"] == 1 and got["s", "AA", "+"] == 0
    assert sorted(r["pos"] for r in patterns.pattern_positions(df, "rec", "text", "AA", 2).collect()) == [0, 1]
    assert patterns.windows(df, "rec", "text", 8, 4).count() == 0
    w = patterns.windows(spark.createDataFrame([("r", "CGCGCGCGNA")], "rec string, text string"), "rec", "text", 8, 2).orderBy("start").collect()
    assert [x["label"] for x in w] == ["zone", "not_evaluable"]


def test_chunks_and_positions(spark):
    df = spark.createDataFrame([(0, "abcdefg"), (1, ""), (2, None), (3, "xy")], "doc long, text string")
    assert sorted((r["doc"], r["start"], r["bases"]) for r in sequences.chunks(df, "doc", "text", 3).collect()) == [(0, 0, "abc"), (0, 3, "def"), (0, 6, "g"), (3, 0, "xy")]
    starts = sequences.running_start(df, "doc", F.coalesce(F.length("text"), F.lit(0)), rows_each=2)
    assert {r["doc"]: r["start"] for r in starts.collect()} == {0: 0, 1: 7, 2: 7, 3: 7}
    recs = starts.select(F.col("doc").alias("rec"), "start", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"))
    held = sequences.records_at(spark.createDataFrame([(0,), (6,), (7,), (8,), (9,)], "pos long"), recs, 4)
    assert sorted((r["pos"], r["rec"], r["pos_in_record"]) for r in held.collect()) == [(0, 0, 0), (6, 0, 6), (7, 3, 0), (8, 3, 1)]


def test_units(spark):
    df = spark.createDataFrame([(0, "abcdefg")], "doc long, text string")
    good, bad = sequences.units(df, "doc", "text", 3), sequences.units(df.withColumn("text", F.lit("abcdeXg")), "doc", "text", 3)
    assert sequences.failed_units(good, good, "doc").count() == 0
    assert [r["chunk"] for r in sequences.failed_units(bad, good, "doc").collect()] == [1]
    gap = sequences.coverage(good.where("chunk <> 1"), "doc").first()
    assert (gap["gaps"], gap["overlaps"]) == (1, 0)


def test_interleaving(spark):
    pairs = spark.createDataFrame([(0, "A" * 10, "C" * 7), (1, "", "C")], "pair long, text_a string, text_b string")
    assert [r["line"] for r in sequences.interleaved(pairs, 4).orderBy("row", "side").collect()] == ["A 1: AAAA", "B 1: CCCC", "A 2: AAAA", "B 2: CCC"]


def test_histogram_nulls(spark):
    df = spark.createDataFrame([("a", "xé"), ("a", None), ("b", ""), (None, "x")], "k string, text string")
    assert {(r["k"], r["byte"]): r["n"] for r in composition.byte_histogram(df, by=("k",)).collect()} == {("a", 120): 1, ("a", 0xC3): 1, ("a", 0xA9): 1, (None, 120): 1}
    assert composition.nucleotide_count(df.where("false")).first()["n_bases"] == 0


def test_intervals(spark):
    log = spark.createDataFrame([("w", 0, 5), ("w", 5, 7), ("w", 9, 12), ("v", 6, 10)], "w string, start long, end long")
    merged = intervals.union(log, ["w"])
    assert sorted((r["w"], r["start"], r["end"]) for r in merged.collect()) == [("v", 6, 10), ("w", 0, 7), ("w", 9, 12)]
    a, b = merged.where("w = 'w'").drop("w").withColumn("k", F.lit(1)), merged.where("w = 'v'").drop("w").withColumn("k", F.lit(1))
    assert intervals.overlap(a, b, ["k"], 4).first()["overlap"] == 2
    assert {r["w"]: r["idle"] for r in intervals.idle_at_end(log, "w").collect()} == {"w": 0, "v": 2}
    parts = intervals.shared_out(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "w string, speed double"), 8)
    assert {r["w"]: r["part"] for r in parts.collect()} == {"a": 2.0, "b": 6.0}
    ema = intervals.smoothed(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0)], "w string, n int, v double"), ["w"], ["n"], "v", 0.5)
    assert ema.first()["ema"] == 2.0


def test_intervals_in_ranges(spark):
    """Windows over ranges of a group say the same as over the whole group, however it is cut, with ties and nulls."""
    rows = [("a", k * 37 % 101, k * 37 % 101 + (k % 9) * (k % 4), k % 7) for k in range(300)] + [("b", 5, 500, 1), ("b", 5, 5, 2), ("b", 700, 701, 3), (None, 3, 4, 5)]
    log = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "w string, start long, end long, v long, n long")
    cuts = (1 << 30, 40, 3)
    found = [sorted(map(tuple, intervals.union(log, ["w"], rows_each=c).collect()), key=str) for c in cuts]
    assert found[0] == found[1] == found[2] and ("b", 5, 500) in found[0] and ("b", 700, 701) in found[0]
    means = [{r["w"]: round(r["ema"], 9) for r in intervals.smoothed(log, ["w"], ["start", "n"], "v", 0.3, rows_each=c).collect()} for c in cuts]
    mean = None
    for _, v in sorted(((r[1], n), r[3]) for n, r in enumerate(rows) if r[0] == "a"):
        mean = v if mean is None else mean * 0.7 + v * 0.3
    assert means[0] == means[1] == means[2] and means[0]["a"] == round(mean, 9)
    before = [sorted(((r["n"], r["_p_v"]) for r in intervals.previous(log, ["w"], ["start", "n"], ["v"], rows_each=c).collect())) for c in cuts]
    assert before[0] == before[1] == before[2] and (301, 1) in before[0] and (300, None) in before[0]
    assert intervals.union(log.where("false"), ["w"]).count() == 0


def test_running_start_of_sparse_numbers(spark):
    """Far apart, negative, repeated and null numbers."""
    rows = [(None, 5), (-(10**15), 1), (3, 7), (3, 2), (10**18, 4)]
    df = spark.createDataFrame(rows, "n long, size long")
    for each in (1, 2, 100):
        got = sorted(((r["n"], r["size"], r["start"]) for r in sequences.running_start(df, "n", F.col("size"), rows_each=each).collect()), key=lambda x: x[2])
        assert got == [(None, 5, 0), (-(10**15), 1, 5), (3, 2, 6), (3, 7, 8), (10**18, 4, 15)]
    assert sequences.running_start(df.where("false"), "n", F.col("size")).count() == 0


def test_slices_of_chunks(spark):
    df = spark.createDataFrame([(0, "abcdefghij"), (1, "abc"), (2, None)], "doc long, text string")
    chunks = sequences.chunks(df, "doc", "text", 3)
    assert [tuple(r) for r in sequences.sliced(chunks, "doc", 2, 6, 3).collect()] == [(0, "cdefgh")]


def test_comparison_of_odd_texts(spark):
    """Nulls, empty texts, symbols outside of the basic plane and with the number 0, lower case and unknown symbols."""
    rows = [(0, "a\0🙂nX", "A\0xnY"), (1, None, "x"), (2, "", "x"), (3, "same", "same"), (4, "nab", "xN")]
    pieces = compare.paired_pieces(spark.createDataFrame(rows, "pair long, text_a string, text_b string"))
    got = sorted((r["pair"], r["pos"], r["a"], r["b"], r["kind"]) for r in compare.differences(pieces).collect())
    assert got == [(0, 0, "a", "A", "case_only"), (0, 2, "🙂", "x", "real"), (0, 4, "X", "Y", "real"), (4, 0, "n", "x", "with_unknown"), (4, 1, "a", "N", "with_unknown")]
    assert sorted((r["pair"], r["kind"], r["n"]) for r in compare.kinds(pieces).collect()) == [(0, "case_only", 1), (0, "real", 2), (4, "with_unknown", 2)]
    assert sorted((r["pair"], r["pos"]) for r in compare.first_differences(pieces, 1).collect()) == [(0, 0), (4, 0)]
    sizes = spark.createDataFrame([(0, 5), (3, 4), (4, 2)], "pair long, compared long")
    assert sorted((r["pair"], r["bucket_start"], r["n"]) for r in compare.density(pieces, sizes, 2).collect()) == [(0, 0, 1), (0, 2, 1), (0, 4, 1), (3, 0, 0), (3, 2, 0), (4, 0, 2)]
    pairs = spark.createDataFrame(rows, "pair long, text_a string, text_b string")
    assert sorted(map(tuple, compare.pair_density(pairs, 2).collect())) == [(0, 0, 1), (0, 2, 1), (0, 4, 1), (3, 0, 0), (3, 2, 0), (4, 0, 2)]
    assert {r["pair"]: (r["differences"], r["first_pos"]) for r in compare.summary(pairs).collect()} == {0: (3, 0), 1: (0, None), 2: (0, None), 3: (0, None), 4: (2, 0)}
    zero = compare.paired_pieces(spark.createDataFrame([(0, "\0", "b")], "pair long, text_a string, text_b string"))
    assert [r["a"] for r in compare.differences(zero).collect()] == ["\0"]


def test_zone_classifier_learns_the_rule(spark):
    r = random.Random(4)
    rows = [(k, "".join(r.choice("CG" * r.choice([1, 9]) + "ACGT") for _ in range(400))) for k in range(60)] + [(99, "CG" * 200), (98, "AT" * 200)]
    windows = patterns.windows(spark.createDataFrame(rows, "doc long, text string"), "doc", "text", 40, 20)
    seen = patterns.classified(windows, 40).collect()
    assert len(seen) == windows.where("evaluable").count() and sum(x["label"] == x["predicted"] for x in seen) > 0.95 * len(seen)
    one_label = patterns.windows(spark.createDataFrame([(98, "AT" * 200)], "doc long, text string"), "doc", "text", 40, 20)
    assert {x["predicted"] for x in patterns.classified(one_label, 40).collect()} == {"background"}
    assert patterns.classified(windows.where("false"), 40).count() == 0


def test_made_sequences(spark):
    df = spark.createDataFrame([(1, 5000), (2, 0), (3, None), (4, 3)], "doc long, n long")
    rows = generators.sequences(df, "doc", "n", unit=1000).orderBy("doc", "chunk").collect()
    text = "".join(r["bases"] for r in rows if r["doc"] == 1)
    assert len(text) == 5000 and {r["doc"] for r in rows} == {1, 4} and all(text[k - 3 : k + 4] == generators.PLANTED for k in (1000, 2000, 3000, 4000))
    assert set(text) <= set("ACGTacgtN") and len(set(text)) > 4
    swept = generators.error_sweep(spark.createDataFrame([(1, "ACGT" * 300), (2, None)], "doc long, text string"), "doc", "text", 50_000).collect()
    assert len(swept) == len(generators.ALPHABETS) and all(r["ok"] and r["injected"] > 10 for r in swept)


def test_measurements(spark):
    runs = spark.createDataFrame([("g", k, t) for k, t in enumerate([9.0, 3.0, 1.0, 2.0, 4.0])], "g string, k int, t double")
    assert measurement.median_of_repeats(runs, ["g"], "k", "t").first()["median"] == 3.0
    samples = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0)], "g string, cpu double, gpu double")
    r = measurement.resource_summary(samples, ["g"], ["cpu", "gpu"]).first()
    assert (r["cpu_mean"], r["cpu_max"], r["gpu_mean"], r["gpu_max"]) == (2.0, 3.0, None, None)
    ragged = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "x array<double>").withColumn("g", F.lit(1))
    assert [(m["place"], m["mean"]) for m in measurement.element_means(ragged, ["g"], "x").orderBy("place").collect()] == [(0, 2.0), (1, 2.0)]
    assert measurement.median_of_repeats(spark.createDataFrame([("g", k, t) for k, t in enumerate([1.0, 2.0, 2.0, 2.0, None])], "g string, k int, t double"), ["g"], "k", "t").first()["median"] == 2.0
    assert measurement.median_of_repeats(runs.where("k = 0"), ["g"], "k", "t").count() == 0
    same = measurement.agreement(spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("g", 3, 6), ("h", 1, None), ("h", 2, None)], "g string, k int, v int"), ["g"], "k", "v")
    assert {r["g"]: (r["same"], r["dissenters"]) for r in same.collect()} == {"g": (False, "3"), "h": (True, "")}
    listed = measurement.top(spark.createDataFrame([(k, k % 3) for k in range(10)], "k int, n int"), [F.col("n").desc(), "k"], 4).collect()
    assert [(r["k"], r["more"]) for r in listed] == [(2, 6), (5, 6), (8, 6), (1, 6)]
    assert measurement.counter_energy(spark.createDataFrame([("a", 1, 8), ("a", 2, 3)], "g string, k int, c long"), ["g"], ["k"], "c", 10).first()["used"] == 5
    fit = measurement.amdahl(spark.createDataFrame([("a", n, 2 + 8 / n) for n in (1, 2, 4, 8)], "g string, n int, t double"), ["g"], "n", "t").first()
    assert (fit["serial_part"], fit["most_speedup"]) == (0.2, 5.0)


def test_generators(spark):
    df = spark.createDataFrame([(1, "ACGTACGTACGTnnAC"), (2, "nn"), (3, None)], "doc long, text string")
    out = generators.mutations(df, "doc", "text", 5).collect()
    assert len(out) == 5 and all(r["original"].upper() != r["changed"] for r in out) and len({r["pos"] for r in out}) == 5
    assert generators.with_errors(df, "doc", "text", "digits", 1_000_000).where("doc = 1 and error rlike '^[0-9]$'").count() == 16
    assert generators.with_errors(df, "doc", "text", "digits", 0).count() == 0


def test_texts(spark):
    assert one(spark, texts.human_size(F.col("n")), n=1536) == "1.50 KB" and one(spark, texts.human_size(F.col("n")), n=12) == "12 B"
    assert one(spark, texts.dotted(F.col("n")), n=1234567) == "1.234.567"
    assert [one(spark, texts.whole(F.col("t"), -1), t=t) for t in ("12", " 7 ", "3.5", "x")] == [12, 7, -1, -1]
    assert one(spark, texts.restored(F.col("t"), {"asi": "así"}), t="Asi `asi` asistir asi.") == "Así `asi` asistir así."
    assert one(spark, texts.restored(F.col("t"), {"asi": "así"}), t="asi asi.py x.asi asi(asi) asi[asi] @asi %asi asi\nasi") == "así asi.py x.asi asi(asi) asi[asi] @asi %asi así\nasí"
    assert one(spark, texts.suspicious(F.col("t")), t="La funcion, la función; condiciones Metodo metodo 2 lineas") == ["Metodo", "funcion", "lineas", "metodo"]
    assert one(spark, texts.unaccented(F.col("t"), ["asi", "mas"]), t="Mas o mas asi") == ["asi", "mas"]
    assert one(spark, texts.wrapped(F.col("t"), 5), t="aa bb cccccccc d") == "aa bb\ncccccccc\nd"
    assert one(spark, texts.short_device(F.col("t")), t="NVIDIA GeForce RTX 4050 Laptop GPU") == "RTX 4050"
