import random
import re

import pytest
from pyspark.sql import functions as F
from strandspark.llm import near_dedup


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    of = {i: sets(t, width) for i, t in rows}
    parent = {i: i for i in of}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(of)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if of[a] and of[b] and 100 * len(of[a] & of[b]) >= percent * len(of[a] | of[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(of[i]), top(i), top(i) == i) for i in of}


def corpus():
    r = random.Random(4)
    vocabulary = ["w%d" % k for k in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 40, 120]))]
        for _ in range(r.choice([1, 3, 30])):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 9])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "Straße é ÉCOLE"), (n + 7, "straße é ÉCOLE")]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_tangled_group(spark):
    """Many documents around one base, most too far from each other: the prefix filter's part."""
    r = random.Random(9)
    base = ["b%d" % k for k in range(60)]
    rows = []
    for n in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 3, 5, 7])):
            words[r.randrange(60)] = "e%d" % r.randrange(15)
        rows.append((n, " ".join(words)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_edges(spark):
    empty = near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("kept as it is"))
    out = near_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 1]


def test_components(spark):
    chain = [(k, k + 1) for k in range(10, 40)] + [(100, 105), (101, 105), (7, 7)]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(10, 41)} == {10} and got[105] == got[101] == 100
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_template_group_makes_few_pairs(spark):
    """Documents from one template with own text, alike but not linked: their common shingles lead to no pairs."""
    r = random.Random(2)
    common = [f"c{k}" for k in range(270)]
    rows = [(k, " ".join(common + [f"o{r.randrange(10**9)}" for _ in range(30)])) for k in range(400)]
    rows += [(400 + k, rows[k][1].rsplit(" ", 2)[0] + " x y") for k in range(5)]
    made = []
    agreeing = near_dedup._agreeing

    def counting(width, percent):
        made.append(spark.sparkContext.accumulator(0))
        run, count = agreeing(width, percent), made[-1]

        def counted(batches):
            def seen():
                for batch in batches:
                    count.add(batch.num_rows)
                    yield batch

            yield from run(seen())

        return counted

    near_dedup._agreeing = counting
    try:
        got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    finally:
        near_dedup._agreeing = agreeing
    assert got == {k: k if k < 400 else k - 400 for k in range(405)}
    assert sum(a.value for a in made) < 32 * len(rows)


def test_size_classes_and_percentages(spark):
    """Groups of several sizes, frequent keys among them, at other widths and thresholds, against brute force."""
    r = random.Random(17)
    base = ["b%d" % k for k in range(90)]
    rows = []
    for n in range(130):
        words = base[: r.choice([70, 76, 80, 84, 90])]
        for _ in range(r.choice([0, 2, 4, 6, 9, 12])):
            words[r.randrange(len(words))] = "e%d" % r.randrange(400)
        rows.append((n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent, bands, coordinates in ((3, 85, 32, 6), (1, 90, 32, 6), (2, 70, 64, 4)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(df, width, percent, bands, coordinates).collect()}
        assert got == brute(rows, width, percent)


def test_deduplicated_edges(spark):
    """Nulls, empty and very long texts, clashing columns, an empty table."""
    long = "w " * 200_000
    rows = [(1, None), (2, ""), (3, None), (4, long), (5, long), (None, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("component", F.lit(1))
    out = near_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted((x["doc_id"] or 0) for x in out.collect()) == [0, 0, 1, 2, 3, 4]
    assert near_dedup.deduplicated(df.where("false")).count() == 0
