"""op12: a manifest against a tree of plain lists."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandspark.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows):
    leaves, paths = [leaf_of([r[c] for c in COLUMNS]) for r in rows], defaultdict(list)

    def up(nodes):
        while len(nodes) > 1:
            above = []
            for k in range(0, len(nodes), 8):
                run = nodes[k : k + 8]
                for i, (_, members) in enumerate(run):
                    for m in members:
                        paths[m].append((i, [x for x, _ in run]))
                above.append((h(*(x for x, _ in run)), [m for _, members in run for m in members]))
            nodes = above
        return nodes[0]

    subroots, own = [], {}
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted((k for k, r in enumerate(rows) if r["lang"] == lang), key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, leaves[k]))
        subroots.append(up([(leaves[k], [k]) for k in members]))
        own |= dict.fromkeys(members, subroots[-1][0])
    root, out = up(subroots)[0], []
    for k, r in enumerate(rows):
        digest = leaves[k]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            digest = leaf_of([r[c] for c in COLUMNS[:4]] + [lower(r["text"])])
        for i, run in paths[k]:
            digest = h(*run[:i], digest, *run[i + 1 :])
        out.append((r["doc_id"], leaves[k], own[k], root, h(*(x for i, run in paths[k] for j, x in enumerate(run) if j != i)), digest, digest == root))
    return sorted(out, key=str)


def checked(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()), key=str)


def test_documents_of_many_languages(spark, small, tmp_path):
    """Null languages, ids and texts, languages of one row, repeated rows, a column of another's name."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("l"), (F.col("doc_id") % 40).cast("string")))).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id"))).withColumn("text", F.when(F.col("n_chars") % 3 > 0, F.col("text")))
    rows = odd.unionByName(odd.limit(9)).withColumn("digest", F.lit("x")).withColumn("grp", F.lit(1))
    assert checked(spark, tmp_path, rows) == plain([r.asDict() for r in rows.collect()])


@pytest.mark.parametrize("many", [1, 8, 9, 5000])
def test_one_language(spark, tmp_path, many):
    """5000 rows need a second stage of blocks."""
    rows = spark.range(many).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(4).cast("long").alias("n_chars"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"))
    got = checked(spark, tmp_path, rows)
    assert got == plain([r.asDict() for r in rows.collect()])
    assert {r[-1] for r in got} == ({True, False} if many > 1 else {zlib.crc32(b"0") % 3 != 0})


def test_empty_table(spark, small, tmp_path):
    assert checked(spark, tmp_path, spark.read.parquet(f"{small}/documents.parquet").limit(0)) == []


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_every_place_is_used_once(levels):
    places = np.concatenate([merkle.address(levels, d, np.arange(8**d)) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(merkle.nodes(levels)))


def test_trees_below_the_middle_are_stored_together():
    """Five levels are two on three: after the top's nine places each tree below has its 73 in a row, split again."""
    for k in range(64):
        below = np.concatenate([merkle.address(5, 2 + d, np.arange(8**d) + k * 8**d) for d in range(3)])
        assert (below.min(), below.max()) == (9 + 73 * k, 9 + 73 * k + 72)


@pytest.mark.parametrize("many", [1, 2, 8, 9, 64, 65, 511, 4095, 4096])
@pytest.mark.parametrize("height", [0, 1, 2, 3, 4])
def test_block_of_any_size(many, height):
    """Roots, paths and folds; a block that isn't its group's last level has single children too."""
    if many > 8**height:
        return
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(many)]
    level = [x.hex() for x in leaves]
    for _ in range(height):
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    block = merkle.Block.built(leaves, height)
    assert block.root().hex() == level[0]
    seen = 0
    for first, run, above in block.paths([]):
        for k, own in enumerate(run):
            path = merkle.unpacked(merkle.packed([(k, run), *above] if height else above))
            assert own == leaves[first + k].hex() and merkle.folded(own, path) == level[0]
            assert (merkle.folded("0" * 64, path) == level[0]) is False
            seen += 1
    assert seen == many
