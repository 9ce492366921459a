"""MinHash near-dedup with circulant permutations, banding, exact Jaccard checks and connected components.

Every set of word shingles is hashed once by an initial permutation; one further permutation, circularly shifted
by k, gives coordinate k of the signature. Bands of coordinates name buckets. Documents with equal sets collapse to
their smallest doc_id first, so a large group of copies costs one row from there on.

Within a bucket, candidate links go from one leader to all others, are confirmed on the full sets, and join components.
What a bucket then still holds of different components is compared too, never inside a component. Where that would be
many pairs, in a large group of documents that are alike but not enough, an exact prefix filter stands in for the bucket:
two sets as similar as asked share one of their rarest shingles, and early enough that the rest can make up the similarity.
How early depends on the partner's size, so a shingle leads only to partners of the sizes that its place allows: documents
from one template, whose own text keeps them apart, never meet in what they have in common. So no link that changes a
component is lost, and no group is expanded to all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, mix64, parts, slices, spans, table, utf8, written

#: Space, tab, line feed, vertical tab, form feed, carriage return: what ends a word.
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles; of all its words if they are fewer."""
    for row, end in slices(offsets):
        part, own = _LOWER[data[offsets[row] : offsets[end]]], offsets[row : end + 1] - offsets[row]
        starts, ends, words = spans(_GAP[part], own)
        h = hashed(part, starts, ends)
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += mix64(h[k : k + n] * _ODD[k % 8] + np.uint64(k))
        rolled = mix64(rolled)
        for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = mix64(h[k : k + 1] * _ODD[(k - a) % 8] + whole)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least image under one permutation shifted by k, after an initial permutation."""
    initial = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(initial), 1024):
        np.minimum(least, _permuted(initial[None, k : k + 1024] + shifts).min(axis=1), out=least)
    return least


def _signed(width: int, bands: int, rows: int):
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in parts(batches, 1):
            data, offsets = utf8(batch.column(1))
            n, one, two, own = [], [], [], []
            for s in shingle_sets(data, offsets, width):
                n.append(len(s))
                if len(s):
                    one.append(int(mix64(s).sum().astype(np.int64)))
                    two.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)))
                    own.append(signature(s, bands * rows))
            own = np.array(own, np.uint64).reshape(len(own), bands, rows)
            keys = np.repeat(salt[None], len(own), axis=0)
            for k in range(rows):
                keys = mix64(keys * _ODD[1] + own[:, :, k])
            at = pa.array(np.where(np.array(n) > 0, np.cumsum(np.array(n) > 0) - 1, -1)) if n else pa.array([], pa.int64())
            at = pc.if_else(pc.greater_equal(at, 0), at, None)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            one, two, keys = pa.array(one, pa.int64()).take(at), pa.array(two, pa.int64()).take(at), keys.take(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), one, two, keys],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for batch in parts(batches, 1):
            sets = [s.view(np.int64) for s in shingle_sets(*utf8(batch.column(1)), width)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])

    return run


def _agreeing(width: int, percent: int):
    """Pairs of texts whose sets have 100 * intersection >= percent * union, by the full sets."""

    def run(batches):
        for batch in parts(batches, 2, 3):
            sets = [list(shingle_sets(*utf8(batch.column(k)), width)) for k in (2, 3)]
            keep = []
            for a, b in zip(*sets, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round hooks every node to its smallest neighbour, follows these hooks to their ends, and rewrites the edges
    between what is left; all of it in tables, none of it on the driver.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        hooks = written(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            nearer = written(hooks.join(up, "to", "left").select("node", F.coalesce("further", "to").alias("to"), (F.coalesce("further", "to") != F.col("to")).alias("moved")), "hooks")
            hooks = nearer.drop("moved")
            if nearer.where("moved").isEmpty():
                break
        own = hooks.withColumnRenamed("to", "component")
        if labels is None:
            labels = own
        else:
            labels = written(labels.join(own.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
        a, b = own.select(F.col("node").alias("a"), F.col("component").alias("ca")), own.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        left = written(left.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, component long")


def size_class(n: Column) -> Column:
    """Sizes that differ by up to a hundredth fall into one class; classes ascend with sizes, small sizes are their own."""
    return F.floor(F.log(n.cast("double")) / math.log(1.01)).cast("int")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...).

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``percent`` / 100; component_id is the smallest doc_id that links reach, ``kept`` marks it. With 32 bands of 6
    coordinates a pair at 0.8 is missed with probability 6e-5, at 0.85 with 3e-7, at 0.7 with 0.02: lower thresholds ask
    for more and shorter bands (64 of 4: 2e-8 at 0.7). Null or empty texts and texts
    without words have an empty set and stay alone; a null doc_id has a null component and is kept. Rows that share a
    doc_id count as one document. Repeated texts collapse before any comparison. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signed(width, bands, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    named = signed.where("set_a is not null and doc_id is not null")
    classes = written(named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = named.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    # What is known of a key or a document is a table before anything joins it: its size tells the planner whether to send
    # it to all tasks or to move texts, and a hot key's rows can be split over tasks.
    shared = written(keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key"), "shared")
    members = written(keyed.join(shared, "key").select("key", F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")).distinct(), "members")
    involved = written(members.select(F.col("node").alias("doc_id")).distinct(), "involved")
    their = written(texts.join(involved, "doc_id", "left_semi"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (their.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return written(written(pairs, "pairs").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_agreeing(width, percent), "a long, b long"), "links")

    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)  # noqa: E731  what the sizes alone allow
    leaders = written(members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("leader")).select("key", F.col("leader.node").alias("a"), F.col("leader.n").alias("n_a")), "leaders")
    links = confirmed(members.join(leaders, "key").where((F.col("node") != F.col("a")) & near("n", "n_a")).select("a", F.col("node").alias("b")).distinct())
    labels = components(links)

    def mixed(rows: DataFrame, *keys: str) -> DataFrame:
        """(*keys, main, c, cross) of the keys with several components: the largest, how many rows, how many pairs across."""
        own = rows.groupBy(*keys, "component").agg(F.count("*").alias("c"))
        every = own.groupBy(*keys).agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        return written(every.where("c * c > cc").select(*keys, F.col("main.component").alias("main"), "c", ((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("cross")), "mixed")

    def across(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        """Pairs of a row of ``left`` and one of ``right`` (*keys, main, node, n, component, rest) with equal keys and different components.

        ``rest``: how many shingles two documents can share at most if this key is the rarest that they share. Pairs inside
        the largest component of a key are never made.
        """
        a, b = (rows.select(*keys, "main", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"), F.col("rest").alias(f"rest_{x}")) for rows, x in ((left, "a"), (right, "b")))
        enough = F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
        met = [x.join(y.drop("main"), [*keys]).where((F.col("c_a") != F.col("c_b")) & near("n_a", "n_b") & enough) for x, y in ((a.where("c_a <> main"), b), (a.where("c_a = main"), b.where("c_b <> main")))]
        return met[0].unionByName(met[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    held = written(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("rest", F.col("n")), "held")
    held = held.join(mixed(held, "key"), "key")
    many = F.col("cross") > 2 * F.col("c")
    simple = held.where(~many)
    pairs = [across(simple, simple, "key")]
    tangled = written(held.where(many).select("node", "n", "component").distinct(), "tangled")
    if not tangled.isEmpty():
        each = their.join(tangled, their.doc_id == tangled.node, "left_semi").mapInArrow(_sets(width), "node long, shingles array<long>")
        each = written(each.select("node", F.explode("shingles").alias("key")), "shingles")
        frequent = written(each.groupBy("key").agg(F.count("*").alias("had")).where("had > 1"), "frequent")
        # Shingles that one document alone has are its rarest: they take the first places, but lead to no other document.
        ordered = each.join(frequent, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("had", "key"))).alias("rarest"))
        placed = ordered.join(tangled, "node").select("node", "n", "component", (F.col("n") - F.size("rarest")).alias("alone"), F.posexplode("rarest").alias("at", "shingle"))
        placed = placed.select("node", "n", "component", "shingle.*", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
        # With this key as the rarest in common, a partner has at most ``largest`` shingles. Keys that many documents have
        # lead by size classes to partners that can be large enough; those of a few lead to all of these.
        largest = F.floor(F.col("rest") * (100 + percent) / percent - F.col("n"))
        least = F.ceil(F.col("n") * percent / 100)
        few, one = F.col("had") <= 32, F.lit(-1)
        classes_of = F.sequence(size_class(least), size_class(F.least(largest, F.floor(F.col("n") * 100 / percent))))
        fitting = placed.where(largest >= least).select("*", F.when(few, one).otherwise(size_class(F.col("n"))).alias("own"), F.explode(F.when(few, F.array(one)).otherwise(classes_of)).alias("other"))
        prefix = written(fitting.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "component", "rest"), "prefixes")
        prefix = prefix.join(mixed(prefix, "key", "low", "high"), ["key", "low", "high"])
        pairs.append(across(prefix.where("own = low"), prefix.where("own = high"), "key", "low", "high"))
    links = links.unionByName(confirmed(pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1]).distinct()))
    labels = components(links)

    rep = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("bands").join(rep, ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.coalesce(own == F.col("doc_id"), F.lit(True))).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies: that with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; all columns are kept as they are.
    """
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
