"""A Merkle manifest of a table of documents, its trees stored in van Emde Boas layout.

Every document is a leaf; of each language, leaves ascend by doc_id and every eight neighbours make a node, up to one subroot;
subroots make the root in the same way. A tree is stored in blocks of up to five levels (4096 leaves). Inside a block the
levels are split at half height into a top tree and the trees below it, each stored in a row, and each split again likewise, so
that a path from a leaf to the top touches few places. Where a node is follows by arithmetic alone. The roots of the blocks
are the leaves of the next blocks, so a manifest is a few tables of blocks, and a proof reads one block of each.

Rows of one language are numbered over ranges of (language, doc_id), and blocks are rows of a bounded size, so no language is
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Children of a node, and levels of nodes above the leaves of a block.
FAN, HEIGHT = 8, 4
LEAVES = FAN**HEIGHT
DIGEST = 32


def nodes(levels: int) -> int:
    """How many nodes a complete tree of so many levels has."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes number ``index`` of a depth (0: the root) are in the layout of a complete tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = levels - top
    wide = FAN ** (depth - top)
    return nodes(top) + index // wide * nodes(below) + address(below, depth - top, index % wide)


@lru_cache(maxsize=HEIGHT + 1)
def places(height: int) -> list[np.ndarray]:
    """For each depth of a block with ``height`` levels above its leaves, where its nodes are."""
    return [address(height + 1, depth, np.arange(FAN**depth)) for depth in range(height + 1)]


@lru_cache(maxsize=HEIGHT + 1)
def order(height: int) -> list[tuple[int, int]]:
    """(depth, number) of the inner nodes in the order in which a block is built: trees below first, then the one on top of them."""

    def inner(levels: int, depth: int, index: int) -> Iterator[tuple[int, int]]:
        """Those above the lowest of ``levels`` levels of the tree under a node."""
        if levels > 1:
            top = levels // 2
            wide = FAN**top
            for k in range(wide):
                yield from inner(levels - top, depth + top, index * wide + k)
            yield from whole(top, depth, index)

    def whole(levels: int, depth: int, index: int) -> Iterator[tuple[int, int]]:
        if levels == 1:
            yield depth, index
            return
        top = levels // 2
        wide = FAN**top
        for k in range(wide):
            yield from whole(levels - top, depth + top, index * wide + k)
        yield from whole(top, depth, index)

    return list(inner(height + 1, 0, 0))


def counts(leaves: int, height: int) -> list[int]:
    """How many nodes there are at each depth: the last run of a level may be short."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Block:
    """A tree of up to LEAVES leaves in its layout: ``raw`` has a digest for each place, zeros where there is no node."""

    def __init__(self, raw: bytes | bytearray, leaves: int, height: int):
        self.raw, self.height, self.counts = raw, height, counts(leaves, height)

    @classmethod
    def built(cls, leaves: list[bytes], height: int) -> Block:
        block = cls(bytearray(DIGEST * nodes(height + 1)), len(leaves), height)
        at = places(height)
        for k, digest in zip(at[height][: len(leaves)].tolist(), leaves, strict=True):
            block.raw[DIGEST * k : DIGEST * (k + 1)] = digest
        for depth, index in order(height):
            if index < block.counts[depth]:
                k = int(at[depth][index])
                block.raw[DIGEST * k : DIGEST * (k + 1)] = hashlib.sha256("".join(block.run(depth + 1, index)).encode()).digest()
        return block

    def run(self, depth: int, parent: int) -> list[str]:
        """The digests of a node's children, at ``depth``, in hexadecimal."""
        own = places(self.height)[depth][FAN * parent : min(FAN * (parent + 1), self.counts[depth])]
        return [bytes(self.raw[DIGEST * k : DIGEST * (k + 1)]).hex() for k in own.tolist()]

    def root(self) -> bytes:
        return bytes(self.raw[:DIGEST])

    def paths(self, above: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[str], list[tuple[int, list[str]]]]]:
        """For each run of leaves: the number of its first, their digests, and the path from their parent up, ``above`` at its end.

        A path lists for each level the place in its run and the run's digests.
        """
        if self.height == 0:
            yield 0, self.run(0, 0), above
            return
        known = {0: above}
        for depth in range(1, self.height):
            known = {FAN * parent + k: [(k, run), *path] for parent, path in known.items() for run in [self.run(depth, parent)] for k in range(len(run))}
        for parent, path in known.items():
            yield FAN * parent, self.run(self.height, parent), path


def packed(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([k, len(run)]) + bytes.fromhex("".join(run)) for k, run in path)


def unpacked(raw: bytes) -> list[tuple[int, list[str]]]:
    out, at = [], 0
    while at < len(raw):
        k, many = raw[at], raw[at + 1]
        text = raw[at + 2 : at + 2 + DIGEST * many].hex()
        out.append((k, [text[2 * DIGEST * i : 2 * DIGEST * (i + 1)] for i in range(many)]))
        at += 2 + DIGEST * many
    return out


def folded(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """What a leaf with its siblings on the path makes of the root."""
    for k, run in path:
        digest = hashed([*run[:k], digest, *run[k + 1 :]])
    return digest


def siblings(path: list[tuple[int, list[str]]]) -> str:
    return "".join(x for k, run in path for i, x in enumerate(run) if i != k)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each value as its number of bytes, a colon and the value, - for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _numbered(rows: DataFrame, keys: list[str], rows_each: int) -> DataFrame:
    """``rows``, written, with ``at``: row numbers from 0 in the order of ``keys``, over ranges of them; of each range the driver sees one count."""
    parts = max(1, -(-rows.count() // rows_each))
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_id", 33)
    before = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = before.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    low = F.lit((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("at", F.col("_before") + F.col("_id").bitwiseAND(low)).drop("_id", "_part", "_before")  # one row a range


BLOCK = "grp string, block long, n int, height int, ids array<long>, tree binary, changed array<binary>"


def _built(batches):
    """Blocks from rows (grp, block, place, leaves of the group at this level, height, id, digest, changed), sorted by the first three."""
    waiting: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        first = {c: rows.column(c)[0].as_py() for c in ("grp", "block", "height")}
        made = Block.built(rows.column("digest").to_pylist(), first["height"])
        return pa.RecordBatch.from_arrays([pa.array([first["grp"]], pa.string()), pa.array([first["block"]], pa.int64()), pa.array([rows.num_rows], pa.int32()), pa.array([first["height"]], pa.int32()), pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([bytes(made.raw)], pa.binary()), pa.array([rows.column("changed").to_pylist()], pa.list_(pa.binary()))], ["grp", "block", "n", "height", "ids", "tree", "changed"])

    def key(batch: pa.RecordBatch, row: int):
        return batch.column(0)[row].as_py(), batch.column(1)[row].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        number = batch.column(1).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if waiting and key(waiting[0], 0) != key(batch, a):
                yield block(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield block(pa.Table.from_batches(waiting))


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    out = F.lit(0)
    for k in range(21):
        out = F.when(n > F.expr(f"{FAN**k}L"), k + 1).otherwise(out)
    return out


@dataclass
class Forest:
    """Trees of several groups: ``stages`` from leaves up, each a table of blocks (BLOCK); ``roots`` has (grp, root) of each group."""

    stages: list[DataFrame]
    roots: DataFrame


def grown(rows: DataFrame, sizes: DataFrame) -> Forest:
    """The trees over ``rows`` (grp, place, id, digest, changed), places from 0 without gaps in each group, of which ``sizes`` has (grp, n).

    Each stage is a shuffle of digests by block, then one row for each block; there are as many as the largest group has
    levels, four a stage.
    """
    stages, roots = [], []
    while True:
        each = rows.join(sizes, "grp").select("grp", F.floor(F.col("place") / LEAVES).alias("block"), "place", F.least(F.lit(HEIGHT), _height(F.col("n"))).cast("int").alias("height"), "id", "digest", "changed")
        sorted_ = each.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
        stage = written(sorted_.mapInArrow(_built, BLOCK), "blocks")
        stages.append(stage)
        top = stage.select("grp", F.col("block").alias("place"), F.lit(None).cast("long").alias("id"), F.substring("tree", 1, DIGEST).alias("digest"), F.lit(None).cast("binary").alias("changed"))
        done = sizes.where(F.col("n") <= LEAVES).select("grp")
        roots.append(top.join(done, "grp", "left_semi").select("grp", F.lower(F.hex("digest")).alias("root")))
        sizes = sizes.where(F.col("n") > LEAVES).select("grp", F.ceil(F.col("n") / LEAVES).cast("long").alias("n"))
        if sizes.isEmpty():
            break
        rows = top
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Forest(stages, out)


PATHS = "grp string, block long, path binary"


def _lower_paths(batches):
    """(grp, block, path) of the blocks below from blocks (grp, block, n, height, tree, path)."""
    for batch in batches:
        groups, numbers, found = [], [], []
        for grp, block, n, height, tree, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for first, run, above in Block(tree, n, height).paths(unpacked(path)):
                for k in range(len(run)):
                    groups.append(grp)
                    numbers.append(block * LEAVES + first + k)
                    found.append(packed([(k, run), *above] if height else above))
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], ["grp", "block", "path"])


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest blocks of ``forest`` with ``path``, from each block's root to the very top; ``above`` has (grp, path) from each group's root on."""
    known = above.select("grp", F.expr("0L").alias("block"), "path")
    for k in range(len(forest.stages) - 1, -1, -1):
        # Groups that end at this stage or below it have one block here or none; their path is that from the group's root.
        here = forest.stages[k].join(known, ["grp", "block"])
        if k == 0:
            return here
        lower = here.select("grp", "block", "n", "height", "tree", "path").mapInArrow(_lower_paths, PATHS)
        ended = known.join(forest.stages[k].select("grp").distinct(), "grp", "left_anti")
        known = lower.unionByName(ended)


@dataclass
class Manifest:
    """The trees of all languages, the tree of their subroots, the root (None for an empty table)."""

    languages: Forest
    top: Forest
    subroots: DataFrame
    root: str | None


def _group(lang: Column) -> Column:
    """A language as a text that is never null and sorts by bytes, null first."""
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("."), lang))


def manifest(docs: DataFrame, changed: Column | None = None, rows_each: int = 200_000) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text, ...), written to the shared folder.

    ``changed``: a digest to check beside each leaf, null for none. Null doc_ids come first; rows that share a doc_id are
    leaves side by side, ordered by their digests, so equal rows are exchangeable; a null language is one by itself. Other
    columns are no part of a leaf. An empty table has no root.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own = docs.select(_group(F.col("lang").cast("string")).alias("grp"), F.col("doc_id").cast("long").alias("id"), F.unhex(leaf([F.col(c) for c in names])).alias("digest"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    numbered = _numbered(written(own, "digests"), ["grp", "id", "digest"], rows_each)
    first = numbered.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    first = written(first, "groups")
    rows = numbered.join(first.select("grp", "first"), "grp").select("grp", (F.col("at") - F.col("first")).alias("place"), "id", "digest", "changed")
    languages = grown(rows, first.select("grp", "n"))
    subroots = written(languages.roots, "subroots")
    ranked = _numbered(subroots, ["grp"], rows_each).select(F.lit("").alias("grp"), F.col("at").alias("place"), F.lit(None).cast("long").alias("id"), F.unhex("root").alias("digest"), F.lit(None).cast("binary").alias("changed"), F.col("grp").alias("lang"))
    ranked = written(ranked, "languages")
    top = grown(ranked.drop("lang"), ranked.groupBy("grp").agg(F.count("*").alias("n")))
    found = top.roots.first()
    return Manifest(languages, top, ranked.select(F.col("lang").alias("grp"), "place", F.lower(F.hex("digest")).alias("subroot")), found["root"] if found else None)


def language_paths(m: Manifest) -> DataFrame:
    """(grp, path): from each language's subroot to the root."""
    start = m.subroots.sparkSession.createDataFrame([("", b"")], "grp string, path binary")
    blocks = with_paths(m.top, start).select("grp", "block", "n", "height", "tree", "path")
    by_place = blocks.mapInArrow(_lower_paths, PATHS).select(F.col("block").alias("place"), "path")
    return m.subroots.select("grp", "place").join(by_place, "place").select("grp", "path")


def _proved(root: str):
    def run(batches):
        for batch in batches:
            for n, height, ids, tree, changed, path, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[list] = [[] for _ in range(6)]
                for first, run_, above in Block(tree, n, height).paths(unpacked(path)):
                    beyond = siblings(above)
                    for k, own in enumerate(run_):
                        # A tree of one leaf has no siblings of its own: the leaf is the subroot.
                        rest = "".join(x for i, x in enumerate(run_) if i != k) if height else ""
                        other = changed[first + k]
                        given = own if other is None else other.hex()
                        made = folded(given, [(k, run_), *above] if height else above)
                        for column, x in zip(out, (ids[first + k], own, hashlib.sha256((rest + beyond).encode()).hexdigest(), given, made, made == root), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
                arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:2], pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), *arrays[2:]], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "given", "folded_root", "verified"])

    return run


def proved(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, given, folded_root, verified) of every leaf of a manifest.

    ``given`` is the digest that was checked: the changed one where there is one, else the leaf. It is folded with the leaf's
    siblings, level by level, to what should be the root. A leaf without any sibling has the hash of nothing as its proof.
    """
    blocks = with_paths(m.languages, language_paths(m)).join(m.subroots.select("grp", "subroot"), "grp")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, given string, folded_root string, verified boolean"
    return blocks.select("n", "height", "ids", "tree", "changed", "path", "subroot").mapInArrow(_proved(m.root or ""), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [lower])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.unhex(tampered))
    return proved(manifest(docs, changed)).drop("given")
