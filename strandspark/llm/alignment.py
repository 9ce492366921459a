"""Tokens of two tokenizers over the same bytes, aligned by merge-path partitioning.

Both token sequences end at ascending byte offsets. Merging the two lists of ends walks a path through their grid; the
diagonals of the grid cut it into pieces of equal work, and a binary search along each diagonal tells where the path crosses
it. So pieces are merged independently of each other, all at once: at each step of a piece the two tokens that are current
overlap, and where both end together a group ends. Groups that begin in one piece and end in a later one are stitched by
counting ends over the pieces.

How often two ids overlap is a corpus-wide count. Pairs are counted in tasks before they are shuffled; of the counts a
bounded head, the most frequent pairs, goes to all tasks, and occurrences of all other pairs are joined with theirs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import parts, table, utf8, written
from .subwords import Chunked, Vocabulary, valid, vocabulary

#: Steps of a piece of the merge.
WORK = 128
ALIGNED = "doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>"


class Pieces:
    """A sentencepiece model: the bytes of each id, and texts cut before the spaces over which no piece reaches."""

    decode = Vocabulary.decode

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        own = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.space = self.model.piece_to_id("▁")
        #: Where no piece has a space after anything else, merges never cross such a space.
        self.apart = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of chunks that begin with the space that the model itself puts before a text."""
        raw, cuts = data.tobytes(), offsets.tolist()
        found = self.model.encode([raw[a + 1 : b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], num_threads=1)
        found = [ids or [self.space] for ids in found]  # a space alone: the model gives nothing for an empty text
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths


class _Spaced(Chunked):
    """Whole texts from chunks that begin at a row, or at a space after another character."""

    def __init__(self, own: Pieces):
        super().__init__(own.encode, {})
        self.apart = own.apart

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        if self.apart:
            cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut[:-1])


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the ends ``a`` are among the first d of both, for each diagonal d; of equal ends that of ``a`` comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        earlier = np.zeros(len(low), bool)
        earlier[open_] = a[middle[open_]] <= b[diagonals[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & earlier, middle + 1, low), np.where(open_ & ~earlier, middle, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, group_a, group_b) of tokens with the byte ends ``a`` and ``b``, both ascending to the same last end.

    Token link_a[k] overlaps token link_b[k], each pair once, in order; group k ends before token group_a[k] and group_b[k].
    """
    total = len(a) + len(b)
    first = np.arange(0, total, work)
    i = crossings(a, b, first)
    j = first - i
    far = max(int(a[-1]), int(b[-1])) + 1 if total else 0
    ends_a, ends_b = np.append(a, far), np.append(b, far)
    before_a = np.append(-1, a)
    steps = min(work, total)
    at_a, at_b, both = (np.zeros((len(first), steps), t) for t in (np.int32, np.int32, bool))
    for step in range(steps):
        own_b = ends_b[j]
        at_a[:, step], at_b[:, step] = i, j
        both[:, step] = before_a[i] == own_b  # the token of a that ended last ended here: a group is over
        taken = ends_a[i] <= own_b
        i = np.minimum(i + taken, len(a))
        j = np.minimum(j + ~taken, len(b))
    at_a, at_b, both = at_a.ravel()[:total], at_b.ravel()[:total], both.ravel()[:total]
    return at_a[~both], at_b[~both], at_a[both], at_b[both] + 1


def encoded(texts: pa.Array, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids_a, offsets_a, ids_b, offsets_b) of a space and each text; rows without text, and those whose bytes one side changes, have none."""
    some = pc.fill_null(pc.not_equal(texts, ""), False)
    spaced = pc.if_else(some, pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), "")
    data, offsets = valid(*utf8(spaced))
    va, vb = vocabulary(path_a), pieces(path_b)
    sides = []
    same = np.ones(len(texts), bool)
    for v, chunked in ((va, Chunked(encoder(path_a).encode, {})), (vb, _Spaced(vb))):
        ids, rows = chunked.ids(data, offsets)
        ids = ids.astype(np.int32)
        back = np.frombuffer(v.decode(ids), np.uint8)
        ends = np.append(0, np.cumsum(v.lengths[ids]))[rows]
        if not np.array_equal(ends, offsets) or not np.array_equal(back, data):
            for k in range(len(texts)):
                same[k] &= np.array_equal(back[ends[k] : ends[k + 1]], data[offsets[k] : offsets[k + 1]])
        sides.append((ids, rows))
    out = []
    for ids, rows in sides:
        many = np.diff(rows)
        out += [ids[np.repeat(same, many)], np.append(0, np.cumsum(np.where(same, many, 0)))]
    return tuple(out)


def _ends(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


def _packed(values: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    """Rows of ids as little-endian unsigned integers of ``width`` bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(values.astype(f"<u{width}"))])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    return data.view(f"<u{width}").astype(np.int32), offsets // width


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b, group_a, group_b) of every row of ``docs`` (doc_id, text, ...), from the whole text.

    ``a`` are the ids of a space and the text by the byte-level vocabulary at ``path_a``, ``b`` those of the text by the
    sentencepiece model at ``path_b``, which adds that space; strings of special tokens are plain text. ``group_a`` and
    ``group_b`` have, for each stretch between two offsets where tokens of both end, how many tokens it has of each. Null and
    empty texts, and texts whose bytes the ids of one side don't give back, have empty lists. Repeated rows and null doc_ids
    are rows like all others; other columns are ignored.
    """

    def run(batches):
        va, vb = vocabulary(path_a), pieces(path_b)
        for batch in parts(batches, 1, most=1 << 20):
            a, rows_a, b, rows_b = encoded(batch.column(1), path_a, path_b)
            _, _, group_a, group_b = merge_path(_ends(a, va.lengths), _ends(b, vb.lengths))
            rows = np.searchsorted(group_a, rows_a, "right")
            rows[rows_a == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(a, rows_a), _lists(b, rows_b), *(_lists(np.diff(g, prepend=0), rows) for g in (group_a, group_b))], ["doc_id", "a", "b", "group_a", "group_b"])

    return _texts(docs).mapInArrow(run, ALIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _width(path_a: str, path_b: str) -> int:
    return 2 if max(vocabulary(path_a).size, pieces(path_b).size) <= 1 << 16 else 4


def packed(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b): the same ids as little-endian unsigned integers, of two bytes where all ids fit: what passes go over."""
    width = _width(path_a, path_b)

    def run(batches):
        for batch in parts(batches, 1, most=1 << 20):
            a, rows_a, b, rows_b = encoded(batch.column(1), path_a, path_b)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(a, rows_a, width), _packed(b, rows_b, width)], ["doc_id", "a", "b"])

    return _texts(docs).mapInArrow(run, "doc_id long, a binary, b binary")


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): in how many places of all ``packed`` rows a token with id a overlaps one with id b. Counted in tasks first."""
    width = _width(path_a, path_b)

    def run(batches):
        la, vb = vocabulary(path_a).lengths, pieces(path_b)
        for batch in parts(batches, 0, 1, most=1 << 20):
            (a, _), (b, _) = _flat(batch.column(0), width), _flat(batch.column(1), width)
            i, j, _, _ = merge_path(_ends(a, la), _ends(b, vb.lengths))
            keys, n = np.unique(a[i].astype(np.int64) * vb.size + b[j], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys // vb.size).astype(np.int32)), pa.array((keys % vb.size).astype(np.int32)), pa.array(n, pa.int64())], ["a", "b", "n"])

    return rows.select("a", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class _Head:
    """Sorted keys of the most frequent pairs, their counts, and whether no pair of the same b counts more."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n, self.best = keys[order], n[order], best[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, n, best) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, np.where(known, self.n[at], 0), known & self.best[at]


def written_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): ``a1,a2|b1;`` for all groups in a row, ids in decimal, and where each token's part ends, in that order."""
    size_a, size_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
    at_a = np.arange(len(a)) + np.repeat(group_b - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(group_a, size_b)
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[group_a - 1]], mark[at_b[group_b - 1]] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    for k in range(1, 10):
        digits += ids >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    if len(ends):
        out[ends - 1] = mark
    rest, place = ids, ends - 2
    while len(rest):
        out[place] = rest % 10 + 48
        rest = rest // 10
        more = rest > 0
        rest, place = rest[more], place[more] - 1
    return out, ends


def _summed(path_a: str, path_b: str, head):
    width = _width(path_a, path_b)

    def run(batches):
        la, vb = vocabulary(path_a).lengths, pieces(path_b)
        for batch in parts(batches, 2, 3, most=1 << 20):
            (a, rows_a), (b, rows_b) = _flat(batch.column(2), width), _flat(batch.column(3), width)
            i, j, group_a, group_b = merge_path(_ends(a, la), _ends(b, vb.lengths))
            own, which = np.unique(a[i].astype(np.int64) * vb.size + b[j], return_inverse=True)
            known, n, best = (x[which] for x in head.value.of(own))
            links = np.searchsorted(i, rows_a)
            per_row = lambda x, at=links: np.diff(np.append(0, np.cumsum(x))[at])
            groups = np.diff(np.where(rows_a > 0, np.searchsorted(group_a, rows_a, "right"), 0))
            raw, ends = written_groups(a, b, group_a, group_b)
            cuts, raw = np.append(0, ends)[rows_a + rows_b].tolist(), memoryview(raw)
            digest = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            rare = np.flatnonzero(~known)
            rare_rows = np.searchsorted(rare, links)
            tail = pa.ListArray.from_arrays(pa.array(rare_rows.astype(np.int32)), pa.array(own[which[rare]], pa.int64()))
            numbers = (np.diff(rows_a), np.diff(rows_b), groups, np.diff(links), per_row(best), per_row(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digest, pa.string()), tail], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "tail"])

    return run


def most_frequent(counts: DataFrame, most: int) -> int | None:
    """The least power of two such that at most ``most`` pairs count so often or more; None if all pairs are so few."""
    sizes = {r["e"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("c")).collect()}
    total = 0
    for e in sorted(sizes, reverse=True):
        total += sizes[e]
        if total > most:
            return 1 << (e + 1)
    return None


def summaries(docs: DataFrame, path_a: str, path_b: str, most: int = 1 << 19) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``: ids, groups and links as ``aligned`` has them.

    Every pair of overlapping tokens is a link; a pair of ids counts as often as it is linked in all rows. n_best are the
    links whose count no other pair with the same b exceeds, count_sum adds all links' counts. The groups are hashed as
    ``a1,a2|b1;a3|b2``; rows without tokens have zeros and an empty text. An empty table gives an empty result. At most
    ``most`` pairs, the most frequent ones, are sent to tasks (17 bytes each); links of all others are joined with their
    counts, so none of these keys is frequent.
    """
    spark = docs.sparkSession
    rows = written(packed(docs, path_a, path_b).select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    counts = written(pair_counts(rows, path_a, path_b), "pair-counts")
    size = pieces(path_b).size
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    marked = counts.join(best, "b").select((F.col("a").cast("long") * size + F.col("b")).alias("key"), "n", (F.col("n") == F.col("most")).alias("best"))
    least = most_frequent(counts, most)
    frequent = marked if least is None else marked.where(F.col("n") >= least)
    found = frequent.toArrow()
    head = spark.sparkContext.broadcast(_Head(*(found.column(k).to_numpy() for k in range(3))))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, tail array<long>"
    out = rows.select("row", "doc_id", "a", "b").mapInArrow(_summed(path_a, path_b, head), schema)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if least is None:
        return out.select(*columns, "n_best", "count_sum", "groups_sha256")
    out = written(out, "links")
    rare = out.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("c"))
    rare = rare.join(marked.where(F.col("n") < least), "key").groupBy("row").agg(F.sum(F.col("c") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("_best"))
    joined = out.join(rare, "row", "left")
    return joined.select(*columns, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
