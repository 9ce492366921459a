"""Token ids in binary files: one zstandard dictionary for all, one frame for each document, an index of offsets.

The dictionary is trained on the serialized ids of a bounded sample and stored once beside the files; each file keeps its
hash. A file is ``TIDS1``, the hash, the width of an id (2 or 4 bytes, little-endian), frames in ascending doc_id order,
then for each document doc_id, number of ids and offset of its frame (negative where the doc_id is null), and at the very end
the number of documents and where the index begins. So one document is read by its index entry and its frame alone.

Each attempt of a task writes files of its own names, and the manifest, which Spark's committer makes, names those of the
attempts that count: a repeated task or a lost executor leaves files that nobody reads. The folder is in the shared file system,
by its URI.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import opened, qualified
from .bpe import by_pretokens
from .common import parts, sampled, shared_dir, slices, table, utf8, written
from .subwords import Chunked, byte_characters

MAGIC = b"TIDS1"
_HEAD, _TAIL = struct.Struct("<5s32sB"), struct.Struct("<QQ")


@lru_cache(maxsize=4)
def library(path: str) -> Chunked:
    """Whole texts by the tokenizers library, which gets every distinct pre-token once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    character, tokenize = dict(enumerate(byte_characters())), tokenizer.model.tokenize

    def merge(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mapped, cuts = data.tobytes().decode("latin-1").translate(character), offsets.tolist()
        ids: list[int] = []
        ends = [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids += [t.id for t in tokenize(mapped[a:b])]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends)

    return Chunked(by_pretokens(merge), added)


def packed(documents: list[tuple[int | None, bytes]], dictionary: bytes, width: int) -> bytes:
    """A file of documents (doc_id, ids as little-endian unsigned 32-bit integers), in the order given."""
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=False)
    frames, entries, at = [], [], _HEAD.size
    for doc_id, ids in documents:
        frame = compressor.compress(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes())
        entries.append((0, len(ids) // 4, -at) if doc_id is None else (doc_id, len(ids) // 4, at))
        frames.append(frame)
        at += len(frame)
    index = np.array(entries, "<i8").reshape(-1, 3).tobytes()
    return b"".join([_HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width), *frames, index, _TAIL.pack(len(documents), at)])


class Reader:
    """Documents of one open file, by reads of its head, its index and the frames that are asked for.

    ``entries`` has doc_id and number of ids of each document, ``null`` where the doc_id is null; ``ids(k)`` reads one frame.
    """

    def __init__(self, file, dictionary: bytes):
        self.file = file
        magic, digest, self.width = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        size = file.seek(0, 2) or file.tell()
        many, end = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        self.entries = np.frombuffer(self._at(end, 24 * many), "<i8").reshape(many, 3)
        self.null, self.bounds = self.entries[:, 2] < 0, np.append(np.abs(self.entries[:, 2]), end)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _at(self, begin: int, size: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(size)

    def _unpacked(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}").astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        return self._unpacked(self._at(int(self.bounds[k]), int(self.bounds[k + 1] - self.bounds[k])))

    def all(self) -> Iterator[np.ndarray]:
        """The ids of all documents, from about a megabyte of frames at a time."""
        for row, end in slices(self.bounds, 1 << 20):
            first, cuts = int(self.bounds[row]), self.bounds[row : end + 1].tolist()
            frames = self._at(first, cuts[-1] - first)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield self._unpacked(frames[a - first : b - first])

    def named(self, doc_id: int) -> list[int]:
        """The places of the documents with this doc_id; those without one come first, all others ascend."""
        known = int(self.null.sum())
        return list(range(known + int(np.searchsorted(self.entries[known:, 0], doc_id, "left")), known + int(np.searchsorted(self.entries[known:, 0], doc_id, "right"))))


def trained_dictionary(docs: DataFrame, path: str, sample: int = 500, size: int = 1 << 15, width: int = 2, most: int = 1 << 14) -> bytes:
    """A dictionary from the ids of ``sample`` documents, those with the smallest hashes of doc_id; empty if they are too few.

    The sample, ``most`` characters of each of its texts, bounds what the driver sees. It changes how small the files are,
    never what they hold.
    """
    rows = sampled(docs.select("doc_id", "text"), "doc_id", sample).select(F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text")).collect()
    ids, offsets = library(path).ids(*utf8(pa.array([r["text"] for r in rows], pa.string())))
    ids = ids.astype(f"<u{width}")
    cuts = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    cuts = [p[k : k + 4096] for p in cuts for k in range(0, len(p), 4096)]
    try:
        return zstandard.train_dictionary(size, cuts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, text_bytes: int = 16 << 20) -> DataFrame:
    """Writes the ids of every whole text of ``docs`` (doc_id, text, ...), ``end_id`` appended, to files in ``folder``.

    Returns the manifest: (file, n_docs, n_tokens, least, most, part, number): part and number ascend as doc_id does, which
    is from least to most in a file. Null texts count as empty and hold the end id alone; null doc_ids come first; rows that
    share a doc_id follow each other by a hash of their texts, equal rows in any order. Files hold about ``text_bytes`` of
    text, or one longer document. Each attempt of a task writes files of its own names; the manifest names those of the attempts
    that count, others are never read. The folder is in Spark's file system; a store that pyarrow can't open is an error.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if _size(path) <= 1 << 16 else 4
    folder = qualified(spark, folder)
    target, base = opened(folder)
    dictionary = trained_dictionary(docs, path, width=width)
    target.create_dir(base, recursive=True)
    with target.open_output_stream(f"{base}/dictionary.zstd") as f:
        f.write(dictionary)
    sent, end = spark.sparkContext.broadcast(dictionary), np.array([end_id], "<u4").tobytes()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A repeated doc_id is dealt by text, and equal rows by their place in the input: no key is one task's alone.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = docs.repartitionByRange(max(1, -(-size // (2 * text_bytes))), *order).sortWithinPartitions(*order[:2])

    def run(batches):
        own, base = opened(folder)
        part, number, held, chunked = TaskContext.get().partitionId(), 0, 0, library(path)
        waiting: list[tuple[int | None, bytes]] = []

        def flush():
            name, tokens = f"{part:06d}-{number:05d}-{uuid.uuid4().hex}.ids", sum(len(i) // 4 for _, i in waiting)
            with own.open_output_stream(f"{base}/{name}") as f:
                f.write(packed(waiting, sent.value, width))
            known = [i for i, _ in waiting if i is not None]
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(waiting)], "n_tokens": [tokens], "least": pa.array(known[:1] or [None], pa.int64()), "most": pa.array(known[-1:] or [None], pa.int64()), "part": [part], "number": [number]})

        for batch in parts(batches, 1, most=1 << 23):
            data, offsets = utf8(batch.column(1))
            ids, places = chunked.ids(data, offsets)
            raw, cuts = memoryview(ids.view(np.uint8)), (4 * places).tolist()
            for doc_id, n, a, b in zip(batch.column(0).to_pylist(), np.diff(offsets).tolist(), cuts[:-1], cuts[1:], strict=True):
                waiting.append((doc_id, bytes(raw[a:b]) + end))
                held += n
                if held >= text_bytes:
                    yield flush()
                    waiting, held, number = [], 0, number + 1
        if waiting:
            yield flush()

    return written(dealt.mapInArrow(run, "file string, n_docs long, n_tokens long, least long, most long, part long, number long"), "manifest")


def _size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _dictionary(folder: str) -> bytes:
    source, base = opened(folder)
    with source.open_input_stream(f"{base}/dictionary.zstd") as f:
        return f.read()


def read(spark: SparkSession, folder: str, manifest: DataFrame, most: int = 100_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``manifest``, from the files alone.

    start counts the ids of all documents before it. The running sum is over one row a file. A task reads whole files, one as
    long as there are no more than ``most``; beyond that all tasks have about as many.
    """
    folder = qualified(spark, folder)
    dictionary = spark.sparkContext.broadcast(_dictionary(folder))
    before = F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = max(1, manifest.count())
    tasks = min(files, most)
    turn = F.row_number().over(Window.orderBy("part", "number")) - 1
    starts = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"), F.floor(turn * F.lit(tasks).cast("long") / files).cast("int").alias("task"))

    def run(batches):
        own, base = opened(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with own.open_input_file(f"{base}/{name}") as f:
                    reader = Reader(f, dictionary.value)
                    n = reader.entries[:, 1]
                    crc = [zlib.crc32(i.tobytes()) for i in reader.all()]
                ids = pa.array(reader.entries[:, 0], pa.int64(), mask=reader.null)
                yield pa.RecordBatch.from_arrays([ids, pa.array(before + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartitionById(tasks, F.col("task")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(spark: SparkSession, folder: str, manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this doc_id (none, or several if it is repeated): only index entries and their frames are read."""
    folder = qualified(spark, folder)
    own, base = opened(folder)
    dictionary, out = _dictionary(folder), []
    for r in manifest.where((F.col("least") <= doc_id) & (F.col("most") >= doc_id)).orderBy("part", "number").select("file").collect():
        with own.open_input_file(f"{base}/{r['file']}") as f:
            reader = Reader(f, dictionary)
            out += [reader.ids(k) for k in reader.named(doc_id)]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read(spark, folder, manifest)
