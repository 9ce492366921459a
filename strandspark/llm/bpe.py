"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the ranks of all neighbouring pairs are found by binary
search over the sorted pair keys, each word's lowest rank is merged wherever it occurs in that word, and words without
a mergeable pair leave. (A word of over 4096 bytes would keep all rounds waiting: its pairs go through a heap.) Decoding gathers the bytes of all ids at once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, slices, table, utf8
from .subwords import Chunked, Vocabulary, distinct, place_of, pretokens, vocabulary

_NEVER = np.int32((1 << 31) - 1)
#: Words with more bytes take no part in rounds.
LONG = 4096


def pair_ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, merged symbols) of pairs of symbols, by binary search over the sorted pair keys."""
    key = left * np.int64(v.size) + right
    ranks, into = np.full(len(key), _NEVER, np.int32), np.zeros(len(key), np.int32)
    maybe = np.flatnonzero(v.seen[place_of(key)])
    at = np.searchsorted(v.keys, key[maybe])
    at[at == len(v.keys)] = 0
    known = v.keys[at] == key[maybe]
    ranks[maybe[known]], into[maybe[known]] = v.ranks[at[known]], v.into[at[known]]
    return ranks, into


@lru_cache(maxsize=4)
def _byte_pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and merged symbols of all pairs of bytes, which every first round asks for."""
    v = vocabulary(path)
    ranks, into = pair_ranks(v, np.repeat(v.byte_ids, 256), np.tile(v.byte_ids, 256))
    return ranks, into


@lru_cache(maxsize=4)
def _merges(path: str) -> dict[int, tuple[int, int]]:
    v = vocabulary(path)
    return dict(zip(v.keys.tolist(), zip(v.ranks.tolist(), v.into.tolist(), strict=True), strict=True))


def merged_long(word: np.ndarray, path: str) -> np.ndarray:
    """The ids of one word of any length: its pairs wait in a heap, so that a round costs what it merges, not the whole word."""
    v, merges = vocabulary(path), _merges(path)
    symbols, n = v.byte_ids[word].tolist(), len(word)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = _byte_pairs(path)[0][word[:-1].astype(np.int32) * 256 + word[1:]]
    at = np.flatnonzero(ranks != _NEVER)
    heap = ((ranks[at].astype(np.int64) << 40) | at).tolist()
    heapq.heapify(heap)
    size, low = v.size, (1 << 40) - 1
    while heap:
        top = heapq.heappop(heap)
        k = top & low
        right = following[k]
        if symbols[k] < 0 or right >= n:
            continue
        found = merges.get(symbols[k] * size + symbols[right])
        if found is None or found[0] != top >> 40:
            continue  # one of the two has changed since
        symbols[k], symbols[right] = found[1], -1
        after = following[k] = following[right]
        if after < n:
            before[after] = k
            found = merges.get(symbols[k] * size + symbols[after])
            if found is not None:
                heapq.heappush(heap, found[0] << 40 | k)
        left = before[k]
        if left >= 0:
            found = merges.get(symbols[left] * size + symbols[k])
            if found is not None:
                heapq.heappush(heap, found[0] << 40 | left)
    return np.array([s for s in symbols if s >= 0], np.int32)


def merged(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the ids of all words in a row, and how many each word has."""
    v = vocabulary(path)
    words = len(offsets) - 1
    symbols = v.byte_ids.astype(np.int32)[data]
    word = np.repeat(np.arange(words, dtype=np.int32), np.diff(offsets))
    rank, into = np.full(len(symbols), _NEVER, np.int32), np.zeros(len(symbols), np.int32)
    if len(data) > 1:
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        ranks, merges = _byte_pairs(path)
        rank[:-1] = np.where(word[1:] == word[:-1], ranks[pair], _NEVER)
        into[:-1] = merges[pair]

    def look(left: np.ndarray) -> None:
        """Sets the rank of the pairs that begin at these places."""
        left = left[left + 1 < len(symbols)]
        ranks, into[left] = pair_ranks(v, symbols[left], symbols[left + 1])
        rank[left] = np.where(word[left] == word[left + 1], ranks, _NEVER)

    done_word, done_symbols = [], []
    while len(symbols):
        first = np.ones(len(word), bool)
        np.not_equal(word[1:], word[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
        keep = lowest != _NEVER
        done_word.append(word[~keep])
        done_symbols.append(symbols[~keep])
        chosen = np.flatnonzero((rank == lowest) & keep)
        if not len(chosen):
            break
        # Of overlapping occurrences, as in a run of one symbol, every second one is merged, from the left.
        run = np.ones(len(chosen), bool)
        np.not_equal(chosen[1:], chosen[:-1] + 1, out=run[1:])
        begin = np.flatnonzero(run)
        if len(begin) < len(chosen):
            chosen = chosen[(np.arange(len(chosen)) - np.repeat(begin, np.diff(np.append(begin, len(chosen))))) % 2 == 0]
        symbols[chosen] = into[chosen]
        keep[chosen + 1] = False
        place = (np.cumsum(keep) - 1)[chosen]
        symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
        rank[place[place == len(symbols) - 1]] = _NEVER
        look(np.concatenate([place, place[place > 0] - 1]))
    if not done_word:
        return np.zeros(0, np.int32), np.zeros(words, np.int64)
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=words)


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words of about 2**18 bytes; a long word is one by itself."""
    row = 0
    for k in [*np.flatnonzero(np.diff(offsets) > LONG).tolist(), len(offsets) - 1]:
        yield from ((row + a, row + b) for a, b in slices(offsets[row : k + 1]))
        if k < len(offsets) - 1:
            yield k, k + 1
        row = k + 1


def by_pretokens(merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """What gives the ids of all chunks in a row, and how many each has: ``merge`` gets the distinct pre-tokens of all chunks once."""

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, owners = pretokens(data, offsets)
        own, own_offsets, which = distinct(data, starts, len(data))
        ids, lengths = merge(own, own_offsets)
        many = lengths[which]
        ends = np.append(0, np.cumsum(many))
        at = np.repeat((np.cumsum(lengths) - lengths)[which] - ends[:-1], many)
        at += np.arange(ends[-1])
        return ids[at], np.diff(ends[owners])

    return encode


@lru_cache(maxsize=4)
def encoder(path: str) -> Chunked:
    def merge(data: np.ndarray, offsets: np.ndarray):
        found = []
        for a, b in _stretches(offsets):
            if b == a + 1 and offsets[b] - offsets[a] > LONG:
                ids = merged_long(data[offsets[a] : offsets[b]], path)
                found.append((ids, np.array([len(ids)])))
            else:
                found.append(merged(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path))
        return (np.concatenate([np.zeros(0, np.int32), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    return Chunked(by_pretokens(merge), vocabulary(path).added)


def _round_trip(path: str):
    def run(batches):
        v, chunked = vocabulary(path), encoder(path)
        for batch in parts(batches, 1):
            ids, offsets = chunked.ids(*utf8(batch.column(1)))
            raw, digests = memoryview(ids.view(np.uint8)), [[], []]
            decoded, ends = v.decode(ids), np.append(0, np.cumsum(v.lengths[ids]))[offsets]
            for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                digests[0].append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                digests[1].append(hashlib.sha256(decoded[c:d].decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), *(pa.array(d, pa.string()) for d in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches):
        chunked = encoder(path)
        for batch in parts(batches, 1):
            ids, offsets = chunked.ids(*utf8(batch.column(1)))
            out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        v = vocabulary(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                lists = batch.column(1)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
                kept = np.append(0, np.cumsum(ids >= 0))[offsets]
                ids = ids[ids >= 0]
                ends = np.append(0, np.cumsum(v.lengths[ids]))[kept].tolist()
                raw = v.decode(ids)
                texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_null(), None, texts)], ["doc_id", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text, ...) by the vocabulary file at ``path``.

    Whole texts of any length; null and empty texts have no ids. Strings of added tokens in a text become their ids, as
    in the library. One row for each row, repeated or not; other columns are ignored.
    """
    return _texts(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): bytes that aren't UTF-8 become U+FFFD, null ids a null text, null entries nothing."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``: texts encoded, then decoded again."""
    return _texts(docs).mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
