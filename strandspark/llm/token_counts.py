"""Token counts by dynamic programming on a trie of distinct pre-tokens.

A unigram model gives every piece of a vocabulary a score; a pre-token's tokens are the pieces of its best segmentation. The
forward score of a prefix (the best score of any segmentation of it, and how many pieces that has) is the same for all
pre-tokens that begin with it. So distinct pre-tokens go into a trie, level by level, each node gets its forward score once
from the nodes above it, and terminal nodes hold the counts of whole pre-tokens.

The vocabulary file orders pieces by frequency and gives no probabilities; by Zipf's law the piece at place r of the order
scores -log(r + 1), in whole thousandths so that sums are exact. Of equal scores the segmentation with fewer pieces counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table, utf8
from .subwords import Chunked, distinct, pretokens, vocabulary

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(-(1 << 60))
#: Words with more bytes are no part of the trie.
LONG = 256


class Pieces:
    """The pieces of a byte-level vocabulary by the hash of their bytes, and their scores."""

    def __init__(self, path: str):
        v = vocabulary(path)
        added = set(v.added.values())
        best: dict[bytes, int] = {}
        for i in range(v.size):
            piece = v.bytes[v.starts[i] : v.starts[i] + v.lengths[i]].tobytes()
            if piece and i not in added:
                best.setdefault(piece, -round(1000 * float(np.log(i + 1))))
        self.score = best
        self.longest = max(map(len, best))
        hashes = []
        for piece in best:
            h = 0
            for c in piece:
                h = (h * int(_BASE) + c + 1) % (1 << 64)
            hashes.append(h)
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[order]
        self.scores = np.array(list(best.values()), np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.sizes = set(map(len, best))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & np.uint64(len(self.seen) - 1)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many pieces each row's best segmentation has; 0 for the empty row."""
        size = np.diff(offsets)
        out = np.zeros(len(size), np.int64)
        for k in np.flatnonzero(size > LONG):
            out[k] = self.of_long(data[offsets[k] : offsets[k + 1]])
        short = np.flatnonzero(size <= LONG)
        size, begin = size[short], offsets[:-1][short]
        order = np.argsort(-size, kind="stable")  # the words that reach a depth come first
        reach = np.searchsorted(-size[order], -np.arange(size.max(initial=0) + 1), side="right")
        node = np.zeros(len(size), np.int64)  # of each word, in that order, at the level before
        # The forward value of a node: its score times 2**20 less its pieces, so that fewer pieces win among equals.
        value = np.zeros(1, np.int64)
        hashes = np.zeros((1, 0), np.uint64)
        above = np.zeros((1, 0), np.int64)  # values of the nodes above each node, the nearest first
        for depth in range(1, len(reach)):
            words_here = order[: reach[depth]]
            letter = data[begin[words_here] + depth - 1].astype(np.int64)
            found, node = np.unique(node[: reach[depth]] * 256 + letter, return_inverse=True)
            parent, letter = found >> 8, (found & 255).astype(np.uint64) + np.uint64(1)
            hashes = np.concatenate([letter[:, None], hashes[parent][:, : self.longest - 1] * _BASE + letter[:, None]], axis=1)
            above = np.concatenate([value[parent][:, None], above[parent][:, : self.longest - 1]], axis=1)
            value = np.full(len(found), _NEVER)
            row, column, score = self._known(hashes)
            np.maximum.at(value, row, above[row, column] + (score << 20) - 1)
            ended = size[words_here] == depth
            out[short[words_here[ended]]] = -value[node[ended]] & ((1 << 20) - 1)
        return out

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places of ``hashes`` that are pieces, and their scores. A bit map keeps most others from the search."""
        at = np.nonzero(self.seen[hashes & np.uint64(len(self.seen) - 1)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[found] == hashes[at]
        return (*(x[hit] for x in at), self.scores[found[hit]])

    def of_long(self, word: np.ndarray, most: int = 1 << 16) -> int:
        """The same for one long word, which shares little with others: its prefixes are one path, in stretches of ``most``.

        Scores and pieces are whole numbers without a bound.
        """
        keep = self.longest
        scores, counts = [0], [0]  # of the last prefixes, the nearest last
        for start in range(0, len(word), most):
            low = max(0, start - keep)
            letters = word[low : start + most].astype(np.uint64) + np.uint64(1)
            rolled, ends, sizes, values = np.zeros(len(letters), np.uint64), [], [], []
            power = 1
            for n in range(1, keep + 1):
                m = len(letters) - n + 1
                if m <= 0:
                    break
                # The hash of the n bytes before an end, first byte first: that of n - 1 bytes, one byte further in front.
                rolled = letters[:m] * np.uint64(power) + rolled[1 : m + 1] if n > 1 else letters.copy()
                power = power * int(_BASE) % (1 << 64)
                if n in self.sizes:
                    place, score = self._known(rolled)
                    ends.append(place + n)
                    sizes.append(np.full(len(place), n))
                    values.append(score)
            ends, sizes, values = (np.concatenate(x) for x in (ends, sizes, values))
            own = ends > start - low
            order = np.argsort(ends[own], kind="stable")
            ends, sizes, values = (x[own][order].tolist() for x in (ends, sizes, values))
            k, many = 0, len(ends)
            for end in range(start - low + 1, len(letters) + 1):
                best, pieces = None, 0
                while k < many and ends[k] == end:
                    s, c = scores[-sizes[k]] + values[k], counts[-sizes[k]] + 1
                    if best is None or s > best or (s == best and c < pieces):
                        best, pieces = s, c
                    k += 1
                scores.append(best)
                counts.append(pieces)
            scores, counts = scores[-keep:], counts[-keep:]
        return counts[-1]


@lru_cache(maxsize=4)
def counter(path: str) -> Chunked:
    pieces = Pieces(path)

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, owners = pretokens(data, offsets)
        own, own_offsets, which = distinct(data, starts, len(data))
        n = np.append(0, np.cumsum(pieces.counts(own, own_offsets)[which]))[owners]
        return np.diff(n), np.ones(len(n) - 1, np.int64)

    return Chunked(encode, {})


def _counted(path: str):
    def run(batches):
        chunked = counter(path)
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunked.counts(*utf8(batch.column(1))), pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text, ...), whole texts and pre-tokens of any length.

    Null and empty texts have none; single bytes are pieces, so every text has a count. Null doc_ids stay null, repeated rows
    count alike; other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted(path), "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
