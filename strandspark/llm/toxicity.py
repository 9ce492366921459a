"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of the whole word, so misspellings that were never seen
share most of a known word's vectors. A window of consecutive words is the mean of its words' vectors (repeats and
places past the end of a text count as nothing), a linear softmax gives its two classes, and a text scores as its most toxic window: one insult isn't averaged away by a long text. Both
the vectors and the softmax are learned at once, from labelled texts.

Only the difference of the two logits matters for a score, and it is a mean over words; so scoring needs one number a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, mix64, parts, slices, spans, table, utf8

BUCKETS = 1 << 18
LENGTHS = (3, 4, 5)
#: Words of a window: enough for several insults of a text that has them, few enough that one part of a long text counts.
WINDOW = 96
#: A text with at least this score counts as toxic.
THRESHOLD = 0.7
#: Bytes between words: ASCII white space, punctuation and other marks except the apostrophe; all else belongs to words.
_GAP = np.ones(256, bool)
_GAP[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: lower-cased bytes, starts, ends and hashes of their words, offsets of the rows in these."""
    for row, end in slices(offsets):
        part = _LOWER[data[offsets[row] : offsets[end]]]
        starts, ends, rows = spans(_GAP[part], offsets[row : end + 1] - offsets[row])
        yield part, starts, ends, hashed(part, starts, ends), rows


def grams(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): those of the n-grams of each word, its two ends marked, and of the word itself."""
    size = ends - starts
    padded = np.zeros(int((size + 2).sum()), np.uint64)
    begin = np.cumsum(size + 2) - (size + 2)
    at = np.repeat(starts - begin - 1, size)
    inside = np.ones(len(padded), bool)
    inside[begin] = inside[begin + size + 1] = False
    inside = np.flatnonzero(inside)
    padded[inside] = part[inside + at]
    padded[begin], padded[begin + size + 1] = 256, 257
    word = np.repeat(np.arange(len(size)), size + 2)
    found, owner = [hashes], [np.arange(len(size))]
    rolled = np.zeros(len(padded), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        m = len(padded) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(1000003) + padded[n - 1 :] + np.uint64(1)
        if n in LENGTHS:
            whole = word[:m] == word[n - 1 :]
            found.append(mix64(rolled[whole] + np.uint64(n)))
            owner.append(word[:m][whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(found)[order] & np.uint64(BUCKETS - 1)).astype(np.int32)
    return buckets, np.append(0, np.cumsum(np.bincount(owner, minlength=len(size))))


def _windows(rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, doc): windows of ``window`` words that half overlap, and the row of each; rows without words have none."""
    n = np.diff(rows)
    many = np.where(n > 0, np.maximum(1, -(-(n - window // 2) // (window // 2))), 0)
    doc = np.repeat(np.arange(len(n)), many)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return rows[:-1][doc] + step * (window // 2), doc


def _sums(x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(x, dtype=np.float64))
    return sums[stops] - sums[starts]


def _grouped(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, group, fresh): where each distinct word is first, which one each word is, and whether it is new here.

    A word that its row has within the last ``WINDOW`` words isn't new: repeats of one word add nothing to a window.
    """
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    begins = np.ones(len(order), bool)
    np.not_equal(sorted_hashes[1:], sorted_hashes[:-1], out=begins[1:])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    fresh = np.ones(len(order), bool)
    fresh[order[1:]] = begins[1:] | (np.diff(order) >= WINDOW) | (row[order[1:]] != row[order[:-1]])
    return order[begins], group, fresh


class Model:
    """One weight for each n-gram bucket: its vector times the difference of the softmax's two rows; and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def word_scores(self, part, starts, ends, hashes, rows) -> np.ndarray:
        first, group, fresh = _grouped(hashes, rows)
        if not len(first):
            return np.zeros(0)
        buckets, offsets = grams(part, starts[first], ends[first], hashes[first])
        return (np.add.reduceat(self.weights[buckets], offsets[:-1]) / np.diff(offsets))[group] * fresh

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row; texts without words have that of the bias alone."""
        out = []
        for part, starts, ends, hashes, rows in words(data, offsets):
            logit = np.full(len(rows) - 1, -np.inf)
            begin, doc = _windows(rows, WINDOW)
            if len(doc):
                stop = np.minimum(begin + WINDOW, rows[1:][doc])
                np.maximum.at(logit, doc, _sums(self.word_scores(part, starts, ends, hashes, rows), begin, stop) / WINDOW)
            logit[np.isinf(logit)] = 0
            out.append(1 / (1 + np.exp(-np.clip(logit + self.bias, -60, 60))))
        return np.concatenate(out) if out else np.zeros(0)


def _telling(having: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of one share of texts that have a bucket against a share for each label."""

    def log_likelihood(k, n):
        share = np.clip(k / n, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (n - k) * np.log(1 - share)

    return 2 * (log_likelihood(having[0], of[0]) + log_likelihood(having[1], of[1]) - log_likelihood(having.sum(axis=0), of.sum()))


def train(texts: list[str], labels: list[int], dimension: int = 4, rounds: int = 120, rate: float = 0.3, least: float = 8.0, decay: float = 1e-8, floor: float = 1e-5) -> Model:
    """Vectors and softmax by full-batch Adam on the logistic loss of each text's most toxic window.

    In texts labelled 0 every window counts as clean; without both labels there is nothing to learn and the score is
    the share of label 1.
    """
    once: dict[str, int] = {}  # copies of a text would make its other words look telling
    for text, label in zip(texts, labels, strict=True):
        once[text] = max(label, once.get(text, 0))
    texts, y = list(once), np.array(list(once.values()), np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -6.0 if len(y) == 0 or y.max() == 0 else 6.0)
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, counted, all_rows, known = [], [], [np.zeros(1, np.int64)], {}
    sizes, buckets = [], []
    for part, starts, ends, hashes, rows in words(data, offsets):
        first, at, fresh = _grouped(hashes, rows)
        distinct = hashes[first]
        counted.append(fresh)
        new = np.array([h not in known for h in distinct.tolist()], bool)
        for h in distinct[new].tolist():
            known[h] = len(known)
        if new.any():
            b, o = grams(part, starts[first[new]], ends[first[new]], distinct[new])
            buckets.append(b), sizes.append(np.diff(o))
        ids.append(np.array([known[h] for h in distinct.tolist()], np.int64)[at] if len(distinct) else np.zeros(0, np.int64))
        all_rows.append(rows[1:] + all_rows[-1][-1])
    token, counted, rows = np.concatenate(ids), np.concatenate(counted), np.concatenate(all_rows)
    if not known:
        return Model(np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean()))))
    gram, size = np.concatenate(buckets), np.concatenate(sizes).astype(np.float64)
    first_gram = (np.cumsum(size) - size).astype(np.int64)
    begin, doc = _windows(rows, WINDOW)
    stop = np.minimum(begin + WINDOW, rows[1:][doc])
    first_window = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    toxic, own = y[doc] > 0.5, np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    weight = np.where(toxic, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    # Buckets that texts of both labels have alike only blur the mean; those that tell labels apart are learned.
    owner = np.repeat(np.arange(len(size)), size.astype(np.int64))
    having = np.zeros((2, BUCKETS))
    for k in range(0, len(y), 250):
        own_tokens = token[rows[k] : rows[min(k + 250, len(y))]]
        in_doc = np.repeat(np.arange(k, min(k + 250, len(y))), np.diff(rows[k : k + 251]))
        pair = np.unique(own_tokens * np.int64(len(y)) + in_doc)
        of_word, of_doc = pair // len(y), pair % len(y)
        many = size[of_word].astype(np.int64)
        flat = np.repeat(first_gram[of_word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair = np.unique(gram[flat].astype(np.int64) * len(y) + np.repeat(of_doc, many))
        for label in (0, 1):
            having[label] += np.bincount(pair[(y[pair % len(y)] > 0.5) == label] // len(y), minlength=BUCKETS)
    usable = _telling(having, np.array([(1 - y).sum(), y.sum()])) >= least
    kept = usable[gram]
    gram, owner = gram[kept], owner[kept]
    rng = np.random.default_rng(11)
    vectors, softmax, bias = rng.normal(0, 0.02, (BUCKETS, dimension)) * usable[:, None], rng.normal(0, 0.5, dimension), -1.0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, np.zeros(1))]
    for turn in range(1, rounds + 1):
        flat = vectors @ softmax
        word = np.bincount(owner, flat[gram], minlength=len(size)) / size
        logit = _sums(word[token] * counted, begin, stop) / WINDOW + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        # All windows of a text count alike at first; in the end the most toxic one does.
        sharp = np.exp(np.minimum(8.0, 12.0 * turn / rounds) * (logit - np.maximum.reduceat(logit, first_window)[own]))
        g = (p - toxic) * weight * sharp / np.add.reduceat(sharp, first_window)[own]
        change = np.bincount(begin, g, len(token) + 1) - np.bincount(stop, g, len(token) + 1)
        on_word = np.bincount(token, np.cumsum(change)[:-1] * counted, minlength=len(size)) / size / WINDOW
        on_flat = np.bincount(gram, on_word[owner], minlength=BUCKETS) + decay * flat
        gradients = (on_flat[:, None] * softmax, vectors.T @ on_flat, np.array([g.sum()]))
        current = [vectors, softmax, np.array([bias])]
        for k, (x, d) in enumerate(zip(current, gradients, strict=True)):
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            x -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + floor)
        bias = float(current[2][0])
    # The score at which the two labels of the training texts part with the fewest errors becomes the threshold of use.
    model = Model(vectors @ softmax, bias)
    seen = model.scores(data, offsets)
    order = np.argsort(-seen, kind="stable")
    gain = np.cumsum(np.where(y[order] > 0.5, 1, -1))
    best = np.flatnonzero(gain == gain.max())
    at = best[len(best) // 2]
    parted = np.clip((seen[order[at]] + seen[order[min(at + 1, len(order) - 1)]]) / 2, 1e-6, 1 - 1e-6)
    return Model(model.weights, bias + np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(parted / (1 - parted)))


def _chosen(labelled: DataFrame, most: int, longest: int = 1 << 15) -> DataFrame:
    """(text, toxic): at most ``most`` rows of (doc_id, text, toxic), those with the smallest hashes of doc_id, in this order in one partition."""
    short = labelled.where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    return short.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def bounded_sample(labelled: DataFrame, most: int, longest: int = 1 << 15) -> tuple[list[str], list[int]]:
    """At most ``most`` rows (doc_id, text, toxic), those with the smallest hashes of doc_id: the same at every partitioning.

    Texts of more than ``longest`` characters are no part of it, so rows and characters are bounded.
    """
    rows = _chosen(labelled, most, longest).collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def _fitted(batches):
    """The model of (text, toxic) as one row: the bytes of its weights, and its bias."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    model = train(texts, labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])


def learned(docs: DataFrame, labels: DataFrame, usable: Column, most: int = 4000) -> Model:
    """A model from at most ``most`` labelled rows (the documented bound of the training sample) for which ``usable`` holds.

    Labels other than 0 and 1 and null doc_ids don't count. Of a doc_id with several labels the largest counts. Without
    labelled rows, or with one label alone, all texts score alike, on that label's side. A task trains, so that neither texts
    nor what training needs of memory come to the driver; the model's weights do.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    models = _chosen(texts.join(F.broadcast(picked), "doc_id"), most).mapInArrow(_fitted, "weights binary, bias double").collect()
    return Model(np.frombuffer(models[0]["weights"], np.float32), models[0]["bias"]) if models else train([], [])


def rounded(model: Model, column: pa.Array) -> np.ndarray:
    """The scores of a column of texts as they are given out; decisions are made on these."""
    return np.round(model.scores(*utf8(column)), 6)


def _scored(weights, bias: float):
    def run(batches):
        model = Model(weights.value, bias)
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rounded(model, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text, ...), from the whole text and nothing else.

    Null and empty texts and texts without words score as the model's bias alone says. Repeated rows score alike;
    other columns are ignored. The model that goes to executors has a fixed size: 2**18 weights.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scored(weights, model.bias), "doc_id long, score double")


def held_out() -> Column:
    """True for the rows whose labels are never learned from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns.

    Rows are judged one by one, repeated or without a doc_id: null and empty texts and texts without words by the model's
    bias alone. An empty table stays empty.
    """
    weights, bias, column = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias, docs.columns.index("text")

    def run(batches):
        own = Model(weights.value, bias)
        for batch in parts(batches, column):
            yield batch.filter(pa.array(rounded(own, batch.column(column)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"), ~held_out())
    return scores(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
