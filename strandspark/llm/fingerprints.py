"""Document fingerprints by content-defined chunking with normalised gear-hash boundaries.

A gear hash of the last 16 bytes marks boundaries; before the usual chunk size a stricter condition holds than after it, so
sizes gather around it. An insertion or a deletion moves only the boundaries near it: the digests of all other chunks stay.
A fingerprint is the set of chunk digests with the bytes that each covers, and what part of these bytes another fingerprint
has too is the containment of one text in the other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices, table, utf8

LEAST, USUAL, MOST = 8, 24, 96
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Top bits that must be zero: five before the usual size, three after it.
_STRICT, _LOOSE = np.uint32(0xF8000000), np.uint32(0xE0000000)
#: The bytes that a hash depends on: each step shifts by two bits, and after 16 a byte has left the 32.
REACH = 16


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the last 16: each step shifts by two bits and adds the byte's value. By doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(2 * k)
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """For each row its chunks (start, end); those of equal texts are equal, whatever lies around them."""
    for row, end in slices(offsets, 1 << 18):
        part, own = data[offsets[row] : offsets[end]], (offsets[row : end + 1] - offsets[row]).tolist()
        h = gear(part)
        loose = np.flatnonzero((h & _LOOSE) == 0)
        strict = ((h[loose] & _STRICT) == 0).tolist()
        loose = (loose + 1).tolist()
        loose.append(1 << 62)
        strict.append(True)
        k = 0
        base = int(offsets[row])
        for a, b in zip(own[:-1], own[1:], strict=True):
            out = []
            start = a
            while start < b:
                # Hashes near the start of the text depend on what lies before it: none of them counts.
                low, usual, high = max(start + LEAST, a + REACH), start + USUAL, start + MOST
                while loose[k] < low:
                    k += 1
                j = k
                while loose[j] < usual and loose[j] < high and not strict[j]:
                    j += 1
                cut = min(loose[j], high, b)
                out.append((base + start, base + cut))
                start = cut
            yield out


def digests(raw: bytes, spans: list[tuple[int, int]]) -> dict[str, int]:
    """The bytes that each digest covers, repeats added up."""
    digest = xxhash.xxh3_64_hexdigest
    keys = [digest(raw[a:b]) for a, b in spans]
    out = dict.fromkeys(keys, 0)
    for key, (a, b) in zip(keys, spans, strict=True):
        out[key] += b - a
    return out


def written_form(fingerprint: dict[str, int]) -> str:
    """Digests in ascending order, each with the bytes that it covers in hexadecimal."""
    return " ".join([f"{k}:{n:x}" for k, n in sorted(fingerprint.items())])


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The part of the bytes of ``a`` that ``b`` covers too; 1 if both are empty, 0 if only one is."""
    whole = sum(a.values())
    if not whole:
        return float(not b)
    return sum(min(n, b[k]) for k, n in a.items() if k in b) / whole


def _prints(texts: list[bytes]) -> list[dict[str, int]]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    raw = data.tobytes()
    return [digests(raw, own) for own in chunks(data, offsets)]


def _compared(batches):
    """Rows (bucket, doc_id, text, extra) in order; each is compared with the next one, for which ``extra`` rows only stand in."""
    last = None  # (bucket, doc_id, text bytes)

    def results(rows):
        if not rows:
            return None
        texts = [r[1].decode("utf-8", "replace") for r in rows]
        following = [r[2].decode("utf-8", "replace") for r in rows]
        edited = []
        for t, f in zip(texts, following, strict=True):
            k = len(t) // 3
            edited.append((t[: len(t) - k] + f[:k]).encode())
        distinct = list(dict.fromkeys(x for r in rows for x in r[1:]))
        known = dict(zip(distinct, _prints(distinct), strict=True))
        own, changed, nxt = [known[r[1]] for r in rows], _prints(edited), [known[r[2]] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([written_form(p) for p in own], pa.string()),
                pa.array([written_form(p) for p in changed], pa.string()),
                pa.array([round(containment(a, b), 6) for a, b in zip(own, changed, strict=True)], pa.float64()),
                pa.array([round(containment(a, b), 6) for a, b in zip(own, nxt, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        buckets, ids, extra = (batch.column(k).to_pylist() for k in (0, 1, 3))
        data, offsets = utf8(batch.column(2))
        for row, end in slices(offsets, 1 << 20):
            part, own = data[offsets[row] : offsets[end]].tobytes(), (offsets[row : end + 1] - offsets[row]).tolist()
            ready = []
            for k in range(row, end):
                text = part[own[k - row] : own[k - row + 1]]
                if last is not None and last[0] == buckets[k]:
                    ready.append((last[1], last[2], text))
                last = None if extra[k] else (buckets[k], ids[k], text)
            out = results(ready)
            if out is not None:
                yield out


def _cuts(keys: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(down, h): where the order of ``keys`` (down, h) is cut into about ``parts`` even parts, ascending.

    A document number that fills several parts is cut by the hashes of its texts; a hash that does so stands there several
    times.
    """
    if parts == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    accuracy = max(10_000, 10 * parts)
    found = Counter(keys.agg(F.percentile_approx("down", [k / parts for k in range(1, parts)], accuracy)).first()[0])
    cuts = [(d, -(1 << 63)) for d, n in found.items() if n == 1]
    hot = {d: n for d, n in found.items() if n > 1}
    if hot:
        most = max(hot.values()) + 1
        shares = keys.where(F.col("down").isin(list(hot))).groupBy("down").agg(F.percentile_approx("h", [k / most for k in range(1, most)], accuracy).alias("h"))
        cuts += [(r["down"], r["h"][round(k * most / (hot[r["down"]] + 1)) - 1]) for r in shares.collect() for k in range(1, hot[r["down"]] + 1)]
    return tuple(np.array(x, np.int64) for x in zip(*sorted(cuts), strict=True))


def buckets(down: np.ndarray, h: np.ndarray, turn: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The part of each row. Rows whose key is that of several cuts are equal: they go to any part between these."""
    first, last = (np.searchsorted(cuts[0], down, side) for side in ("left", "right"))
    out = first.copy()
    at = np.flatnonzero(last > first)
    for low in np.unique(first[at]).tolist():
        rows = at[first[at] == low]
        own = cuts[1][low : last[rows[0]]]
        left, right = (np.searchsorted(own, h[rows], side) for side in ("left", "right"))
        out[rows] = low + np.where(left == right, left, np.where(right - left == 1, right, left + turn[rows] % (right - left + 1)))
    return out


def fingerprinted(docs: DataFrame, rows_each: int = 10_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``.

    The edited text is the text with its last third (code points, rounded down) replaced by as many first code points of
    the next document in descending doc_id order, after the last by those of the first; near_edited and near_next are the
    containments of the text in its edited text and in the next one. Null texts count as empty, null doc_ids count as
    the least number, rows that share a doc_id follow each other by a hash of their texts, equal rows in any order. A single row is its own
    next document. An empty table gives an empty result; other columns are ignored.

    The order is dealt to parts of about ``rows_each`` rows, one task each; repeated ids are dealt by text, equal rows one by
    one. Only the first row of each part is copied, to stand behind the part before.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    least = F.lit(-(1 << 63)).cast("long")
    keyed = slim.withColumn("down", F.bitwise_not(F.coalesce("doc_id", least))).withColumn("h", F.xxhash64("text"))
    rows = docs.count()
    cuts = _cuts(keyed.select("down", "h"), max(1, -(-rows // max(rows_each, rows // 100_000))))

    @F.pandas_udf("int")
    def part_of(down: pd.Series, h: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series(buckets(down.to_numpy(), h.to_numpy(), turn.to_numpy(), cuts).astype(np.int32))

    keyed = keyed.withColumn("bucket", part_of("down", "h", F.monotonically_increasing_id()))
    first = keyed.groupBy("bucket").agg(F.min(F.struct("down", "h")).alias("first")).select("bucket", "first.*").collect()
    if not first:
        return slim.mapInArrow(_nothing, _SCHEMA)
    first = sorted(tuple(r) for r in first)
    moved = docs.sparkSession.createDataFrame([(b, first[k - 1][0], d, h) for k, (b, d, h) in enumerate(first)], "bucket int, before int, down long, h long")
    heads = keyed.join(F.broadcast(moved), ["bucket", "down", "h"]).groupBy(F.col("before").alias("bucket")).agg(F.first(F.struct("doc_id", "text")).alias("x")).select("bucket", "x.*")
    both = keyed.select("bucket", "doc_id", "text", F.lit(False).alias("extra"), "down", "h").unionByName(heads.select("bucket", "doc_id", "text", F.lit(True).alias("extra"), F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("h")))
    dealt = both.repartitionById(first[-1][0] + 1, F.col("bucket")).sortWithinPartitions("extra", "down", "h")
    return dealt.select("bucket", "doc_id", "text", "extra").mapInArrow(_compared, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _nothing(batches):
    """For a table without rows."""
    yield from ()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
