"""Test data with known answers, made from given sequences by arithmetic on positions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import BASES
from .arrays import points
from .composition import symbol_counts

# The alphabets that each kind of error draws from.
ALPHABETS = {"letters": "XZJOQE", "digits": "0123456789", "symbols": "@#$%*?", "spaces": " \t"}
ALPHABETS["mixed"] = "".join(ALPHABETS.values())
PRIME, FACTOR = 2_147_483_647, 48_271  # 2**31 - 1, on which ``draws`` relies


def draws(position: np.ndarray, seed: int, salt: int) -> np.ndarray:
    """Numbers below 2**31 - 1 that look random, from positions: three steps of a multiplicative generator."""
    position = position + (seed * 7919 + salt * 104_729)
    x = _remainders((position % PRIME if position.size and position.min() < 0 else position).astype(np.uint64), 2)
    for _ in range(3):
        x *= np.uint64(FACTOR)
        x += np.uint64(12_345)
        _remainders(x, 1)
    return x.view(np.int64)


def _remainders(x: np.ndarray, folds: int) -> np.ndarray:
    """``x`` modulo 2**31 - 1 in place, without a division: bits above add to those below, and what is still too large wraps around.

    One fold is enough below 2**61, two for all.
    """
    above = np.empty_like(x)
    for _ in range(folds):
        np.right_shift(x, np.uint64(31), out=above)
        x &= np.uint64(PRIME)
        x += above
    np.subtract(x, np.uint64(PRIME), out=above)
    return np.minimum(x, above, out=x)


def texts_of(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A text column of ASCII symbols, ``offsets`` of its rows in them."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def shifts(keys: np.ndarray) -> np.ndarray:
    """What sets the positions of sequences with these keys apart."""
    return keys % PRIME * 1_000_003 % PRIME


def _places(key: int, n: int) -> np.ndarray:
    """The positions of a text, apart from those of other texts by its key."""
    return np.arange(n, dtype=np.int64) + key % PRIME * 1_000_003 % PRIME


def _substituted(alphabet: str, per_million: int, seed: int):
    letters = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)

    def of(key: int, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, places, new code points)."""
        codes = points(text)
        place = _places(key, len(codes))
        at = np.flatnonzero((draws(place, seed, 1) % 1_000_000 < per_million) & (codes != 10))
        return codes, at, letters[draws(place[at], seed, 2) % len(letters)]

    return of


def with_errors(df: DataFrame, key: str, text: str, kind: str, per_million: int, seed: int = 1234) -> DataFrame:
    """(key, pos, original, error): substitutions of symbols, never insertions, at places drawn by position and key."""
    of = _substituted(ALPHABETS[kind], per_million, seed)

    def run(batches):
        for batch in batches:
            for row, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if k is not None and t:
                    codes, at, new = of(k, t)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), row))), pa.array(at, pa.int64()), pa.array([chr(c) for c in codes[at].tolist()], pa.string()), pa.array([chr(c) for c in new.tolist()], pa.string())], ["key", "pos", "original", "error"])

    return df.select(key, F.col(text).alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, pos long, original string, error string")


def dirty(df: DataFrame, key: str, text: str, kind: str, per_million: int, seed: int = 1234) -> DataFrame:
    """(key, text, injected): each text with these substitutions made, and how many they are."""
    of = _substituted(ALPHABETS[kind], per_million, seed)

    def run(batches):
        for batch in batches:
            texts, injected = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k is None or not t:
                    texts.append(t)
                    injected.append(0)
                    continue
                codes, at, new = of(k, t)
                codes = codes.copy()
                codes[at] = new
                texts.append(codes.tobytes().decode("utf-32-le"))
                injected.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(injected, pa.int64())], ["key", "text", "injected"])

    return df.select(key, F.col(text).alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string, injected long")


def error_sweep(df: DataFrame, key: str, text: str, per_million: int, kinds: tuple[str, ...] = tuple(ALPHABETS)) -> DataFrame:
    """(kind, injected, detected, ok): for each kind of error, how many were made in sequences of valid symbols, and how many a count finds."""
    rows = []
    for kind in kinds:
        made = dirty(df, key, text, kind, per_million)
        counted = symbol_counts(made, "text", (key, "injected"))
        rows.append(counted.agg(F.lit(kind).alias("kind"), F.coalesce(F.sum("injected"), F.lit(0)).alias("injected"), F.coalesce(F.sum("n_invalid"), F.lit(0)).alias("detected")))
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("injected") == F.col("detected"))


def mutations(df: DataFrame, key: str, text: str, n: int, seed: int = 1234) -> DataFrame:
    """(key, pos, original, changed): exactly ``n`` places of each text (all, if it has fewer), each base another one.

    The n smallest draws of a text's base positions; the new base is 1 to 3 further in ACGT.
    """
    place_of = np.full(128, -1, np.int64)
    place_of[[ord(c) for c in BASES + BASES.lower()]] = [0, 1, 2, 3] * 2

    def run(batches):
        for batch in batches:
            for row, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if k is None or not t:
                    continue
                codes = points(t)
                at = np.flatnonzero((codes < 128) & (place_of[np.minimum(codes, 127)] >= 0))
                draw = draws(_places(k, len(codes))[at], seed, 3)
                chosen = np.lexsort((at, draw))[:n]
                at, draw = at[chosen], draw[chosen]
                old = codes[at]
                new = (place_of[old] + draw % 3 + 1) % 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), row))), pa.array(at, pa.int64()), pa.array([chr(c) for c in old.tolist()], pa.string()), pa.array([BASES[c] for c in new.tolist()], pa.string())], ["key", "pos", "original", "changed"])

    return df.select(key, F.col(text).alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, pos long, original string, changed string")


#: A pattern that stands across every border of two units, so that a count that loses borders is wrong.
PLANTED = "GATTACA"
#: So many symbols are made at once.
PART = 1 << 18


def sequences(df: DataFrame, key: str, length: str, unit: int = 1024, seed: int = 1234) -> DataFrame:
    """(key, chunk, start, bases): made sequences of the lengths in ``df`` with known content, a unit of symbols a row.

    Bases are drawn by position; of twenty stretches of 256 symbols about one is unknown (N), two are lower case, and three are
    islands, mostly C and G in turn; the
    pattern PLANTED stands across every border of units inside a sequence, in upper case. Units are made PART symbols at once.
    """
    numbers = F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col(length) - 1) / unit).cast("long"))).otherwise(F.array().cast("array<long>"))
    each = df.select(F.col(key).alias("_key"), F.col(length).cast("long").alias("_n"), F.explode(numbers).alias("_chunk"))
    planted = np.frombuffer(PLANTED.encode(), np.uint8)
    letters = np.frombuffer(BASES.encode(), np.uint8)
    before, together = len(planted) // 2, max(1, PART // unit)
    edges = np.flatnonzero((np.arange(unit) + before) % unit < len(planted))  # of a unit, where the pattern can stand

    def made(keys, n, chunk):
        """Symbols of several units side by side, and the offsets of these."""
        first, shift = chunk * unit, shifts(keys)
        size = np.minimum(n, first + unit) - first
        offsets = np.append(0, np.cumsum(size))
        at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
        draw = draws(at + np.repeat(shift, size), seed, 4)
        codes = letters[draw & 3]
        low, many = first >> 8, ((first + size - 1) >> 8) - (first >> 8) + 1
        number = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        kind = (draws(number + np.repeat(shift, many), seed, 5) % 20).astype(np.uint8)
        here = np.minimum(np.repeat(first + size, many), number + 1 << 8) - np.maximum(np.repeat(first, many), number << 8)
        stretch = np.repeat(kind, here)
        island = np.flatnonzero(stretch >= 17)
        island = island[draw[island] % 5 > 0]
        codes[island] = np.where(at[island] & 1 == 0, np.uint8(ord("C")), np.uint8(ord("G")))
        codes += (stretch < 3) * np.uint8(32)
        codes[stretch == 0] = ord("N")
        row, column = np.nonzero(edges < size[:, None])
        at = first[row] + edges[column]
        place = (at + before) % unit
        held = (place < len(planted)) & (at + before >= unit) & (at - place + len(planted) <= n[row])
        codes[(offsets[row] + edges[column])[held]] = planted[place[held]]
        return codes, offsets

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, together):
                part = batch.slice(row, together)
                keys, n, chunk = (part.column(c).to_numpy().astype(np.int64) for c in range(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(chunk * unit, pa.int64()), texts_of(*made(keys, n, chunk))], ["key", "chunk", "start", "bases"])

    return each.where("_key is not null").mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, chunk long, start long, bases string")
