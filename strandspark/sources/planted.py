"""Planted sequence files: made records of known content, written in each variant that readers must take alike.

Content follows from the record's key and the position alone, so answers are counted from it without any file. Every file has
traps: headers with bases and with the planted pattern, the pattern across borders of units (it counts) and of records (it
doesn't), unknown stretches, lower case, single ambiguous and invalid symbols, records shorter than a line.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.composition import COUNTED, symbol_counts
from ..operators.arrays import rows_of_bytes
from ..operators.generators import PART, PLANTED, draws, sequences, shifts, texts_of
from ..operators.halos import chunk_pattern_counts
from .folders import opened, qualified

# What part of a group's symbols each of its records has, in hundredths.
SHARES = (42, 27, 16, 10, 5)
#: Symbols a line (None: all in one), line end, whether records stand in descending order.
VARIANTS: dict[str, tuple[int | None, str, bool]] = {"plain": (80, "\n", False), "crlf": (80, "\r\n", False), "unwrapped": (None, "\n", False), "reordered": (80, "\n", True)}
UNIT = 1024
#: One in so many symbols is ambiguous, one invalid.
ODD = 2000


def weighted(df: DataFrame, key: str, total: str, least: int = 7) -> DataFrame:
    """(key, length): for each row a group of records with the shares of ``total`` symbols, ``least`` at least; keys are consecutive.

    Rows without a key or a total give none.
    """
    shares = F.posexplode(F.array(*map(F.lit, SHARES))).alias("_at", "_share")
    each = df.select(F.col(key).cast("long").alias("_key"), F.col(total).cast("long").alias("_total"), shares).where("_key is not null and _total is not null")
    return each.select((F.col("_key") * len(SHARES) + F.col("_at")).alias("key"), F.greatest(F.lit(least), F.floor(F.col("_total") * F.col("_share") / 100)).cast("long").alias("length"))


def content(records: DataFrame, unit: int = UNIT, seed: int = 1234) -> DataFrame:
    """(key, chunk, start, bases) of records (key, length), in the order in which these stand: nothing is shuffled.

    A record begins with the pattern's last four symbols and ends with its first three (if its last unit isn't a full one).
    """
    pattern = np.frombuffer(PLANTED.encode(), np.uint8)
    tail, head = pattern[: len(PLANTED) // 2], pattern[len(PLANTED) // 2 :]

    def run(batches):
        for batch in batches:
            for row, end, raw, offsets in rows_of_bytes(batch.column(3), PART):
                part, codes, size = batch.slice(row, end - row), raw.copy(), np.diff(offsets)
                start = part.column(2).to_numpy()
                place = np.arange(len(codes)) + np.repeat(start - offsets[:-1] + shifts(part.column(0).to_numpy()), size)
                draw = draws(place, seed, 6).astype(np.uint32)
                odd = draw - draw // np.uint32(ODD) * np.uint32(ODD)
                codes[odd == 0], codes[odd == 1] = ord("R"), ord("*")
                for k in np.flatnonzero(start == 0).tolist():
                    codes[offsets[k] : offsets[k + 1]][: len(head)] = head[: size[k]]
                for k in np.flatnonzero(size < unit).tolist():
                    n = min(len(tail), size[k])
                    codes[offsets[k + 1] - n : offsets[k + 1]] = tail[len(tail) - n :]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], texts_of(codes, offsets)], ["key", "chunk", "start", "bases"])

    return sequences(records, "key", "length", unit, seed).mapInArrow(run, "key long, chunk long, start long, bases string")


def answers(chunks: DataFrame, key: str = "key", unit: int = UNIT) -> DataFrame:
    """(n_records, n_a, ..., n_invalid, planted): what a reader of these records (key, chunk, start, bases) must find, one row."""
    counts = symbol_counts(chunks, "bases", ("chunk",)).agg(F.count_if(F.col("chunk") == 0).alias("n_records"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED))
    found = chunk_pattern_counts(chunks, key, [PLANTED], unit).where("strand = '+'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("planted"))
    return counts.join(F.broadcast(found))  # one row each


def _lines(width: int | None, end: bytes):
    """Bytes of a record's units as lines; what doesn't fill a line waits for the next unit, never more than a line."""
    filled = 0

    def wrapped(bases: bytes) -> bytes:
        nonlocal filled
        if width is None:
            return bases
        first = (width - filled) % width if filled else width
        parts = [bases[:first], *(bases[k : k + width] for k in range(first, len(bases), width))]
        filled = (filled + len(bases)) % width
        return end.join(p for p in parts if p) + (end if bases and filled == 0 else b"")

    return wrapped


def written(records: DataFrame, path: str, variant: str = "plain", file_symbols: int = 64 << 20, unit: int = UNIT, seed: int = 1234) -> int:
    """Writes records (key, length) as files of about ``file_symbols`` symbols each to ``path``, and returns how many files.

    Only keys and lengths are shuffled: a file's task makes its records unit by unit and holds one of them. Groups of consecutive
    keys stay in a file; a record longer than ``file_symbols`` makes a longer file. Names depend on the data alone; a task that
    runs again leaves the file as it is. Records without a key or of no length are left out.
    """
    width, line_end, backwards = VARIANTS[variant]
    folder = qualified(records.sparkSession, path)
    target, base = opened(folder)
    target.create_dir(base, recursive=True)
    known = records.where("key is not null and length > 0")
    files = max(1, -(-(known.agg(F.sum("length")).first()[0] or 0) // file_symbols))
    file = F.pmod(F.floor(F.col("key") / len(SHARES)), F.lit(files)).cast("int")
    dealt = known.repartitionById(files, file).sortWithinPartitions(F.col("key").desc() if backwards else F.col("key").asc())
    end = line_end.encode()

    def run(batches):
        source, base = opened(folder)
        name, temporary = f"{base}/made-{TaskContext.get().partitionId():06d}.fna", f"{base}/.{uuid.uuid4().hex}"
        out, last, wrapped, open_line = None, None, None, False
        for batch in batches:
            for key, bases in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out = out or source.open_output_stream(temporary)
                if key != last:
                    text = f">made{key} chromosome {key % len(SHARES) + 1}, {PLANTED} tacit catalogue of {PLANTED.lower()}"
                    out.write((end if open_line else b"") + text.encode() + end)
                    last, wrapped = key, _lines(width, end)
                text = wrapped(bases.encode())
                out.write(text)
                open_line = not text.endswith(end)
        if out is not None:
            if open_line:
                out.write(end)
            out.close()
            if source.get_file_info(name).is_file:
                source.delete_file(temporary)
            else:
                source.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return content(dealt, unit, seed).mapInArrow(run, "file string").count()
