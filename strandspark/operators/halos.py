"""Patterns and windows of sequences in chunks, over the borders between them.

What lies inside a chunk is counted where the chunk is read. For what lies over a border only edges move: the last symbols of a
chunk and the first ones of those after it meet by an equi-join's shuffle on (key, chunk), so no chunk is copied and no sequence
is one task, however long. Chunks of a sequence are numbered from 0 without gaps and have ``size`` symbols, the last one fewer.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import folded
from .patterns import both_strands, counts_by_pattern, first_invalid, labelled, match_schema, matched, pattern_counts, window_schema, windowed, zoned
from .sequences import CHUNK


def borders(chunks: DataFrame, key: str, halo: int, size: int = CHUNK) -> DataFrame:
    """(key, at, last, next) of each chunk that something follows: its last ``halo`` symbols, at which place they begin, and as many as follow it.

    Chunks shorter than ``halo`` let later ones through: as many of them send their edges as a halo can reach.
    """
    if halo < 1:
        raise ValueError("a halo has at least one symbol")
    reach = -(-halo // size)
    bases, number = F.col("bases").cast("string"), F.col("chunk").cast("long")
    at = F.greatest(F.col("start"), F.col("start") + F.length(bases) - halo)
    own = F.struct(number.alias("chunk"), F.lit(0).alias("place"), at.alias("at"), F.substring(bases, -halo, halo).alias("part"))
    sent = [F.struct((number - d).alias("chunk"), F.lit(d).alias("place"), F.lit(None).cast("long").alias("at"), F.substring(bases, 1, halo).alias("part")) for d in range(1, reach + 1)]
    each = chunks.where(F.length(bases) > 0).select(F.col(key), F.explode(F.array(own, *sent)).alias("e")).select(key, "e.*").where("chunk >= 0")
    met = each.groupBy(key, "chunk").agg(F.max("at").alias("at"), F.max(F.when(F.col("place") == 0, F.col("part"))).alias("last"), F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "part")))).alias("_later"))
    unbroken = F.filter("_later", lambda p, k: p["place"] == k + 1)
    later = F.substring(F.array_join(F.transform(unbroken, lambda p: p["part"]), ""), 1, halo)
    return met.where(F.col("last").isNotNull() & (F.size("_later") > 0)).select(key, "at", "last", later.alias("next")).where(F.length("next") > 0)


def chunk_pattern_counts(chunks: DataFrame, key: str, patterns: list[str], size: int = CHUNK) -> DataFrame:
    """(key, pattern, strand, n) of sequences in chunks (key, chunk, start, bases): what ``pattern_counts`` gives for whole texts."""
    inside = pattern_counts(chunks, "bases", patterns, (key,))
    longest = max(map(len, patterns))
    if longest < 2:
        return inside
    sides = both_strands(patterns)
    slim = borders(chunks, key, longest - 1, size).select(key, F.concat("last", "next").cast("binary").alias("_raw"), F.octet_length("last").cast("long").alias("_border"))
    over = counts_by_pattern(slim.mapInArrow(matched([q for _, _, q in sides], 1, border=True), match_schema(slim, (key,), len(sides))), sides, (key,))
    return inside.unionByName(over).groupBy(key, "pattern", "strand").agg(F.sum("n").alias("n"))


def _located(pattern: str, k: int):
    def run(batches):
        for batch in batches:
            rows, places = [], []
            for row, (text, first, border) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                begin = 0 if border is None else max(0, border - len(pattern) + 1)
                end = len(text) if border is None else border + len(pattern) - 1
                at, found = text.find(pattern, begin, end), 0
                while at >= 0 and found < k:
                    rows.append(row)
                    places.append(first + at)
                    at, found = text.find(pattern, at + 1, end), found + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], [batch.schema.names[0], "pos"])

    return run


def _first(found: DataFrame, key: str, k: int) -> DataFrame:
    """The first ``k`` places of each key; Spark keeps k of a key before the shuffle."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= k).drop("_n")


def chunk_pattern_positions(chunks: DataFrame, key: str, pattern: str, k: int, size: int = CHUNK) -> DataFrame:
    """(key, pos): the first ``k`` places of a pattern without N in each sequence; at most k of a chunk and of a border leave it."""
    schema = f"`{key}` {chunks.schema[key].dataType.simpleString()}, pos long"
    none = F.lit(None).cast("long").alias("_border")
    rows = chunks.select(key, folded(F.col("bases").cast("string")).alias("_t"), F.col("start").cast("long").alias("_first"), none).where(F.col("_t").contains(pattern))
    if len(pattern) > 1:
        edge = borders(chunks, key, len(pattern) - 1, size).select(key, folded(F.concat("last", "next")).alias("_t"), F.col("at").alias("_first"), F.length("last").cast("long").alias("_border"))
        rows = rows.unionByName(edge.where(F.col("_t").contains(pattern)))
    return _first(rows.mapInArrow(_located(pattern, k), schema), key, k)


def _window_rows(chunks: DataFrame, key: str, width: int, size: int) -> DataFrame:
    """(key, text, first, border): chunks, and edges around borders."""
    rows = chunks.select(key, F.col("bases").cast("string").alias("_t"), F.col("start").cast("long").alias("first"), F.lit(None).cast("long").alias("border"))
    if width > 1:
        edge = borders(chunks, key, width - 1, size).select(key, F.concat("last", "next").alias("_t"), F.col("at").alias("first"), F.length("last").cast("long").alias("border"))
        rows = rows.unionByName(edge)
    return rows


def chunk_windows(chunks: DataFrame, key: str, width: int, step: int, size: int = CHUNK) -> DataFrame:
    """What ``windows`` gives for whole texts, of sequences in chunks: windows inside a chunk, and those over borders."""
    return labelled(_window_rows(chunks, key, width, size).mapInArrow(windowed(width, step), window_schema(chunks, key)), width)


def chunk_zone_density(chunks: DataFrame, key: str, width: int, step: int, size: int = CHUNK) -> DataFrame:
    """(key, evaluated, not_evaluable, zones) of the windows of each sequence in chunks: no window leaves its chunk, only counts do."""
    schema = f"`{key}` {chunks.schema[key].dataType.simpleString()}, evaluated long, not_evaluable long, zones long"
    counted = _window_rows(chunks, key, width, size).mapInArrow(zoned(width, step), schema)
    return counted.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("evaluated", "not_evaluable", "zones")))


def chunk_first_invalid(chunks: DataFrame, key: str, k: int) -> DataFrame:
    """(key, pos, symbol): the first ``k`` invalid symbols of each sequence in chunks, by place in the sequence."""
    own = chunks.select(F.struct(F.col(key).alias("key"), F.col("start").cast("long").alias("start")).alias("_place"), F.col("bases").cast("string").alias("bases"))
    found = first_invalid(own, "_place", "bases", k)
    return _first(found.select(F.col("_place.key").alias(key), (F.col("pos") + F.col("_place.start")).alias("pos"), "symbol"), key, k)
