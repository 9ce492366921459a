"""Patterns on both strands, and windows of a sequence with their composition."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import AMBIGUOUS, BASES, UNKNOWN, either, folded
from ..sources.folders import shared
from .arrays import points, rows_of_bytes


def complement(pattern: str) -> str:
    return pattern.translate(str.maketrans("ACGT", "TGCA"))[::-1]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[97:123] -= 32


def matched(patterns: list[str], keys: int, border: bool = False):
    """How often each of ``patterns`` is in each text: letters are compared once, matches are shifted conjunctions of that.

    ``border``: the column after the text says how many of its bytes stand before a border; only matches over it count.
    """

    def run(batches):
        for batch in batches:
            edges = batch.column(keys + 1).to_numpy(zero_copy_only=False) if border else None
            for row, end, raw, offsets in rows_of_bytes(batch.column(keys)):
                folded_bytes = _FOLD[raw]
                equal = {c: folded_bytes == ord(c) for c in set("".join(patterns)) | set("ACGT")}
                equal["N"] = equal["A"] | equal["C"] | equal["G"] | equal["T"]
                counts = []
                for p in patterns:
                    m = max(0, len(raw) - len(p) + 1)
                    held = np.ones(m, bool)
                    for k, c in enumerate(p):
                        held &= equal[c][k : k + m]
                    at = np.flatnonzero(held)
                    owner = np.searchsorted(offsets, at, "right") - 1
                    inside = at + len(p) <= offsets[owner + 1]
                    if border:
                        edge = offsets[owner] + edges[row + owner]
                        inside &= (at < edge) & (at + len(p) > edge)
                    counts.append(np.bincount(owner[inside], minlength=end - row))
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns[:keys], *(pa.array(c, pa.int64()) for c in counts)], [*batch.schema.names[:keys], *(f"m{k}" for k in range(len(patterns)))])

    return run


def pattern_counts(df: DataFrame, text: str, patterns: list[str], by: tuple[str, ...]) -> DataFrame:
    """(*by, pattern, strand, n): overlapping matches, case folded, N for any base, on the strand and its complement.

    A palindrome counts on both. One pass over the bytes of the texts; only counts are shuffled.
    """
    sides = both_strands(patterns)
    slim = df.select(*by, F.col(text).cast("binary").alias("_raw"))
    return counts_by_pattern(slim.mapInArrow(matched([q for _, _, q in sides], len(by)), match_schema(slim, by, len(sides))), sides, by)


def both_strands(patterns: list[str]) -> list[tuple[str, str, str]]:
    """(pattern, strand, what is looked for there)."""
    return [(p, strand, q) for p in patterns for strand, q in (("+", p), ("-", complement(p)))]


def match_schema(df: DataFrame, by: tuple[str, ...], many: int) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by] + [f"m{k} long" for k in range(many)])


def counts_by_pattern(found: DataFrame, sides: list[tuple[str, str, str]], by: tuple[str, ...]) -> DataFrame:
    """(*by, pattern, strand, n) from rows (*by, m0, m1, ...) of counts."""
    wide = found.groupBy(*by).agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(len(sides))))
    rows = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("strand"), F.coalesce(F.col(f"m{k}"), F.lit(0)).alias("n")) for k, (p, s, _) in enumerate(sides)))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.pattern", "r.strand", "r.n")


def pattern_totals(counts: DataFrame, by: str) -> DataFrame:
    """Totals over records, strands and patterns in one pass; null stands for all."""
    return counts.rollup("pattern", "strand", by).agg(F.sum("n").alias("n"))


def pattern_positions(df: DataFrame, key: str, text: str, pattern: str, k: int) -> DataFrame:
    """(key, pos): the first ``k`` positions (from 0) of a pattern without N in each text, overlapping ones too."""
    t = folded(F.col(text))

    def run(batches):
        for batch in batches:
            rows, places = [], []
            for row, whole in enumerate(batch.column(1).to_pylist()):
                at, found = whole.find(pattern), 0
                while at >= 0 and found < k:
                    rows.append(row)
                    places.append(at)
                    at, found = whole.find(pattern, at + 1), found + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], [batch.schema.names[0], "pos"])

    return df.where(t.contains(pattern)).select(key, t.alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, pos long")


def window_sums(codes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_c, n_g, n_cg, evaluable) of the windows of ``width`` code points at ``starts``: differences of running sums."""
    is_c, is_g = (codes == 67) | (codes == 99), (codes == 71) | (codes == 103)
    base = is_c | is_g | (codes == 65) | (codes == 97) | (codes == 84) | (codes == 116)
    total = lambda x, n=width: (c := np.append(np.int64(0), np.cumsum(x)))[starts + n] - c[starts]
    return total(is_c), total(is_g), total(np.append(is_c[:-1] & is_g[1:], False), width - 1), total(base) == width


def window_starts(length: np.ndarray, first: np.ndarray, border: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows of texts that are at ``first`` of their sequences: at multiples of ``step``; with a border (else -1) only those over it."""
    low = np.where(border < 0, 0, np.maximum(0, border - width + 1))
    high = np.where(border < 0, length - width + 1, np.minimum(border, length - width + 1))
    begin = low + -(first + low) % step
    many = np.maximum(0, -(-(high - begin) // step))
    row = np.repeat(np.arange(len(many)), many)
    return row, begin[row] + step * (np.arange(len(row)) - (np.cumsum(many) - many)[row])


def _window_parts(batch: pa.RecordBatch, width: int, step: int):
    """For parts of a batch (key, text, first, border): its first and end row, and (row, start, n_c, n_g, n_cg, evaluable) of all windows there.

    Texts of a part, some hundred KB, stand side by side, so that their windows are summed at once.
    """
    first = batch.column(2).to_numpy(zero_copy_only=False)
    border = batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
    for row, end, codes, offsets in rows_of_bytes(batch.column(1), 1 << 18):
        if (codes >= 128).any():
            codes = points(codes.tobytes().decode("utf-8", "surrogatepass"))
            offsets = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1).slice(row, end - row)), 0).to_numpy(zero_copy_only=False)))
        own, starts = window_starts(np.diff(offsets), first[row:end], border[row:end], width, step)
        if len(own):
            yield row, end, (own, starts + first[row:end][own], *window_sums(codes, offsets[own] + starts, width))


def windowed(width: int, step: int):
    """Windows of rows (key, text, first, border): starts are multiples of ``step``, ``first`` is the place of the text's first symbol.

    With a border, how many of a text's symbols stand before it, only windows over it count; null: all.
    """

    def run(batches):
        for batch in batches:
            for row, end, (own, starts, *counts, evaluable) in _window_parts(batch, width, step):
                arrays = [batch.column(0).slice(row, end - row).take(pa.array(own)), *(pa.array(x, pa.int64()) for x in (starts, *counts)), pa.array(evaluable, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[0], "start", "n_c", "n_g", "n_cg", "evaluable"])

    return run


def windows(df: DataFrame, key: str, text: str, width: int, step: int) -> DataFrame:
    """(key, start, n_c, n_g, n_cg, gc, obs_exp, evaluable, label) of windows of ``width`` symbols every ``step``.

    A window with anything but bases isn't evaluable. It is a zone if more than half of it is C or G and the pair CG is more
    than 0.6 times as frequent as C and G would make it by chance. Texts shorter than a window have none. Sums of windows are
    differences of running sums over the text.
    """
    slim = df.select(key, F.col(text).cast("string").alias("_t"), F.expr("0L").alias("first"), F.lit(None).cast("long").alias("border"))
    return labelled(slim.mapInArrow(windowed(width, step), window_schema(df, key)), width)


def zoned(width: int, step: int):
    """(key, evaluated, not_evaluable, zones) of rows (key, text, first, border), by the rule of ``labelled``, counted in the row."""

    def run(batches):
        for batch in batches:
            for row, end, (own, _, n_c, n_g, n_cg, evaluable) in _window_parts(batch, width, step):
                both = np.maximum(n_c * n_g, 1)
                zone = evaluable & (np.round((n_c + n_g) / width, 6) > 0.5) & (n_c > 0) & (n_g > 0) & (np.round(n_cg * width / both, 6) > 0.6)
                counts = [np.bincount(own[x], minlength=end - row) for x in (evaluable, ~evaluable, zone)]
                some = np.unique(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row).take(pa.array(some)), *(pa.array(c[some], pa.int64()) for c in counts)], [batch.schema.names[0], "evaluated", "not_evaluable", "zones"])

    return run


def window_schema(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, start long, n_c long, n_g long, n_cg long, evaluable boolean"


def labelled(counted: DataFrame, width: int) -> DataFrame:
    """Windows (key, start, n_c, n_g, n_cg, evaluable) with gc, obs_exp and label."""
    gc = F.round((F.col("n_c") + F.col("n_g")) / width, 6)
    ratio = F.when((F.col("n_c") > 0) & (F.col("n_g") > 0), F.round(F.col("n_cg") * width / (F.col("n_c") * F.col("n_g")), 6)).otherwise(0.0)
    out = counted.withColumn("gc", gc).withColumn("obs_exp", ratio)
    return out.withColumn("label", F.when(~F.col("evaluable"), "not_evaluable").when((F.col("gc") > 0.5) & (F.col("obs_exp") > 0.6), "zone").otherwise("background"))


#: What a window's label and features follow from.
COMPOSITION = ["n_c", "n_g", "n_cg", "evaluable"]


def census(windows: DataFrame, width: int) -> DataFrame:
    """(n_c, n_g, n_cg, evaluable, n, gc, obs_exp, label): how many of all windows have each composition. Written when it is called.

    There are at most 2 * (width + 1) ** 3 compositions, however many windows; labels and predictions are made once for each.
    """
    path = f"{shared(windows.sparkSession)}/census-{uuid.uuid4().hex}"
    labelled(windows.groupBy(*COMPOSITION).agg(F.count("*").alias("n")), width).write.parquet(path)
    return windows.sparkSession.read.parquet(path)


def _featured(windows: DataFrame, width: int) -> DataFrame:
    """Windows that are evaluable with truth and features."""
    seen = windows.where("evaluable").withColumn("truth", (F.col("label") == "zone").cast("double"))
    return seen.select("*", *((F.col(c) / width).alias(f"_{c}") for c in ("n_c", "n_g", "n_cg")), (F.col("n_c") * F.col("n_g") / (width * width)).alias("_product"))


def _assembled(seen: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen)


def fitted(windows: DataFrame, width: int, sample: int = 20_000, rounds: int = 100, known: DataFrame | None = None):
    """(ready, net, labels, chosen): evaluable windows with features and truth, a small dense network trained on ``chosen``, and the labels seen there.

    It learns from at most ``sample`` windows, half of them zones where there are so many, those with the smallest hashes of
    key and start. Without both labels there is no network. Trains when it is called; goes over all windows once, or twice
    where their census isn't ``known``: from how many have a label follows under which hash the smallest are, and few are sorted.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    key, half = windows.columns[0], sample // 2
    seen = _featured(windows, width)
    known = census(windows, width) if known is None else known
    totals = {r["truth"]: r["n"] for r in _featured(known, width).groupBy("truth").agg(F.sum("n").alias("n")).collect()}
    place = F.xxhash64(key, "start")

    def kept(bounds: dict[float, int | None]) -> DataFrame:
        some = seen if None in bounds.values() else seen.where(place < max(bounds.values(), default=0))
        under = reduce(or_, ((F.col("truth") == t) & (F.lit(True) if b is None else place < b) for t, b in bounds.items()), F.lit(False))
        path = f"{shared(windows.sparkSession)}/windows-{uuid.uuid4().hex}"
        some.where(under).select("truth", *FEATURES, key, "start").write.parquet(path)
        return windows.sparkSession.read.parquet(path)

    # Twice as many as are asked for, so that chance leaves enough.
    near = {t: None if n <= 2 * half + 1000 else -(1 << 63) + (2 * half + 1000) * (1 << 64) // n for t, n in totals.items()}
    few = kept(near)
    got = {r["truth"]: r["n"] for r in few.groupBy("truth").agg(F.count("*").alias("n")).collect()}
    if any(got.get(t, 0) < min(half, n) for t, n in totals.items()):  # hashes of repeated keys lie together
        few = kept(dict.fromkeys(totals))
    halves = [few.where(F.col("truth") == t).orderBy(place, key, "start").limit(half) for t in (0.0, 1.0)]
    # Written once: training goes over the chosen ones many times.
    path = f"{shared(windows.sparkSession)}/windows-{uuid.uuid4().hex}"
    _assembled(halves[0].unionByName(halves[1])).select("features", "truth", *FEATURES).write.parquet(path)
    chosen = windows.sparkSession.read.parquet(path)
    ready, labels = _assembled(seen), sorted(totals)
    if len(labels) < 2:
        return ready, None, labels, chosen
    return ready, MultilayerPerceptronClassifier(layers=[4, 8, 2], labelCol="truth", seed=1, maxIter=rounds).fit(chosen), labels, chosen


#: What the network sees of a window.
FEATURES = ["_n_c", "_n_g", "_n_cg", "_product"]


def classified(windows: DataFrame, width: int, sample: int = 20_000, rounds: int = 100) -> DataFrame:
    """``windows`` that are evaluable with ``predicted``: what a small dense network says that learned the rule's labels from counts alone.

    Predictions are made by generated code. Without both labels the most frequent one is predicted.
    """
    ready, net, labels, _ = fitted(windows, width, sample, rounds)
    return _predicted(ready, net, labels).select(*windows.columns, "predicted")


def _predicted(ready: DataFrame, net, labels: list[float]) -> DataFrame:
    if net is None:
        return ready.withColumn("predicted", F.lit("zone" if labels == [1.0] else "background"))
    return net.transform(ready).withColumn("predicted", F.when(F.col("prediction") > 0.5, "zone").otherwise("background"))


def classified_census(windows: DataFrame, width: int, sample: int = 20_000, rounds: int = 100) -> DataFrame:
    """What ``classified`` says of all windows, as (n_c, n_g, n_cg, label, predicted, n): each composition is decided once."""
    known = census(windows, width)
    _, net, labels, _ = fitted(windows, width, sample, rounds, known)
    return _predicted(_assembled(_featured(known, width)), net, labels).select("n_c", "n_g", "n_cg", "label", "predicted", "n")


def first_zones(windows: DataFrame, key: str, k: int) -> DataFrame:
    """The first ``k`` zones of each record, by place; Spark keeps k of a record before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return windows.where("label = 'zone'").withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def first_invalid(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, pos, symbol): the first ``k`` invalid symbols of each text, positions from 0 in characters."""
    valid = np.zeros(128, bool)
    valid[[10, 13, *(ord(c) for c in either(BASES + UNKNOWN + AMBIGUOUS))]] = True

    def run(batches):
        for batch in batches:
            rows, places, found = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                codes = points(t)
                at = np.flatnonzero((codes >= 128) | ~valid[np.minimum(codes, 127)])[:k]
                rows.append(np.full(len(at), row))
                places.append(at)
                found += map(chr, codes[at].tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places), pa.int64()), pa.array(found, pa.string())], ["key", "pos", "symbol"])

    return df.select(key, F.col(text).alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, pos long, symbol string")


def zone_density(windows: DataFrame, key: str) -> DataFrame:
    """(key, evaluated, not_evaluable, zones) of each record."""
    return windows.groupBy(key).agg(F.count_if("evaluable").alias("evaluated"), F.count_if(~F.col("evaluable")).alias("not_evaluable"), F.count_if(F.col("label") == "zone").alias("zones"))
