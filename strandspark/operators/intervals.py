"""Work logs: intervals of platforms and workers, their unions, overlaps, speeds and idle times."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(df: DataFrame, order: str, rows_each: int = 100_000) -> tuple[DataFrame, bool]:
    """``df`` with ``_b``, the range of ``order`` that a row is in, ascending, and whether there are several.

    Windows over a group and a range stand in for those over a whole group, which may be a third of all rows; what a range
    must know of those before it follows from one row for each. Ranges are parted at quantiles of ``order``, from a sketch
    that tasks make and merge, so a burst of values is parted like any other; rows of one value stay together. Counts the
    rows, and for several ranges makes the sketch, when it is called.
    """
    many = max(1, -(-df.count() // rows_each))
    if many == 1:
        return df.withColumn("_b", F.lit(0)), False
    shares = [k / many for k in range(1, many)]
    parted = np.unique(df.agg(F.percentile_approx(F.col(order).cast("double"), shares, 20 * many).alias("q")).first()["q"] or [])

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(parted, values.to_numpy(np.float64), "left")).astype("int32")

    return df.withColumn("_b", place(F.col(order).cast("double"))), True


def met(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what is known of their ``keys``; a null key is a key like all others."""
    other = known.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in known.columns if c not in keys))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return rows.join(other, same).drop(*(f"_k_{k}" for k in keys))


def previous(df: DataFrame, by: list[str], order: list[str], values: list[str], rows_each: int = 100_000) -> DataFrame:
    """``df`` with ``_p_<value>`` of each of ``values``: what it is in the row before in the group's order; null for the first."""
    ranged, several = in_ranges(df, order[0], rows_each)
    if not several:
        whole = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", *(F.lag(v).over(whole).alias(f"_p_{v}") for v in values))
    own = Window.partitionBy(*by, "_b").orderBy(*order)
    last = ranged.groupBy(*by, "_b").agg(F.max(F.struct(*order, *(F.col(v).alias(f"_v_{v}") for v in values))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_b")
    last = last.select(*by, "_b", F.lag("_last").over(before).alias("_last"))
    seen = ranged.select("*", F.row_number().over(own).alias("_n"), *(F.lag(v).over(own).alias(f"_l_{v}") for v in values))
    joined = met(seen, last, [*by, "_b"])
    return joined.select(*df.columns, *(F.when(F.col("_n") > 1, F.col(f"_l_{v}")).otherwise(F.col(f"_last._v_{v}")).alias(f"_p_{v}") for v in values))


def _islands(rows: DataFrame, by: list[str], reached: Column | None) -> DataFrame:
    """(*by, _i, start, end, _fresh): intervals merged inside a window of ``by``; ``reached`` is what those before the window reach."""
    own = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    before = before if reached is None else F.greatest(before, reached)
    fresh = rows.withColumn("_fresh", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    island = fresh.withColumn("_i", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_fresh").alias("_fresh"))


def union(log: DataFrame, by: list[str], rows_each: int = 100_000) -> DataFrame:
    """(*by, start, end): touching and overlapping intervals of a group merged into one.

    Inside ranges of starts first; a range knows by one row what those before it reach, and how many unions began there.
    """
    ranged, several = in_ranges(log.select(*by, "start", "end").where("start is not null and end is not null"), "start", rows_each)
    if not several:
        return _islands(ranged, by, None).select(*by, "start", "end")
    reach = ranged.groupBy(*by, "_b").agg(F.max("end").alias("_r"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(*by, "_b", F.max("_r").over(earlier).alias("_r"))
    parts = _islands(met(ranged, reach, [*by, "_b"]), [*by, "_b"], F.col("_r"))
    begun = parts.groupBy(*by, "_b").agg(F.sum("_fresh").alias("_f")).select(*by, "_b", F.coalesce(F.sum("_f").over(earlier), F.lit(0)).alias("_f"))
    return met(parts, begun, [*by, "_b"]).groupBy(*by, (F.col("_f") + F.col("_i")).alias("_island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def overlap(a: DataFrame, b: DataFrame, by: list[str], width: int) -> DataFrame:
    """(*by, overlap): how long both of two sets of disjoint intervals run. Both meet in buckets of ``width`` time units.

    An interval is cut at bucket borders, so pieces in one bucket meet by an equi-join and nothing counts twice.
    """
    both = _cut(a, by, width).join(_cut(b, by, width).select(*by, "_bucket", F.col("start").alias("_s"), F.col("end").alias("_e")), [*by, "_bucket"])
    common = F.least("end", "_e") - F.greatest("start", "_s")
    return both.where(common > 0).groupBy(*by).agg(F.sum(common).cast("long").alias("overlap"))


def _cut(log: DataFrame, by: list[str], width: int) -> DataFrame:
    buckets = F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))
    cut = log.select(*by, "start", "end", F.explode(buckets).alias("_bucket"))
    return cut.select(*by, "_bucket", F.greatest("start", F.col("_bucket") * width).alias("start"), F.least("end", (F.col("_bucket") + 1) * width).alias("end"))


def next_ration(units: Column, seconds: Column, target: float = 0.25, least: int = 1, most: int = 32) -> Column:
    """How many units a worker should get next to be busy for ``target`` seconds."""
    return F.when(seconds > 0, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(units / seconds * target).cast("int")))).otherwise(F.lit(least))


def rations(log: DataFrame, by: list[str], order: list[str], units: str, seconds: str, target: float = 0.25) -> DataFrame:
    """``log`` with ``ration``: what each step should have got, from the speed of the step before; 1 at first."""
    known = previous(log, by, order, [units, seconds])
    return known.withColumn("ration", F.coalesce(next_ration(F.col(f"_p_{units}"), F.col(f"_p_{seconds}"), target), F.lit(1))).select(*log.columns, "ration")


def smoothed(log: DataFrame, by: list[str], order: list[str], value: str, weight: float, rows_each: int = 100_000) -> DataFrame:
    """(*by, ema): the exponential mean of ``value`` in order, the last one having ``weight``.

    A value counts by its place from the end, weight * (1 - weight) ** place, the first one by (1 - weight) ** place alone.
    So the mean is a sum, and places add up over ranges.
    """
    ranged, _ = in_ranges(log, order[0], rows_each)
    sizes = ranged.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    later = Window.partitionBy(*by).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("_after"), F.sum("_c").over(Window.partitionBy(*by)).alias("_all"))
    own = Window.partitionBy(*by, "_b").orderBy(*(F.col(c).desc() for c in order))
    placed = met(ranged.withColumn("_n", F.row_number().over(own)), sizes, [*by, "_b"]).withColumn("_place", F.col("_after") + F.col("_n") - 1)
    share = F.pow(F.lit(1 - weight), F.col("_place")) * F.when(F.col("_place") == F.col("_all") - 1, 1.0).otherwise(weight)
    return placed.groupBy(*by).agg(F.sum(share * F.col(value)).alias("ema"))


def idle_at_end(log: DataFrame, worker: str) -> DataFrame:
    """(worker, idle): from a worker's last end to the end of all work."""
    last = log.groupBy(worker).agg(F.max("end").alias("_last"))
    everything = log.agg(F.max("end").alias("_all"))
    return last.join(F.broadcast(everything)).select(worker, (F.col("_all") - F.col("_last")).alias("idle"))  # one row


def shared_out(workers: DataFrame, pending: float) -> DataFrame:
    """(…, part): pending work in proportion to speed."""
    whole = workers.agg(F.sum("speed").alias("_all"))
    return workers.join(F.broadcast(whole)).withColumn("part", F.round(pending * F.col("speed") / F.col("_all"), 6)).drop("_all")  # one row


def by_start(log: DataFrame, worker: str) -> DataFrame:
    """``log`` in the order in which work began: ranges of starts are sorted side by side."""
    return log.orderBy("start", "end", worker)
