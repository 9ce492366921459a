"""Runs and samples: speedups, best and median times, agreement, resources, energy, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import met, previous


def speedups(runs: DataFrame, by: list[str], label: str, time: str, base: str, workers: str | None = None) -> DataFrame:
    """``runs`` with speedup over the run labelled ``base`` of the group (else its first by label), and efficiency."""
    own = Window.partitionBy(*by)
    first = F.first(time).over(own.orderBy(label).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    reference = F.coalesce(F.max(F.when(F.col(label) == base, F.col(time))).over(own), first)
    out = runs.withColumn("speedup", F.when(F.col(time) > 0, F.round(reference / F.col(time), 6)))
    return out if workers is None else out.withColumn("efficiency_pct", F.round(100 * F.col("speedup") / F.col(workers), 4))


def best(runs: DataFrame, by: list[str], label: str, time: str) -> DataFrame:
    """(*by, best, time): the fastest configuration, the first by label among equals."""
    least = F.min(F.struct(time, label)).alias("_m")
    return runs.groupBy(*by).agg(least).select(*by, F.col(f"_m.{label}").alias("best"), F.col(f"_m.{time}").alias(time))


def median_of_repeats(runs: DataFrame, by: list[str], order: str, time: str, accuracy: int = 10_000) -> DataFrame:
    """(*by, median): the upper median of a group's times without the first run, which warms up.

    A sketch that tasks make and merge tells two times between which the median lies, about six in ``accuracy`` of a group's
    rows apart. What is below is counted, and only what lies between is put in order: the median is exact, whatever the sketch's
    error, and no group is one array or one window.
    """
    sides = [0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    first = runs.groupBy(*by).agg(F.min_by(time, order).alias("_first"), F.count(time).alias("_all"), F.percentile_approx(time, sides, accuracy).alias("_q"), F.min(time).alias("_least"), F.max(time).alias("_most"))
    # Few runs: all lie between.
    few = F.col("_all") < 2 * accuracy
    bounds = first.select(*by, "_first", "_all", F.when(few, F.col("_least")).otherwise(F.col("_q")[0]).alias("_low"), F.when(few, F.col("_most")).otherwise(F.col("_q")[1]).alias("_high"))
    kept = met(runs.where(F.col(time).isNotNull()), bounds, by).withColumn("_t", F.col(time))
    # Times that lie below become one row of a group, each time between one row.
    place = F.when(F.col("_t") >= F.col("_low"), F.col("_t"))
    counted = kept.where(F.col("_t") <= F.col("_high")).groupBy(*by, place.alias("_t")).agg(F.count("*").alias("_c"), F.max("_first").alias("_first"), F.max("_all").alias("_all"), F.max("_low").alias("_low"))
    warm = F.when(F.col("_t").isNull(), F.col("_first") < F.col("_low")).otherwise(F.col("_t") == F.col("_first"))
    counted = counted.withColumn("_c", F.col("_c") - F.when(F.coalesce(warm, F.lit(False)), 1).otherwise(0))
    reached = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_to", reached)
    middle = F.floor((F.col("_all") - 1) / 2)
    return placed.where((F.col("_all") > 1) & (middle < F.col("_to")) & (middle >= F.col("_to") - F.col("_c"))).select(*by, F.col("_t").alias("median"))


def agreement(results: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """(*by, same, dissenters): whether all configurations agree with the first by label, and which don't.

    A group is the few configurations of one measurement: their names are one text.
    """
    reference = results.groupBy(*by).agg(F.min(F.struct(label, value)).alias("_r")).select(*by, F.col(f"_r.{value}").alias("_r"))
    seen = results.join(reference, by).withColumn("_other", ~F.col(value).eqNullSafe(F.col("_r")))
    return seen.groupBy(*by).agg((F.count_if("_other") == 0).alias("same"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_other"), F.col(label).cast("string")))), ",").alias("dissenters"))


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): one row that is the same for the same rows in any order and any partitioning; floats count to six digits.

    Column names don't matter, their order does; repeated rows count as often as they stand.
    """
    columns = [F.round(f"`{f.name}`", 6) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema]
    own = F.xxhash64(F.to_json(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))), {"ignoreNullFields": "false"}))
    sums = F.coalesce(F.bit_xor(own), F.lit(0)), F.coalesce(F.sum(F.shiftright(own, 16)), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.xxhash64(*sums).alias("digest"))


def consolidated(totals: DataFrame, found: DataFrame, key: str, order: list[str], k: int = 1000) -> DataFrame:
    """(key, total, *order): the sum of what all parts of an operation counted (key, n), with the first ``k`` places of each key.

    Spark keeps k of a key before the shuffle; the total counts all, also those that are not listed.
    """
    whole = totals.groupBy(key).agg(F.sum("n").alias("total"))
    listed = found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k)
    return whole.join(listed.select(key, *order), key, "left")


def top(detail: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of a report in an order, with ``more``: how many rows are not listed."""
    more = detail.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return detail.orderBy(*order).limit(k).join(F.broadcast(more))  # one row


def without(runs: DataFrame, tag: str, excluded: list[str]) -> DataFrame:
    """The runs that a chart shows: those whose tag isn't excluded; runs without a tag stay."""
    return runs.where(~F.coalesce(F.col(tag).isin(excluded), F.lit(False)))


def distinct_counts(df: DataFrame, by: list[str], *counts: str) -> DataFrame:
    """(*by, counts): the different numbers of workers of a group's runs in any of several columns, ascending. They are few."""
    each = df.select(*by, F.explode(F.array(*counts)).alias("_c")).where("_c is not null").distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("_c")).alias("counts"))


def rate(n: Column, seconds: Column) -> Column:
    """Per second; 0 where no time passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def resource_summary(samples: DataFrame, by: list[str], metrics: list[str], least: int = 2) -> DataFrame:
    """Mean and maximum of each metric, null where it has fewer than ``least`` samples: not measured isn't 0."""
    enough = lambda m, x: F.when(F.count(m) >= least, x)
    return samples.groupBy(*by).agg(*(c for m in metrics for c in (F.round(enough(m, F.avg(m)), 6).alias(f"{m}_mean"), enough(m, F.max(m)).alias(f"{m}_max"))))


def element_means(df: DataFrame, by: list[str], array: str) -> DataFrame:
    """(*by, place, mean, n): the mean of each place of an array column; arrays may differ in length."""
    return df.select(*by, F.posexplode(array).alias("place", "_x")).groupBy(*by, "place").agg(F.round(F.avg(F.col("_x").cast("double")), 5).alias("mean"), F.count("_x").alias("n"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def amdahl(runs: DataFrame, by: list[str], workers: str, time: str) -> DataFrame:
    """(*by, serial_part, most_speedup): the line T(n) = a + b / n through the runs; a / (a + b) is serial."""
    x = 1 / F.col(workers)
    fit = runs.groupBy(*by).agg(F.regr_slope(F.col(time), x).alias("_b"), F.regr_intercept(F.col(time), x).alias("_a"))
    part = F.col("_a") / (F.col("_a") + F.col("_b"))
    return fit.select(*by, F.round(part, 6).alias("serial_part"), F.round(1 / part, 4).alias("most_speedup"))


def counter_energy(samples: DataFrame, by: list[str], order: list[str], counter: str, full: int) -> DataFrame:
    """(*by, used): the sum of a counter's steps; a step back means that it passed ``full`` and began again."""
    step = F.col(counter) - F.col(f"_p_{counter}")
    return previous(samples, by, order, [counter]).withColumn("_d", step).groupBy(*by).agg(F.sum(F.when(F.col("_d") < 0, F.col("_d") + full).otherwise(F.col("_d"))).alias("used"))


def power_energy(samples: DataFrame, by: list[str], order: str, power: str) -> DataFrame:
    """(*by, energy): the trapezoid integral of ``power`` over ``order``, a number of time units."""
    slim = samples.select(*by, F.col(order).alias("_o"), F.col(order).alias("_x"), F.col(power).alias("_y"))
    area = (F.col("_x") - F.col("_p__x")) * (F.col("_y") + F.col("_p__y")) / 2
    return previous(slim, by, ["_o"], ["_x", "_y"]).withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("energy"))


def model_agreement(df: DataFrame, a: str, b: str, n: str | None = None) -> DataFrame:
    """(a, b, n): how often two models say what; ``n``: a column that says for how many a row stands."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum(n) if n else F.count("*")).alias("n"))


def evidence(df: DataFrame, criterion: str, platform: str, platforms: list[str], value: str) -> DataFrame:
    """A row for each criterion, a column for each platform, blank where nothing was measured."""
    wide = df.groupBy(criterion).pivot(platform, platforms).agg(F.max(F.col(value).cast("string")))
    return wide.select(criterion, *(F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(p) for p in platforms))
