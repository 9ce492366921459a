"""Results as files that people read: interleaved rows, summaries, the folder of a run. Spark's committer makes them whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_interleaved(lines: DataFrame, path: str) -> None:
    """Lines (pair, row, side, line) as text files whose names ascend with the order of pair, row and side."""
    lines.repartitionByRange("pair", "row").sortWithinPartitions("pair", "row", "side").select("line").write.text(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts of a run, a few rows, as one JSON file; nulls stay visible as such."""
    facts.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def summary_lines(summary: DataFrame, columns: list[str], width: int = 16) -> DataFrame:
    """(line): rows as right-aligned columns under a header, for a report."""
    header = "".join(f"{c:>{width}}" for c in columns)
    body = summary.select(F.concat(*(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c in columns)).alias("line"))
    return summary.sparkSession.createDataFrame([(header,)], "line string").unionByName(body)


def write_run(path: str, facts: DataFrame, tables: dict[str, DataFrame]) -> None:
    """A run's folder: its facts as JSON and each table as CSV with a header."""
    write_facts(facts, f"{path}/facts")
    for name, df in tables.items():
        df.write.csv(f"{path}/{name}", header=True)


def check_room(spark: SparkSession, path: str, needed: int) -> int:
    """The bytes that are free in the file system of ``path``; an error in words for its user where they are fewer than ``needed``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    free = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getStatus().getRemaining()
    if free < needed:
        raise OSError(f"{path} has room for {free} bytes, {needed} are needed")
    return free
