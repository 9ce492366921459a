"""The folder that the driver and all executors share, and files in Spark's file systems that tasks open by themselves."""

from __future__ import annotations

import re
import tempfile

from pyarrow import fs
from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def opened(path: str):
    """(file system, path in it) of a full URI, for tasks that read or write parts of files."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI that Spark means by ``path``: without a scheme it is in the cluster's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
