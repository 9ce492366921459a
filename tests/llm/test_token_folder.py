"""op5's folder: files of repeated attempts are never read, and every task reads about as many files."""

import glob
import shutil

import public_tokenizers
from pyspark.sql import functions as F
from strandspark.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_attempts_that_do_not_count_are_never_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 50)) for k in range(400)] + [(None, None), (7, "again")], "doc_id long, text string")
    manifest = token_files.write(docs, PATH, str(tmp_path), text_bytes=2000)
    assert manifest.count() > 20
    for name in glob.glob(f"{tmp_path}/*.ids"):
        shutil.copy(name, name.replace(".ids", "0.ids"))
    shapes = []
    for most in (100_000, 5, 1):
        read = token_files.read(spark, str(tmp_path), manifest, most)
        rows = sorted(read.collect(), key=lambda r: r["start"])
        assert len(rows) == 402 and [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]
        shapes.append([tuple(r) for r in rows])
        seen = [r["n"] for r in read.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(seen) == min(most, manifest.count())
    assert shapes[0] == shapes[1] == shapes[2]
