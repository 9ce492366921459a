"""Models are trained by tasks: the driver holds neither what they learn from nor what training needs of memory."""

import os
import random

import numpy as np
from pyspark.sql import functions as F
from strandspark.llm import secrets, toxicity


def elsewhere(real):
    """``real``, which the driver mustn't call with rows."""
    here = os.getpid()

    def run(x, y, *more):
        if os.getpid() == here and len(y):
            raise AssertionError("the driver trains")
        return real(x, y, *more)

    return run


def test_toxicity_is_trained_by_a_task(spark, monkeypatch):
    r = random.Random(1)
    rows = [(k, None if k == 7 else " ".join(r.choice(["river", "stone", "cloud", "table"]) for _ in range(20)) + (" blorgish" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    expected = toxicity.train(*toxicity.bounded_sample(rows, 60))
    monkeypatch.setattr(toxicity, "train", elsewhere(toxicity.train))
    model = toxicity.learned(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True), 60)
    assert np.isclose(model.bias, expected.bias, atol=1e-6) and np.allclose(model.weights, expected.weights, atol=1e-4) and model.weights.any()


def test_secrets_begin_in_a_task(spark, monkeypatch):
    r = random.Random(4)
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    rows = [(k, f"the word is internationalization{k % 50} and password = {key()} here") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = docs.mapInArrow(secrets._examples, "seen binary, label int, digit boolean").groupBy("seen", "label", "digit").count().orderBy(F.xxhash64("seen"), "seen").collect()
    x, y = [], []
    for label, digit in ((0, True), (0, False), (1, None)):
        for row in found:
            if row["label"] == label and digit in (None, row["digit"]):
                x += [np.frombuffer(row["seen"], np.int16)] * row["count"]
                y += [label] * row["count"]
    expected = secrets.train(np.array(x), np.array(y))
    monkeypatch.setattr(secrets, "train", elsewhere(secrets.train))
    net = secrets.learned(docs)
    assert np.allclose((net.threshold, net.slope, net.shift), (expected.threshold, expected.slope, expected.shift), atol=1e-6) and net.threshold < 1
    assert all(np.allclose(p, q, atol=1e-6) for p, q in zip(net.parameters, expected.parameters, strict=True))
