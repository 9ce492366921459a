"""Secrets are learned from the candidates of all rows, not of a sample."""

import random

import numpy as np
from strandspark.llm import secrets


def test_thresholds_from_counts_are_those_from_scores():
    rng = np.random.default_rng(3)
    for _ in range(200):
        score, truth = rng.integers(0, 12, 60) / 12, (rng.random(60) < 0.4).astype(int)
        own, which = np.unique(score, return_inverse=True)
        counts = [np.bincount(which[truth == k], minlength=len(own)) for k in (1, 0)]
        for recall, alarms in ((0.9, 0.001), (0.5, 0.3), (1.0, 1.0)):
            assert secrets.threshold_of_counts(own, *counts, recall, alarms) == secrets.threshold_of(score, truth, recall, alarms)


def test_every_candidate_is_learned_from(spark, monkeypatch):
    """However rows are dealt, shards hold all distinct candidates, and the same network comes out; repeated rows are one there."""
    r = random.Random(4)
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    rows = [(k, f"the word is internationalization{k} and password = {key()} or {k:013d} here") for k in range(300)] + [(k, "plain repeatedtext12345") for k in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, refined = [], secrets.refined

    def watched(found, net, many):
        distinct = found.select("seen", "label", "digit").distinct().count()
        before = net.threshold, [p.copy() for p in net.parameters]
        out = refined(found, net, many)
        seen.append((many, distinct, found.selectExpr("sum(n)").first()[0], any((p != q).any() for p, q in zip(before[1], out.parameters, strict=True))))
        return out

    monkeypatch.setattr(secrets, "refined", watched)
    monkeypatch.setattr(secrets, "SHARD", 400)
    nets = [secrets.learned(docs.repartition(n), most=40) for n in (1, 5)]
    assert seen[0] == seen[1] and seen[0][0] == seen[0][1] and seen[0][3]
    assert seen[0][0] >= 900 and seen[0][2] >= seen[0][0] + 399
    assert nets[0].threshold == nets[1].threshold and all((p == q).all() for p, q in zip(nets[0].parameters, nets[1].parameters, strict=True))
