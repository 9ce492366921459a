"""Eight-bit integers against the network they are made from."""

import random

import numpy as np
from pyspark.sql import functions as F
from strandspark.operators import patterns, quantised


def windows_of(spark):
    r = random.Random(5)
    rows = [(k, "".join(r.choice("CG" * r.choice([1, 9]) + "ACGT") for _ in range(400))) for k in range(80)] + [(99, "CG" * 200), (98, "AT" * 200), (97, "ACGTN" * 50)]
    return patterns.windows(spark.createDataFrame(rows, "doc long, text string"), "doc", "text", 40, 20)


def test_layers_are_those_of_the_network(spark):
    """What the matrices decide is what the library predicts."""
    windows = windows_of(spark)
    ready, net, _, _ = patterns.fitted(windows, 40)
    layers = quantised.layers_of(np.array(net.weights.toArray()), [4, 8, 2])
    rows = net.transform(ready).select("prediction", *patterns.FEATURES).collect()
    assert quantised.decided(layers, np.array([r[1:] for r in rows])).tolist() == [int(r[0]) for r in rows]


def test_three_ways(spark):
    windows = windows_of(spark)
    rows = [tuple(r) for r in quantised.three_ways(windows, 40).collect()]
    total = sum(r[3] for r in rows)
    assert total == windows.where("evaluable").count()
    assert sum(r[3] for r in rows if r[1] == r[2]) > 0.95 * total and sum(r[3] for r in rows if r[0] == r[1]) > 0.95 * total
    alone = windows.where(F.col("label") == "background")
    assert {tuple(r)[:3] for r in quantised.three_ways(alone, 40).collect()} == {("background",) * 3}
    assert quantised.three_ways(windows.where("false"), 40).count() == 0


def test_integers_of_random_layers():
    """Decisions differ only where the two classes are close to each other."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        layers = [(rng.normal(0, 3, (8, 4)), rng.normal(0, 1, 8)), (rng.normal(0, 3, (2, 8)), rng.normal(0, 1, 2))]
        x = rng.random((2000, 4)) * [1, 1, 1, 0.25]
        made = quantised.Int8(layers, x)
        assert all(m.dtype == np.int8 for m in made.matrices)
        hidden = 1 / (1 + np.exp(-(x @ layers[0][0].T + layers[0][1])))
        out = hidden @ layers[1][0].T + layers[1][1]
        close = np.abs(out[:, 0] - out[:, 1]) < 0.6
        assert (made.decided(x) == quantised.decided(layers, x))[~close].all()
