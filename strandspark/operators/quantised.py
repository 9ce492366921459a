"""The window classifier in eight-bit integers, made from the trained one, and what rule, network and integers say of the same windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import FEATURES, _featured, census, fitted


def layers_of(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, bias) of each layer from a network's weights in a row: matrices by columns, each followed by its bias."""
    out, at = [], 0
    for before, after in zip(sizes[:-1], sizes[1:], strict=True):
        matrix = weights[at : at + before * after].reshape(before, after).T
        at += before * after
        out.append((matrix, weights[at : at + after]))
        at += after
    return out


def decided(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The class of each row by the layers as they are: sigmoid between them."""
    for k, (matrix, bias) in enumerate(layers):
        x = x @ matrix.T + bias
        if k < len(layers) - 1:
            x = 1 / (1 + np.exp(-x))
    return x.argmax(axis=1)


class Int8:
    """Layers whose inputs, weights and sums between layers are integers.

    Each input has a scale of its own, taken into the first matrix; weights have one scale a layer; sums are made in 32 bits.
    What comes out of a hidden layer is looked up: 256 sums, 256 values of the sigmoid. Scales are the largest values that
    ``sample`` has; what lies beyond them counts as they.
    """

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], sample: np.ndarray):
        self.inputs = np.maximum(np.abs(sample).max(axis=0), 1e-9) / 127
        self.matrices, self.biases, self.tables, self.steps = [], [], [], []
        scale, x = np.ones(1), sample
        matrix_scale = self.inputs
        for k, (matrix, bias) in enumerate(layers):
            folded = matrix * matrix_scale
            scale = max(np.abs(folded).max(), 1e-12) / 127
            self.matrices.append(np.clip(np.round(folded / scale), -127, 127).astype(np.int8))
            self.biases.append(np.round(bias / scale).astype(np.int32))
            x = x @ matrix.T + bias
            if k < len(layers) - 1:
                step = max(np.abs(x).max(), 1e-9) / 127
                self.steps.append(step / scale)
                self.tables.append(np.round(127 / (1 + np.exp(-np.arange(-128, 128) * step))).astype(np.int8))
                x = 1 / (1 + np.exp(-x))
                matrix_scale = np.full(len(bias), 1 / 127)

    def decided(self, x: np.ndarray) -> np.ndarray:
        """The class of each row."""
        q = np.clip(np.round(x / self.inputs), -127, 127).astype(np.int8)
        for k, (matrix, bias) in enumerate(zip(self.matrices, self.biases, strict=True)):
            sums = q.astype(np.int32) @ matrix.T.astype(np.int32) + bias
            if k < len(self.matrices) - 1:
                q = self.tables[k][np.clip(np.round(sums / self.steps[k]), -128, 127).astype(np.int64) + 128]
        return sums.argmax(axis=1)


def three_ways(windows: DataFrame, width: int, sample: int = 20_000, rounds: int = 100) -> DataFrame:
    """(rule, network, int8, n): how many evaluable windows each says what of.

    The network learns from ``sample`` windows, whose features also give the integers' scales: that bounds what the driver
    sees. All evaluable windows are counted by composition, each of which is decided once. Without both labels there is no
    network: all three say what the rule says.
    """
    known = census(windows, width)
    _, net, _, chosen = fitted(windows, width, sample, rounds, known)
    ready = _featured(known, width)
    if net is None:
        return ready.groupBy(F.col("label").alias("rule")).agg(F.sum("n").alias("n")).select("rule", F.col("rule").alias("network"), F.col("rule").alias("int8"), "n")
    layers = layers_of(np.array(net.weights.toArray()), [4, 8, 2])
    seen = chosen.select(*FEATURES).toArrow()
    integers = Int8(layers, np.stack([seen.column(c).to_numpy() for c in FEATURES], axis=1))

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1).reshape(-1, 4)
            rule = (batch.column(0).to_numpy(zero_copy_only=False) > 0.5).astype(np.int64)
            codes, whose = np.unique(rule * 4 + decided(layers, x) * 2 + integers.decided(x), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, whose, batch.column(5).to_numpy())
            names = np.array(["background", "zone"], object)
            yield pa.RecordBatch.from_arrays([*(pa.array(names[codes >> k & 1], pa.string()) for k in (2, 1, 0)), pa.array(n, pa.int64())], ["rule", "network", "int8", "n"])

    return ready.select("truth", *FEATURES, "n").mapInArrow(run, "rule string, network string, int8 string, n long").groupBy("rule", "network", "int8").agg(F.sum("n").alias("n"))
