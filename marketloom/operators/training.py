"""Mini-batch training of a perceptron on window samples, in epochs over all executors.

Samples are dealt by hash to bounded shards, stored once as one packed matrix each. In every epoch each
shard runs mini-batches of Adam (clipped gradients, seeded order) from the common weights; weights and
moments are then averaged by shard size in a two-level sum, and the driver gets a few partial sums, not one
per shard. The state is written after every epoch, so a stopped run goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.labels import class_index
from marketloom.session import materialize

SHARD_ROWS = 65_536


@dataclass(frozen=True)
class Network:
    """Layer widths; the parameters of all layers are one vector. Hidden layers are rectified."""

    layers: tuple[int, ...]

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.layers, self.layers[1:]))

    def start(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        return np.concatenate([np.concatenate([r.standard_normal(a * b) * np.sqrt(2 / a), np.zeros(b)])
                               for a, b in zip(self.layers, self.layers[1:])])

    def split(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.layers, self.layers[1:]):
            out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def forward(self, w: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Outputs of the layers, and class probabilities."""
        outs, parts = [x], self.split(w)
        for i, (weight, bias) in enumerate(parts):
            z = outs[-1] @ weight + bias
            outs.append(np.maximum(z, 0) if i < len(parts) - 1 else z)
        e = np.exp(outs[-1] - outs[-1].max(axis=1, keepdims=True))
        return outs, e / e.sum(axis=1, keepdims=True)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, int, np.ndarray]:
        """(summed loss, correct rows, gradient of the mean loss)."""
        outs, p = self.forward(w, x)
        rows = np.arange(len(y))
        loss = float(-np.log(np.maximum(p[rows, y], 1e-15)).sum())
        d = p.copy()
        d[rows, y] -= 1
        d /= len(y)
        found = []
        for (weight, _), out in zip(reversed(self.split(w)), reversed(outs[:-1])):
            found.append(np.concatenate([(out.T @ d).ravel(), d.sum(axis=0)]))
            d = (d @ weight.T) * (out > 0)
        return loss, int((p.argmax(axis=1) == y).sum()), np.concatenate(found[::-1])


@dataclass
class Trained:
    """Weights, both moments and steps of Adam, and (epoch, loss, accuracy) of every epoch."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float
    history: list[tuple[int, float, float]]


def _epoch(net: Network, s: Trained, x: np.ndarray, y: np.ndarray, order: np.ndarray, rate: float, clip: float,
           batch: int) -> tuple[np.ndarray, float, int]:
    """Adam over the mini-batches of a shard: (weights, moments and steps in one vector, loss, correct)."""
    w, m, v, t = s.weights.copy(), s.first.copy(), s.second.copy(), s.steps
    loss, correct = 0.0, 0
    for lo in range(0, len(order), batch):
        rows = order[lo:lo + batch]
        part, right, g = net.gradient(w, x[rows], y[rows])
        loss, correct = loss + part, correct + right
        g *= min(1.0, clip / max(1e-12, float(np.sqrt(g @ g))))
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return np.concatenate([w, m, v, [t]]), loss, correct


def pack(windows: DataFrame, keys: Sequence[str], seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, x binary, y binary): the samples of each shard in an order that ``keys`` fix. Samples without a
    label or with a missing value are left out."""
    flat = F.transform(F.flatten("features"), lambda v: v.cast("double"))
    rows = (windows.where(F.col("signal_label").isNotNull())
            .select(flat.alias("x"), class_index(F.col("signal_label")).alias("y"), F.xxhash64(F.lit(seed), *keys).alias("h"))
            .where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    n = windows.count()
    shards = max(1, min(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1_024), -(-n // shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        x = np.array(pdf["x"].tolist(), float)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "x": [x.tobytes()], "y": [pdf["y"].to_numpy(np.int64).tobytes()]})

    return materialize(rows.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInPandas(
        run, "shard long, x binary, y binary"), "shards")


def train_network(shards: DataFrame, net: Network, epochs: int = 50, rate: float = 3e-4, clip: float = 1.0,
                  batch: int = 64, seed: int = 42, path: str | None = None) -> Trained:
    """Train on the shards of ``pack``. With ``path`` the state of each epoch is written there, and training goes on
    from the last one found."""
    spark = shards.sparkSession
    state = (load_state(spark, path) if path else None) or Trained(
        net.start(seed), np.zeros(net.size), np.zeros(net.size), 0.0, [])
    groups = F.pmod("shard", F.lit(max(1, int(shards.count() ** 0.5)))).cast("long")
    for epoch in range(len(state.history) + 1, epochs + 1):
        def run(batches: Iterator[pa.RecordBatch], s: Trained = state, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    y = np.frombuffer(y, np.int64)
                    x = np.frombuffer(x, float).reshape(len(y), -1)
                    order = np.random.default_rng([seed, epoch, shard]).permutation(len(y))
                    made, loss, correct = _epoch(net, s, x, y, order, rate, clip, batch)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard]), pa.array([len(y)]), pa.array([loss]), pa.array([correct]),
                         pa.array([(made * len(y)).tobytes()], pa.binary())], ["shard", "n", "loss", "correct", "part"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard")
            total = np.sum([np.frombuffer(p) for p in pdf["part"]], axis=0)
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [pdf["n"].sum()], "loss": [pdf["loss"].sum()],
                                 "correct": [pdf["correct"].sum()], "part": [total.tobytes()]})

        layout = "shard long, n long, loss double, correct long, part binary"
        parts = sorted(shards.mapInArrow(run, layout).withColumn("g", groups).groupBy("g").applyInPandas(
            lambda pdf: add(pdf.drop(columns="g")), layout).collect())
        n = sum(r.n for r in parts)
        if not n:
            break
        made = np.sum([np.frombuffer(r.part) for r in parts], axis=0) / n
        k = net.size
        state = Trained(made[:k], made[k:2 * k], made[2 * k:3 * k], float(made[-1]), [*state.history, (
            epoch, sum(r.loss for r in parts) / n, 100.0 * sum(r.correct for r in parts) / n)])
        if path:
            save_state(spark, state, path)
    return state


def save_state(spark: SparkSession, s: Trained, path: str) -> None:
    epoch, loss, accuracy = s.history[-1]
    row = (epoch, loss, accuracy, s.steps, *(bytearray(v.tobytes()) for v in (s.weights, s.first, s.second)))
    spark.createDataFrame([row], "epoch int, loss double, accuracy double, steps double, weights binary, first binary, second binary"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/state-{epoch:06d}")


def load_state(spark: SparkSession, path: str) -> Trained | None:
    """The state of the last epoch written to ``path``; None if there is none."""
    try:
        rows = spark.read.parquet(f"{path}/state-*").orderBy("epoch")
    except AnalysisException:
        return None
    last = rows.orderBy(F.desc("epoch")).first()
    history = [tuple(r) for r in rows.select("epoch", "loss", "accuracy").collect()]
    weights, first, second = (np.frombuffer(bytes(v)) for v in (last.weights, last.first, last.second))
    return Trained(weights, first, second, last.steps, history)


def predict_network(s: Trained, net: Network, windows: DataFrame) -> DataFrame:
    """Windows with ``label``, ``prediction`` (class indexes) and ``probability`` (array)."""
    weights = s.weights

    @F.pandas_udf("array<double>")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(list(net.forward(weights, np.array(x.tolist(), float))[1])) if len(x) else pd.Series([], dtype=object)

    made = windows.withColumns({"label": class_index(F.col("signal_label")).cast("double"), "probability": probability(F.flatten("features"))})
    return made.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
