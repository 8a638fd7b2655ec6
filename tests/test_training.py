import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import training
from marketloom.operators.training import Network
from marketloom.session import scratch_path


@pytest.fixture(scope="module")
def windows(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(3_000):
        x = r.normal(size=(2, 3))
        rows.append((i, x.tolist(), int(np.sign(x[0, 0] + x[1, 1])) if abs(x[0, 0] + x[1, 1]) > 0.5 else 0))
    rows += [(5_000, [[float("nan")] * 3] * 2, 1), (5_001, [[1.0] * 3] * 2, None)]
    return spark.createDataFrame(rows, "id int, features array<array<double>>, signal_label int")


def test_gradient_is_the_slope_of_the_loss():
    r = np.random.default_rng(3)
    net = Network((4, 5, 6, 3))
    w, x, y = net.start(2), r.normal(size=(20, 4)), r.integers(0, 3, 20)
    loss, correct, g = net.gradient(w, x, y)
    assert 0 <= correct <= 20
    for i in r.choice(net.size, 25, replace=False):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.gradient(w + step, x, y)[0] - net.gradient(w - step, x, y)[0]) / 2e-6 / 20
        assert slope == pytest.approx(g[i], abs=1e-6)


def test_shards_hold_every_usable_sample_once(windows):
    shards = training.pack(windows, ["id"], shard_rows=500)
    rows = shards.collect()
    assert sum(len(np.frombuffer(r.y, np.int64)) for r in rows) == 3_000
    assert len({r.shard for r in rows}) == len(rows) > 1
    again = training.pack(windows.repartition(7), ["id"], shard_rows=500).collect()
    assert {r.shard: bytes(r.x) for r in rows} == {r.shard: bytes(r.x) for r in again}


def test_training_learns_and_resumes(spark, windows):
    shards, net = training.pack(windows, ["id"]), Network((6, 16, 3))
    once = training.train_network(shards, net, epochs=8, rate=3e-3)
    losses = [h[1] for h in once.history]
    assert losses[-1] < 0.8 * losses[0] and once.history[-1][2] > 70 and [h[0] for h in once.history] == list(range(1, 9))
    path = scratch_path(spark, "network")
    training.train_network(shards, net, epochs=3, rate=3e-3, path=path)
    again = training.train_network(shards, net, epochs=8, rate=3e-3, path=path)
    assert (once.weights == again.weights).all() and once.history == again.history
    assert training.train_network(shards, net, epochs=8, path=path).steps == again.steps  # nothing left to do
    made = training.predict_network(once, net, windows.where("id < 3000")).collect()
    assert sum(r.prediction == r.label for r in made) > 2_100
    assert all(sum(r.probability) == pytest.approx(1) for r in made[:50])


def test_no_samples(windows):
    shards = training.pack(windows.where("false"), ["id"])
    assert training.train_network(shards, Network((6, 4, 3)), epochs=2).history == []
