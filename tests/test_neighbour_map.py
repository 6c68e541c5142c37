"""The neighbour graph against brute force, and the map against principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import neighbour_map as nm
from gristmill.operators import topics


def curved(n, dims=12, seed=3):
    """Points on five closed curves that wind through a few dimensions: principal components fold them."""
    rnd = np.random.default_rng(seed)
    which, t = rnd.integers(0, 5, n), rnd.uniform(0, 2 * np.pi, n)
    waves = np.stack([f(m * t + p) for m, f, p in zip((1, 1, 2, 2, 3, 3), (np.sin, np.cos) * 3, (0, 0, 1, 1, 2, 2), strict=True)], axis=1)
    turn = np.stack([np.linalg.qr(rnd.standard_normal((dims, 6)))[0] for _ in range(5)])
    return np.einsum("nk,ndk->nd", waves, turn[which]) + rnd.standard_normal((5, dims))[which] * 1.5 + rnd.normal(0, 0.02, (n, dims))


def order(distance):
    np.fill_diagonal(distance, np.inf)
    return np.argsort(distance, axis=1, kind="stable")


def trust(x, y, k=15):
    """How few of the map's nearest are strangers in the space."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, rank = len(x), np.argsort(order(1 - unit @ unit.T), axis=1)
    near = order(((y[:, None] - y[None]) ** 2).sum(-1))[:, :k]
    strange = np.maximum(np.take_along_axis(rank, near, 1) + 1 - k, 0).sum()
    return 1 - 2 * strange / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def points(spark):
    x = curved(700)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "i long, v array<double>")
    return x, rows.repartition(3)


@pytest.mark.parametrize(("options", "least"), [({}, 0.97), ({"leaf": 64, "trees": 8, "rounds": 1}, 0.9)])
def test_recall_of_the_graph(spark, points, options, least):
    x, rows = points
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = order(1 - unit @ unit.T)[:, :30]
    found = {}
    for r in nm.neighbour_graph(rows, "i", "v", 30, **options).collect():
        assert abs(r.distance - (1 - unit[r.id] @ unit[r.other])) < 1e-9 and r.id != r.other
        found.setdefault(r.id, set()).add(r.other)
    assert max(map(len, found.values())) <= 30
    assert np.mean([len(found[i] & set(true[i])) / 30 for i in range(len(x))]) >= least


def test_weights_add_up(spark, points):
    _, rows = points
    graph = nm.neighbour_graph(rows, "i", "v", 16)
    edges = {(r.id, r.other): r.w for r in nm.fuzzy_weights(graph).collect()}
    assert all(0 <= w <= 1 + 1e-9 for w in edges.values()) and all(abs(edges[b, a] - w) < 1e-9 for (a, b), w in edges.items() if (b, a) in edges)
    nearest = {r.id: r.other for r in graph.groupBy("id").agg(F.min_by("other", "distance").alias("other")).collect()}
    assert all(edges[i, o] > 1 - 1e-9 for i, o in nearest.items())


def test_map_is_truer_than_components(spark, points):
    x, rows = points
    made = {r.i: r.p for r in nm.neighbour_map(rows, "i", "v", dims=2, k=15, part=300).collect()}
    plain = {r.i: r.p for r in topics.components(rows, "i", "v", 2).collect()}
    found, base = (trust(x, np.asarray([m[i] for i in range(len(x))])) for m in (made, plain))
    assert found > 0.98 and 1 - found < 0.7 * (1 - base), (found, base)


def test_copies_and_few_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (101, None), (None, [1.0, 1.0])], "i long, v array<double>")
    graph = nm.neighbour_graph(same, "i", "v", 5, leaf=8, trees=2)
    assert {r.id for r in graph.collect()} >= set(range(40)) and graph.where("id < 40 and other < 40 and distance > 1e-9").isEmpty()
    assert len(nm.neighbour_map(same, "i", "v", dims=2, k=5, rounds=1, epochs=2).collect()) >= 40
    assert nm.neighbour_map(same.limit(0), "i", "v", dims=2).count() == 0
