"""The joint fit by blocks against one dense system, and against the state that made the data."""

import numpy as np
import pytest

from tidemark.operators import joint


def data(nodes, days, seed, missing=0.2, noise=0.05):
    rng = np.random.default_rng(seed)
    t = np.arange(days)
    x = np.array([3 + np.sin(t / 6 + i / 3) + 0.1 * i for i in range(nodes)])
    delays, shift = {"a": 0, "b": 3, "c": 7}, {"a": 0.0, "b": -1.2, "c": 0.7}
    rows = []
    for i in range(nodes):
        for s, d in delays.items():
            for k in range(days):
                if rng.random() > missing and 0 <= k - d and not (i == 2 and s != "b"):
                    rows.append((i, int(k), s, float(x[i, k - d] + shift[s] + rng.normal(0, noise)), float(noise**2 * (1 + i % 2))))
    return x, delays, shift, rows


def ring(nodes):
    return [(i, (i + 1) % nodes, 0.5 + i % 3) for i in range(nodes)]


def dense(nodes, days, rows, delays, edges, curvature, coupling, ridge):
    sources = sorted(delays)
    size = nodes * days + len(sources) - 1
    a, b = np.zeros((size, size)), np.zeros(size)
    a[: nodes * days, : nodes * days] += 1e-9 * np.eye(nodes * days)
    for i, k, s, z, v in rows:
        if 0 <= k - delays[s] < days:
            at = [i * days + k - delays[s]] + ([nodes * days + sources.index(s) - 1] if s != sources[0] else [])
            for p in at:
                b[p] += z / v
                for q in at:
                    a[p, q] += 1 / v
    for j in range(len(sources) - 1):
        a[nodes * days + j, nodes * days + j] += ridge
    for i in range(nodes):
        for t in range(days - 2):
            d = np.zeros(size)
            d[i * days + t : i * days + t + 3] = 1, -2, 1
            a += curvature * np.outer(d, d)
    for i, j, w in edges:
        for t in range(days):
            d = np.zeros(size)
            d[i * days + t], d[j * days + t] = 1, -1
            a += coupling * w * np.outer(d, d)
    sol = np.linalg.solve(a, b)
    return sol[: nodes * days].reshape(nodes, days), dict(zip(sources, [0.0, *sol[nodes * days :]], strict=True))


def test_blocks_reach_the_dense_solution(spark):
    nodes, days = 5, 20
    x, delays, shift, rows = data(nodes, days, 1)
    edges = ring(nodes)
    obs = spark.createDataFrame([*rows, (None, 1, "a", 1.0, 1.0), (0, 2, "other", 9.0, 1.0), (0, 500, "a", 9.0, 1.0), (1, 3, "a", None, 1.0)], "node int, day int, source string, z double, v double")
    out, offsets = joint.joint_fit(obs, spark.createDataFrame(edges, "src int, dst int, weight double"), "node", "day", "source", "z", "v", delays, 0, days, curvature=40.0, coupling=1.0, sweeps=24, tolerance=1e-5)
    got = np.zeros((nodes, days))
    for r in out.collect():
        got[r.node, r.day] = r.x
        assert (r.q is None) == (r.day < 1) and (r.c is None) == (r.day < 2)
    want, shifts = dense(nodes, days, rows, delays, edges, 40.0, 1.0, 1e-6)
    assert np.abs(got - want).max() < 2e-3 and all(abs(offsets[s] - shifts[s]) < 2e-3 for s in delays)
    # a region with one source only, and the rest, are near the state that made the data
    assert np.abs(got - x)[:, 2:-8].mean() < 0.05 and all(abs(offsets[s] - shift[s]) < 0.1 for s in delays)


@pytest.mark.parametrize("days", [1, 2, 3, 9])
def test_banded_solve(days):
    rng = np.random.default_rng(days)
    diagonal, right = rng.random((4, days)) + 0.1, rng.normal(size=(4, days))
    second = np.diff(np.eye(days), n=2, axis=0) if days > 2 else np.zeros((0, days))
    for row, (d, r) in zip(joint.solve_banded(diagonal, right, 7.0), zip(diagonal, right, strict=True), strict=True):
        assert np.allclose(row, np.linalg.solve(np.diag(d) + 7 * second.T @ second, r))


def test_colours_of_neighbours_differ():
    edges = [(i, j) for i in range(12) for j in range(i) if (i * j) % 3 == 1]
    of = joint.colours(edges, list(range(12)))
    assert all(of[a] != of[b] for a, b in edges if a != b)


def test_too_many_regions_are_refused(spark):
    obs = spark.range(10).selectExpr("CAST(id AS INT) AS node", "1 AS day", "'a' AS source", "1.0D AS z", "1.0D AS v")
    with pytest.raises(ValueError):
        joint.joint_fit(obs, spark.createDataFrame([], "src int, dst int, weight double"), "node", "day", "source", "z", "v", {"a": 0}, 0, 3, most=5)
