"""Epsilon grid order join against all pairs."""

import math

import numpy as np
import pytest

from boxoffice.llm import vectors
from boxoffice.llm.components import local_roots


def check(spark, rows):
    got = vectors.links_and_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")).collect()
    usable = [v is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, _ in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    unit = [np.array(v) / np.abs(v).max() if u else None for (_, v, _), u in zip(rows, usable)]  # no overflow in the products
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and len(unit[i]) == len(unit[j]):
                linked[i, j] = unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.9
    roots = local_roots(n, *np.nonzero(linked))
    least = {}
    for r, (v, _, _) in zip(roots, rows):
        if v is not None:
            least[r] = min(least.get(r, v), v)
    want = [(v, int(linked[i].sum()), least.get(roots[i]), v is not None and v == least.get(roots[i])) for i, (v, _, _) in enumerate(rows)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def rows_of(x):
    return [(i, [float(c) for c in v], "x") for i, v in enumerate(x)]


def test_clusters_and_noise(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 8)
    monkeypatch.setattr(vectors, "SUPER", 1)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(scale=0.25, size=(150, 12)), rng.normal(size=(100, 12))])
    check(spark, rows_of(x))


def test_low_dimension_is_cut_into_distant_intervals(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 4)
    rng = np.random.default_rng(6)
    angle = rng.uniform(0, 2 * np.pi, 200)
    check(spark, rows_of(np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.1, 9, (200, 1))))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, None, "x"), (2, [], "x"), (3, [0.0, 0.0], "x"), (4, [1.0, nan], "x"), (5, [inf, 1.0], "x"), (6, [1.0, None], "x"),
                  (7, [1.0, 0.0], "x"), (7, [1.0, 0.0], "x"), (None, [2.0, 0.1], "x"), (8, [1.0, 0.0, 0.0], "x"), (9, [1e300, 1e290], "x"), (10, [-1.0, 0.0], "x"),
                  (None, [0.0, 1.0], "x")])
    check(spark, [])


@pytest.mark.parametrize("table", ["sf0.01"])
def test_whole_table(spark, table):
    frame = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    got = {r["vec_id"]: r for r in vectors.links_and_groups(frame).collect()}
    rows = frame.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    assert [got[r["vec_id"]]["n_links"] for r in rows] == (linked.sum(1) - 1).tolist()
