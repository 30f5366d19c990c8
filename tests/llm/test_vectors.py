from collections import Counter

import numpy as np
import pytest

from pagewright.llm import vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int")


def brute(rows, cosine, axes):
    nodes = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == axes and all(x is not None and np.isfinite(x) for x in v) and any(v):
            nodes.setdefault(tuple(np.float32(v).tolist()), set()).add(i)
    keys = list(nodes)
    x = np.array(keys)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = [tuple(sorted(nodes[k])) for k in keys]
    links = {(i, j) for own in ids for i in own for j in own if i != j}
    for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
        links |= {(i, j) for i in ids[a] for j in ids[b] if i != j} | {(j, i) for i in ids[a] for j in ids[b] if i != j}
    parent = {i: i for own in ids for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    count = Counter(i for i, _ in links)
    return {(i, root(i), k) for i, k in count.items()}


def links(frame, *args):
    return {tuple(r) for r in vectors.join(frame, *args).select("vec_id", "class_id", "n_links").collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 32))
    near = base[:60] + rng.normal(scale=0.1, size=(60, 32))
    cluster = base[70] + rng.normal(scale=0.08, size=(80, 32))
    skewed = rng.normal(size=(80, 32)) * np.geomspace(3, 0.05, 32)
    x = np.concatenate([base, near, cluster, skewed]).astype(np.float32)
    rows = list(enumerate(x.tolist())) + [(9000, x[3].tolist()), (9000, x[3].tolist()), (9001, (x[3] * 2).tolist()), (None, x[4].tolist()), (9002, None), (9003, []), (9004, [0.0] * 32), (9005, [1.0, 2.0]), (9006, [float("nan")] * 32), (9007, [None] * 32), (9008, [float("inf")] + [0.0] * 31)]
    expected = brute(rows, 0.97, 32)
    assert len(expected) > 150
    for together in (8192, 50):  # whole cells, and cells in parts
        monkeypatch.setattr(vectors, "CELL_VECTORS", together)
        assert links(frame(spark, rows).withColumnRenamed("label", "node")) == expected


@pytest.mark.parametrize("m, g", [(2, 0), (2, 3), (4, 2), (8, 4), (32, 1)])
def test_any_plan_gives_the_same_links(spark, monkeypatch, m, g):
    rng = np.random.default_rng(m)
    x = np.concatenate([rng.normal(size=(200, 32)), rng.normal(size=32) + rng.normal(scale=0.12, size=(60, 32)), np.tile(rng.normal(size=32), (30, 1))]).astype(np.float32)
    rows = list(enumerate(x.tolist()))

    def fixed(variance, squared, count):
        dealt = vectors.deal(32, m)
        return dealt, [squared * variance[d].sum() / variance.sum() * (1 + 1e-6) + 1e-9 for d in dealt], [min(g, len(d)) for d in dealt]

    monkeypatch.setattr(vectors, "plan", fixed)
    monkeypatch.setattr(vectors, "CELL_VECTORS", 40)
    assert links(frame(spark, rows)) == brute(rows, 0.97, 32)


def test_the_plan_takes_more_of_the_grid_for_more_vectors():
    variance = np.geomspace(0.1, 0.001, 64)
    few, many = (sum(vectors.plan(variance, 0.06, n)[2]) for n in (1_000, 10**8))
    assert few < many
    assert len(vectors.plan(np.ones(1), 0.06, 10)[0]) == 1


def test_few_axes_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    assert links(frame(spark, rows)) == {(1, 1, 1), (2, 1, 1)}
    assert vectors.join(frame(spark, [])).count() == 0


def test_each_length_is_joined(spark):
    rng = np.random.default_rng(4)
    rows = []
    for axes, n in ((32, 40), (3, 20), (2, 10), (1, 3)):
        x = rng.normal(size=(n, axes))
        rows += [(100 * axes + k, v) for k, v in enumerate(np.concatenate([x, x[:4] + rng.normal(scale=0.01, size=(min(n, 4), axes))]).astype(np.float32).tolist())]
    expected = set().union(*(brute(rows, 0.97, axes) for axes in (32, 3, 2, 1)))
    assert links(frame(spark, rows)) == expected
