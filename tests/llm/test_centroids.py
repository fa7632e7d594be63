"""Clustering with bounds against the plain form, and odd input."""

import hashlib

import numpy as np
import pytest

from factloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in e]) for i, e, *_ in rows
            if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = np.array([v for _, v in first], object)
    x = np.array([v for _, v in kept], object)

    def nearest():
        d = np.stack([((x - m) ** 2).sum(1) for m in c], 1)
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        a, _ = nearest()
        for j in range(len(c)):
            own = [i for i, b in enumerate(a) if b == j]
            if own:
                c[j] = [sum(x[i][p] for i in own) // len(own) for p in range(dims)]
    a, d = nearest()
    inertia = {j: sum(d[i][j] for i, b in enumerate(a) if b == j) for j in set(a)}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(((kept[i][0], b, d[i][b], inertia[b], sum(inertia.values()), sha[b]) for i, b in enumerate(a)), key=key)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    middle = draw.normal(0, 0.3, (6, 8))
    out = [(i, [float(x) for x in middle[draw.integers(6)] + draw.normal(0, 0.1, 8)], 1, "x", 2) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.5] * 7, [0.5] * 9, [None] + [0.1] * 7, [nan] + [0.1] * 7, [inf] + [0.1] * 7, [0.0] * 8, [-0.0] * 8, [1000.0] * 8]
    out += [(500 + i, e, None, None, None) for i, e in enumerate(odd)] + [(None, [0.25] * 8, 1, "x", 2)]
    return out + out[:30] + [(7, [0.1] * 8, 1, "x", 2)] * 40


@pytest.mark.parametrize("k,rounds", [(12, 5), (40, 3), (1, 2), (5, 0), (1000, 1)])
def test_clusters_equal_brute_force(spark, rows, k, rounds):
    some = rows if k < 1000 else rows[:30]
    got = centroids.cluster_vectors(spark.createDataFrame(some, SCHEMA).repartition(3), k, rounds, 8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert plain(got) == brute(some, k, rounds, 8)


def test_bounds_save_distances_and_stay_exact():
    draw = np.random.default_rng(9)
    middle = draw.integers(-200, 200, (10, 16))
    v = (middle[draw.integers(10, size=3000)] + draw.integers(-20, 20, (3000, 16))).astype(np.int64)
    history, state, counted = [v[:10].copy()], centroids.evaluate_all(v, v[:10]), 0
    for _ in range(6):
        c = history[-1].copy()
        for j in range(10):
            own = v[state[0] == j]
            if len(own):
                c[j] = own.sum(0) // len(own)
        history.append(c)
        past = np.stack(history)
        moved = np.sqrt((((past - past[-1]).astype(float)) ** 2).sum(2))
        state, n = centroids.reassign(v, state, past, moved)
        counted += n
        d = np.stack([((v - m) ** 2).sum(1) for m in c], 1)
        assert (state[0] == d.argmin(1)).all()
        loose = state[3] - moved[state[4], np.arange(10)]
        assert (loose <= np.sqrt(d) + 1e-6).all()
    assert counted < 6 * 3000 * 10 / 3


def test_empty_table_and_large_components(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_vectors(none, 40, 5, 8).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([(1, None, 1, "x", 2)], SCHEMA), 40, 5, 8).count() == 0
    far = spark.createDataFrame([(1, [3e38] * 8, 1, "x", 2)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(far, 2, 1, 8).collect()
