import hashlib
import random

import numpy as np
import pytest

from trackspark.llm import whitening
from trackspark.llm.ballkmeans import Balls, cluster
from trackspark.llm.queries import op12_clusters, op13_whitening

SF = "/root/testdata/sf0.001"


def lloyd(rows, k, rounds, seed):
    """All vectors against all centroids, in Python's integers."""
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        own = place()
        for c in range(len(centroids)):
            if members := [v for (_, v), (_, at) in zip(rows, own, strict=True) if at == c]:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = place()
    each = {c: sum(d for d, at in own if at == c) for c in range(len(centroids))}
    return sorted(((i, c, d, each[c], sum(each.values()), tuple(centroids[c])) for (i, _), (d, c) in zip(rows, own, strict=True)), key=str)


def test_clusters_against_all_distances(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-3, 0, 0, 1, 5]) for _ in range(3)]) for k in range(300)]  # many equal vectors, many ties
    rows += [(7, [1, 1, 1]), (None, [9, 9, 9]), (None, [0, 0, 1])]
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 1.0, 2.0])]
    frame = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1) for i, v in [*rows, *bad]], "vec_id long, embedding array<double>, cluster int").repartition(3)
    for k, rounds, size in ((5, 4, 64), (8, 10, 7), (400, 2, 50)):
        out = cluster(frame, width=3, k=k, rounds=rounds, scale=1, seed="3:", block_rows=size).collect()
        assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out), key=str) == lloyd(rows, k, rounds, "3:")


def test_balls_compare_only_neighbours():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-200, 200, (12, 4))
    vectors = rng.integers(-200, 200, (500, 4))
    distance = ((vectors[:, None] - centroids) ** 2).sum(2)
    for own in (None, rng.integers(0, 12, 500), distance.argmin(1)):
        at, least = Balls(centroids).nearest(vectors, own)
        assert (at == distance.argmin(1)).all() and (least == distance.min(1)).all()


def test_no_vectors_and_too_large_ones(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cluster(empty).count() == 0 and whitening.whiten(empty).count() == 0
    with pytest.raises(Exception, match="too large"):
        cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), width=1).count()


def white_by_numpy(rows, scale):
    x = np.array(sorted({tuple(int(np.floor(scale * c)) for c in v) for _, v in rows}), float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, values[::-1], vectors[:, ::-1]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5] + 100).tolist()) for k in range(200)]
    rows += [(500, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])]
    bad = [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in [*rows, *bad]], "vec_id long, embedding array<double>, whitened double").repartition(4)
    out = whitening.whiten(frame).collect()
    assert len(out) == 4 * len(rows)
    x, values, vectors = white_by_numpy(rows, 256)
    n, sums = len(x), x.sum(0).astype(int).tolist()
    assert {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    by_id = {}
    for i, v in rows:
        by_id.setdefault(i, []).append([int(np.floor(256 * c)) for c in v])
    for c in range(4):
        some = [r for r in out if r.component == c + 1 and r.vec_id not in (0, None)]
        assert np.allclose([r.explained for r in some], values[c] / values.sum(), rtol=1e-9)
        want = [(np.array(by_id[r.vec_id][0]) - x.mean(0)) @ vectors[:, c] / np.sqrt(values[c]) for r in some]
        got = [r.whitened for r in some]
        assert np.allclose(got, want, atol=1e-8) or np.allclose(got, np.negative(want), atol=1e-8)
    for r in out:
        assert r.deviation in {sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in by_id[r.vec_id]}


def test_scatter_is_exact(spark):
    rng = random.Random(8)
    rows = [[rng.randint(-(1 << 45), 1 << 45) for _ in range(3)] for _ in range(50)]
    fit = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3)
    n, sums, low, high = whitening._sums(fit)
    assert n == 50 and sums == [sum(c) for c in zip(*rows, strict=True)] and low == [min(c) for c in zip(*rows, strict=True)]
    y = [[n * v - s for v, s in zip(r, sums, strict=True)] for r in rows]
    assert whitening.scatter(fit, n, sums, low, high) == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]


def test_whitening_of_flat_and_uneven_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], kind)).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    with pytest.raises(ValueError, match="1 to 2"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind))


def test_queries(spark):
    clusters, white = op12_clusters(spark, SF).collect(), op13_whitening(spark, SF).collect()
    assert len(clusters) == 500 and len(white) == 2000
    assert len({(r.cluster, r.centroid_sha256) for r in clusters}) == 8 and len({r.inertia for r in clusters}) == 1
    assert white[0].identity_error <= 1e-4
