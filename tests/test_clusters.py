"""Clustering on executors against the same in memory."""

import numpy as np
import pytest

from spectrail.operators import clustering, graph
from spectrail.operators.graph import Graph, distances, eigenvectors


def table(spark, x, block=5):
    rows = [(i, i // block, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, block_id int, features array<double>").repartition(3)


def laplacian(x, metric, sigma):
    d = distances(metric, x, x)
    s = np.exp(-d * d / (2 * sigma * sigma))
    np.fill_diagonal(s, 1.0)
    degree = s.sum(axis=1)
    return np.eye(len(x)) - s / np.sqrt(np.outer(degree, degree))


def signed(v):
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)


@pytest.mark.parametrize(("metric", "sigma", "block"), [("manhattan", 0.8, 7), ("euclidean", 0.15, 16), ("cosine", 0.3, 100)])
def test_eigenvectors_equal_the_dense_matrix(spark, metric, sigma, block):
    x = np.random.default_rng(2).random((60, 3)) + 0.05
    own = Graph(table(spark, x), metric, sigma, block=block)
    try:
        vectors, values = eigenvectors(own, 3)
    finally:
        own.close()
    got = np.array([r["features"] for r in vectors.orderBy("point_id").collect()])
    vals, vecs = np.linalg.eigh(laplacian(x, metric, sigma))
    assert np.allclose(values, vals[:3], atol=1e-9)
    assert np.allclose(got, signed(vecs[:, :3]), atol=1e-5)


def test_a_graph_in_parts_has_an_eigenvector_for_each(spark):
    """Far apart: nothing is compared between the parts, and 0 is an eigenvalue as often as there are parts."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in (0.0, 40.0, 80.0)])
    own = Graph(table(spark, x), "euclidean", 0.1, block=8)
    try:
        assert all(abs(a - b) <= 1 for a, b in spark.table(own.name).join(own.blocks.selectExpr("block as a", "c0 as ca"), "a").join(own.blocks.selectExpr("block as b", "c0 as cb"), "b").select("ca", "cb").collect())
        _, values = eigenvectors(own, 3)
    finally:
        own.close()
    assert np.allclose(values, 0, atol=1e-9)
    found = clustering.spectral_clusters(table(spark, x), 3, 0.1, "euclidean").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(r.point_id // 20)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def test_distances_of_blocks():
    rng = np.random.default_rng(1)
    a, b = rng.random((4, 5)), rng.random((3, 5))
    plain = {
        "manhattan": lambda x, y: np.abs(x - y).sum(),
        "euclidean": lambda x, y: np.linalg.norm(x - y),
        "minkowski": lambda x, y: (np.abs(x - y) ** 4).sum() ** 0.25,
        "chebyshev": lambda x, y: np.abs(x - y).max(),
        "hamming": lambda x, y: (x != y).sum(),
        "cosine": lambda x, y: 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y),
        "jaccard": lambda x, y: 1 - np.minimum(x, y).sum() / np.maximum(x, y).sum(),
    }
    for metric, f in plain.items():
        assert np.allclose(distances(metric, a, b, 4), [[f(x, y) for y in b] for x in a])
    with pytest.raises(ValueError):
        distances("none", a, b)


def test_kmeans_of_points_equals_memory(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 3, 6, 9)])
    rows, centres = clustering.kmeans_points(table(spark, x), 4, 100, 1e-9, 1)
    got = {r.point_id: (r.cluster, r.distance) for r in rows.collect()}
    best = min((clustering.kmeans(x, 4, 100, 1e-9, s) for s in range(10)), key=lambda f: (f[2] ** 2).sum())
    assert sum(d * d for _, d in got.values()) == pytest.approx((best[2] ** 2).sum(), rel=1e-9)
    assert np.allclose(sorted(centres.tolist()), sorted(best[1].tolist()))
    again = clustering.kmeans_points(table(spark, x).repartition(7), 4, 100, 1e-9, 1)[1]
    assert np.allclose(centres, again)
    same, _ = clustering.kmeans_points(table(spark, np.ones((6, 2))), 3, 5, 1e-9, 0)
    assert [r.distance for r in same.collect()] == [0.0] * 6


@pytest.mark.parametrize("noise", [0.0, 0.001, 0.3])
def test_vca_of_points_equals_memory(spark, noise):
    rng = np.random.default_rng(4)
    ends = rng.random((10, 4))
    x = (ends @ rng.dirichlet(np.ones(4), 80).T).T + noise * rng.standard_normal((80, 10))
    x[70:] = x[:10]  # copies
    for seed in (0, 3):
        found, spectra = clustering.vca(x.T, 4, seed)
        ids, far = clustering.vca_points(table(spark, x), 4, seed)
        assert ids == found and np.allclose(far, spectra, atol=1e-9)
    with pytest.raises(ValueError):
        clustering.vca_points(table(spark, np.ones((5, 3))), 2)
    with pytest.raises(ValueError):
        clustering.vca_points(table(spark, x).limit(0), 2)


def test_presences_by_block_equal_memory(spark):
    rng = np.random.default_rng(5)
    ends = rng.random((8, 4))
    x = (ends @ rng.dirichlet(np.ones(4) * 0.4, 30).T).T
    shares = {r.point_id: r.a for r in clustering.abundances_nnls(table(spark, x), ends).collect()}
    want = clustering.dominant(np.array([shares[i] for i in range(30)]), [i // 5 for i in range(30)])
    assert {r.block_id: r.present for r in clustering.dominant_by_block(table(spark, x), ends).collect()} == want


def test_blocks_are_of_bounded_size(spark):
    x = np.random.default_rng(0).random((400, 2))
    sizes = [r[0] for r in graph.dealt(table(spark, x), "euclidean", 5.0, 32).selectExpr("size(ids)").collect()]
    assert sum(sizes) == 400 and max(sizes) < 3 * 32


@pytest.mark.parametrize(("least", "metric"), [(0.0, "manhattan"), (1e-3, "euclidean"), (0.2, "cosine")])
def test_similarities_of_all_pairs(spark, least, metric):
    x = np.random.default_rng(3).random((70, 3)) * 2 + 0.05
    s = np.exp(-(distances(metric, x, x) ** 2) / (2 * 0.3 * 0.3))
    np.fill_diagonal(s, 1.0)
    rows = clustering.similarity_graph(table(spark, x), metric, 0.3, least=least, block=16).collect()
    got = {(r.i, r.j): r.s for r in rows}
    want = {(i, j): s[i, j] for i in range(70) for j in range(70) if s[i, j] >= least}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_buckets_of_a_graph_follow_its_pairs(spark):
    x = np.array([[0.0], [0.1], [50.0], [50.1], [50.2]])
    blocks = graph.dealt(table(spark, x), "euclidean", 1.0, 2).cache()
    assert graph.most_bytes(blocks) == 16 * (2 * 2 + 3 * 3)
    assert graph.most_bytes(blocks.limit(0)) == 0
