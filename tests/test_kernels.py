import numpy as np
import pytest

from spectrail.config import Algorithm, Fit, Init, Instrument
from spectrail.operators import clustering, factorise, filters, partitioning, stencils
from spectrail.operators import kernels as K


def planted(seed=0, channels=32, k=3, pixels=400, noise=False):
    rng = np.random.default_rng(seed)
    w, h = rng.random((channels, k)) + 0.05, rng.dirichlet(np.ones(k) * 0.5, pixels).T
    x = w @ h * 50
    return (rng.poisson(x).astype(float) if noise else x), w, h


@pytest.mark.parametrize("algorithm", [Algorithm.LOG_SURROGATE, Algorithm.BMD])
@pytest.mark.parametrize("init", list(Init))
def test_loss_falls(algorithm, init):
    x, *_ = planted(noise=True)
    fit = Fit(components=3, init=init, algorithm=algorithm, simplex_w=False, max_iter=40, no_stop=True)
    w, h, report = K.factorise(x, np.eye(len(x)), fit)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(report["trace"], report["trace"][1:]))
    assert (w >= 0).all() and (h >= 0).all()


def test_recovers_a_planted_product():
    x, *_ = planted()
    w, h, _ = K.factorise(x, np.eye(len(x)), Fit(components=3, simplex_w=False, max_iter=2000, tol=1e-12))
    assert np.linalg.norm(w @ h - x) < 0.03 * np.linalg.norm(x)


def test_simplex_columns_add_up_and_fixed_entries_stay():
    x, *_ = planted()
    fixed = np.full((32, 3), np.nan)
    fixed[0, 0] = 0.25
    w, _, _ = K.factorise(x, np.eye(32), Fit(components=3, max_iter=20, no_stop=True))
    assert np.allclose(w.sum(axis=0), 1, atol=1e-4)
    w, _, _ = K.factorise(x, np.eye(32), Fit(components=3, simplex_w=False, max_iter=5, no_stop=True), fixed_w=fixed)
    _, h, _ = K.factorise(x, np.eye(32), Fit(components=3, simplex_w=False, simplex_h=True, max_iter=5, no_stop=True))
    assert np.allclose(h.sum(axis=0), 1, atol=1e-3)


def test_l2_and_projected_gradient():
    x, *_ = planted()
    w, h, report = K.factorise(x, np.eye(32), Fit(components=3, simplex_w=False, l2=True, max_iter=50, no_stop=True))
    assert report["trace"][-1] < report["trace"][0]
    fit = Fit(components=3, simplex_w=False, algorithm=Algorithm.PROJECTED_GRADIENT, floor=0.05, max_iter=3, line_search=True)
    w, h, _ = K.factorise(x, np.eye(32), fit)
    assert (h > 0).all() and (w > 0).all()


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Fit(simplex_w=True, simplex_h=True)
    with pytest.raises(ValueError):
        Fit(l2=True, mu=1.0)
    with pytest.raises(ValueError):
        Fit(algorithm=Algorithm.L2_SURROGATE)
    with pytest.raises(ValueError):
        K.factorise(np.array([[-1.0, 1.0]]), np.eye(1), Fit(components=1))
    assert Instrument(200.0, 10, 0.1, 0.0, ("Fe", "O"), split_elements=("Fe",), split_energies=(1.0,)).dictionary_columns == 5


@pytest.mark.parametrize("k", [1, 2, 5])
def test_bisection(k):
    rng = np.random.default_rng(k)
    num, den = rng.random((k, 50)) + 0.1, rng.random((k, 50)) + 0.1
    nu = K.bisection(num, den, 1e-14, 1e-10)
    assert np.allclose(np.maximum(num / (den + nu), 1e-14).sum(axis=0), 1, atol=1e-8)
    a = rng.standard_normal((k, 50))
    assert np.allclose(np.maximum(a + K.projection(a, 1e-14, 1e-10), 1e-14).sum(axis=0), 1, atol=1e-8)
    with pytest.raises(ValueError):
        K.bisection(np.zeros((k, 1)), np.ones((k, 1)), 1e-14)


def test_nnls():
    rng = np.random.default_rng(3)
    a, x = rng.random((20, 4)), np.array([0.0, 1.5, 0.0, 0.5])
    assert np.allclose(K.nnls(a, a @ x), x, atol=1e-8)
    b = rng.standard_normal(20)
    got = K.nnls(a, b)
    slope = a.T @ (b - a @ got)
    assert (got >= 0).all() and (slope <= 1e-8).all() and abs(slope @ got) < 1e-8


def test_vca_finds_vertices():
    rng = np.random.default_rng(5)
    ends = rng.random((12, 3))
    shares = np.concatenate([np.eye(3), rng.dirichlet(np.ones(3), 200)])
    found, _ = clustering.vca((ends @ shares.T), 3)
    assert sorted(found) == [0, 1, 2]
    with pytest.raises(ValueError):
        clustering.vca(ends, 0)


def test_dominant_resolves_conflicts():
    assert clustering.dominant(np.array([[0.9, 0.1, 0.2], [0.8, 0.3, 0.1], [0.1, 0.2, 0.9]]), [0, 0, 1]) == {0: [0, 1], 1: [2]}


def test_separate():
    w = np.array([[0.99, 0.3, 1e-4], [0.005, 0.4, 0.5], [0.005, 0.3, 0.5]])
    m = filters.separate(w, 1)
    assert m[0].tolist() == [1.0, 0.0, 0.0] and m[:, 0].tolist() == [1.0, 0.0, 0.0] and np.allclose(m.sum(axis=0), 1)
    m = filters.separate(np.array([[0.5, 0.2], [0.48, 0.3], [0.02, 0.5]]), 2)
    assert m[2, 0] == 0 and m[:2, 1].tolist() == [0, 0]


def test_kmeans_and_denoise():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in (0, 3, 6)])
    labels, centres, _ = clustering.kmeans(data, 3, 50, 1e-9, 1)
    assert len(set(labels.tolist())) == 3 and sorted(np.round(centres.mean(axis=1)).tolist()) == [0, 3, 6]
    image = np.zeros((12, 20))
    image[:, 10:] = 1.0
    noisy = image + np.random.default_rng(1).normal(0, 0.1, image.shape)
    assert np.abs(stencils.denoise_image(noisy, 0.15, 20) - image).mean() < np.abs(noisy - image).mean()


def test_distributed_fit_equals_local(spark):
    x, *_ = planted(pixels=90, noise=True)
    x = np.maximum(x, 0.5)
    pixels = spark.createDataFrame([(i, x[:, i].tolist()) for i in range(x.shape[1])], "pixel_id long, spectrum array<double>")
    fit = Fit(components=3, simplex_w=False, max_iter=4, no_stop=True, ridge=0.01)
    start = np.random.default_rng(2).random((32, 3)) + 0.1
    local_w, local_h, _ = K.factorise(x, np.eye(32), fit.change(simplex_w=True, simplex_rows=(0,), ridge=0.0), w=start)
    for parts in (1, 5):
        w, h, report = factorise.fit_pixels(pixels.repartition(parts), np.eye(32), fit.change(simplex_w=True, simplex_rows=(0,), ridge=0.0), w=start)
        got = np.array([r["h"] for r in h.orderBy("pixel_id").collect()]).T
        assert np.allclose(w, local_w, atol=1e-8) and np.allclose(got, local_h, atol=1e-8)


@pytest.mark.parametrize("change", [{}, {"ridge": 0.02, "mu": 0.1}, {"l2": True}, {"normalise": True}, {"algorithm": Algorithm.BMD}])
def test_distributed_variants_equal_local(spark, change):
    x, *_ = planted(seed=4, pixels=40, noise=True)
    pixels = spark.createDataFrame([(i, x[:, i].tolist()) for i in range(x.shape[1])], "pixel_id long, spectrum array<double>")
    fit = Fit(components=2, simplex_w=False, max_iter=3, no_stop=True, **change)
    start = np.random.default_rng(2).random((32, 2)) + 0.1
    local_w, local_h, _ = K.factorise(x, np.eye(32), fit, w=start)
    w, h, _ = factorise.fit_pixels(pixels.repartition(3), np.eye(32), fit, w=start)
    got = np.array([r["h"] for r in h.orderBy("pixel_id").collect()]).T
    assert np.allclose(w, local_w, rtol=1e-6) and np.allclose(got, local_h, rtol=1e-6)


def test_gram_start_equals_local(spark):
    x, *_ = planted(seed=6, pixels=60)
    pixels = spark.createDataFrame([(i, x[:, i].tolist()) for i in range(x.shape[1])], "pixel_id long, spectrum array<double>")
    assert np.allclose(factorise.gram(pixels.repartition(4)), x @ x.T)
    w, h, report = factorise.fit_pixels(pixels, np.eye(32), Fit(components=3, simplex_w=False, max_iter=25, no_stop=True))
    got = np.array([r["h"] for r in h.orderBy("pixel_id").collect()]).T
    fit = Fit(components=3, simplex_w=False, max_iter=25, no_stop=True)
    local_w, local_h, _ = K.factorise(x, np.eye(32), fit, w=factorise.nndsvd_start(pixels, np.eye(32), fit))
    assert np.allclose(w @ got, local_w @ local_h, rtol=1e-6)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(report["trace"], report["trace"][1:]))


def table_of(spark, m, name="spectrum"):
    return spark.createDataFrame([(i, m[:, i].tolist()) for i in range(m.shape[1])], f"pixel_id long, {name} array<double>").repartition(3)


def collected(h):
    return np.array([r["h"] for r in h.orderBy("pixel_id").collect()]).T


def two_sided(seed=0):
    """Spectra of which a component's larger side of u isn't the larger side of u and v together."""
    rng = np.random.default_rng(seed)
    while True:
        x = rng.gamma(0.3, 1.0, (12, 40))
        u, _, v = np.linalg.svd(x, full_matrices=False)
        up, un = (np.linalg.norm(np.maximum(sign * u[:, 1:3], 0), axis=0) for sign in (1, -1))
        vp, vn = (np.linalg.norm(np.maximum(sign * v[1:3], 0), axis=1) for sign in (1, -1))
        if ((up > un) != (up * vp > un * vn)).any():
            return x


@pytest.mark.parametrize("init", [Init.NNDSVD, Init.NNDSVDA])
def test_distributed_svd_start_equals_local(spark, init):
    x, fit = two_sided(), Fit(components=3, init=init, simplex_w=False, max_iter=3, no_stop=True)
    d, h = K.start_factors(x, 3, init, fit.eps, 0)
    assert np.allclose(factorise.nndsvd_start(table_of(spark, x), np.eye(12), fit), np.maximum(d, fit.floor), atol=1e-8)
    if init == Init.NNDSVDA:
        local_w, local_h, _ = K.factorise(x, np.eye(12), fit)
        w, h, _ = factorise.fit_pixels(table_of(spark, x), np.eye(12), fit)
        assert np.allclose(w, local_w, rtol=1e-6) and np.allclose(collected(h), local_h, rtol=1e-6)


@pytest.mark.parametrize("init", [Init.RANDOM, Init.NNDSVDAR])
def test_distributed_random_starts(spark, init):
    x, pixels = two_sided(), 40
    fit = Fit(components=3, init=init, simplex_w=False, seed=1)
    w, h = factorise.start(table_of(spark, x), np.eye(12), fit, None, None)
    again = factorise.start(table_of(spark, x).repartition(7), np.eye(12), fit, None, None)[1]
    got, (d, local) = collected(h), K.start_factors(x, 3, init, fit.eps, 1)
    assert np.allclose(got, collected(again), rtol=1e-9) and not np.allclose(got, collected(factorise.start(table_of(spark, x), np.eye(12), fit.change(seed=2), None, None)[1]))
    assert got.shape == (3, pixels)
    if init == Init.RANDOM:
        assert np.allclose(w, np.maximum(d, fit.floor)) and 0.6 < got.mean() / (np.sqrt(2 / np.pi * x.mean())) < 1.4
    else:
        base = K.start_factors(x, 3, Init.NNDSVD, fit.eps, 1)[1]
        assert np.allclose(got[base > 0], base[base > 0], atol=1e-8) and (got[base == 0] < x.mean() / 15).all() and (got > 0).all()


@pytest.mark.parametrize("change", [{"ridge": 0.05, "line_search": True}, {"safe": True}, {"safe": True, "normalise": True}])
def test_distributed_options_equal_local(spark, change):
    x, *_ = planted(seed=4, pixels=40, noise=True)
    if "safe" in change:
        x[:, 3], x[5] = 0, 0
    fit = Fit(components=2, simplex_w=False, max_iter=5, no_stop=True, **change)
    begin = np.random.default_rng(2).random((32, 2)) + 0.1
    local_w, local_h, _ = K.factorise(x, np.eye(32), fit, w=begin)
    w, h, _ = factorise.fit_pixels(table_of(spark, x), np.eye(32), fit, w=begin)
    assert np.allclose(w, local_w, rtol=1e-6) and np.allclose(collected(h), local_h, rtol=1e-6)


@pytest.mark.parametrize("with_w", [True, False])
def test_distributed_fit_takes_a_start_and_fixed_values_of_h(spark, with_w):
    x, *_ = planted(seed=5, pixels=40, noise=True)
    rng, fit = np.random.default_rng(3), Fit(components=2, simplex_w=False, simplex_h=True, max_iter=3, no_stop=True)
    begin, fixed = rng.random((2, 40)) + 0.1, np.full((2, 40), np.nan)
    fixed[0, :5], fixed[1, 7] = 0.25, 0.5
    w0 = rng.random((32, 2)) + 0.1 if with_w else None
    local_w, local_h, _ = K.factorise(x, np.eye(32), fit, w=w0, h=begin, fixed_h=fixed)
    w, h, _ = factorise.fit_pixels(table_of(spark, x), np.eye(32), fit, w=w0, h=table_of(spark, begin, "h"), fixed_h=table_of(spark, fixed, "h").where("pixel_id < 20"))
    assert np.allclose(w, local_w, rtol=1e-6) and np.allclose(collected(h), local_h, rtol=1e-6)


def test_elbow_and_blocks(spark):
    rows = [(0, i, float(np.exp(-3 * i) if i < 3 else np.exp(-9 - 0.01 * i))) for i in range(25)]
    df = spark.createDataFrame(rows, "block_id int, comp int, ratio double")
    assert partitioning.elbow(df).first()["n_relevant"] == 3
    assert partitioning.best_block(spark, 10, 10, 1, 1e12).count() == 0


def test_a_pass_moves_abundances_only(spark):
    pixels = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "pixel_id long, spectrum array<double>")
    spectra = factorise.Spectra(pixels, "spectrum")
    try:
        h = spark.createDataFrame([(i, [1.0]) for i in range(50)], "pixel_id long, h array<double>")
        df = factorise._pass(spectra, h, np.ones((2, 1)), None, Fit(components=1, simplex_w=False))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "ShuffledHashJoin" in plan and "Bucketed: true" in plan
        assert df.count() == 50
    finally:
        spectra.close()
    assert not spark.catalog.tableExists(spectra.name)


def test_ragged_and_null_spectra_are_refused(spark):
    import pyarrow as pa

    kind = pa.list_(pa.float64())
    assert K.matrix(pa.array([[1.0, 2.0], [3.0, None]], kind))[0].tolist() == [1.0, 3.0]
    for rows in ([[1.0, 2.0], None], [[1.0, 2.0, 3.0], [4.0]]):
        with pytest.raises(ValueError):
            K.matrix(pa.array(rows, kind))
        pixels = spark.createDataFrame(list(enumerate(rows)), "pixel_id long, spectrum array<double>").repartition(1)
        with pytest.raises(Exception, match="values"):
            factorise.solve_fixed(pixels, np.ones((2, 1))).collect()


def test_shares_by_rows_equal_active_sets(spark):
    rng = np.random.default_rng(2)
    ends, v = rng.random((12, 3)), rng.random((40, 12)) - 0.2
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "point_id long, features array<double>")
    got = {r.point_id: r.a for r in clustering.abundances_nnls(points, ends).collect()}
    assert all(np.allclose(got[i], np.maximum(K.nnls(ends, r), 1e-10), atol=1e-8) for i, r in enumerate(v))


def test_files_of_a_fit_are_deleted(spark, tmp_path, monkeypatch):
    import os

    from spectrail.sources import shared

    for module in (shared, factorise):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    x, *_ = planted(pixels=30)
    factorise.fit_pixels(table_of(spark, x), np.eye(32), Fit(components=2, max_iter=7, no_stop=True), cut_every=2)
    assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["h"]
