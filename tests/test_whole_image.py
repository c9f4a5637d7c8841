"""Fits over all pixels against the block's kernel: stop rules, projected gradients, layout."""

import numpy as np
import pytest

from spectrail.config import Algorithm, Fit
from spectrail.operators import factorise
from spectrail.operators import kernels as K

from .test_kernels import collected, planted, table_of


def case(seed=3, pixels=60, rows=12, k=2):
    rng = np.random.default_rng(seed)
    x = rng.gamma(0.5, 1.0, (rows, k)) @ rng.dirichlet(np.ones(k), pixels).T + 0.01 * rng.random((rows, pixels))
    return x, rng.random((rows, k)) + 0.1, rng.random((k, pixels)) + 0.1


def both(spark, x, w, h, fit, **given):
    g = np.eye(len(x))
    local = K.factorise(x, g, fit, w=w, h=h, **{k: v for k, v in given.items() if k == "fixed_w"})
    far = factorise.fit_pixels(table_of(spark, x), g, fit, w=w, h=table_of(spark, h, "h"), **given)
    return local, (far[0], collected(far[1]), far[2])


STOPS = [
    {"tol": 1e-3},
    {"tol": 2e-3, "max_iter": 60},
    {"tol": 1e-2, "ridge": 0.02, "mu": 0.1},
    {"tol": 1e-3, "l2": True},
    {"tol": 1e-3, "simplex_w": True, "simplex_rows": (0, 1, 2)},
    {"tol": 1e-3, "algorithm": Algorithm.BMD, "normalise": True},
    {"tol": 1e-12, "max_iter": 4},
]


@pytest.mark.parametrize("change", STOPS)
def test_stops_where_the_kernel_does(spark, change):
    x, w, h = case()
    fit = Fit(components=2, **{"simplex_w": False, "max_iter": 30} | change)
    (lw, lh, one), (fw, fh, two) = both(spark, x, w, h, fit)
    assert (one["iterations"], one["stopped"]) == (two["iterations"], two["stopped"])
    assert np.allclose(one["trace"], two["trace"], rtol=1e-9) and two["loss"] == pytest.approx(one["loss"], rel=1e-9)
    assert np.allclose(lw, fw, rtol=1e-6) and np.allclose(lh, fh, rtol=1e-6)
    # the loss is that of what comes back
    scale = fit.components / (x.mean() * len(x)) if fit.normalise else 1.0
    assert two["loss"] == pytest.approx(K.loss(x * scale, fw * scale, fh, fit) / x.size, rel=1e-9)


def test_stops_when_factors_settle(spark):
    """From the solution of a fit, both factors change less than the tolerance before the loss' rule can hold."""
    x, w, h = case(pixels=30)
    fit = Fit(components=2, simplex_w=False, max_iter=30, tol=0.5)
    (_, _, one), (_, _, two) = both(spark, x, w, h, fit)
    assert one["stopped"] == two["stopped"] == "factors settled" and one["iterations"] == two["iterations"]


def test_stops_with_a_fixed_w(spark):
    x, w, h = case(pixels=30)
    fit = Fit(components=2, simplex_w=False, simplex_h=True, max_iter=50, tol=1e-3)
    g = np.eye(len(x))
    lw, lh, one = K.factorise(x, g, fit, w=w, h=h, fixed_w=w)
    _, far, two = factorise.fit_pixels(table_of(spark, x), g, fit, w=w, h=table_of(spark, h, "h"), update_w=False)
    assert (one["iterations"], one["stopped"]) == (two["iterations"], two["stopped"]) and np.allclose(lh, collected(far), rtol=1e-6)


@pytest.mark.parametrize("cut", [1, 2])
def test_a_round_too_many_leaves_nothing(spark, tmp_path, monkeypatch, cut):
    import os

    from spectrail.sources import shared

    for module in (shared, factorise):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    x, w, h = case()
    fit = Fit(components=2, simplex_w=False, max_iter=40, tol=1e-2)
    _, local, one = K.factorise(x, np.eye(len(x)), fit, w=w, h=h)
    _, far, two = factorise.fit_pixels(table_of(spark, x), np.eye(len(x)), fit, w=w, h=table_of(spark, h, "h"), cut_every=cut)
    assert one["iterations"] == two["iterations"] and np.allclose(local, collected(far), rtol=1e-6)
    assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["h"]


GRADIENTS = [
    {},
    {"line_search": True},
    {"line_search": True, "mu": 0.05, "ridge": 0.02},
    {"l2": True, "line_search": True},
    {"simplex_h": True},
    {"simplex_w": True, "line_search": True},
    {"normalise": True, "line_search": True},
]


@pytest.mark.parametrize("change", GRADIENTS)
def test_projected_gradients_equal_the_kernel(spark, change):
    """A higher floor makes the first steps longer, so that the search has both ways to go."""
    x, w, h = case(seed=5, pixels=40)
    floor = 1e-2 if change else 1e-14
    fit = Fit(components=2, algorithm=Algorithm.PROJECTED_GRADIENT, max_iter=6, no_stop=True, floor=floor, **{"simplex_w": False} | change)
    (lw, lh, one), (fw, fh, two) = both(spark, x, w, h, fit)
    assert np.allclose(one["trace"], two["trace"], rtol=1e-8) and np.allclose(lw, fw, rtol=1e-6) and np.allclose(lh, fh, rtol=1e-6)


def test_projected_gradients_stop_and_take_fixed_values(spark):
    x, w, h = case(seed=6, pixels=40)
    fixed = np.full(w.shape, np.nan)
    fixed[0] = w[0]
    fit = Fit(components=2, algorithm=Algorithm.PROJECTED_GRADIENT, simplex_w=False, max_iter=30, floor=1e-2, tol=1e-3, line_search=True)
    (lw, lh, one), (fw, fh, two) = both(spark, x, w, h, fit, fixed_w=fixed)
    assert (one["iterations"], one["stopped"]) == (two["iterations"], two["stopped"])
    assert np.allclose(lw, fw, rtol=1e-6) and np.allclose(lh, fh, rtol=1e-6)


def test_first_steps_are_the_bounds_of_all_pixels(spark):
    x, *_ = planted(pixels=50)
    fit = Fit(components=3, floor=1e-3, ridge=0.1, mu=0.2)
    g = np.random.default_rng(0).random((32, 5))
    spectra = factorise.Spectra(table_of(spark, x), "spectrum")
    try:
        got = factorise.first_steps(spectra, g, 3, fit)
    finally:
        spectra.close()
    assert got == pytest.approx((K.lipschitz_h(x, g, 3, fit), K.lipschitz_w(x, g, 3, fit.floor)), rel=1e-9)


def test_buckets_follow_bytes():
    mb = 1 << 20
    assert [factorise.bucket_count(size, 8) for size in (0, 100, 3 * mb, 800 * mb, 2048 * mb, 100_000 * 128 * mb)] == [1, 1, 3, 8, 16, 100_000]
    for size in (mb, 7 * mb, 900 * mb, 10**13):
        assert size / factorise.bucket_count(size, 200) <= 128 * mb


@pytest.mark.parametrize("change", [{}, {"algorithm": Algorithm.PROJECTED_GRADIENT, "line_search": True, "floor": 1e-2}])
def test_a_dictionary_that_follows_w(spark, change):
    """G made anew after each step of W, in memory and over all pixels."""
    x, w, h = case(seed=8, pixels=30)
    first = np.random.default_rng(0).random((12, 12)) * 0.1 + np.eye(12)
    anew = lambda now: np.hstack([first[:, :-1], first[:, -1:] * (1 + now[0].mean())])
    fit = Fit(components=2, **{"simplex_w": False, "max_iter": 5, "tol": 1e-3} | change)
    lw, lh, one = K.factorise(x, first, fit, w=w, h=h, refresh=anew)
    fw, far, two = factorise.fit_pixels(table_of(spark, x), first, fit, w=w, h=table_of(spark, h, "h"), refresh=anew)
    assert (one["iterations"], one["stopped"]) == (two["iterations"], two["stopped"]) and np.allclose(one["trace"], two["trace"], rtol=1e-9)
    assert np.allclose(lw, fw, rtol=1e-6) and np.allclose(lh, collected(far), rtol=1e-6) and not np.allclose(two["g"], first)
