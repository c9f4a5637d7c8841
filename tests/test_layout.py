"""Levels of blocks, text matrices of many splits, dense rows, lookups in large tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.config import Fit
from spectrail.functions import vectors as V
from spectrail.operators import composition, factorise, lookups, measures, reshape, stencils
from spectrail.operators import kernels as K
from spectrail.plans import catalogue
from spectrail.sources import text_matrix


def test_levels_keep_each_components_order():
    present = {3: [0, 1], 1: [0], 2: [2], 5: [1, 2], 4: [], 6: [3], 7: [0]}
    levels = factorise.levels_of(present)
    assert levels == [[1, 2, 6], [3], [5, 7]]
    rng = np.random.default_rng(0)
    present = {b: rng.choice(8, rng.integers(1, 4), replace=False).tolist() for b in range(60)}
    levels = factorise.levels_of(present)
    at = {b: i for i, level in enumerate(levels) for b in level}
    assert sorted(at) == list(range(60)) and all(at[a] < at[b] for a in at for b in at if a < b and set(present[a]) & set(present[b]))
    assert factorise.levels_of({}) == []


def test_refinement_by_levels_equals_one_after_another(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(0.6, 1.0, (9, 72)) + 0.01
    rows = [(int(i) // 12, int(i), x[:, i].tolist()) for i in range(72)]
    pixels = spark.createDataFrame(rows, "block_id int, pixel_id long, spectrum array<double>").repartition(4)
    present = {0: [0, 1], 1: [2], 2: [1, 3], 3: [0], 4: [], 5: [2, 3]}
    start, fit = rng.random((9, 4)) + 0.1, Fit(components=4, simplex_w=False, max_iter=5)
    want = start.copy()
    for block in sorted(present):
        if own := sorted(present[block]):
            want[:, own] = K.factorise(x[:, 12 * block : 12 * block + 12], np.eye(9), fit.change(components=len(own)), w=want[:, own])[0]
    assert np.allclose(factorise.refine_in_order(pixels, np.eye(9), start, present, fit), want, rtol=1e-9)
    assert factorise.levels_of(present) == [[0, 1], [2, 3], [5]]
    assert np.allclose(factorise.refine_in_order(pixels, np.eye(9), start, {0: []}, fit), start)


@pytest.mark.parametrize("bytes_", ["100b", "128m"])
def test_text_matrix_of_many_splits(spark, tmp_path, bytes_):
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(150, 4)), 3)
    (tmp_path / "m.txt").write_text("150 4\n" + "\n".join(" ".join(map(str, row)) for row in m) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = text_matrix.read_matrix(spark, str(tmp_path / "m.txt"))
        got = np.zeros((150, 4))
        cells = df.collect()
        for r in cells:
            got[r["i"], r["j"]] = r["value"]
        assert len(cells) == 600 and np.array_equal(got, m)
        if bytes_ == "100b":
            assert spark.read.text(str(tmp_path / "m.txt")).rdd.getNumPartitions() > 5
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{name}", value)


def test_text_matrix_of_many_files(spark, tmp_path):
    cells = spark.range(40).selectExpr("id div 4 as i", "id % 4 as j", "id / 3 as value").where("i % 3 <> 1")
    path = str(tmp_path / "out")
    text_matrix.write_matrix(cells, path, 12, 4)
    got = {(r["i"], r["j"]): r["value"] for r in text_matrix.read_matrix(spark, path).collect()}
    assert len(got) == 48 and all(v == ((4 * i + j) / 3 if i < 10 and i % 3 != 1 else 0.0) for (i, j), v in got.items())


def test_rows_of_cells_with_gaps(spark):
    cells = spark.createDataFrame([(1, 5, 2.0), (1, 3, 1.0), (1, 9, 7.0), (2, 4, None), (3, 1, 4.0)], "pixel_id long, channel int, value double")
    got = {r.pixel_id: r.spectrum for r in reshape.to_pixels(cells, 4, 3).collect()}
    assert got == {1: [1.0, 0.0, 2.0, 0.0], 2: [0.0] * 4, 3: [0.0] * 4}
    with pytest.raises(Exception, match="twice"):
        reshape.to_pixels(cells.union(cells), 4, 3).collect()
    assert spark.range(1).select(V.filled(F.array().cast("array<struct<a:int,v:double>>"), "a", "v", 3)).first()[0] == [0.0] * 3


@pytest.mark.parametrize("size", [0, 1, 500])
def test_nearest_in_a_large_table(spark, monkeypatch, size):
    """By ranges: no broadcast of the table, ties to the first key, gaps wider than a range, one key with most rows."""
    rng = np.random.default_rng(size)
    keys = np.sort(np.concatenate([rng.integers(0, 2000, size), rng.integers(90_000, 90_020, size)])).astype(float)
    table = spark.createDataFrame([(float(k), float(i)) for i, k in enumerate(keys)], "k double, v double").repartition(3)
    asked = [float(v) for v in rng.integers(-50, 95_000, 300)] + [45_000.5] * 500 + [float(k) + 0.5 for k in keys[:40]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*asked, None])], "id long, x double")
    monkeypatch.setattr(lookups, "LOOKUP_BYTES", -1)
    df = lookups.nearest(rows, F.col("x"), table, "k", "v", "out")
    got = {r.id: r.out for r in df.collect()}
    assert len(got) == len(asked) + 1 and got[len(asked)] is None and df.columns == ["id", "x", "out"]
    known = [(float(k), float(i)) for i, k in enumerate(keys)]
    for i, v in enumerate(asked):
        assert got[i] == (min(known, key=lambda p: (abs(p[0] - v), p))[1] if known else None)


def test_wide_rows_are_no_small_table(spark):
    wide = spark.range(400).select("id", F.array_repeat(F.lit(1.0), 20_000).alias("x"))
    assert not lookups.fits(wide) and lookups.fits(wide.limit(3)) and lookups.fits(wide.limit(0))
    pixels = spark.createDataFrame([(i, i % 2, [1.0 + i, 2.0]) for i in range(6)], "pixel_id long, block_id int, spectrum array<double>")
    got = {r.pixel_id: r.spectrum for r in measures.poisson_normalised(pixels, by="block_id").collect()}
    for i in range(6):
        mine = np.array([[1.0 + j, 2.0] for j in range(i % 2, 6, 2)])
        assert np.allclose(got[i], np.array([1.0 + i, 2.0]) / np.sqrt(3.0 + i) / np.sqrt(mine.sum(axis=0)))


def test_numbers_of_ids():
    u = K.uniform_by_id(np.arange(20_000), 3, 5)
    assert ((u > 0) & (u < 1)).all() and abs(u.mean() - 0.5) < 0.01 and np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.03
    n = K.normal_by_id(np.arange(20_000), 2, 5)
    assert abs(n.mean()) < 0.02 and abs(n.std() - 1) < 0.02 and np.array_equal(n[7:9], K.normal_by_id(np.array([7, 8]), 2, 5))
    assert not np.allclose(n, K.normal_by_id(np.arange(20_000), 2, 6)) and K.uniform_by_id(np.array([-3, 2**62]), 2, 0).shape == (2, 2)


def test_an_estimator_deals_checks_and_writes_blocks(spark, tmp_path):
    from spectrail.config import BlockFit
    from spectrail.plans.estimators import BlockWiseUnmixing

    rng = np.random.default_rng(2)
    x = rng.gamma(0.8, 1.0, (7, 48)) + 0.01
    pixels = spark.createDataFrame([(i, x[:, i].tolist()) for i in range(48)], "pixel_id long, spectrum array<double>")
    settings = BlockFit(fit=Fit(components=2, max_iter=5), clusters=2, classifier="refined_vca", poisson=True)
    est = BlockWiseUnmixing(np.eye(7), settings, background_rows=0)
    path = str(tmp_path / "blocks")
    rows = est.prepare(pixels, (6, 8), (3, 4), path)
    got = {(r.block_id, r.pixel_id): r.spectrum for r in rows.collect()}
    assert {b for b, _ in got} == {0, 1, 2, 3} and len(got) == 48
    mine = [i for b, i in got if b == 3]
    assert np.allclose(got[3, mine[0]], x[:, mine[0]] / np.sqrt(x[:, mine[0]].sum()) / np.sqrt(x[:, mine].sum(axis=1)))
    h = est.fit_transform(rows, prepared=True).collect()
    assert len(h) == 48 and est.w.shape == (7, 2)
    again = BlockWiseUnmixing(np.eye(7), settings, background_rows=0)
    again.fit_transform(est.prepare(pixels, (6, 8), (3, 4)).select("block_id", "pixel_id", "spectrum"), prepared=True)
    assert np.allclose(again.w, est.w)
    with pytest.raises(ValueError, match="places"):
        est.prepare(pixels.where("pixel_id <> 5"), (6, 8), (3, 4))


def test_a_start_below_the_floor_is_refused_in_safe_fits(spark):
    x = np.random.default_rng(0).random((4, 5)) + 0.1
    pixels = spark.createDataFrame([(i, x[:, i].tolist()) for i in range(5)], "pixel_id long, spectrum array<double>")
    h = spark.createDataFrame([(i, [1.0, -0.5]) for i in range(5)], "pixel_id long, h array<double>")
    for safe in (True, False):
        fit = Fit(components=2, simplex_w=False, max_iter=1, safe=safe)
        if safe:
            with pytest.raises(Exception, match="below the floor"):
                factorise.fit_pixels(pixels, np.eye(4), fit, h=h)
        else:
            assert factorise.fit_pixels(pixels, np.eye(4), fit, h=h)[1].count() == 5


def test_values_of_a_row_are_found_once_and_not_for_each_element(spark):
    """Spark refuses a Python function in a lambda, which runs for each element, and takes it in what a lambda is given."""
    rows = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, None)], "i int, a array<double>")
    same = F.udf(lambda a: a, "array<double>")("a")
    first = F.udf(lambda a: a[0] if a else None, "double")("a")
    found = {
        "share": V.share(same),
        "weight": composition.weight_percent(same, [2.0, 6.0]),
        "scale": V.scale(F.col("a"), first),
        "matvec": V.matvec(V.literal([[1.0, 2.0], [3.0, 4.0]]), same),
        "nearest": V.nearest(V.literal([0.0, 0.9, 5.0]), first),
        "residual": stencils.residual_gradient(first, [1.0, 3.0]),
    }
    got = [r.asDict() for r in rows.select("i", *(c.alias(n) for n, c in found.items())).orderBy("i").drop("i").collect()]
    assert got[0] == {"share": [25.0, 75.0], "weight": [10.0, 90.0], "scale": [1.0, 3.0], "matvec": [7.0, 15.0], "nearest": 1, "residual": [0.5, 1.5]}
    assert got[1] == {"share": [None, None], "weight": [0.0, 0.0], "scale": [0.0, 0.0], "matvec": [0.0, 0.0], "nearest": 0, "residual": [0.0, 0.0]}
    assert got[2] == {"share": None, "weight": None, "scale": None, "matvec": [None, None], "nearest": None, "residual": [None, None]}


@pytest.mark.parametrize("name", ["atomic_to_weight", "quantification_share", "quantification_selected"])
def test_rows_by_element_take_each_spectrum_once_in_a_step(spark, name):
    """Spark repeats an exploded array's expression in the conditions of a filter before it, once in each."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "_m#" in line and "transform(" in line]
    assert steps and all(line.count("coalesce(_m#") == max(1, line.count("size(") + line.count("isnotnull(")) for line in steps)
