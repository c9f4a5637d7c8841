"""Images in tiles against the same image in one piece."""

import numpy as np
import pytest

from spectrail.operators import fusion, tiles
from spectrail.operators.fusion import Refinement
from spectrail.operators.stencils import denoise_image


def image_rows(spark, images, holes=0.0, y0=0, x0=0, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for key, m in images.items():
        for (y, x), v in np.ndenumerate(m):
            if rng.random() >= holes or (y, x) in ((0, 0), (m.shape[0] - 1, m.shape[1] - 1)):
                rows.append((key, y + y0, x + x0, float(v)))
    return spark.createDataFrame(rows, "element string, y int, x int, value double"), rows


@pytest.mark.parametrize(("tile", "rounds", "holes"), [(4, 7, 0.0), (5, 4, 0.3), (64, 6, 0.2), (16, 1, 0.0)])
def test_denoising_in_tiles(spark, tile, rounds, holes):
    rng = np.random.default_rng(tile)
    images = {"a": rng.random((13, 9)), "b": rng.random((6, 21)), None: rng.random((3, 3))}
    table, rows = image_rows(spark, images, holes, 2, 5)
    got = {(r.element, r.y, r.x): r.value for r in tiles.denoise_maps(table, 0.15, rounds, tile=tile).collect()}
    assert len(got) == len(rows)
    for key, m in images.items():
        dense = np.zeros(m.shape)
        for k, y, x, v in rows:
            if k == key:
                dense[y - 2, x - 5] = v
        want = denoise_image(dense, 0.15, rounds)
        assert all(got[k, y, x] == pytest.approx(want[y - 2, x - 5], abs=1e-12) for k, y, x, _ in rows if k == key)


def test_no_map_gives_no_rows(spark):
    assert tiles.denoise_maps(spark.createDataFrame([], "element string, y int, x int, value double"), 0.1, 3).count() == 0


def composed(spark, height, width, holes, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for y in range(height):
        for x in range(width):
            if rng.random() >= holes or (y, x) in ((0, 0), (height - 1, width - 1)):
                rows.append((y * width + x, y + 3, x + 1, rng.dirichlet(np.ones(3)).tolist(), float(rng.random())))
    return rows, spark.createDataFrame(rows, "pixel_id long, y int, x int, q array<double>, image double").repartition(4)


@pytest.mark.parametrize(
    ("tile", "holes", "change"),
    [(4, 0.0, {"rounds": 4}), (5, 0.4, {"rounds": 3}), (64, 0.2, {"rounds": 5}), (4, 0.9, {"rounds": 3}), (6, 0.1, {"rounds": 3, "tv_rounds": 1}), (6, 0.1, {"rounds": 4, "regularise": False})],
)
def test_refining_in_tiles(spark, tile, holes, change):
    rows, table = composed(spark, 14, 11, holes)
    r, numbers = Refinement(**change), [6.0, 8.0, 26.0]
    y, x = (np.array([row[i] for row in rows]) - low for i, low in ((1, 3), (2, 1)))
    q, image, costs = fusion.refine(np.array([row[3] for row in rows]).T, np.array([row[4] for row in rows]), y, x, numbers, r)
    refined, traces = fusion.refine_image(table, numbers, r, tile)
    got = {p.pixel_id: p for p in refined.collect()}
    assert len(got) == len(rows)
    assert np.allclose([got[row[0]].q for row in rows], q.T, atol=1e-10) and np.allclose([got[row[0]].image for row in rows], image, atol=1e-10)
    found = np.array([list(c)[1:] for c in traces.orderBy("round").collect()])
    assert np.allclose(found, costs, rtol=1e-9)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1)])
def test_refining_thin_images(spark, shape):
    rows, table = composed(spark, *shape, 0.0)
    r = Refinement(rounds=2)
    q, _, costs = fusion.refine(np.array([row[3] for row in rows]).T, np.array([row[4] for row in rows]), np.array([row[1] for row in rows]) - 3, np.array([row[2] for row in rows]) - 1, [6.0, 8.0, 26.0], r)
    refined, traces = fusion.refine_image(table, [6.0, 8.0, 26.0], r, 4)
    got = {p.pixel_id: p.q for p in refined.collect()}
    assert np.allclose([got[row[0]] for row in rows], q.T, atol=1e-10)
    assert np.allclose([list(c)[1:] for c in traces.orderBy("round").collect()], costs, rtol=1e-9)


def test_no_task_gets_a_whole_image(spark):
    """Rows of a tile with its margin, however many tiles there are."""
    rows = spark.range(40 * 40).selectExpr("id as pixel_id", "cast(id div 40 as int) as y", "cast(id % 40 as int) as x")
    sizes = tiles.with_tiles(rows, 8, 2, 40, 40).groupBy("ty", "tx").count().collect()
    assert len(sizes) == 25 and max(r["count"] for r in sizes) == 144
    assert fusion.refine_image(spark.createDataFrame([], "pixel_id long, y int, x int, q array<double>, image double"), [1.0], Refinement(rounds=2))[0].count() == 0
