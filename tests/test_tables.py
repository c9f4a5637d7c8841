import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.config import Absorption, Fusion, Instrument, ProblemType
from spectrail.functions import physics as P
from spectrail.functions import text as X
from spectrail.functions import vectors as V
from spectrail.operators import absorption, composition, dictionary, filters, lookups, measures, reshape
from spectrail.plans.estimators import BlockWiseUnmixing, Unmixing
from spectrail.config import BlockFit, Fit
from spectrail.sources import blocks, databases, text_matrix


def test_text_matrix_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5), (1, 2, math.pi), (2, 1, -0.1)], "i long, j int, value double")
    text_matrix.write_matrix(cells, f"{tmp_path}/m", 3, 3)
    got = {(r.i, r.j): r.value for r in text_matrix.read_matrix(spark, f"{tmp_path}/m").collect()}
    assert len(got) == 9 and got[1, 2] == math.pi and got[2, 1] == -0.1 and got[0, 1] == 0.0
    text_matrix.write_matrix(cells.select("i", "value"), f"{tmp_path}/v", 3)
    assert [r.thickness for r in text_matrix.pixel_vector(spark, f"{tmp_path}/v").orderBy("pixel_id").collect()] == [1.5, math.pi, -0.1]
    with pytest.raises(Exception):
        text_matrix.read_matrix(spark, f"{tmp_path}/none")


def test_databases(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n"table": {"Fe": {"atomic_mass": 55.8, "density": 7.9, "number": 26},\n "O": {"atomic_mass": 16.0, "density": 0.0014, "number": 8}}}')
    (tmp_path / "l.json").write_text('{"table": {"Fe": {"KL3": {"energy": 6.4, "cs": 2.0}}}}')
    (tmp_path / "m.json").write_text('{"interpolated_MACs": {"Fe": {"energies (keV)": [1.0, 2.0], "mass_absorption_coefficient (cm2/g)": [9.0, 8.0]}}}')
    (tmp_path / "n.json").write_text('{\n"Ka": ["KL3","KL2"],\n"Ka1": ["KL3"]}')
    (tmp_path / "e.txt").write_text("1.0 0.5\n\n  2.0   0.7\n")
    assert databases.periodic_table(spark, f"{tmp_path}/p.json").count() == 2
    assert databases.xray_lines(spark, f"{tmp_path}/l.json", ["Fe"]).first()["energy"] == 6.4
    with pytest.raises(ValueError):
        databases.xray_lines(spark, f"{tmp_path}/l.json", ["Xx"])
    assert sorted(r.mac for r in databases.absorption_coefficients(spark, f"{tmp_path}/m.json").collect()) == [8.0, 9.0]
    assert {r.name: len(r.aliases) for r in databases.line_names(spark, f"{tmp_path}/n.json").collect()} == {"Ka": 2, "Ka1": 1}
    assert sorted(r.efficiency for r in databases.detector_efficiency(spark, f"{tmp_path}/e.txt").collect()) == [0.5, 0.7]


def test_blocks_round_trip_with_ragged_edges(spark, tmp_path):
    pixels = spark.createDataFrame([(i, [float(i), float("nan")]) for i in range(12)], "pixel_id long, spectrum array<double>")
    rows = blocks.with_blocks(pixels, 2, 3, 4)
    assert {r.block_id for r in rows.collect()} == {0, 1, 2, 3}
    blocks.write_blocks(rows, f"{tmp_path}/b")
    back = blocks.read_blocks(spark, f"{tmp_path}/b", "spectrum")
    assert back.count() == 12 and back.where("pixel_id = 5").first()["spectrum"] == [5.0, 1e-14]


def test_simpson(spark):
    one = spark.range(1)
    for n, exact in ((2, 0.5), (3, 8 / 3), (4, 9.0), (5, 64 / 3)):
        y = V.literal([float(i * i) for i in range(n)])
        assert one.select(V.simpson(y).alias("v")).first()["v"] == pytest.approx(exact)
        assert one.select(V.simpson_at(y, V.literal([float(i) for i in range(n)])).alias("v")).first()["v"] == pytest.approx(exact)
    x = [0.0, 0.5, 2.0, 2.5, 4.0, 4.1]
    got = one.select(V.simpson_at(V.literal([v * v for v in x]), V.literal(x)).alias("v")).first()["v"]
    assert got == pytest.approx(4.1**3 / 3)
    with pytest.raises(Exception):
        one.select(V.simpson(V.literal([1.0]))).collect()


def test_guards_and_lookups(spark):
    bad = spark.createDataFrame([(0, [1.0, -1.0])], "pixel_id long, spectrum array<double>")
    with pytest.raises(Exception, match="negative"):
        filters.non_negative(bad).collect()
    table = spark.createDataFrame([("Fe", 26, 55.8, 7.9)], "element string, number int, atomic_mass double, density double")
    with pytest.raises(Exception, match="not in the table"):
        lookups.lookup(spark.createDataFrame([("Zz",)], "element string"), table).collect()
    with pytest.raises(ValueError):
        composition.element_values(table, ["Zz"])
    with pytest.raises(ValueError):
        composition.mixture_density(F.array(F.lit(1.0)), [0.0])
    with pytest.raises(ValueError):
        V.distance("minkowski", F.col("a"), F.col("b"), 11)
    zero = spark.range(1).select(V.share(V.literal([0.0, 0.0])).alias("s"), composition.weight_percent(V.literal([0.0, 0.0]), [1.0, 2.0]).alias("w")).first()
    assert zero["s"] == [None, None] and zero["w"] == [0.0, 0.0]


def test_absorption_kernel_equals_columns(spark):
    q = spark.createDataFrame([(0, [60.0, 40.0], 100.0), (1, [0.0, 0.0], 100.0), (2, [1.0, 3.0], 0.0)], "pixel_id long, q array<double>, t double")
    macs, masses, rho = np.array([[900.0, 50.0], [400.0, 20.0]]), [55.8, 16.0], [7.9, 2.0]
    got = {r.pixel_id: r.a for r in absorption.correction_spectra(q, "q", "t", macs, masses, rho, 22.0).collect()}
    for c in range(2):
        want = {r.pixel_id: r.v for r in q.select("pixel_id", absorption.correction(F.col("q"), macs[:, c], masses, rho, F.col("t"), 22.0).alias("v")).collect()}
        assert all(got[k][c] == pytest.approx(want[k]) for k in want)
    assert got[1] == [1.0, 1.0] and got[2] == [1.0, 1.0]


def test_dictionary_drops_elements_without_peaks(spark):
    lines = spark.createDataFrame([("Fe", "Ka", 0.5, 1.0), ("Fe", "Kb", 0.9, 1.0), ("U", "Ma", 50.0, 1.0), ("O", "Ka", 0.5, 1.0)], "element string, line string, energy double, cs double")
    eff = spark.createDataFrame([(0.1, 0.9), (0.8, 0.8)], "energy double, efficiency double")
    inst = Instrument(200.0, 40, 0.05, 0.1, ("Fe", "U", "O"), split_elements=("Fe",), split_energies=(0.7,), absorption=Absorption.NONE)
    names = {r.g_name for r in dictionary.dictionary(spark, inst, lines, eff).select("g_name").distinct().collect()}
    assert names == {"Fe_low", "Fe_high", "O", "background_0", "background_1"}
    identity = Instrument(200.0, 4, 0.05, 0.1, ("Fe",), problem=ProblemType.IDENTITY)
    assert dictionary.dictionary(spark, identity, lines, eff).count() == 4


def test_ordinals(spark):
    rows = spark.createDataFrame([(v,) for v in ("1", "2", "3", "11", "112", "1011", "21", "x")], "v string")
    assert [r[0] for r in rows.select(X.ordinal(F.col("v"))).collect()] == ["1st", "2nd", "3rd", "11th", "112th", "1011th", "21st", "x"]


def test_energy_index_rounds_away_from_zero(spark):
    got = spark.range(1).select(*(P.energy_index(e, 1.0, 0.0) for e in (0.5, 2.5, -0.5))).first()
    assert list(got) == [1, 3, -1]


def test_dense_sum_equals_long_sum(spark):
    pixels = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "pixel_id long, spectrum array<double>")
    assert reshape.dense_sum(pixels).first()["total"] == [45.0, 10.0]
    assert {r.channel: r.total for r in reshape.summed_spectrum(pixels).collect()} == {0: 45.0, 1: 10.0}


def test_estimators_end_to_end(spark):
    rng = np.random.default_rng(0)
    names = ["Fe", "O", "Si"]
    w = np.array([[0.7, 0.1], [0.2, 0.3], [0.1, 0.6]])
    g = np.abs(rng.standard_normal((16, 3))) + 0.1
    h = rng.dirichlet([0.4, 0.4], 64).T
    x = g @ w @ h * 200
    pixels = spark.createDataFrame([(i, i // 8, i % 8, i // 32, x[:, i].tolist(), float(h[0, i])) for i in range(64)], "pixel_id long, y int, x int, block_id int, spectrum array<double>, image double")
    table = spark.createDataFrame([("Fe", 26, 55.8, 7.9), ("O", 8, 16.0, 1.4), ("Si", 14, 28.1, 2.3)], "element string, number int, atomic_mass double, density double")
    est = Unmixing(g, Fit(components=2, max_iter=15), names, table, background_rows=0)
    est.fit_transform(pixels.select("pixel_id", "spectrum"))
    assert np.allclose(est.w.sum(axis=0), 1, atol=1e-3)
    spectra, loadings, q = est.results()
    assert spectra.shape == (2, 16) and loadings.count() == 64
    assert all(sum(r.q) == pytest.approx(100) for r in q.collect())
    maps = est.maps()
    assert maps.where("density > 0 and mean_z > 0").count() == 64
    low = spark.createDataFrame([(i, [100.0, 50.0, 20.0, 10.0, 5.0]) for i in range(64)], "pixel_id long, spectrum array<double>")
    t = est.thickness(low, maps, 2.0, 1.0, 0.0, 200.0, 15.0, 10.0)
    assert t.where("thickness > 0").count() == 64
    macs = spark.createDataFrame([(e, 1.0, 100.0) for e in names], "element string, energy double, mac double")
    a = est.absorption(macs, [1.0] * 16, names, 22.0, thickness_map=t)
    assert a.count() == 64
    est.refine(pixels.select("pixel_id", "y", "x", "block_id"), pixels.select("pixel_id", "image"), names)
    assert est.costs.count() == 60 and est.absorption(macs, [1.0] * 16, names, 22.0, thickness_nm=50.0, source=Fusion.HAADF).count() == 64
    assert est.report().count() == 6 and est.residual(pixels.select("pixel_id", "spectrum"), 1).count() == 64
    for kind in ("vca", "refined_vca", "spectral", "refined_spectral"):
        bw = BlockWiseUnmixing(g, BlockFit(fit=Fit(components=2, max_iter=10), clusters=2, classifier=kind), names, table, background_rows=0)
        assert bw.fit_transform(pixels).count() == 64
    assert bw.abundances(pixels).count() == 64


def test_streaming_sum(spark, tmp_path):
    from spectrail.streaming import accumulate

    spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "pixel_id long, spectrum array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("pixel_id long, spectrum array<double>").parquet(f"{tmp_path}/in")
    run = accumulate(stream).format("memory").queryName("summed").start()
    run.processAllAvailable()
    run.stop()
    assert {r.channel: r.total for r in spark.table("summed").collect()} == {0: 4.0, 1: 6.0}


def test_renamed_lines_with_names_of_any_number(spark, monkeypatch):
    """Names that are sent whole and names that are joined give the same rows."""
    lines = spark.createDataFrame([(26, "KL3", 6.4, 1.0), (26, "KM3", 7.1, 0.1), (29, "KL3", 8.0, 1.0), (29, None, 0.9, 0.5)], "number int, line string, energy double, cs double")
    names = spark.createDataFrame([("Ka1", ["KL3"]), ("Kb", ["KM3", "KM2"])], "name string, aliases array<string>")
    elements = spark.createDataFrame([(26, "Fe"), (29, "Cu")], "number int, element string")
    for most in (100_000, 0):
        monkeypatch.setattr(lookups, "LOOKUP_ROWS", most)
        found = {tuple(r) for r in lookups.renamed_lines(lines, names, elements).collect()}
        assert found == {("Fe", "Ka1", 6.4, 1.0), ("Fe", "KM3", 7.1, 0.1), ("Cu", "Ka1", 8.0, 1.0), ("Cu", None, 0.9, 0.5)}


def test_nearest_in_any_number_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    keys = [float(k) for k in rng.integers(0, 40, 60)] + [None]
    table = spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)], "k double, v double")
    rows = spark.createDataFrame([(float(x),) for x in np.arange(-2, 44, 0.25)] + [(None,)], "x double")
    known = sorted((k, float(i)) for i, k in enumerate(keys) if k is not None)
    want = {x: min(known, key=lambda p: (abs(p[0] - x), p))[1] for x in np.arange(-2, 44, 0.25)}
    for most in (100_000, 7):
        monkeypatch.setattr(lookups, "LOOKUP_ROWS", most)
        got = {r.x: r.out for r in lookups.nearest(rows, F.col("x"), table, "k", "v", "out").collect()}
        assert got.pop(None) is None and got == want
    empty = lookups.nearest(rows, F.col("x"), table.limit(0), "k", "v", "out")
    assert empty.where("out is not null").count() == 0 and empty.count() == rows.count()


def test_joins_of_few_keys_move_the_small_side(spark):
    cells = spark.range(1000).select((F.col("id") % 100).alias("pixel_id"), (F.col("id") % 4).alias("channel"), (F.col("id") % 13).cast("double").alias("value"))
    for df in (measures.min_max_scaled(cells), filters.without_zero_lines(cells, 1e-3).select("channel")):
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_results_in_a_folder(spark, tmp_path):
    from spectrail.sources import results

    table = spark.createDataFrame([("Fe", 26, 55.8, 7.9), ("O", 8, 16.0, 0.0014)], "element string, number int, atomic_mass double, density double")
    pixels = spark.createDataFrame([(i, [float(i + 1), 2.0, 3.0]) for i in range(6)], "pixel_id long, spectrum array<double>")
    est = Unmixing(np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]), Fit(components=2, max_iter=5), ["Fe", "O"], table, background_rows=0)
    est.fit_transform(pixels)
    a = pixels.select("pixel_id", F.col("spectrum").alias("a"))
    est.save(f"{tmp_path}/r", a)
    other = Unmixing(np.eye(3), background_rows=0)
    h = {r.pixel_id: r.h for r in other.load(spark, f"{tmp_path}/r").collect()}
    assert h == {r.pixel_id: r.h for r in est.h.collect()} and np.allclose(other.w, est.w) and np.allclose(other.g, est.g) and other.names == ["Fe", "O"]
    assert other.q.count() == 6 and results.read_results(spark, f"{tmp_path}/r").a.count() == 6 and results.read_h(spark, f"{tmp_path}/r").count() == 6
    with pytest.raises(Exception):
        est.save(f"{tmp_path}/r")


def test_instrument_of_metadata():
    tem = {"beam_energy": 200, "Detector": {"EDS": {"azimuth_angle": 1.0, "elevation_angle": 18.0}}, "Stage": {"tilt_alpha": 2.0}}
    meta, axis = {"Acquisition_instrument": {"TEM": tem}, "Sample": {"elements": ["Fe", "O"]}}, {"size": 2048, "scale": 0.01, "offset": -0.2}
    inst = Instrument.from_metadata(meta, axis, elevation=None, thickness=50.0)
    assert (inst.beam_energy, inst.elevation, inst.tilt, inst.axis_size, inst.elements, inst.thickness) == (200.0, 18.0, 2.0, 2048, ("Fe", "O"), 50.0)
    assert Instrument.from_metadata({}, axis, beam_energy=100.0, azimuth=0.0, elevation=22.0, tilt=0.0, elements=("Al",)).beam_energy == 100.0
    with pytest.raises(ValueError, match="elements"):
        Instrument.from_metadata({"Acquisition_instrument": {"TEM": tem}}, axis)


def test_images_are_checked(spark):
    pixels = spark.range(12).withColumnRenamed("id", "pixel_id")
    assert blocks.checked(pixels, 3, 4).count() == 12
    for bad in (pixels.where("pixel_id <> 5"), pixels.union(pixels.limit(1)), pixels.selectExpr("pixel_id + 1 AS pixel_id")):
        with pytest.raises(ValueError):
            blocks.checked(bad, 3, 4)


def test_noise_is_normalised_by_block(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(1, 9, (20, 5)).astype(float)
    pixels = spark.createDataFrame([(i, i // 10, r.tolist()) for i, r in enumerate(x)], "pixel_id long, block_id int, spectrum array<double>")
    got = {r.pixel_id: r.spectrum for r in measures.poisson_normalised(pixels, by="block_id").collect()}
    for b in range(2):
        own = x[10 * b : 10 * b + 10]
        assert np.allclose([got[10 * b + k] for k in range(10)], own / (np.sqrt(own.sum(axis=1))[:, None] * np.sqrt(own.sum(axis=0))))
    est = BlockWiseUnmixing(np.eye(5), BlockFit(fit=Fit(components=2, max_iter=5), clusters=2, poisson=True), background_rows=0)
    assert est.fit_transform(pixels).count() == 20


def test_verbose_fits_report(spark, capsys):
    pixels = spark.createDataFrame([(i, [float(i + 1), 2.0]) for i in range(6)], "pixel_id long, spectrum array<double>")
    est = Unmixing(np.eye(2), Fit(components=1, max_iter=3, no_stop=True, verbose=True), background_rows=0)
    est.fit_transform(pixels)
    assert "round 1: loss" in capsys.readouterr().out and est.report_of_fit["seconds"] > 0


def test_values_below_the_floor_are_refused(spark):
    rows = spark.createDataFrame([(1.0,), (-1e-16,)], "v double").select(filters.above_floor(F.col("v"), 1e-14).alias("v"))
    assert rows.count() == 2
    with pytest.raises(Exception, match="below the floor"):
        spark.createDataFrame([(-1.0,)], "v double").select(filters.above_floor(F.col("v"), 1e-14).alias("v")).collect()


def test_a_local_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from spectrail.sources import shared

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    own = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]", applicationId="a"))
    assert shared.shared_dir(own) == shared.shared_dir(own) and shared.shared_dir(own).startswith("file://")


def test_the_periodic_table_by_number(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"table": {"26": {"symbol": "Fe", "atomic_mass": 55.8, "density": 7.9}}}')
    assert databases.periodic_table_by_number(spark, f"{tmp_path}/n.json").collect()[0].asDict() == {"element": "Fe", "number": 26, "atomic_mass": 55.8, "density": 7.9}
