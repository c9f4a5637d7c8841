"""The registered queries over the operators, each with SQL that DuckDB can run where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Algorithm, BlockFit, Fit, FreePath, MeanType
from ..functions import physics as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import absorption, clustering, composition, dictionary, factorise, filters, fusion, lookups, measures, partitioning, reshape, stencils, thickness, tiles
from ..operators import kernels as K
from . import fixtures as T
from .fixtures import AXIS_SQL, CELLS_SQL, DH_SQL, ELEMENTS_SQL, G_SQL, GRID_SQL, IMAGE_SQL, LINES_SQL, LOWLOSS_SQL, MACS_SQL, Q_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- dictionary ------------------------------------------------------------------------------------------------------


@query(f"WITH {AXIS_SQL} SELECT channel, round(energy, 9) AS energy FROM axis")
def energy_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.energy_axis(spark, 100, 0.1, 0.05).select("channel", r6("energy", 9).alias("energy"))


PEAKS_SQL = f"""{LINES_SQL}, {AXIS_SQL}, seen AS (
  SELECT l.*, (SELECT arg_min(e.efficiency, (abs(e.energy - l.energy), e.energy)) FROM efficiency e) AS eff,
    CASE WHEN n_nationkey <> 3 THEN '' WHEN l.energy < 2 THEN '_low' ELSE '_high' END AS band
  FROM lines l WHERE l.energy > 5e-2 AND l.energy < 1005e-2),
peaks AS (
  SELECT channel, element || band AS g_name, sum(cs * eff * exp(-pow(axis.energy - seen.energy, 2) / (2 * s * s)) / (s * sqrt(2 * pi()))) AS value
  FROM (SELECT *, (energy * 1e-2 + 65e-3) / 23548e-4 AS s FROM seen) seen CROSS JOIN axis GROUP BY channel, g_name),
background AS (
  SELECT channel, unnest(['background_0', 'background_1']) AS g_name,
    unnest([eff * (200e0 - energy) / (energy * 200) * (1 - (200e0 - energy) / 200), eff * (200e0 - energy) * (200e0 - energy) / (energy * 40000)]) AS value
  FROM (SELECT channel, energy, (SELECT arg_min(e.efficiency, (abs(e.energy - a.energy), e.energy)) FROM efficiency e) AS eff FROM axis a))"""


@query(f"WITH {PEAKS_SQL} SELECT channel, g_name, round(value, 9) AS value FROM peaks")
def gaussian_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dictionary.peaks(T.lines(spark, sf_dir), T.instrument(T.element_names(spark, sf_dir)), T.efficiency(spark, sf_dir))
    return g.select("channel", "g_name", r6("value", 9).alias("value"))


@query(f"WITH {PEAKS_SQL} SELECT channel, g_name, round(value, 6) AS value FROM background")
def bremsstrahlung_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = dictionary.background(spark, T.instrument(T.element_names(spark, sf_dir)), T.efficiency(spark, sf_dir))
    return b.select("channel", "g_name", r6("value").alias("value"))


@query(f"""WITH {PEAKS_SQL}, g AS (SELECT * FROM peaks UNION ALL SELECT * FROM background), norms AS (SELECT g_name, sqrt(sum(value * value)) AS n FROM g GROUP BY g_name)
  SELECT g.channel, g.g_name, round(g.value / CASE WHEN g.g_name LIKE 'background%' THEN n ELSE (SELECT avg(n) FROM norms WHERE g_name NOT LIKE 'background%') END, 9) AS value FROM g JOIN norms USING (g_name)""")
def dictionary_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dictionary.dictionary(spark, T.instrument(T.element_names(spark, sf_dir)), T.lines(spark, sf_dir), T.efficiency(spark, sf_dir))
    return g.select("channel", "g_name", r6("value", 9).alias("value"))


@query("SELECT CAST(sum(CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END) AS BIGINT) AS g_columns FROM nation")
def g_column_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("element"), "n_regionkey")
    return dictionary.count_columns(nation.select("element"), nation.where("n_regionkey = 1"))


def absorbed_sql(size: int, factor: str = "") -> str:
    """g(channel, g_name, row, value): the dictionary of `size` channels behind 80 nm, absorbed by lines' own elements and,
    in the background, by all elements alike; row: its place among the names."""
    chi = "80e0 * 1e-7 / sin(radians(22e0))"
    return f"""{LINES_SQL}, {ELEMENTS_SQL}, {MACS_SQL}, axis AS (SELECT CAST(i AS INTEGER) AS channel, i * ({size} * (10e0 / {size}) / {size - 1}) + 5e-2 AS energy FROM (SELECT unnest(generate_series(0, {size - 1})) AS i)),
own AS (SELECT l.element, line, arg_min(mac, (abs(m.energy - l.energy), m.energy)) AS mac FROM lines l JOIN macs m USING (element) GROUP BY l.element, line),
a AS (SELECT element, line, (1 - exp(-mac * density * {chi})) / (mac * density * {chi}) AS a FROM own JOIN elements USING (element)),
seen AS (
  SELECT l.*, a.a, (energy * 1e-2 + 65e-3) / 23548e-4 AS s, (SELECT arg_min(e.efficiency, (abs(e.energy - l.energy), e.energy)) FROM efficiency e) AS eff,
    CASE WHEN n_nationkey <> 3 THEN '' WHEN l.energy < 2 THEN '_low' ELSE '_high' END AS band
  FROM lines l JOIN a USING (element, line) WHERE l.energy > 5e-2 AND l.energy < 1005e-2),
peaks AS (
  SELECT channel, element || band AS g_name, min(n_nationkey + CASE WHEN n_nationkey > 3 OR band = '_high' THEN 1 ELSE 0 END) AS row,
    sum(cs * eff * a * exp(-pow(axis.energy - seen.energy, 2) / (2 * s * s)) / (s * sqrt(2 * pi()))) AS value
  FROM seen CROSS JOIN axis GROUP BY channel, g_name),
of_channel AS (SELECT channel, element, any_value(atomic_mass) AS mass, any_value(density) AS density, any_value(number) AS number, arg_min(mac, (abs(m.energy - axis.energy), m.energy)) AS mac FROM axis CROSS JOIN elements JOIN macs m USING (element) GROUP BY channel, element),
weighed AS (SELECT *, 1e0 AS alike, number - CASE WHEN number < 4 THEN 1 ELSE 0 END AS place, ((1e0 + place % 3) + (5e-1 + place % 7)) / 2 AS share FROM of_channel),
mixed AS (SELECT channel, unnest(['alike', 'share']) AS kind, unnest([sum(mass * mac * alike) / sum(mass / density * alike), sum(mass * mac * share) / sum(mass / density * share)]) * {chi} AS chi FROM weighed GROUP BY channel),
background AS (
  SELECT channel, kind, unnest(['background_0', 'background_1']) AS g_name, unnest([26, 27]) AS row,
    unnest([k * (200e0 - energy) / (energy * 200) * (1 - (200e0 - energy) / 200), k * (200e0 - energy) * (200e0 - energy) / (energy * 40000)]) AS value
  FROM (SELECT channel, kind, energy, (1 - exp(-chi)) / chi * (SELECT arg_min(e.efficiency, (abs(e.energy - a.energy), e.energy)) FROM efficiency e) AS k FROM axis a JOIN mixed USING (channel))),
raw AS (SELECT channel, g_name, row, value FROM peaks UNION ALL SELECT channel, g_name, row, value FROM background WHERE kind = 'alike'),
norms AS (SELECT g_name, sqrt(sum(value * value)) AS n FROM raw GROUP BY g_name),
g AS (SELECT channel, raw.g_name, row, value / CASE WHEN raw.g_name LIKE 'background%' THEN n ELSE (SELECT avg(n) FROM norms WHERE g_name NOT LIKE 'background%') END AS value FROM raw JOIN norms USING (g_name))"""


def absorbed(spark: SparkSession, sf_dir: str, size: int) -> dictionary.Dictionary:
    names = T.element_names(spark, sf_dir)
    return dictionary.build(spark, T.instrument(names, size, 80.0), T.lines(spark, sf_dir), T.efficiency(spark, sf_dir), T.macs(spark, sf_dir), T.elements(spark, sf_dir))


@query(f"WITH {absorbed_sql(100)} SELECT channel, g_name, round(value, 9) AS value FROM g")
def dictionary_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary with internal absorption of the instrument's thickness."""
    inst = T.instrument(T.element_names(spark, sf_dir), 100, 80.0)
    g = dictionary.dictionary(spark, inst, T.lines(spark, sf_dir), T.efficiency(spark, sf_dir), T.macs(spark, sf_dir), T.elements(spark, sf_dir))
    return g.select("channel", "g_name", r6("value", 9).alias("value"))


@query(f"WITH {absorbed_sql(100)} SELECT channel, g_name, round(b.value / n, 9) AS value FROM background b JOIN norms USING (g_name) WHERE kind = 'share'")
def background_of_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background anew, absorbed by the mean composition of W."""
    first = absorbed(spark, sf_dir, 100)
    new = first.refreshed(T.row_factors(len(first.names)))
    rows = [(c, n, float(new.g[c, new.names.index(n)])) for n in dictionary.BACKGROUND for c in range(100)]
    return spark.createDataFrame(rows, "channel int, g_name string, value double").withColumn("value", r6("value", 9))


@query(f"""WITH {absorbed_sql(50)}, {CELLS_SQL}, w AS (SELECT DISTINCT row, g_name, 1e0 + row % 3 AS w1, 5e-1 + row % 7 AS w2 FROM g),
d AS (SELECT channel + 1 AS channel, sum(value * w1) AS d1, sum(value * w2) AS d2 FROM g JOIN w USING (g_name) GROUP BY channel),
n AS (SELECT sum(d1 * d1) AS a11, sum(d1 * d2) AS a12, sum(d2 * d2) AS a22 FROM d), p AS (SELECT pixel_id, sum(d1 * value) AS b1, sum(d2 * value) AS b2 FROM cells JOIN d USING (channel) GROUP BY pixel_id),
h AS (SELECT pixel_id, greatest(abs((a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12)), 1e-14) AS h1, greatest(abs((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12)), 1e-14) AS h2 FROM p CROSS JOIN n),
e AS (SELECT pixel_id, regexp_replace(g_name, '_high$', '') AS element, w1 * h1 + w2 * h2 AS v FROM h CROSS JOIN w WHERE g_name NOT LIKE 'background%' AND NOT regexp_matches(g_name, '_low$'))
SELECT pixel_id, element, round(100e0 * v / sum(v) OVER (PARTITION BY pixel_id), 5) AS at_percent FROM e""")
def lines_to_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines and an instrument to compositions: the absorbed dictionary, abundances of known components, shares."""
    from .estimators import BlockWiseUnmixing

    own = absorbed(spark, sf_dir, T.CHANNELS)
    est = BlockWiseUnmixing(own.g, names=list(own.names), background_rows=own.background_rows)
    est.w = T.row_factors(len(own.names))
    est.h = factorise.solve_fixed(T.cube(spark, sf_dir), own.g @ est.w)
    elements = [e for _, e in est._rows(None)]
    return by_element(est.quantification(), "q", elements, "at_percent", 5)


@query()
def unmixing_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit with the absorbed dictionary, whose background follows the mean composition once."""
    from .estimators import Unmixing

    est = Unmixing.of(absorbed(spark, sf_dir, T.CHANNELS), Fit(components=2, max_iter=5, no_stop=True))
    est.fit_transform(T.cube(spark, sf_dir), refresh=1)
    return by_element(est.quantification(), "q", [e for _, e in est._rows(None)], "at_percent", 3)


# -- cube, blocks, sums ----------------------------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT pixel_id, channel, value FROM cells")
def count_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cells(spark, sf_dir)


@query(f"WITH {GRID_SQL} SELECT DISTINCT pixel_id, y, x, block_id FROM grid")
def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grid(spark, sf_dir).select("pixel_id", "y", "x", "block_id")


@query(f"WITH {CELLS_SQL} SELECT channel, sum(value) AS total FROM cells GROUP BY channel")
def summed_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.summed_spectrum(T.cube(spark, sf_dir)).select((F.col("channel") + 1).alias("channel"), "total")


@query(f"WITH {GRID_SQL} SELECT block_id, channel, sum(value) AS total FROM grid GROUP BY block_id, channel")
def block_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.summed_spectrum(T.grid(spark, sf_dir), "spectrum", "block_id").select("block_id", (F.col("channel") + 1).alias("channel"), "total")


@query(f"WITH {GRID_SQL} SELECT block_id, pixel_id, y, x, sum(value) AS intensity FROM grid GROUP BY ALL")
def block_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grid(spark, sf_dir).select("block_id", "pixel_id", "y", "x", V.total(F.col("spectrum")).alias("intensity"))


@query(f"WITH {GRID_SQL} SELECT channel, sum(value) AS total FROM grid WHERE x >= 2 AND x < 7 GROUP BY channel")
def roi_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    roi = reshape.in_rectangle(T.grid(spark, sf_dir), 0, 1 << 30, 2, 7)
    return reshape.summed_spectrum(roi).select((F.col("channel") + 1).alias("channel"), "total")


@query(f"""WITH {DH_SQL} SELECT channel, comp, round(sum(w * v), 6) AS contribution FROM d JOIN h USING (comp) GROUP BY channel, comp""")
def model_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.literal(T.factor_matrix().T.tolist())
    rows = T.cube(spark, sf_dir).select(F.posexplode(F.zip_with(d, T.factor_h(), V.scale)).alias("comp", "part")).select("comp", F.posexplode("part").alias("channel", "v"))
    return rows.groupBy((F.col("channel") + 1).alias("channel"), "comp").agg(r6(F.sum("v")).alias("contribution"))


@query(f"""WITH {CELLS_SQL}, s AS (SELECT *, sum(value) OVER (PARTITION BY pixel_id) AS r, sum(value) OVER (PARTITION BY channel) AS c FROM cells)
  SELECT pixel_id, channel, round(coalesce(value / nullif(sqrt(r) * sqrt(c), 0), 0), 9) AS value FROM s""")
def poisson_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_cells(measures.poisson_normalised(T.cube(spark, sf_dir)), "spectrum", 1).withColumn("value", r6("value", 9))


# -- compositions ----------------------------------------------------------------------------------------------------


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, q): atomic percent of the 25 elements, whose counts are the first 25 channels."""
    return T.cube(spark, sf_dir).select("pixel_id", V.share(F.slice("spectrum", 1, 25)).alias("q"))


def by_element(pixels: DataFrame, column: str, names: list[str], out: str, digits: int = 6) -> DataFrame:
    rows = pixels.select("pixel_id", F.posexplode(column).alias("i", "v"))
    return rows.select("pixel_id", F.get(F.array(*map(F.lit, names)), "i").alias("element"), r6("v", digits).alias(out))


@query(f"WITH {Q_SQL} SELECT pixel_id, element, round(pct, 6) AS at_percent FROM q")
def quantification_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_element(compositions(spark, sf_dir), "q", T.element_names(spark, sf_dir), "at_percent")


@query(f"""WITH {CELLS_SQL}, {ELEMENTS_SQL} SELECT pixel_id, element, round(100e0 * value / nullif(sum(value) OVER (PARTITION BY pixel_id), 0), 6) AS at_percent
  FROM cells JOIN elements ON channel = number WHERE number IN (2, 5, 11, 17)""")
def quantification_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.element_names(spark, sf_dir)
    own = composition.simplex_rows(names, [names[16], names[1], names[10], names[4]])
    identity = np.eye(25).tolist()
    q = T.cube(spark, sf_dir).select("pixel_id", composition.quantification(F.slice("spectrum", 1, 25), identity, [i for i, _ in own]).alias("q"))
    return by_element(q, "q", [e for _, e in own], "at_percent")


@query(f"""WITH {DH_SQL}, {ELEMENTS_SQL} SELECT pixel_id, element, round(100e0 * fit / sum(fit) OVER (PARTITION BY pixel_id), 6) AS at_percent FROM dh JOIN elements ON channel = number""")
def quantification_from_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.factor_matrix()[:25].tolist()
    q = T.cube(spark, sf_dir).select("pixel_id", composition.quantification(T.factor_h(), w, range(25)).alias("q"))
    return by_element(q, "q", T.element_names(spark, sf_dir), "at_percent")


W_SQL = f"""{Q_SQL}, w AS (SELECT *, coalesce(100e0 * pct * atomic_mass / nullif(sum(pct * atomic_mass) OVER (PARTITION BY pixel_id), 0), 0) AS weight FROM q)"""


def weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[float]], list[str]]:
    names = T.element_names(spark, sf_dir)
    v = composition.element_values(T.elements(spark, sf_dir), names)
    return compositions(spark, sf_dir).withColumn("w", composition.weight_percent(F.col("q"), v["atomic_mass"])), v, names


@query(f"WITH {W_SQL} SELECT pixel_id, element, round(weight, 6) AS weight_percent FROM w")
def atomic_to_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, names = weights(spark, sf_dir)
    return by_element(rows, "w", names, "weight_percent")


@query(f"WITH {W_SQL} SELECT pixel_id, round(coalesce(sum(weight) / nullif(sum(weight / density), 0), 0), 6) AS density FROM w GROUP BY pixel_id")
def density_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v, _ = weights(spark, sf_dir)
    return rows.select("pixel_id", r6(composition.mixture_density(F.col("w"), v["density"])).alias("density"))


@query(f"WITH {W_SQL} SELECT pixel_id, round(coalesce(sum(weight * density) / nullif(sum(weight), 0), 0), 6) AS density FROM w GROUP BY pixel_id")
def density_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v, _ = weights(spark, sf_dir)
    return rows.select("pixel_id", r6(composition.mixture_density(F.col("w"), v["density"], MeanType.WEIGHTED)).alias("density"))


@query(f"WITH {Q_SQL} SELECT pixel_id, round(sum(pct * number) / 100, 6) AS mean_z FROM q GROUP BY pixel_id")
def mean_atomic_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.element_names(spark, sf_dir)
    rows = composition.with_maps(compositions(spark, sf_dir), "q", names, T.elements(spark, sf_dir))
    return rows.select("pixel_id", r6("mean_z").alias("mean_z"))


INTENSITY_SQL = f"""{DH_SQL}, sums AS (SELECT comp, sum(v) AS s FROM h GROUP BY comp), intensity AS (
  SELECT n_name || CASE n_nationkey WHEN 3 THEN '_low' WHEN 4 THEN '_high' ELSE '' END AS g_name, n_name AS element, n_nationkey, d.comp, w, w * (n_nationkey + 1) * s AS intensity
  FROM nation JOIN d ON channel = n_nationkey + 1 JOIN sums USING (comp))"""


def _intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    name = F.concat("n_name", F.when(key == 3, "_low").when(key == 4, "_high").otherwise(""))
    nation = T.table(spark, sf_dir, "nation").select(name.alias("g_name"), (key + 1.0).alias("value"), key)
    d = F.array(*(V.literal(r) for r in T.factor_matrix()[:25].tolist()))
    w = nation.select("g_name", F.posexplode(F.get(d, key)).alias("comp", "value"))
    h = T.table(spark, sf_dir, "supplier").select(T.factor_h("s_suppkey").alias("h"))
    return composition.explained_intensity(nation, w, h)


@query(f"WITH {INTENSITY_SQL} SELECT g_name, comp, round(intensity, 6) AS intensity FROM intensity")
def explained_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intensity(spark, sf_dir).select("g_name", "comp", r6("intensity").alias("intensity"))


@query(f"""WITH {INTENSITY_SQL} SELECT element, comp, round(100e0 * w / sum(w) OVER (PARTITION BY comp), 6) AS at_percent, round(100e0 / sqrt(intensity), 6) AS std_percent
  FROM intensity WHERE g_name NOT LIKE '%\\_low' ESCAPE '\\'""")
def concentration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.concentration_report(_intensity(spark, sf_dir)).select("element", "comp", r6("at_percent").alias("at_percent"), r6("std_percent").alias("std_percent"))


# -- absorption ------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES_SQL} SELECT s_suppkey, round((SELECT arg_min(e.efficiency, (abs(e.energy - s.s_acctbal / 1000), e.energy)) FROM efficiency e), 6) AS efficiency FROM supplier s""")
def nearest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.nearest(T.table(spark, sf_dir, "supplier"), F.col("s_acctbal") / 1000.0, T.efficiency(spark, sf_dir), "energy", "efficiency", "efficiency")
    return rows.select("s_suppkey", r6("efficiency").alias("efficiency"))


ENERGY = 3.2
MAC_SQL = f"""{W_SQL}, macs AS (SELECT n_name AS element, r_regionkey * 2e0 + 7e-1 AS energy, (n_nationkey + 10e0) * 3 / (r_regionkey + 1e0) AS mac FROM nation CROSS JOIN region),
near AS (SELECT element, arg_min(mac, (abs(energy - 32e-1), energy)) AS mac FROM macs GROUP BY element),
mixed AS (SELECT pixel_id, sum(weight * mac) / nullif(sum(weight), 0) AS mu, coalesce(sum(weight) / nullif(sum(weight / density), 0), 0) AS rho FROM w JOIN near USING (element) GROUP BY pixel_id),
chi AS (SELECT *, mu * rho * (50e0 + pixel_id % 7 * 1e1) * 1e-7 / sin(radians(22e0)) AS chi FROM mixed)"""


@query(f"WITH {MAC_SQL} SELECT pixel_id, round(mu, 6) AS mac FROM mixed")
def mass_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, names = weights(spark, sf_dir)
    macs = absorption.coefficients(T.macs(spark, sf_dir), names, [ENERGY])[:, 0]
    return rows.select("pixel_id", r6(absorption.mixture_coefficient(F.col("w"), macs)).alias("mac"))


@query(f"WITH {MAC_SQL} SELECT pixel_id, round(coalesce((1 - exp(-chi)) / nullif(chi, 0), 1), 9) AS factor FROM chi")
def absorption_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v, names = weights(spark, sf_dir)
    macs = absorption.coefficients(T.macs(spark, sf_dir), names, [ENERGY])[:, 0]
    t = (F.col("pixel_id") % 7) * 10.0 + 50.0
    return rows.select("pixel_id", r6(absorption.correction(F.col("q"), macs, v["atomic_mass"], v["density"], t, 22.0), 9).alias("factor"))


@query(f"""WITH {MAC_SQL}, f AS (SELECT pixel_id, coalesce((1 - exp(-chi)) / nullif(chi, 0), 1) AS factor FROM chi)
  SELECT pixel_id, channel, round(value / factor, 6) AS value FROM cells JOIN f USING (pixel_id)""")
def absorption_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.element_names(spark, sf_dir)
    v = composition.element_values(T.elements(spark, sf_dir), names)
    macs = absorption.coefficients(T.macs(spark, sf_dir), names, [ENERGY] * T.CHANNELS)
    pixels = T.cube(spark, sf_dir).withColumns({"q": V.share(F.slice("spectrum", 1, 25)), "t": (F.col("pixel_id") % 7) * 10.0 + 50.0})
    factors = absorption.correction_spectra(pixels, "q", "t", macs, v["atomic_mass"], v["density"], 22.0)
    from ..sources.blocks import corrected

    rows = corrected(pixels, factors)
    return reshape.to_cells(rows, "spectrum", 1).withColumn("value", r6("value"))


# -- thickness -------------------------------------------------------------------------------------------------------


def simpson_sql(n: str, odd: bool) -> str:
    """SQL of the rule at unit steps over channel 0 .. n - 1 of p(pixel_id, channel, value)."""
    if odd:
        return f"sum(value * CASE WHEN channel = 0 OR channel = {n} - 1 THEN 1 WHEN channel % 2 = 1 THEN 4 ELSE 2 END) / 3e0"
    inner = f"sum(CASE WHEN channel > {n} - 2 THEN 0 WHEN channel = 0 OR channel = {n} - 2 THEN value WHEN channel % 2 = 1 THEN 4 * value ELSE 2 * value END) / 3e0"
    return f"{inner} + sum(CASE {n} - channel WHEN 1 THEN value * (5e0 / 12e0) WHEN 2 THEN value * (2e0 / 3e0) WHEN 3 THEN -value / 12e0 ELSE 0 END)"


@query(f"WITH {CELLS_SQL}, p AS (SELECT pixel_id, channel - 1 AS channel, value FROM cells WHERE channel <= 49) SELECT pixel_id, round({simpson_sql('49', True)}, 6) AS integral FROM p GROUP BY pixel_id")
def simpson_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cube(spark, sf_dir).select("pixel_id", r6(V.simpson(F.slice("spectrum", 1, 49))).alias("integral"))


@query(f"WITH {CELLS_SQL}, p AS (SELECT pixel_id, channel - 1 AS channel, value FROM cells) SELECT pixel_id, round({simpson_sql('50', False)}, 6) AS integral FROM p GROUP BY pixel_id")
def simpson_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cube(spark, sf_dir).select("pixel_id", r6(V.simpson(F.col("spectrum"))).alias("integral"))


@query(f"""WITH {CELLS_SQL}, p AS (SELECT pixel_id, channel - 1 AS i, (channel - 1) * 1e0 + (channel % 3) * 1e-1 AS x, value AS y FROM cells WHERE channel <= 49),
t AS (SELECT pixel_id, i, y, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(x) OVER w - x AS h0, lead(x, 2) OVER w - lead(x) OVER w AS h1 FROM p WINDOW w AS (PARTITION BY pixel_id ORDER BY i))
SELECT pixel_id, round(sum((h0 + h1) / 6 * (y * (2 - h1 / h0) + y1 * (h0 + h1) * (h0 + h1) / (h0 * h1) + y2 * (2 - h0 / h1))), 6) AS integral FROM t WHERE i % 2 = 0 AND i < 47 GROUP BY pixel_id""")
def simpson_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [float(c - 1) + (c % 3) * 0.1 for c in range(1, 50)]
    return T.cube(spark, sf_dir).select("pixel_id", r6(V.simpson_at(F.slice("spectrum", 1, 49), V.literal(x))).alias("integral"))


ZERO_SQL = f"""{LOWLOSS_SQL}, i AS (SELECT pixel_id, whole, zero FROM (SELECT pixel_id, {simpson_sql('24', False)} AS whole FROM lowcells GROUP BY pixel_id)
  JOIN (SELECT pixel_id, {simpson_sql('7', True)} AS zero FROM lowcells WHERE channel <= 6 GROUP BY pixel_id) USING (pixel_id))"""
BEAM, ALPHA, BETA = 200.0, 10.0, 15.0
PHYSICS_SQL = "(1 + 200e0 / 1022) / pow(1 + 200e0 / 511, 2)"


@query(f"WITH {ZERO_SQL} SELECT pixel_id, round(whole, 6) AS whole, round(zero, 6) AS zero_loss FROM i")
def zlp_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, zero = thickness.integrals(F.col("spectrum"), 6.0, 1.0, 0.0)
    return T.lowloss(spark, sf_dir).select("pixel_id", r6(whole).alias("whole"), r6(zero).alias("zero_loss"))


@query(f"""WITH {ZERO_SQL}, d AS (SELECT *, 2e0 + pixel_id % 5 AS rho, {PHYSICS_SQL} AS f FROM i), a AS (SELECT *, 55e-1 * pow(rho, 3e-1) / (f * 200) AS te FROM d),
b AS (SELECT *, ln(400e0 / (te * te)) AS lr, ln((100e0 + 225 + 125 + 2 * te * te) * 400 / (100e0 + 225 + 125 + 800) / (te * te)) AS lc FROM a)
SELECT pixel_id, round(CASE WHEN whole > 0 AND zero > 0 THEN ln(whole / zero) * (lr / lc) / (11e0 * pow(rho, 3e-1) / (200 * f * 200) * lr) END, 6) AS thickness FROM b""")
def thickness_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = T.lowloss(spark, sf_dir).withColumn("rho", F.col("pixel_id") % 5 + 2.0)
    rows = thickness.thickness_map(pixels, "spectrum", 6.0, 1.0, 0.0, BEAM, BETA, ALPHA, density="rho")
    return rows.select("pixel_id", r6("thickness").alias("thickness"))


@query(f"""WITH {ZERO_SQL}, z AS (SELECT *, 76e-1 * pow(10e0 + pixel_id % 9, 36e-2) AS em FROM i)
SELECT pixel_id, round(CASE WHEN whole > 0 AND zero > 0 THEN ln(whole / zero) * 106 * ({PHYSICS_SQL}) * 200 / (em * ln(2 * 15e0 * 200 / em)) END, 6) AS thickness FROM z""")
def thickness_mean_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, zero = thickness.integrals(F.col("spectrum"), 6.0, 1.0, 0.0)
    t = thickness.thickness(whole, zero, FreePath.MEAN_ATOMIC_NUMBER, BEAM, BETA, mean_z=F.col("pixel_id") % 9 + 10.0)
    return T.lowloss(spark, sf_dir).select("pixel_id", r6(t).alias("thickness"))


@query("""SELECT s_suppkey, CAST(round((s_acctbal / 1000 + 5e-2) / 25e-2) AS INTEGER) AS channel FROM supplier""")
def energy_to_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "supplier").select("s_suppkey", P.energy_index(F.col("s_acctbal") / 1000.0, 0.25, -0.05).alias("channel"))


# -- image fusion and total variation --------------------------------------------------------------------------------

MODEL_SQL = f"""{Q_SQL}, {IMAGE_SQL}, zm AS (SELECT avg(number) AS z FROM elements), dark AS (
  SELECT pixel_id, sum(number / z * pow(coalesce(pct, 0) / 100, 16e-1)) AS modelled FROM q CROSS JOIN zm GROUP BY pixel_id),
both_ AS (SELECT dark.pixel_id, modelled, image / 1e6 AS image FROM dark JOIN image USING (pixel_id))"""


def fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    names = T.element_names(spark, sf_dir)
    numbers = composition.element_values(T.elements(spark, sf_dir), names)["number"]
    q = compositions(spark, sf_dir).withColumn("q", V.scale(V.fill_nan(F.col("q"), 0.0), 0.01))
    return q.join(T.image(spark, sf_dir), "pixel_id").withColumn("image", F.col("image") / 1e6), numbers


@query(f"WITH {MODEL_SQL} SELECT pixel_id, round(modelled, 6) AS modelled FROM both_")
def haadf_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = fused(spark, sf_dir)
    return rows.select("pixel_id", r6(stencils.dark_field(F.col("q"), numbers, 1.6)).alias("modelled"))


@query(f"WITH {MODEL_SQL} SELECT pixel_id, element, round(number / z * (modelled - image), 6) AS gradient FROM both_ CROSS JOIN elements CROSS JOIN zm")
def haadf_residual_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = fused(spark, sf_dir)
    residual = stencils.dark_field(F.col("q"), numbers, 1.6) - F.col("image")
    return by_element(rows.withColumn("g", stencils.residual_gradient(residual, numbers)), "g", T.element_names(spark, sf_dir), "gradient")


@query(f"WITH {MODEL_SQL} SELECT round(sum((modelled - image) * (modelled - image)) / 2, 6) AS cost FROM both_")
def haadf_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = fused(spark, sf_dir)
    return stencils.dark_field_cost(rows, "q", "image", numbers, 1.6).select(r6("cost").alias("cost"))


@query(f"WITH {Q_SQL} SELECT round(sum(coalesce(pct, 0) / 100 * ln(coalesce(pct, 0) / 200 + 1e-8) - coalesce(pct, 0) / 200), 4) AS cost FROM q")
def poisson_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = fused(spark, sf_dir)
    return stencils.poisson_cost(rows.withColumn("now", V.scale(F.col("q"), 0.5)), "q", "now").select(r6("cost", 4).alias("cost"))


PIX_SQL = f"{GRID_SQL}, pix AS (SELECT pixel_id, y, x, sum(value) / 100 AS value FROM grid GROUP BY ALL)"
ALONG_SQL = "WINDOW wy AS (PARTITION BY x ORDER BY y), wx AS (PARTITION BY y ORDER BY x)"


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grid(spark, sf_dir).select("pixel_id", "y", "x", (V.total(F.col("spectrum")) / 100.0).alias("value"))


@query(f"""WITH {PIX_SQL} SELECT pixel_id, round(5e-1 * coalesce(value - lead(value) OVER wy, 0), 6) AS px, round(5e-1 * coalesce(value - lead(value) OVER wx, 0), 6) AS py FROM pix {ALONG_SQL}""")
def tv_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stencils.tv_gradient(pix(spark, sf_dir).withColumns({"px": F.lit(0.0), "py": F.lit(0.0)}), 0.5)
    return g.select("pixel_id", r6("px").alias("px"), r6("py").alias("py"))


@query(f"""WITH {PIX_SQL}, p AS (SELECT *, value / 7 AS px, value / 9 AS py FROM pix)
SELECT pixel_id, round(value - 2e-1 * (px + py - lag(px, 1, 0e0) OVER wy - lag(py, 1, 0e0) OVER wx), 6) AS out FROM p {ALONG_SQL}""")
def tv_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pix(spark, sf_dir).withColumns({"px": F.col("value") / 7.0, "py": F.col("value") / 9.0})
    return stencils.tv_objective(p, 0.2).select("pixel_id", r6("out").alias("out"))


@query(f"""WITH {PIX_SQL}, p AS (SELECT pixel_id, value / 7 AS px, value / 9 AS py FROM pix)
SELECT pixel_id, round(px / greatest(1, sqrt(px * px + py * py)), 6) AS px, round(py / greatest(1, sqrt(px * px + py * py)), 6) AS py FROM p""")
def tv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pix(spark, sf_dir).select("pixel_id", (F.col("value") / 7.0).alias("px"), (F.col("value") / 9.0).alias("py"))
    return stencils.tv_projected(p).select("pixel_id", r6("px").alias("px"), r6("py").alias("py"))


@query(f"""WITH {PIX_SQL}, n AS (SELECT value, coalesce(lead(value) OVER wy, first_value(value) OVER wy) AS ny, coalesce(lead(value) OVER wx, first_value(value) OVER wx) AS nx FROM pix {ALONG_SQL})
SELECT round(sum(sqrt(1e-8 + (value - ny) * (value - ny) + (value - nx) * (value - nx))), 5) AS cost FROM n""")
def tv_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pix(spark, sf_dir)
    height = p.agg(F.max("y") + 1).first()[0]
    return stencils.tv_cost(p, height, T.WIDTH).select(r6("cost", 5).alias("cost"))


def _denoise_sql(rounds: int, lam: str, columns: str = "pixel_id, round(greatest(out, 0), 6) AS out") -> str:
    steps = [f"WITH {PIX_SQL}, s0 AS (SELECT *, 0e0 AS px, 0e0 AS py, 0e0 AS out FROM pix)"]
    for k in range(1, rounds + 1):
        steps.append(f"o{k} AS (SELECT pixel_id, y, x, value, px, py, value - {lam} * (px + py - lag(px, 1, 0e0) OVER wy - lag(py, 1, 0e0) OVER wx) AS out FROM s{k - 1} {ALONG_SQL})")
        steps.append(f"g{k} AS (SELECT pixel_id, y, x, value, out, px + coalesce(out - lead(out) OVER wy, 0) / (8 * {lam}) AS px, py + coalesce(out - lead(out) OVER wx, 0) / (8 * {lam}) AS py FROM o{k} {ALONG_SQL})")
        steps.append(f"s{k} AS (SELECT pixel_id, y, x, value, out, px / greatest(1, sqrt(px * px + py * py)) AS px, py / greatest(1, sqrt(px * px + py * py)) AS py FROM g{k})")
    return ", ".join(steps) + f" SELECT {columns} FROM s{rounds}"


@query(_denoise_sql(3, "15e-2"))
def tv_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.tv_denoise(pix(spark, sf_dir), 0.15, 3).select("pixel_id", r6("out").alias("out"))


# -- distances -------------------------------------------------------------------------------------------------------

SPEC_SQL = """spec AS (SELECT vec_id, label, CAST(i AS INTEGER) AS i, abs(CAST(v AS DOUBLE)) AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
centre AS (SELECT label, i, avg(v) AS c FROM spec GROUP BY label, i), sc AS (SELECT * FROM spec JOIN centre USING (label, i))"""


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, spectrum): magnitudes of the embeddings."""
    return T.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("spectrum"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, features): means of the labels."""
    long = spec(spark, sf_dir).select("label", F.posexplode("spectrum").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("features"))


def _distance_query(metric: str, sql: str, rounded: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = spec(spark, sf_dir).join(centres(spark, sf_dir), "label")
        snap = (lambda a: F.transform(a, lambda v: F.round(v, 1))) if rounded else (lambda a: a)
        return both.select("vec_id", r6(V.distance(metric, snap(F.col("spectrum")), snap(F.col("features")), 3)).alias("distance"))

    run.__name__ = f"dist_{metric}"
    query(f"WITH {SPEC_SQL} SELECT vec_id, round({sql}, 6) AS distance FROM sc GROUP BY vec_id")(run)


for _metric, _sql, _rounded in [
    ("euclidean", "sqrt(sum((v - c) * (v - c)))", False),
    ("manhattan", "sum(abs(v - c))", False),
    ("minkowski", "pow(sum(pow(abs(v - c), 3)), 1e0 / 3e0)", False),
    ("cosine", "1 - sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c)))", False),
    ("chebyshev", "max(abs(v - c))", False),
    ("hamming", "sum(CASE WHEN round(v, 1) <> round(c, 1) THEN 1e0 ELSE 0e0 END)", True),
    ("jaccard", "1 - sum(least(v, c)) / sum(greatest(v, c))", False),
]:
    _distance_query(_metric, _sql, _rounded)

GRAPH_SQL = f"""{SPEC_SQL}, s AS (SELECT a.label AS i, b.label AS j, exp(-pow(sum(abs(a.c - b.c)), 2) / (2 * 25e-2)) AS s FROM centre a JOIN centre b USING (i) GROUP BY a.label, b.label)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centres(spark, sf_dir).select(F.col("label").cast("long").alias("point_id"), "features")


@query(f"WITH {GRAPH_SQL} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(s, 9) AS s FROM s")
def rbf_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.similarity_graph(_points(spark, sf_dir), "manhattan", 0.5).select("i", "j", r6("s", 9).alias("s"))


@query(f"""WITH {GRAPH_SQL}, deg AS (SELECT i, sum(s) AS d FROM s GROUP BY i)
SELECT CAST(s.i AS BIGINT) AS i, CAST(s.j AS BIGINT) AS j, round(CASE WHEN s.i = s.j THEN 1 ELSE 0 END - s.s / sqrt(a.d * b.d), 9) AS l FROM s JOIN deg a ON a.i = s.i JOIN deg b ON b.i = s.j""")
def normalised_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.normalised_laplacian(clustering.similarity_graph(_points(spark, sf_dir), "manhattan", 0.5)).select("i", "j", r6("l", 9).alias("l"))


@query(f"""WITH {SPEC_SQL}, d AS (SELECT spec.vec_id, centre.label, sum((v - c) * (v - c)) AS d FROM spec JOIN centre ON spec.i = centre.i GROUP BY ALL)
SELECT vec_id, CAST(arg_min(label, (d, label)) AS INTEGER) AS cluster, round(sqrt(min(d)), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centres(spark, sf_dir).orderBy("label").collect()
    points = spec(spark, sf_dir).withColumnRenamed("spectrum", "features")
    return clustering.nearest_centre(points, [r["features"] for r in rows]).select("vec_id", "cluster", r6("distance").alias("distance"))


@query(f"""WITH {SPEC_SQL}, d AS (SELECT vec_id, label, sqrt(sum((v - c) * (v - c))) AS d FROM sc GROUP BY vec_id, label)
SELECT CAST(label AS INTEGER) AS cluster, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY round(d, 9), vec_id) AS members FROM d GROUP BY label""")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spec(spark, sf_dir).join(centres(spark, sf_dir), "label")
    rows = both.select(F.col("vec_id").alias("point_id"), F.col("label").cast("int").alias("cluster"), r6(V.euclidean(F.col("spectrum"), F.col("features")), 9).alias("distance"))
    return clustering.members_by_distance(rows).select("cluster", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"""WITH {SPEC_SQL}, d AS (SELECT vec_id, label, sqrt(sum((v - c) * (v - c))) AS d FROM sc GROUP BY vec_id, label)
SELECT CAST(label AS INTEGER) AS cluster, CAST(row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) - 1 AS INTEGER) AS rank, vec_id AS point_id FROM d""")
def cluster_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each member of a cluster, with its rank by distance."""
    both = spec(spark, sf_dir).join(centres(spark, sf_dir), "label")
    rows = both.select(F.col("vec_id").alias("point_id"), F.col("label").cast("int").alias("cluster"), r6(V.euclidean(F.col("spectrum"), F.col("features")), 9).alias("distance"))
    return clustering.ranked_members(rows)


@query(f"WITH {SPEC_SQL} SELECT CAST(label AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS row, round(c, 9) AS w FROM centre")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spec(spark, sf_dir).select(F.col("vec_id").alias("point_id"), F.col("label").cast("int").alias("cluster"), F.col("spectrum").alias("features"))
    return clustering.clustered_w(points.drop("cluster"), points).select("cluster", F.posexplode("w").alias("row", "w")).withColumn("w", r6("w", 9))


@query("SELECT DISTINCT CAST(vec_id % 16 AS INTEGER) AS block_id, CAST(label AS INTEGER) AS cluster FROM embeddings")
def component_presences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("int").alias("cluster"), (F.col("vec_id") % 16).cast("int").alias("block_id"))
    return clustering.presences(e.drop("cluster"), e)


# -- losses, updates -------------------------------------------------------------------------------------------------


def factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[list[float]]]:
    return T.grid(spark, sf_dir).withColumn("h", T.factor_h()), T.factor_matrix().tolist()


@query(f"WITH {DH_SQL} SELECT round(sum((fit - x) * (fit - x)), 4) AS loss FROM xf")
def frobenius_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.frobenius_loss(*factors(spark, sf_dir)).select(r6("loss", 4).alias("loss"))


@query(f"WITH {DH_SQL} SELECT round(sum(fit - greatest(x, 1e-14) * ln(fit)), 4) AS loss FROM xf")
def kl_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.kl_loss(*factors(spark, sf_dir)).select(r6("loss", 4).alias("loss"))


@query(f"WITH {DH_SQL} SELECT round(avg(fit - greatest(x, 1e-14) * ln(fit) + greatest(x, 1e-14) * ln(greatest(x, 1e-14)) - greatest(x, 1e-14)), 6) AS loss FROM xf")
def kl_divergence_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.kl_loss(*factors(spark, sf_dir), average=True, constant=True).select(r6("loss").alias("loss"))


@query(f"""WITH {DH_SQL} SELECT round((SELECT sum(fit - greatest(x, 1e-14) * ln(fit) + greatest(x, 1e-14) * ln(greatest(x, 1e-14)) - greatest(x, 1e-14)) FROM xf)
  + 5e-1 * (SELECT sum(ln(v + 1)) FROM h) + 1e-1 * (SELECT sum(v * v) FROM h), 4) AS loss""")
def penalised_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.total_loss(*factors(spark, sf_dir), 0.2, 0.5, 1.0).select(r6("loss", 4).alias("loss"))


@query(f"WITH {DH_SQL} SELECT round(sum(v * v) * 25e-2, 6) AS penalty FROM h")
def ridge_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.ridge(factors(spark, sf_dir)[0], 0.25).select(r6("penalty").alias("penalty"))


@query(f"WITH {DH_SQL} SELECT round(sum(ln(v + 1e0)) * 5e-1, 6) AS penalty FROM h")
def log_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.log_penalty(factors(spark, sf_dir)[0], 0.5, 1.0).select(r6("penalty").alias("penalty"))


@query(f"WITH {CELLS_SQL} SELECT round(3e0 / (avg(value) * 50), 9) AS factor FROM cells")
def normalise_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.normalisation_factor(T.cube(spark, sf_dir), 3).select(r6("factor", 9).alias("factor"))


@query(f"WITH {DH_SQL} SELECT comp, max(v) AS top FROM h GROUP BY comp")
def component_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.row_maxima(factors(spark, sf_dir)[0])


@query(f"""WITH {GRID_SQL} SELECT channel, round(avg(value), 6) AS value FROM (SELECT block_id, channel, sum(value) AS value FROM grid GROUP BY ALL) GROUP BY channel""")
def block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_spectrum(spark, sf_dir).withColumnRenamed("total", "value")
    return measures.block_average(rows).select("channel", r6("value").alias("value"))


OLD_SQL = f"{DH_SQL}, o AS (SELECT pixel_id, comp, v, v * (1 + 1e-1 * (pixel_id % 3)) AS o FROM h)"


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors(spark, sf_dir)[0].withColumn("h_old", V.scale(F.col("h"), (F.col("pixel_id") % 3) * 0.1 + 1.0))


@query(f"WITH {OLD_SQL} SELECT round(2e-1 / 2 * (2 * sum(o * v) - sum(o * o) + 8 * sum((o - v) * (o - v))), 6) AS surrogate FROM o")
def l2_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.l2_surrogate(_old(spark, sf_dir), 8.0, 0.2).select(r6("surrogate").alias("surrogate"))


KLS_SQL = f"""{OLD_SQL}, c AS (SELECT comp, sum(o * v) AS ov, sum(o * o) AS oo, sum(v * v) AS vv, max(v) AS top, sum(ln(o / v) * o - o + v) AS kl FROM o GROUP BY comp)"""


@query(f"WITH {KLS_SQL} SELECT round(1e-1 * (2 * sum(ov) - sum(oo) + 8 * sum(top * kl)), 6) AS surrogate FROM c")
def smooth_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.kl_surrogate(_old(spark, sf_dir), 8.0, 0.2).select(r6("surrogate").alias("surrogate"))


@query(f"WITH {KLS_SQL} SELECT round(1e-1 * (2 * sum(ov) - sum(oo) + 8 * sum(top * kl)) - 1e-1 * sum(vv), 6) AS gap FROM c")
def surrogate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _old(spark, sf_dir)
    return measures.surrogate_gap(measures.kl_surrogate(rows, 8.0, 0.2), rows, 0.2).select(r6("gap").alias("gap"))


@query(f"WITH {OLD_SQL} SELECT round(12e0 + sum((v - o) * 5e-1) + 3 * sum((v - o) * (v - o)), 6) AS surrogate FROM o")
def quadratic_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    linear, square = measures.quadratic_surrogate(F.col("h"), F.col("h_old"), V.literal([0.5, 0.5]), 3.0)
    return _old(spark, sf_dir).agg((F.sum(linear) + F.sum(square) + 12.0).alias("s")).select(r6("s").alias("surrogate"))


def _step(spark: SparkSession, sf_dir: str, fit: Fit, kind: str = "update", digits: int = 6) -> DataFrame:
    """(pixel_id, comp, value): one step or the gradient of h."""
    import pyarrow as pa

    pixels, d = factors(spark, sf_dir)[0], T.factor_matrix()
    top = factorise._tops(pixels) if fit.ridge else None

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, h = factorise._matrix(b.column(1)), factorise._matrix(b.column(2))
                new = K.update_h(x, d, h, fit, top=top) if kind == "update" else K.grad_h(x, d, h, fit)
                if kind == "step":
                    new = K.step_h(h, new, 1e3, fit)
                yield pa.RecordBatch.from_arrays([b.column(0), factorise._lists(new)], ["pixel_id", "v"])

    rows = pixels.select("pixel_id", "spectrum", "h").mapInArrow(run, "pixel_id long, v array<double>")
    return rows.select("pixel_id", F.posexplode("v").alias("comp", "value")).withColumn("value", r6("value", digits))


FREE = Fit(simplex_w=False)
H_SQL = f"{DH_SQL}, r AS (SELECT pixel_id, comp, sum(w * x / fit) AS num, sum(w) AS den, sum(w * x) AS dx, sum(w * fit) AS df FROM xf JOIN d USING (channel) GROUP BY pixel_id, comp)"


@query(f"WITH {H_SQL} SELECT pixel_id, comp, round(greatest(v * num / den, 1e-14), 6) AS value FROM r JOIN h USING (pixel_id, comp)")
def kl_update_h_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, FREE)


@query(f"WITH {H_SQL} SELECT pixel_id, comp, round(greatest(v * dx / df, 1e-14), 6) AS value FROM r JOIN h USING (pixel_id, comp)")
def l2_update_h_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, FREE.change(l2=True))


@query(f"WITH {H_SQL} SELECT pixel_id, comp, round(greatest(v * num / (den + 3e-1 / (v + 1)), 1e-14), 6) AS value FROM r JOIN h USING (pixel_id, comp)")
def kl_update_h_logarithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of H with the logarithmic penalty."""
    return _step(spark, sf_dir, FREE.change(mu=0.3))


@query(f"""WITH {H_SQL}, top AS (SELECT comp, max(v) AS top FROM h GROUP BY comp)
SELECT pixel_id, comp, round(greatest(v * (num + 4 * top) / (den + 4 * top + 5e-1 * v), 1e-14), 6) AS value FROM r JOIN h USING (pixel_id, comp) JOIN top USING (comp)""")
def kl_update_h_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of H with the ridge, whose bound is of the largest values of all pixels."""
    return _step(spark, sf_dir, FREE.change(ridge=0.5, sigma=8.0))


@query(f"""WITH {H_SQL}, p AS (SELECT pixel_id, sum(x) AS s FROM xf GROUP BY pixel_id)
SELECT pixel_id, comp, round(greatest(s / (den - num + s / v), 1e-14), 6) AS value FROM r JOIN h USING (pixel_id, comp) JOIN p USING (pixel_id) WHERE s > 0""")
def bregman_update_h_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of H by mirror descent, of the pixels that have counts."""
    rows = _step(spark, sf_dir, FREE.change(algorithm=Algorithm.BMD))
    return rows.join(factors(spark, sf_dir)[0].where(V.total(F.col("spectrum")) > 0).select("pixel_id"), "pixel_id", "left_semi")


@query(f"WITH {H_SQL} SELECT pixel_id, comp, round(den - num + 3e-1 / (v + 1) + 5e-1 * v, 6) AS value FROM r JOIN h USING (pixel_id, comp)")
def grad_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, FREE.change(mu=0.3, ridge=0.5), "grad")


WS_SQL = f"{DH_SQL}, s AS (SELECT channel, comp, sum(x / fit * v) AS first, sum(v) AS second, sum(x * v) AS xh, sum(fit * v) AS fh FROM xf JOIN h USING (pixel_id) GROUP BY channel, comp)"


def w_sums(pixels: DataFrame, d: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """What all pixels add to the step of W, by the kernel in each task."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                first, second = K.w_sums(K.matrix(b.column(0)), d, K.matrix(b.column(1)), fit)
                yield pa.RecordBatch.from_arrays([pa.array([[*first.ravel(), *second.ravel()]], pa.list_(pa.float64()))], ["part"])

    found = np.array(reshape.dense_sum(pixels.select("spectrum", "h").mapInArrow(run, "part array<double>"), "part").first()["total"])
    first, second = found[: d.size].reshape(d.shape), found[d.size :]
    return first, second.reshape(d.shape[1], -1) if fit.l2 else second


def _w_step(spark: SparkSession, sf_dir: str, fit: Fit, kind: str = "update", own: bool = False) -> DataFrame:
    """(channel or row, comp, value): a step, or the gradient, of W, with an identity dictionary or a small one."""
    g, w = T.small_dictionary() if own else (np.eye(T.CHANNELS), T.factor_matrix())
    sums = w_sums(factors(spark, sf_dir)[0], g @ w, fit)
    grad = K.grad_w(g, sums, g @ w, fit)
    whole = factors(spark, sf_dir)[0].agg(F.sum(V.total(F.col("spectrum")))).first()[0] if fit.algorithm == Algorithm.BMD else None
    value = {"update": lambda: K.update_w(w, g, sums, fit, total=whole), "grad": lambda: grad, "step": lambda: K.step_w(w, grad, 1e6, fit)}[kind]()
    rows = [(i + (not own), k, float(v)) for i, row in enumerate(value) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, f"{'row' if own else 'channel'} int, comp int, value double").withColumn("value", r6("value"))


@query(f"WITH {WS_SQL} SELECT channel, comp, round(w * first / second, 6) AS value FROM s JOIN d USING (channel, comp)")
def kl_update_w_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _w_step(spark, sf_dir, FREE)


@query(f"WITH {WS_SQL}, t AS (SELECT sum(x) AS total FROM xf) SELECT channel, comp, round(greatest(total / (second - first + total / w), 1e-14), 6) AS value FROM s JOIN d USING (channel, comp) CROSS JOIN t")
def bregman_update_w_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of W by mirror descent."""
    return _w_step(spark, sf_dir, FREE.change(algorithm=Algorithm.BMD))


@query(f"WITH {WS_SQL} SELECT channel, comp, round(w * xh / fh, 6) AS value FROM s JOIN d USING (channel, comp)")
def l2_update_w_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _w_step(spark, sf_dir, FREE.change(l2=True))


@query(f"WITH {WS_SQL} SELECT channel, comp, round(second - first, 6) AS value FROM s")
def grad_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _w_step(spark, sf_dir, FREE, "grad")


@query(f"""WITH {CELLS_SQL}, c AS (SELECT channel, sum(value) AS s FROM cells GROUP BY channel), p AS (SELECT pixel_id, sum(value) AS s FROM cells GROUP BY pixel_id)
SELECT round(max(c.s) * 2 * 1e-1 * 1e-1 / pow(1e-1 * 1e-1 * 2, 2), 4) AS w_bound, round((SELECT max(s) FROM p) * 2 * 1e-1 * 1e-1 / pow(1e-1 * 1e-1 * 2, 2), 4) AS h_bound FROM c""")
def lipschitz_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an identity dictionary, two components and a floor of 0.1: bounds from the largest channel and pixel sums."""
    return _bounds(spark, sf_dir, np.eye(T.CHANNELS), Fit(simplex_w=False, floor=0.1))


def _bounds(spark: SparkSession, sf_dir: str, g: np.ndarray, fit: Fit) -> DataFrame:
    """Both bounds by the kernels: W's from the sum of all spectra, H's as the largest of each task's."""
    import pyarrow as pa

    pixels = T.cube(spark, sf_dir)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([K.lipschitz_h(K.matrix(b.column(0)), g, 2, fit)])], ["h"])

    total = np.array(reshape.dense_sum(pixels).first()["total"])[:, None]
    top = pixels.select("spectrum").mapInArrow(run, "h double").agg(F.max("h").alias("h"))
    return top.select(F.lit(round(K.lipschitz_w(total, g, 2, fit.floor), 4)).alias("w_bound"), r6("h", 4).alias("h_bound"))


# -- the same kernels with a dictionary of their own -----------------------------------------------------------------

GS_SQL = f"{G_SQL}, s AS (SELECT channel, comp, sum(x / fit * v) AS first, sum(v) AS second, sum(x * v) AS xh, sum(fit * v) AS fh FROM xf JOIN h USING (pixel_id) GROUP BY channel, comp), gs AS (SELECT k, comp, sum(g * first) AS num, sum(g * second) AS den, sum(g * xh) AS xn, sum(g * fh) AS fn FROM g JOIN s USING (channel) GROUP BY k, comp)"


def _g_query(name: str, value: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir)

    found.__name__ = name
    query(f"WITH {GS_SQL} SELECT CAST(k AS INTEGER) AS row, CAST(comp AS INTEGER) AS comp, round({value}, 6) AS value FROM gs JOIN w USING (k, comp)")(found)


_g_query("kl_update_w_dictionary", "w * num / den", lambda spark, sf_dir: _w_step(spark, sf_dir, FREE, own=True))
_g_query("l2_update_w_dictionary", "w * xn / fn", lambda spark, sf_dir: _w_step(spark, sf_dir, FREE.change(l2=True), own=True))
_g_query("grad_w_dictionary", "den - num", lambda spark, sf_dir: _w_step(spark, sf_dir, FREE, "grad", own=True))
_g_query("grad_w_l2_dictionary", "2 * (fn - xn)", lambda spark, sf_dir: _w_step(spark, sf_dir, FREE.change(l2=True), "grad", own=True))
_g_query("projected_step_w", "greatest(w - (den - num) / 1e6, 1e-14)", lambda spark, sf_dir: _w_step(spark, sf_dir, FREE, "step", own=True))


@query(f"""WITH {G_SQL}, r AS (SELECT channel, sum(g) AS g FROM g GROUP BY channel), c AS (SELECT channel, sum(value) AS s FROM cells GROUP BY channel),
p AS (SELECT pixel_id, sum(g * 1e-1 * value / pow(g * 1e-2 * 2, 2) * 2 * g * 1e-1) AS s FROM cells JOIN r USING (channel) GROUP BY pixel_id)
SELECT round(max(2 * 1e-1 * s / pow(g * 1e-2 * 2, 2) * 1e-1), 4) AS w_bound, round((SELECT max(s) FROM p) + 2 * 5e-1 + 3e-1, 4) AS h_bound FROM c JOIN r USING (channel)""")
def lipschitz_bounds_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, T.small_dictionary()[0], Fit(simplex_w=False, floor=0.1, ridge=0.5, mu=0.3))


@query(f"""WITH {DH_SQL} SELECT round((SELECT sum(fit - greatest(x, 1e-14) * ln(fit) + greatest(x, 1e-14) * ln(greatest(x, 1e-14)) - greatest(x, 1e-14)) FROM xf) + (SELECT 3e-1 * sum(ln(v + 1)) + 25e-2 * sum(v * v) FROM h), 4) AS kl,
  round((SELECT sum((fit - x) * (fit - x)) / 2 FROM xf), 4) AS l2""")
def kernel_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objectives that the fits report, with both penalties and in squares."""
    import pyarrow as pa

    d, fits = T.factor_matrix(), (FREE.change(mu=0.3, ridge=0.5), FREE.change(l2=True))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, h = K.matrix(b.column(0)), K.matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([K.loss(x, d, h, fit)]) for fit in fits], ["kl", "l2"])

    rows = factors(spark, sf_dir)[0].select("spectrum", "h").mapInArrow(run, "kl double, l2 double")
    return rows.agg(r6(F.sum("kl"), 4).alias("kl"), r6(F.sum("l2"), 4).alias("l2"))


@query(f"""WITH {OLD_SQL}, b AS (SELECT DISTINCT pixel_id, block_id FROM grid), c AS (SELECT block_id, comp, sum(o * v) AS ov, sum(o * o) AS oo, sum(v * v) AS vv, max(v) AS top, sum(ln(o / v) * o - o + v) AS kl FROM o JOIN b USING (pixel_id) GROUP BY block_id, comp)
SELECT block_id, round(1e-1 * (2 * sum(ov) - sum(oo) + 8 * sum(top * kl) - sum(vv)), 6) AS gap FROM c GROUP BY block_id""")
def kernel_surrogate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap that a line search of a block looks at."""
    import pandas as pd

    def run(key, rows):
        old, new = (np.array(rows[c].tolist()).T for c in ("h_old", "h"))
        return pd.DataFrame({"block_id": [int(key[0])], "gap": [K.surrogate_gap(old, new, 8.0, 0.2)]})

    rows = _old(spark, sf_dir).select("block_id", "h_old", "h").groupBy("block_id").applyInPandas(run, "block_id int, gap double")
    return rows.withColumn("gap", r6("gap"))


@query(f"WITH {H_SQL} SELECT pixel_id, comp, round(df - dx, 4) AS value FROM r")
def grad_h_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, FREE.change(l2=True), "grad", 4)


@query(f"""WITH {H_SQL}, a AS (SELECT pixel_id, comp, v - (den - num) / 1e3 AS a FROM r JOIN h USING (pixel_id, comp)), t AS (SELECT pixel_id, max(CASE comp WHEN 0 THEN a END) AS a0, max(CASE comp WHEN 1 THEN a END) AS a1 FROM a GROUP BY pixel_id)
SELECT pixel_id, unnest([0, 1]) AS comp, round(least(greatest((1 + unnest([1, -1]) * (a0 - a1)) / 2, 1e-14), 1), 6) AS value FROM t""")
def projected_step_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gradient step of H, put back on the simplex."""
    return _step(spark, sf_dir, FREE.change(simplex_h=True, simplex_tol=1e-10), "step")


# -- guards, thresholds, scaling, residuals --------------------------------------------------------------------------


@query(f"""WITH {CELLS_SQL}, z AS (SELECT pixel_id, channel, CASE WHEN channel % 10 = 0 OR pixel_id % 7 = 0 THEN 0e0 ELSE value END AS value FROM cells)
SELECT pixel_id, channel, CASE WHEN sum(value) OVER (PARTITION BY channel) = 0 OR sum(value) OVER (PARTITION BY pixel_id) = 0 THEN 1e-3 ELSE value END AS value FROM z""")
def safe_zero_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.cells(spark, sf_dir).withColumn("value", F.when((F.col("channel") % 10 == 0) | (F.col("pixel_id") % 7 == 0), 0.0).otherwise(F.col("value")))
    return filters.without_zero_lines(rows, 1e-3)


@query(f"""WITH {CELLS_SQL} SELECT pixel_id, channel, CASE WHEN channel % 5 = 0 THEN 7e0 ELSE greatest(value - 100, 1e-14) END AS value FROM cells""")
def floor_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.when(F.col("channel") % 5 == 0, F.lit(7.0))
    return T.cells(spark, sf_dir).withColumn("value", filters.masked(fixed, filters.floored(F.col("value") - 100.0, 1e-14)))


@query(f"""WITH {CELLS_SQL}, m AS (SELECT *, value / max(value) OVER (PARTITION BY pixel_id) AS r FROM cells WHERE value > 0), t AS (SELECT pixel_id, channel, CASE WHEN r <= 1e-3 THEN 0 WHEN r >= 98e-2 THEN 1e0 ELSE r END AS r FROM m)
SELECT pixel_id, channel, round(r / sum(r) OVER (PARTITION BY pixel_id), 9) AS value FROM t""")
def postprocess_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = T.cells(spark, sf_dir).where("value > 0").withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("pixel_id")))
    return filters.snapped_share(rows, ["pixel_id"]).withColumn("value", r6("value", 9))


@query(f"""WITH {CELLS_SQL}, b AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM cells GROUP BY channel) SELECT pixel_id, channel, round((value - lo) / nullif(hi - lo, 0), 6) AS value FROM cells JOIN b USING (channel)""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.min_max_scaled(T.cells(spark, sf_dir)).select("pixel_id", "channel", r6("value").alias("value"))


def _residual_sql(over: str, fit: str = "fit") -> str:
    return f"""WITH {DH_SQL}, n AS (SELECT xf.pixel_id, xf.channel, xf.x, {fit} AS fit, block_id FROM xf JOIN grid USING (pixel_id, channel))
SELECT pixel_id, channel, round(CASE WHEN r <= 0 THEN 1e-14 ELSE r END, 9) AS value FROM (SELECT pixel_id, channel, x / sqrt(sum(x * x) OVER ({over})) - fit / sqrt(sum(fit * fit) OVER ({over})) AS r FROM n)"""


@query(_residual_sql(""))
def residual_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.residuals(*factors(spark, sf_dir))
    return reshape.to_cells(rows, "residual", 1).withColumn("value", r6("value", 9))


@query(_residual_sql("PARTITION BY block_id"))
def residual_blockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.residuals(*factors(spark, sf_dir), by="block_id")
    return reshape.to_cells(rows, "residual", 1).withColumn("value", r6("value", 9))


@query(f"""WITH {DH_SQL}, one AS (SELECT pixel_id, channel, w * v AS fit1 FROM d JOIN h USING (comp) WHERE comp = 0), n AS (SELECT pixel_id, channel, x, fit1 FROM xf JOIN one USING (pixel_id, channel))
SELECT pixel_id, channel, round(CASE WHEN r <= 0 THEN 1e-14 ELSE r END, 9) AS value FROM (SELECT pixel_id, channel, x / sqrt(sum(x * x) OVER ()) - fit1 / sqrt(sum(fit1 * fit1) OVER ()) AS r FROM n)""")
def residual_first_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.residuals(*factors(spark, sf_dir), count=1)
    return reshape.to_cells(rows, "residual", 1).withColumn("value", r6("value", 9))


@query(f"""WITH {DH_SQL} SELECT channel, pixel_id, round(sum(w * v), 6) AS value FROM d JOIN h USING (comp) GROUP BY channel, pixel_id""")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pixel_id"), F.posexplode(T.factor_h("s_suppkey")).alias("comp", "value"))
    d = spark.range(1, T.CHANNELS + 1).select(F.col("id").cast("int").alias("channel"), F.posexplode(F.array(F.col("id") % 3 + 1.0, F.col("id") % 7 + 0.5)).alias("comp", "value"))
    return lookups.matrix_product(d, pixels, "comp", "channel", "pixel_id").withColumn("value", r6("value"))


# -- names -----------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(l_linenumber AS INTEGER) AS line_number, count(*) AS n, CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber % 100 BETWEEN 11 AND 13 THEN 'th' WHEN l_linenumber % 10 = 1 THEN 'st' WHEN l_linenumber % 10 = 2 THEN 'nd' WHEN l_linenumber % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM lineitem GROUP BY l_linenumber""")
def ordinal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("line_number")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("ordinal", X.ordinal(F.col("line_number")))


@query("""WITH n AS (SELECT n_nationkey, n_name || CASE n_nationkey % 4 WHEN 0 THEN '_low' WHEN 1 THEN '_high' ELSE '' END AS g_name FROM nation)
SELECT g_name, regexp_replace(g_name, '_(low|high)$', '') AS element, CAST(n_nationkey AS INTEGER) AS row FROM n WHERE NOT regexp_matches(g_name, '_low$')""")
def simplex_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = T.table(spark, sf_dir, "nation").select(F.concat("n_name", F.when(key % 4 == 0, "_low").when(key % 4 == 1, "_high").otherwise("")).alias("g_name"), key.cast("int").alias("row"))
    return rows.where(X.is_simplex_row(F.col("g_name"))).select("g_name", X.element_of(F.col("g_name")).alias("element"), "row")


@query("""WITH names AS (SELECT * FROM (VALUES ('Ka1', ['KL3']), ('Kb1', ['KM3']), ('La', ['L3M5', 'L3M4'])) t(name, aliases)), alias AS (SELECT aliases[1] AS line, name FROM names WHERE len(aliases) = 1),
lines AS (SELECT n_nationkey + 1 AS number, unnest(['KL3', 'KM3', 'L3M5']) AS line, unnest([1e0, 2e0, 3e0]) + n_nationkey AS energy, n_nationkey * 5e-1 AS cs FROM nation)
SELECT n_name AS element, coalesce(alias.name, lines.line) AS line, energy, cs FROM lines JOIN nation ON number = n_nationkey + 1 LEFT JOIN alias ON alias.line = lines.line""")
def line_alias_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Ka1", ["KL3"]), ("Kb1", ["KM3"]), ("La", ["L3M5", "L3M4"])], "name string, aliases array<string>")
    k = F.col("n_nationkey")
    three = F.array(*(F.struct(F.lit(n).alias("line"), (k + float(i)).alias("energy")) for i, n in enumerate(("KL3", "KM3", "L3M5"), 1)))
    lines = T.table(spark, sf_dir, "nation").select((k + 1).cast("int").alias("number"), F.explode(three).alias("v"), (k * 0.5).alias("cs")).select("number", "v.line", "v.energy", "cs")
    return lookups.renamed_lines(lines, names, T.elements(spark, sf_dir))


# -- partitioning ----------------------------------------------------------------------------------------------------


@query(f"""WITH {GRID_SQL}, t AS (SELECT block_id, channel, sum(value) AS s FROM grid GROUP BY ALL), r AS (SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY s DESC, channel) - 1 AS INTEGER) AS comp, s / sum(s) OVER (PARTITION BY block_id) AS ratio FROM t),
l AS (SELECT block_id, comp, ln(greatest(ratio, 1e-30)) AS y FROM r), e AS (SELECT block_id, max(CASE WHEN comp = 0 THEN y END) AS y1, max(CASE WHEN comp = 20 THEN y END) AS y2 FROM l GROUP BY block_id),
d AS (SELECT l.block_id, comp, round(abs(20 * (y1 - y) + comp * (y2 - y1)) / sqrt(400 + pow(y2 - y1, 2)), 9) AS d FROM l JOIN e USING (block_id) WHERE comp < 20)
SELECT block_id, CAST(arg_min(comp, (-d, comp)) AS INTEGER) AS n_relevant FROM d GROUP BY block_id""")
def elbow_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elbow of each block's channel shares in falling order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("block_id")
    rows = block_spectrum(spark, sf_dir)
    ranked = rows.withColumn("comp", F.row_number().over(w.orderBy(F.desc("total"), "channel")) - 1).withColumn("ratio", F.col("total") / F.sum("total").over(w))
    return partitioning.elbow(ranked)


@query("""WITH b AS (SELECT h, w, abs(h / w - 200e0 / 150) AS d FROM (SELECT unnest(generate_series(15, 200)) AS h) CROSS JOIN (SELECT unnest(generate_series(13, 150)) AS w) WHERE h * w * 50 * 8e0 BETWEEN 8e-1 * 2e6 AND 12e-1 * 2e6)
SELECT CAST(h AS INTEGER) AS block_height, CAST(w AS INTEGER) AS block_width FROM b ORDER BY d, h DESC, w DESC LIMIT 1""")
def optimal_block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.best_block(spark, 200, 150, 50, 2e6)


# -- solvers ---------------------------------------------------------------------------------------------------------

SOLVE_SQL = f"""WITH {DH_SQL}, g AS (SELECT sum(CASE WHEN a.comp = 0 AND b.comp = 0 THEN a.w * b.w END) AS a11, sum(CASE WHEN a.comp = 0 AND b.comp = 1 THEN a.w * b.w END) AS a12, sum(CASE WHEN a.comp = 1 AND b.comp = 1 THEN a.w * b.w END) AS a22 FROM d a JOIN d b USING (channel)),
p AS (SELECT pixel_id, sum(CASE WHEN comp = 0 THEN w * value END) AS b1, sum(CASE WHEN comp = 1 THEN w * value END) AS b2 FROM cells JOIN d USING (channel) GROUP BY pixel_id),
s AS (SELECT pixel_id, greatest(abs((a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12)), 1e-14) AS h1, greatest(abs((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12)), 1e-14) AS h2 FROM p CROSS JOIN g)"""


@query(f"{SOLVE_SQL} SELECT pixel_id, unnest([0, 1]) AS comp, round(unnest([h1, h2]), 6) AS h FROM s")
def abundance_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factorise.solve_fixed(T.cube(spark, sf_dir), T.factor_matrix())
    return rows.select("pixel_id", F.posexplode("h").alias("comp", "h")).withColumn("h", r6("h"))


@query(f"""{SOLVE_SQL}, {ELEMENTS_SQL}, f AS (SELECT pixel_id, channel, sum(w * CASE comp WHEN 0 THEN h1 ELSE h2 END) AS fit FROM s CROSS JOIN d GROUP BY pixel_id, channel)
SELECT pixel_id, element, round(100e0 * fit / sum(fit) OVER (PARTITION BY pixel_id), 6) AS at_percent FROM f JOIN elements ON channel = number""")
def abundance_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From spectra to compositions: abundances of a known dictionary, then atomic percent of each element."""
    rows = factorise.solve_fixed(T.cube(spark, sf_dir), T.factor_matrix())
    q = rows.select("pixel_id", composition.quantification(F.col("h"), T.factor_matrix()[:25].tolist(), range(25)).alias("q"))
    return by_element(q, "q", T.element_names(spark, sf_dir), "at_percent")


@query(f"""WITH {H_SQL}, t AS (SELECT pixel_id, max(CASE comp WHEN 0 THEN v * num END) AS n0, max(CASE comp WHEN 1 THEN v * num END) AS n1, max(CASE comp WHEN 0 THEN den END) AS d0, max(CASE comp WHEN 1 THEN den END) AS d1 FROM r JOIN h USING (pixel_id, comp) GROUP BY pixel_id),
q AS (SELECT *, d0 + d1 - n0 - n1 AS b, d0 * d1 - n0 * d1 - n1 * d0 AS c FROM t), u AS (SELECT *, (-b + sqrt(b * b - 4 * c)) / 2 AS nu FROM q)
SELECT pixel_id, unnest([0, 1]) AS comp, round(greatest(unnest([n0 / (d0 + nu), n1 / (d1 + nu)]), 1e-14), 6) AS value FROM u""")
def bisection_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of H on the simplex: the values of each pixel add up to 1."""
    return _step(spark, sf_dir, Fit(simplex_w=False, simplex_h=True, simplex_tol=1e-9))


@query()
def block_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = partitioning.explained_variance(T.grid(spark, sf_dir), 10)
    return rows.select("block_id", "comp", r6("variance", 4).alias("variance"), r6("ratio").alias("ratio"))


@query()
def block_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = np.eye(T.CHANNELS)
    rows = factorise.fit_blocks(T.grid(spark, sf_dir), g, Fit(components=2, max_iter=50))
    return rows.select("block_id", "comp", F.posexplode("w").alias("row", "w")).withColumn("w", r6("w"))


@query()
def distributed_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, _ = factorise.fit_pixels(T.cube(spark, sf_dir), np.eye(T.CHANNELS), Fit(components=2, max_iter=10, no_stop=True))
    return h.select("pixel_id", F.posexplode("h").alias("comp", "h")).withColumn("h", r6("h", 4))


@query()
def vca_endmembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, ends = clustering.vca_points(_points(spark, sf_dir), 3)
    return spark.createDataFrame([(i, int(p), [round(float(v), 6) for v in ends[:, i]]) for i, p in enumerate(found)], "endmember int, point_id long, spectrum array<double>")


@query()
def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.spectral_clusters(_points(spark, sf_dir), 3, 0.5).withColumn("distance", r6("distance"))


@query()
def abundance_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centres(spark, sf_dir).orderBy("label").collect()
    points = spec(spark, sf_dir).select("vec_id", F.col("spectrum").alias("features"))
    found = clustering.abundances_nnls(points, np.array([r["features"] for r in rows]).T)
    return found.select("vec_id", F.posexplode("a").alias("endmember", "share")).withColumn("share", r6("share"))


@query()
def haadf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = fused(spark, sf_dir)
    placed = T.grid(spark, sf_dir).select("pixel_id", "y", "x", "block_id").join(rows, "pixel_id")
    q, _ = fusion.refine_groups(placed, numbers, fusion.Refinement(rounds=10))
    return by_element(q, "q", T.element_names(spark, sf_dir), "at_percent", 4)


@query()
def blockwise_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .estimators import BlockWiseUnmixing

    est = BlockWiseUnmixing(np.eye(T.CHANNELS), BlockFit(fit=Fit(components=2, max_iter=30), clusters=3, classifier="vca"), background_rows=0)
    h = est.fit_transform(T.grid(spark, sf_dir))
    return h.select("pixel_id", F.posexplode("h").alias("comp", "h")).withColumn("h", r6("h", 4))


# -- sources, sinks and the rest of the surface ----------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    import uuid

    from ..sources.shared import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {CELLS_SQL} SELECT CAST(pixel_id AS BIGINT) AS i, CAST(channel - 1 AS INTEGER) AS j, value FROM cells")
def text_matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import text_matrix

    path, rows = _path(spark, "matrix"), T.table(spark, sf_dir, "supplier").count()
    cells = T.cells(spark, sf_dir).select(F.col("pixel_id").alias("i"), (F.col("channel") - 1).alias("j"), "value")
    text_matrix.write_matrix(cells, path, rows, T.CHANNELS)
    return text_matrix.read_matrix(spark, path)


@query(f"WITH {GRID_SQL} SELECT block_id, pixel_id, channel, CASE WHEN channel = 1 THEN 1e-14 ELSE value END AS value FROM grid")
def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written and read again; NaN in the first channel becomes the small fill."""
    from ..sources import blocks

    path = _path(spark, "blocks")
    nan = F.transform("spectrum", lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))
    blocks.write_blocks(T.grid(spark, sf_dir).withColumn("spectrum", nan), path)
    return reshape.to_cells(blocks.read_blocks(spark, path, "spectrum"), "spectrum", 1, "block_id")


@query(f"""WITH {PEAKS_SQL}, b AS (SELECT channel, g_name, value / (1 + channel) AS value FROM background), n AS (SELECT g_name, sqrt(sum(value * value)) AS n FROM b GROUP BY g_name)
SELECT b.channel, g_name, round(value / n, 9) AS value FROM b JOIN n USING (g_name)""")
def background_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background columns again, with absorption factors of a new mean composition."""
    inst = T.instrument(T.element_names(spark, sf_dir))
    factors = dictionary.energy_axis(spark, 100, 0.1, 0.05).select("channel", (F.lit(1.0) / (F.col("channel") + 1)).alias("factor"))
    empty = spark.createDataFrame([], "channel int, g_name string, value double")
    g = dictionary.refreshed_background(spark, inst, T.efficiency(spark, sf_dir), empty, factors)
    return g.select("channel", "g_name", r6("value", 9).alias("value"))


@query(f"WITH {ELEMENTS_SQL} SELECT CAST(c_custkey AS BIGINT) AS c_custkey, element, number, atomic_mass, density FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN elements ON element = n_name")
def lookup_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension joined to rows; the query fails on a key that it lacks."""
    nation = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("element"))
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey").select("c_custkey", "element")
    return lookups.lookup(rows, T.elements(spark, sf_dir)).select("c_custkey", "element", "number", "atomic_mass", "density")


@query(f"""WITH {ELEMENTS_SQL}, macs AS (SELECT n_name AS element, r_regionkey * 2e0 + 7e-1 AS energy, (n_nationkey + 10e0) * 3 / (r_regionkey + 1e0) AS mac FROM nation CROSS JOIN region),
near AS (SELECT element, arg_min(mac, (abs(energy - 32e-1), energy)) AS mac FROM macs GROUP BY element), chi AS (SELECT element, mac, mac * density * 80e0 * 1e-7 / sin(radians(22e0)) AS chi FROM near JOIN elements USING (element))
SELECT element, round(mac, 6) AS mac, round((1 - exp(-chi)) / chi, 9) AS factor FROM chi""")
def absorption_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient and factor of each element by itself, with its own density."""
    names = T.element_names(spark, sf_dir)
    macs = absorption.coefficients(T.macs(spark, sf_dir), names, [ENERGY])[:, 0]
    table = spark.createDataFrame([(n, float(m)) for n, m in zip(names, macs, strict=True)], "element string, mac double")
    rows = lookups.lookup(table, T.elements(spark, sf_dir))
    return rows.select("element", r6("mac").alias("mac"), r6(P.absorption_factor(F.col("mac"), F.col("density"), 80.0 * P.NM_PER_CM, 22.0), 9).alias("factor"))


@query(f"WITH {AXIS_SQL} SELECT channel, round(1e0 / pow(energy, 3), 6) AS mac FROM axis")
def absorption_cube_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.energy_axis(spark, 100, 0.1, 0.05).select("channel", r6(P.cube_law(F.col("energy"))).alias("mac"))


@query(f"""WITH d AS (SELECT s_suppkey, 1e0 + s_suppkey % 17 AS rho, 8e0 + s_suppkey % 60 AS z, {PHYSICS_SQL} AS f FROM supplier), a AS (SELECT *, 55e-1 * pow(rho, 3e-1) / (f * 200) AS te, 76e-1 * pow(z, 36e-2) AS em FROM d),
b AS (SELECT *, ln(400e0 / (te * te)) AS lr, ln((100e0 + 225 + 125 + 2 * te * te) * 400 / (100e0 + 225 + 125 + 800) / (te * te)) AS lc FROM a)
SELECT s_suppkey, round(f, 9) AS relativistic, round(te, 9) AS angle, round(1 / (11e0 * pow(rho, 3e-1) / (200 * f * 200) * lr), 6) AS path_by_density,
  round(106 * f * 200 / (em * ln(2 * 15e0 * 200 / em)), 6) AS path_by_number, round(lr / lc, 9) AS angular FROM b""")
def inelastic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho, z = F.col("s_suppkey") % 17 + 1.0, F.col("s_suppkey") % 60 + 8.0
    return T.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        r6(P.relativistic(BEAM), 9).alias("relativistic"),
        r6(P.characteristic_angle(rho, BEAM), 9).alias("angle"),
        r6(P.free_path_by_density(rho, BEAM)).alias("path_by_density"),
        r6(P.free_path_by_number(z, BEAM, BETA)).alias("path_by_number"),
        r6(P.angular_correction(rho, BEAM, ALPHA, BETA), 9).alias("angular"),
    )


@query(f"WITH {SPEC_SQL} SELECT vec_id, round(sqrt(sum((v - c) * (v - c) * (1 + i % 4))), 6) AS distance FROM sc GROUP BY vec_id")
def dist_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    inverse = V.literal(np.diag([1.0 + i % 4 for i in range(1, 65)]).tolist())
    both = spec(spark, sf_dir).join(centres(spark, sf_dir), "label")
    return both.select("vec_id", r6(V.distance("mahalanobis", F.col("spectrum"), F.col("features"), inverse=inverse)).alias("distance"))


@query(f"WITH {CELLS_SQL} SELECT pixel_id, channel, round(CASE WHEN max(value) OVER (PARTITION BY channel) > min(value) OVER (PARTITION BY channel) THEN value END, 6) AS value FROM cells")
def minmax_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.min_max_restored(measures.min_max_scaled(T.cells(spark, sf_dir)))
    return rows.select("pixel_id", "channel", r6("value").alias("value"))


@query(f"""WITH {GRID_SQL}, t AS (SELECT block_id, pixel_id, list(value ORDER BY channel) AS s FROM grid GROUP BY ALL)
SELECT block_id, CAST(pixel_id AS BIGINT) AS comp, array_to_string(list_transform(s[1:48] || s[49:50], lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS full_text FROM t""")
def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of pooled components in one vector."""
    g = T.grid(spark, sf_dir).withColumnRenamed("pixel_id", "comp")
    parts = g.select("block_id", "comp", F.slice("spectrum", 1, 48).alias("features")), g.select("block_id", "comp", F.slice("spectrum", 49, 2).alias("background"))
    return reshape.pooled(*parts).select("block_id", "comp", F.array_join(F.transform("full", lambda v: v.cast("bigint").cast("string")), ",").alias("full_text"))


@query(f"""WITH {SPEC_SQL}, r AS (SELECT vec_id, string_agg(CAST(round(v, 1) AS VARCHAR), ',' ORDER BY i) AS t FROM spec GROUP BY vec_id) SELECT min(vec_id) AS point_id FROM r GROUP BY t""")
def distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that differ after rounding; of equals the smallest id."""
    points = spec(spark, sf_dir).select(F.col("vec_id").alias("point_id"), F.transform("spectrum", lambda v: F.round(v, 1)).alias("features"))
    return reshape.distinct_rounded(points, "features").select("point_id")


@query("""WITH n AS (SELECT n_name || CASE n_nationkey % 4 WHEN 0 THEN '_low' WHEN 1 THEN '_high' ELSE '' END AS g_name FROM nation) SELECT g_name, regexp_extract(g_name, '_(low|high)$', 1) AS band FROM n""")
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    name = F.concat("n_name", F.when(key % 4 == 0, "_low").when(key % 4 == 1, "_high").otherwise(""))
    return T.table(spark, sf_dir, "nation").select(name.alias("g_name")).withColumn("band", X.band_of(F.col("g_name")))


@query()
def separated_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's components after a fit, with pure elements taken apart."""
    points = factorise.fit_blocks(T.grid(spark, sf_dir), np.eye(T.CHANNELS), Fit(components=2, max_iter=20)).withColumnRenamed("w", "features")
    rows = filters.separate_blocks(points, 1)
    return rows.select("block_id", "comp", F.posexplode("features").alias("row", "share")).withColumn("share", r6("share"))


@query()
def haadf_cost_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = fused(spark, sf_dir)
    placed = T.grid(spark, sf_dir).select("pixel_id", "y", "x", "block_id").join(rows, "pixel_id")
    costs = fusion.refine_groups(placed, numbers, fusion.Refinement(rounds=10))[1]
    return costs.select("block_id", "round", *(r6(c, 4).alias(c) for c in ("image_cost", "chemical_cost", "variation_cost")))


@query(_denoise_sql(3, "15e-2", "'all' AS element, y, x, round(greatest(out, 0), 6) AS value"))
def tv_denoise_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel form of total-variation denoising, in tiles."""
    rows = T.grid(spark, sf_dir).select(F.lit("all").alias("element"), "y", "x", (V.total(F.col("spectrum")) / 100.0).alias("value"))
    return tiles.denoise_maps(rows, 0.15, 3, tile=8).select("element", "y", "x", r6("value").alias("value"))


@query()
def signal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which singular components of each block lie before the elbow."""
    data = partitioning.PartitionedDataset(T.cube(spark, sf_dir), T.WIDTH, 15, (T.BLOCK, T.BLOCK))
    data.block_svd(normalise=True)
    return data.signal_table().withColumn("ratio", r6("ratio"))


@query()
def abundance_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundances by iteration with fixed spectra, block by block."""
    fit = Fit(components=2, simplex_w=False, max_iter=20)
    rows = factorise.abundances_by_block(T.grid(spark, sf_dir), np.eye(T.CHANNELS), T.factor_matrix(), fit)
    return rows.select("block_id", "pixel_id", F.posexplode("h").alias("comp", "h")).withColumn("h", r6("h", 4))


def _abundance_sql(rounds: int) -> str:
    steps = [f"{SOLVE_SQL}, dw AS (SELECT channel, sum(CASE comp WHEN 0 THEN w END) AS w1, sum(CASE comp WHEN 1 THEN w END) AS w2 FROM d GROUP BY channel), a0 AS (SELECT pixel_id, h1, h2 FROM s)"]
    for k in range(rounds):
        steps.append(f"a{k + 1} AS (SELECT pixel_id, greatest(h1 * sum(w1 * value / (w1 * h1 + w2 * h2)) / sum(w1), 1e-14) AS h1, greatest(h2 * sum(w2 * value / (w1 * h1 + w2 * h2)) / sum(w2), 1e-14) AS h2 FROM cells JOIN dw USING (channel) JOIN a{k} USING (pixel_id) GROUP BY pixel_id, h1, h2)")
    return ", ".join(steps)


@query(f"{_abundance_sql(5)} SELECT pixel_id, unnest([0, 1]) AS comp, round(unnest([h1, h2]), 4) AS h FROM a5")
def abundance_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundances by iteration with fixed spectra, over all pixels together."""
    fit = Fit(components=2, simplex_w=False, max_iter=5, no_stop=True)
    _, h, _ = factorise.fit_pixels(T.cube(spark, sf_dir), np.eye(T.CHANNELS), fit, T.factor_matrix(), update_w=False)
    return h.select("pixel_id", F.posexplode("h").alias("comp", "h")).withColumn("h", r6("h", 4))


def _nmf_sql(rounds: int) -> str:
    """Updates of H and W in turn from the least-squares start, then the factors that bring H's columns nearest to 1."""
    steps = [f"{SOLVE_SQL}, dw0 AS (SELECT channel, sum(CASE comp WHEN 0 THEN w END) AS w1, sum(CASE comp WHEN 1 THEN w END) AS w2 FROM d GROUP BY channel), a0 AS (SELECT pixel_id, h1, h2 FROM s)"]
    for k in range(rounds):
        steps.append(f"a{k + 1} AS (SELECT pixel_id, greatest(h1 * sum(w1 * value / (w1 * h1 + w2 * h2)) / sum(w1), 1e-14) AS h1, greatest(h2 * sum(w2 * value / (w1 * h1 + w2 * h2)) / sum(w2), 1e-14) AS h2 FROM cells JOIN dw{k} USING (channel) JOIN a{k} USING (pixel_id) GROUP BY pixel_id, h1, h2)")
        steps.append(f"dw{k + 1} AS (SELECT channel, greatest(w1 * sum(h1 * value / (w1 * h1 + w2 * h2)) / sum(h1), 1e-14) AS w1, greatest(w2 * sum(h2 * value / (w1 * h1 + w2 * h2)) / sum(h2), 1e-14) AS w2 FROM cells JOIN dw{k} USING (channel) JOIN a{k + 1} USING (pixel_id) GROUP BY channel, w1, w2)")
    steps.append(f"m AS (SELECT sum(h1 * h1) AS m11, sum(h1 * h2) AS m12, sum(h2 * h2) AS m22, sum(h1) AS s1, sum(h2) AS s2 FROM a{rounds})")
    steps.append("f AS (SELECT (m22 * s1 - m12 * s2) / (m11 * m22 - m12 * m12) AS f1, (m11 * s2 - m12 * s1) / (m11 * m22 - m12 * m12) AS f2 FROM m)")
    return ", ".join(steps)


def _given_start(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, DataFrame]:
    fit = Fit(components=2, simplex_w=False, max_iter=2, no_stop=True)
    w, h, _ = factorise.fit_pixels(T.cube(spark, sf_dir), np.eye(T.CHANNELS), fit, T.factor_matrix())
    return w, h


@query(f"{_nmf_sql(2)} SELECT pixel_id, unnest([0, 1]) AS comp, round(unnest([h1 * f1, h2 * f2]), 6) AS h FROM a2 CROSS JOIN f")
def distributed_nmf_given_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the whole-image fit from a given W: its abundances."""
    return _given_start(spark, sf_dir)[1].select("pixel_id", F.posexplode("h").alias("comp", "h")).withColumn("h", r6("h"))


@query(f"{_nmf_sql(2)} SELECT channel, unnest([0, 1]) AS comp, round(unnest([w1 / f1, w2 / f2]), 4) AS w FROM dw2 CROSS JOIN f")
def distributed_nmf_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the whole-image fit from a given W: its spectra."""
    w = _given_start(spark, sf_dir)[0]
    rows = spark.createDataFrame([(c + 1, k, float(v)) for c, row in enumerate(w) for k, v in enumerate(row)], "channel int, comp int, w double")
    return rows.withColumn("w", r6("w", 4))


# -- the whole-image fit: its stop, and projected gradients ------------------------------------------------------------


def _stop_sql(rounds: int, tol: str) -> str:
    """Rounds from the given start, the loss after each with both changes, and the first round that a stop rule names."""
    loss = lambda k: f"l{k} AS (SELECT avg(w1 * h1 + w2 * h2 - greatest(value, 1e-14) * ln(w1 * h1 + w2 * h2) + greatest(value, 1e-14) * ln(greatest(value, 1e-14)) - greatest(value, 1e-14)) AS l FROM cells JOIN dw{k} USING (channel) JOIN a{k} USING (pixel_id))"
    change = lambda name, t, key, k: f"""{name}{k} AS (SELECT max(d / (n + {tol} * m)) AS c FROM (SELECT d, n, avg(d) OVER () AS m FROM (
      SELECT unnest([abs(b.{t}1 - a.{t}1), abs(b.{t}2 - a.{t}2)]) AS d, unnest([b.{t}1, b.{t}2]) AS n FROM {"dw" if t == "w" else "a"}{k} b JOIN {"dw" if t == "w" else "a"}{k - 1} a USING ({key}))))"""  # noqa: E731
    parts = [_nmf_sql(rounds), loss(0)]
    for k in range(1, rounds + 1):
        parts += [loss(k), change("cw", "w", "channel", k), change("ch", "h", "pixel_id", k)]
    rows = " UNION ALL ".join(f"SELECT {k} AS k, l{k}.l AS l, cw{k}.c AS cw, ch{k}.c AS ch FROM l{k} CROSS JOIN cw{k} CROSS JOIN ch{k}" for k in range(1, rounds + 1))
    parts.append(f"trace AS ({rows}), seen AS (SELECT *, lag(l) OVER (ORDER BY k) AS before, (SELECT l FROM l0) AS first FROM trace)")
    parts.append(f"ruled AS (SELECT k, l, CASE WHEN greatest(cw, ch) < {tol} THEN 'factors settled' WHEN abs((before - l) / first) < {tol} THEN 'loss settled' WHEN l > before THEN 'loss rose' WHEN k = {rounds} THEN 'max_iter' END AS why FROM seen)")
    return ", ".join(parts) + " SELECT CAST(k AS INTEGER) AS rounds, why, round(l, 6) AS loss FROM ruled WHERE why IS NOT NULL ORDER BY k LIMIT 1"


def _stopped_fit(spark: SparkSession, sf_dir: str, tol: float) -> DataFrame:
    fit = Fit(components=2, simplex_w=False, max_iter=6, tol=tol)
    report = factorise.fit_pixels(T.cube(spark, sf_dir), np.eye(T.CHANNELS), fit, T.factor_matrix())[2]
    return spark.createDataFrame([(report["iterations"], report["stopped"], round(report["loss"], 6))], "rounds int, why string, loss double")


@query(_stop_sql(6, "5e-3"))
def distributed_stop_by_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and why the whole-image fit ends, and the loss of what it returns."""
    return _stopped_fit(spark, sf_dir, 5e-3)


@query(_stop_sql(6, "9e-1"))
def distributed_stop_by_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a tolerance that both factors' changes meet first."""
    return _stopped_fit(spark, sf_dir, 0.9)


GRADIENT_SQL = f"""{SOLVE_SQL}, dw AS (SELECT channel, sum(CASE comp WHEN 0 THEN greatest(w, 1e-1) END) AS w1, sum(CASE comp WHEN 1 THEN greatest(w, 1e-1) END) AS w2 FROM d GROUP BY channel),
a0 AS (SELECT pixel_id, greatest(h1, 1e-1) AS h1, greatest(h2, 1e-1) AS h2 FROM s),
bound AS (SELECT (SELECT max(t) FROM (SELECT sum(value) AS t FROM cells GROUP BY pixel_id)) * 50 AS gh, (SELECT max(t) FROM (SELECT sum(value) AS t FROM cells GROUP BY channel)) * 50 AS gw),
a1 AS (SELECT pixel_id, greatest(h1 - sum(w1 - w1 * value / greatest(w1 * h1 + w2 * h2, 1e-1)) / gh, 1e-1) AS h1, greatest(h2 - sum(w2 - w2 * value / greatest(w1 * h1 + w2 * h2, 1e-1)) / gh, 1e-1) AS h2 FROM cells JOIN dw USING (channel) JOIN a0 USING (pixel_id) CROSS JOIN bound GROUP BY pixel_id, h1, h2, gh),
dw1 AS (SELECT channel, greatest(w1 - sum(h1 - h1 * value / greatest(w1 * h1 + w2 * h2, 1e-1)) / gw, 1e-1) AS w1, greatest(w2 - sum(h2 - h2 * value / greatest(w1 * h1 + w2 * h2, 1e-1)) / gw, 1e-1) AS w2 FROM cells JOIN dw USING (channel) JOIN a1 USING (pixel_id) CROSS JOIN bound GROUP BY channel, w1, w2, gw)"""


@query(f"{GRADIENT_SQL} SELECT round(avg(greatest(w1 * h1 + w2 * h2, 1e-1) - greatest(value, 1e-1) * ln(greatest(w1 * h1 + w2 * h2, 1e-1)) + greatest(value, 1e-1) * ln(greatest(value, 1e-1)) - greatest(value, 1e-1)), 6) AS loss FROM cells JOIN dw1 USING (channel) JOIN a1 USING (pixel_id)")
def distributed_gradient_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the whole-image fit by projected gradients, with steps by the bounds of all pixels: the loss after it."""
    fit = Fit(components=2, simplex_w=False, max_iter=1, no_stop=True, algorithm=Algorithm.PROJECTED_GRADIENT, floor=0.1)
    report = factorise.fit_pixels(T.cube(spark, sf_dir), np.eye(T.CHANNELS), fit, T.factor_matrix())[2]
    return spark.createDataFrame([(round(report["trace"][0], 6),)], "loss double")


@query(f"""WITH {GRID_SQL}, p AS (SELECT pixel_id, sum(value) AS r FROM grid GROUP BY pixel_id), c AS (SELECT block_id, channel, sum(value) AS c FROM grid GROUP BY ALL)
SELECT grid.pixel_id, channel, round(CASE WHEN r * c > 0 THEN value / sqrt(r) / sqrt(c) ELSE 0 END, 6) AS value FROM grid JOIN p USING (pixel_id) JOIN c USING (block_id, channel)""")
def poisson_normalise_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.poisson_normalised(T.grid(spark, sf_dir), by="block_id")
    return reshape.to_cells(rows, "spectrum", 1).withColumn("value", r6("value"))


@query(f"""WITH {SPEC_SQL}, e AS (SELECT i, max(CASE label WHEN 0 THEN c END) AS a, max(CASE label WHEN 1 THEN c END) AS b FROM centre GROUP BY i), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM e),
p AS (SELECT vec_id, sum(a * v) AS av, sum(b * v) AS bv FROM spec JOIN e USING (i) GROUP BY vec_id), u AS (SELECT vec_id, av, bv, aa, bb, (bb * av - ab * bv) / (aa * bb - ab * ab) AS x, (aa * bv - ab * av) / (aa * bb - ab * ab) AS y FROM p CROSS JOIN g),
s AS (SELECT vec_id, CASE WHEN x >= 0 AND y >= 0 THEN x WHEN y < 0 THEN greatest(av / aa, 0) ELSE 0 END AS x, CASE WHEN x >= 0 AND y >= 0 THEN y WHEN y < 0 THEN 0 ELSE greatest(bv / bb, 0) END AS y FROM u)
SELECT vec_id, CAST(unnest([0, 1]) AS INTEGER) AS endmember, round(greatest(unnest([x, y]), 1e-10), 6) AS share FROM s""")
def abundance_nnls_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative shares of two endmembers, for which a closed form exists."""
    ends = np.array([r["features"] for r in centres(spark, sf_dir).where("label < 2").orderBy("label").collect()]).T
    found = clustering.abundances_nnls(spec(spark, sf_dir).select("vec_id", F.col("spectrum").alias("features")), ends)
    return found.select("vec_id", F.posexplode("a").alias("endmember", "share")).withColumn("share", r6("share"))


# -- refinement of a whole image ---------------------------------------------------------------------------------------


def _fusion_sql(rounds: int) -> str:
    """Rounds of two steps of denoising each, over the image's whole rectangle: places without a pixel are 0 in each round."""
    parts = [
        f"""WITH {MODEL_SQL}, e AS (SELECT element, number / z AS z FROM elements CROSS JOIN zm), given AS (SELECT q.pixel_id, q.element, coalesce(pct, 0) / 100 AS v, image / 1e6 AS image FROM q JOIN image USING (pixel_id)),
ends AS (SELECT element, min(v) AS low, CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1e0 END AS span FROM given GROUP BY element),
side AS (SELECT min(image) AS low, CASE WHEN max(image) > min(image) THEN max(image) - min(image) ELSE 1e0 END AS span FROM given),
own AS (SELECT pixel_id, pixel_id // {T.WIDTH} AS y, pixel_id % {T.WIDTH} AS x, element, (v - ends.low) / ends.span AS start, (image - side.low) / side.span AS target FROM given JOIN ends USING (element) CROSS JOIN side),
box AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM own),
places AS (SELECT y, x, element FROM (SELECT unnest(generate_series(y0, y1)) AS y FROM box) CROSS JOIN (SELECT unnest(generate_series(x0, x1)) AS x FROM box) CROSS JOIN (SELECT element FROM elements)),
n0 AS (SELECT pixel_id, y, x, element, start, target, start AS now FROM own)"""
    ]
    over = "WINDOW wy AS (PARTITION BY element, x ORDER BY y), wx AS (PARTITION BY element, y ORDER BY x)"
    for k in range(rounds):
        parts += [
            f"m{k} AS (SELECT pixel_id, sum(z * pow(now, 16e-1)) AS modelled FROM n{k} JOIN e USING (element) GROUP BY pixel_id)",
            f"s{k} AS (SELECT pixel_id, y, x, element, start, target, greatest(now - (16e-1 * pow(now, 6e-1) * z * (modelled - target) / 25 + 8e-2 * (1 - start / (now + 24e-2))), 0) AS now FROM n{k} JOIN m{k} USING (pixel_id) JOIN e USING (element))",
            f"d{k} AS (SELECT y, x, element, coalesce(now, 0e0) AS v FROM places LEFT JOIN s{k} USING (y, x, element))",
            f"f{k} AS (SELECT *, coalesce(v - lead(v) OVER wy, 0) / (8 * 15e-2) AS fx, coalesce(v - lead(v) OVER wx, 0) / (8 * 15e-2) AS fy FROM d{k} {over})",
            f"p{k} AS (SELECT y, x, element, v, fx / greatest(1, sqrt(fx * fx + fy * fy)) AS px, fy / greatest(1, sqrt(fx * fx + fy * fy)) AS py FROM f{k})",
            f"t{k} AS (SELECT y, x, element, greatest(v - 15e-2 * (px + py - lag(px, 1, 0e0) OVER wy - lag(py, 1, 0e0) OVER wx), 0) AS v FROM p{k} {over})",
            f"n{k + 1} AS (SELECT pixel_id, y, x, element, start, target, v AS now FROM s{k} JOIN t{k} USING (y, x, element))",
        ]
    parts.append(f"whole AS (SELECT pixel_id, element, now * span + low AS v FROM n{rounds} JOIN ends USING (element))")
    return ", ".join(parts) + " SELECT pixel_id, element, round(CASE WHEN sum(v) OVER w <> 0 THEN 100e0 * v / sum(v) OVER w ELSE 0 END, 4) AS at_percent FROM whole WINDOW w AS (PARTITION BY pixel_id)"


@query(_fusion_sql(2))
def haadf_fusion_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds on the whole image, in tiles."""
    rows, numbers = fused(spark, sf_dir)
    placed = T.grid(spark, sf_dir).select("pixel_id", "y", "x").join(rows, "pixel_id")
    q, _ = fusion.refine_image(placed, numbers, fusion.Refinement(rounds=2, tv_rounds=2), tile=8)
    return by_element(q, "q", T.element_names(spark, sf_dir), "at_percent", 4)


# -- the facade's maps -------------------------------------------------------------------------------------------------

FACADE_SQL = f"""{DH_SQL}, {ELEMENTS_SQL}, q AS (SELECT pixel_id, element, number, atomic_mass, density, 100e0 * fit / sum(fit) OVER (PARTITION BY pixel_id) AS pct FROM dh JOIN elements ON channel = number),
w_ AS (SELECT *, 100e0 * pct * atomic_mass / sum(pct * atomic_mass) OVER (PARTITION BY pixel_id) AS weight FROM q),
maps AS (SELECT pixel_id, sum(weight) / sum(weight / density) AS rho, sum(pct * number) / 100 AS z FROM w_ GROUP BY pixel_id)"""


def _facade(spark: SparkSession, sf_dir: str):
    """An estimator with a fixed W and H; the last half of its rows counts as background."""
    from .estimators import BlockWiseUnmixing

    names = T.element_names(spark, sf_dir)
    est = BlockWiseUnmixing(np.eye(T.CHANNELS), names=[*names, *(f"hidden{i}" for i in range(T.CHANNELS - len(names)))], table=T.elements(spark, sf_dir), background_rows=T.CHANNELS - len(names))
    est.w = T.factor_matrix()
    est.h = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pixel_id"), T.factor_h("s_suppkey").alias("h"))
    return est, names


@query(f"WITH {FACADE_SQL} SELECT pixel_id, round(rho, 6) AS density, round(z, 6) AS mean_z FROM maps")
def facade_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density and mean atomic number of an estimator's compositions."""
    est, _ = _facade(spark, sf_dir)
    return est.maps().select("pixel_id", r6("density").alias("density"), r6("mean_z").alias("mean_z"))


@query(f"""WITH {FACADE_SQL}, {ZERO_SQL}, dd AS (SELECT i.*, rho, z, {PHYSICS_SQL} AS f FROM i JOIN maps USING (pixel_id)), a AS (SELECT *, 55e-1 * pow(rho, 3e-1) / (f * 200) AS te, 76e-1 * pow(z, 36e-2) AS em FROM dd),
b AS (SELECT *, ln(400e0 / (te * te)) AS lr, ln((100e0 + 225 + 125 + 2 * te * te) * 400 / (100e0 + 225 + 125 + 800) / (te * te)) AS lc FROM a)
SELECT pixel_id, round(CASE WHEN whole > 0 AND zero > 0 THEN ln(whole / zero) * (lr / lc) / (11e0 * pow(rho, 3e-1) / (200 * f * 200) * lr) END, 6) AS by_density,
  round(CASE WHEN whole > 0 AND zero > 0 THEN ln(whole / zero) * 106 * f * 200 / (em * ln(2 * 15e0 * 200 / em)) END, 6) AS by_number FROM b""")
def facade_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thickness by either map of an estimator."""
    est, _ = _facade(spark, sf_dir)
    low, maps = T.lowloss(spark, sf_dir), est.maps()
    by = [est.thickness(low, maps, 6.0, 1.0, 0.0, BEAM, BETA, ALPHA, by=name).select("pixel_id", r6("thickness").alias(out)) for name, out in (("density", "by_density"), ("mean_z", "by_number"))]
    return by[0].join(by[1], "pixel_id")


@query(f"""WITH {FACADE_SQL}, {MACS_SQL}, near AS (SELECT element, arg_min(mac, (abs(energy - 32e-1), energy)) AS mac FROM macs GROUP BY element),
mixed AS (SELECT pixel_id, sum(weight * mac) / sum(weight) AS mu FROM w_ JOIN near USING (element) GROUP BY pixel_id),
chi AS (SELECT pixel_id, mu * rho * 50e0 * 1e-7 / sin(radians(22e0)) AS c, mu * rho * (50e0 + pixel_id % 7 * 1e1) * 1e-7 / sin(radians(22e0)) AS m FROM mixed JOIN maps USING (pixel_id))
SELECT pixel_id, round((1 - exp(-c)) / c, 9) AS constant, round((1 - exp(-m)) / m, 9) AS mapped FROM chi""")
def facade_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absorption factors from an estimator's compositions, with one thickness and with a map of it."""
    est, names = _facade(spark, sf_dir)
    at = est.h.select("pixel_id", ((F.col("pixel_id") % 7) * 10.0 + 50.0).alias("thickness"))
    each = [est.absorption(T.macs(spark, sf_dir), [ENERGY], names, 22.0, **given).select("pixel_id", r6(F.get("a", 0), 9).alias(out)) for given, out in (({"thickness_nm": 50.0}, "constant"), ({"thickness_map": at}, "mapped"))]
    return each[0].join(each[1], "pixel_id")


@query(f"""WITH {DH_SQL}, {ELEMENTS_SQL}, sums AS (SELECT comp, sum(v) AS s FROM h GROUP BY comp)
SELECT element, CAST(comp AS INTEGER) AS comp, round(100e0 * w / sum(w) OVER (PARTITION BY comp), 6) AS at_percent, round(100e0 / sqrt(w * s), 6) AS std_percent FROM d JOIN elements ON channel = number JOIN sums USING (comp)""")
def facade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each component and their errors, as an estimator reports them."""
    est, _ = _facade(spark, sf_dir)
    return est.report().select("element", "comp", r6("at_percent").alias("at_percent"), r6("std_percent").alias("std_percent"))
