"""Views of the driver's tables that stand for instrument data. Constants are formulas of keys, so that SQL can repeat them.

cube: a pixel for each supplier, a channel for each part size 1..50, counts are sums of quantities.
grid: the cube's pixels in rows of ten; blocks are 5 x 5. lowloss: a pixel for each user, 24 hours as channels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Instrument
from ..operators import reshape
from ..sources.blocks import with_blocks

CHANNELS, WIDTH, BLOCK, HOURS = 50, 10, 5, 24
FACTORS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, channel, value) without the empty cells."""
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("channel"))
    return sold.join(parts, "l_partkey").groupBy(F.col("l_suppkey").alias("pixel_id"), "channel").agg(F.sum("l_quantity").alias("value"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, spectrum): a row for each supplier."""
    packed = counts(spark, sf_dir).groupBy("pixel_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "value"))).alias("_m"))
    pixels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pixel_id")).join(packed, "pixel_id", "left")
    values = F.transform(F.sequence(F.lit(1), F.lit(CHANNELS)), lambda c: F.coalesce(F.col("_m")[c], F.lit(0.0)))
    return pixels.select("pixel_id", values.alias("spectrum"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_blocks(cube(spark, sf_dir), BLOCK, BLOCK, WIDTH)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_cells(cube(spark, sf_dir), "spectrum", 1)


def lowloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, spectrum): values by hour of day, as magnitudes, for each user."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("pixel_id"), F.hour("ts").alias("channel"), F.abs("value").alias("value"))
    return reshape.to_pixels(rows.groupBy("pixel_id", "channel").agg(F.sum("value").alias("value")), HOURS)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, image): sums of prices."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pixel_id")).agg(F.sum("l_extendedprice").alias("image"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element, number, atomic_mass, density), one for each nation."""
    n = F.col("n_nationkey") + 1
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("element"), n.cast("int").alias("number"), (n * 2.0 + 0.5).alias("atomic_mass"), ((n % 9) * 0.25 + 1.0).alias("density"))


def element_names(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["element"] for r in elements(spark, sf_dir).orderBy("number").collect()]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element, line, energy, cs): two lines of each element."""
    k = F.col("n_nationkey")
    two = F.array(F.struct(F.lit("Ka1").alias("line"), (k * 0.31 + 0.5).alias("energy"), ((k % 5) + 1.0).alias("cs")), F.struct(F.lit("Kb1").alias("line"), (k * 0.31 + 1.6).alias("energy"), (((k % 5) + 1.0) * 0.3).alias("cs")))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("element"), F.explode(two).alias("v")).select("element", "v.line", "v.energy", "v.cs")


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select((k * 2.0 + 0.7).alias("energy"), (F.lit(0.9) - k * 0.1).alias("efficiency"))


def macs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element, energy, mac): five energies of each element."""
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    regions = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey"))
    return table(spark, sf_dir, "nation").join(regions).select(F.col("n_name").alias("element"), (r * 2.0 + 0.7).alias("energy"), ((k + 10.0) * 3.0 / (r + 1.0)).alias("mac"))


def instrument(names: list[str], size: int = 100, thickness: float = 0.0) -> Instrument:
    return Instrument(beam_energy=200.0, axis_size=size, axis_scale=10.0 / size, axis_offset=0.05, elements=tuple(names), split_elements=(names[3],), split_energies=(2.0,), thickness=thickness)


def factor_matrix() -> np.ndarray:
    """A fixed D of 50 channels and two components."""
    c = np.arange(1, CHANNELS + 1)
    return np.column_stack([1.0 + c % 3, 0.5 + c % 7])


def small_dictionary() -> tuple[np.ndarray, np.ndarray]:
    """A fixed G of 50 channels and three columns, and W of two components."""
    c, k, m = np.arange(1, CHANNELS + 1)[:, None], np.arange(3), np.arange(2)
    return 1.0 + (c * (k + 2)) % 4, 1.0 + (k[:, None] + 2 * m) % 3


def row_factors(rows: int) -> np.ndarray:
    """A fixed W of two components."""
    i = np.arange(rows)
    return np.column_stack([1.0 + i % 3, 0.5 + i % 7])


def factor_h(pixel: str = "pixel_id"):
    """A fixed h of two components."""
    return F.array((F.col(pixel) % 3 + 1.0).cast("double"), (F.col(pixel) % 4 + 0.5).cast("double"))


# -- the same in SQL -------------------------------------------------------------------------------------------------

CELLS_SQL = f"""cells AS (
  SELECT s.s_suppkey AS pixel_id, CAST(c.channel AS INTEGER) AS channel, coalesce(v.value, 0e0) AS value
  FROM supplier s CROSS JOIN (SELECT unnest(generate_series(1, {CHANNELS})) AS channel) c
  LEFT JOIN (SELECT l_suppkey, p_size, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_size) v
    ON v.l_suppkey = s.s_suppkey AND v.p_size = c.channel)"""
GRID_SQL = f"""{CELLS_SQL}, grid AS (
  SELECT *, CAST(pixel_id // {WIDTH} AS INTEGER) AS y, CAST(pixel_id % {WIDTH} AS INTEGER) AS x,
    CAST((pixel_id // {WIDTH}) // {BLOCK} * {WIDTH // BLOCK} + (pixel_id % {WIDTH}) // {BLOCK} AS INTEGER) AS block_id FROM cells)"""
ELEMENTS_SQL = """elements AS (SELECT n_name AS element, CAST(n_nationkey + 1 AS INTEGER) AS number, (n_nationkey + 1) * 2e0 + 5e-1 AS atomic_mass, ((n_nationkey + 1) % 9) * 25e-2 + 1e0 AS density FROM nation)"""
Q_SQL = f"""{CELLS_SQL}, {ELEMENTS_SQL}, q AS (
  SELECT pixel_id, element, number, atomic_mass, density, 100e0 * value / nullif(sum(value) OVER (PARTITION BY pixel_id), 0) AS pct
  FROM cells JOIN elements ON channel = number)"""
LINES_SQL = """lines AS (
  SELECT n_name AS element, n_nationkey, 'Ka1' AS line, n_nationkey * 31e-2 + 5e-1 AS energy, (n_nationkey % 5) + 1e0 AS cs FROM nation
  UNION ALL SELECT n_name, n_nationkey, 'Kb1', n_nationkey * 31e-2 + 16e-1, ((n_nationkey % 5) + 1e0) * 3e-1 FROM nation),
efficiency AS (SELECT r_regionkey * 2e0 + 7e-1 AS energy, 9e-1 - r_regionkey * 1e-1 AS efficiency FROM region)"""
AXIS_SQL = """axis AS (SELECT CAST(i AS INTEGER) AS channel, i * (100 * 1e-1 / 99) + 5e-2 AS energy FROM (SELECT unnest(generate_series(0, 99)) AS i))"""
FIT_SQL = """h AS (SELECT s_suppkey AS pixel_id, 0 AS comp, s_suppkey % 3 + 1e0 AS v FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey % 4 + 5e-1 FROM supplier),
dh AS (SELECT pixel_id, channel, sum(w * v) AS fit FROM d JOIN h USING (comp) GROUP BY pixel_id, channel),
xf AS (SELECT cells.pixel_id, cells.channel, value AS x, fit FROM cells JOIN dh USING (pixel_id, channel))"""
DH_SQL = f"""{GRID_SQL}, d AS (
  SELECT CAST(c AS INTEGER) AS channel, 0 AS comp, 1e0 + c % 3 AS w FROM (SELECT unnest(generate_series(1, {CHANNELS})) AS c)
  UNION ALL SELECT CAST(c AS INTEGER), 1, 5e-1 + c % 7 FROM (SELECT unnest(generate_series(1, {CHANNELS})) AS c)),
{FIT_SQL}"""
G_SQL = f"""{GRID_SQL}, g AS (SELECT CAST(c AS INTEGER) AS channel, k, 1e0 + (c * (k + 2)) % 4 AS g FROM (SELECT unnest(generate_series(1, {CHANNELS})) AS c) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
w AS (SELECT k, comp, 1e0 + (k + 2 * comp) % 3 AS w FROM (SELECT unnest([0, 1, 2]) AS k) CROSS JOIN (SELECT unnest([0, 1]) AS comp)),
d AS (SELECT channel, comp, sum(g * w) AS w FROM g JOIN w USING (k) GROUP BY channel, comp),
{FIT_SQL}"""
MACS_SQL = "macs AS (SELECT n_name AS element, r_regionkey * 2e0 + 7e-1 AS energy, (n_nationkey + 10e0) * 3 / (r_regionkey + 1e0) AS mac FROM nation CROSS JOIN region)"
LOWLOSS_SQL = f"""lowcells AS (
  SELECT u.user_id AS pixel_id, CAST(c.channel AS INTEGER) AS channel, coalesce(v.value, 0e0) AS value
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(0, {HOURS - 1})) AS channel) c
  LEFT JOIN (SELECT user_id, hour(ts) AS h, sum(abs(value)) AS value FROM events GROUP BY user_id, hour(ts)) v ON v.user_id = u.user_id AND v.h = c.channel)"""
IMAGE_SQL = "image AS (SELECT l_suppkey AS pixel_id, sum(l_extendedprice) AS image FROM lineitem GROUP BY l_suppkey)"
