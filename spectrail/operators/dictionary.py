"""The physics dictionary G in long form, (channel, g_name, value): peaks of elements, and two background columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Absorption, Instrument, ProblemType
from ..functions import physics as P
from . import absorption
from .composition import simplex_rows
from .lookups import nearest

BACKGROUND = ("background_0", "background_1")


def energy_axis(spark: SparkSession, size: int, scale: float, offset: float) -> DataFrame:
    """(channel, energy), both ends included."""
    return spark.range(size).select(F.col("id").cast("int").alias("channel"), P.energy_at(F.col("id"), size, scale, offset).alias("energy"))


def count_columns(elements: DataFrame, split: DataFrame) -> DataFrame:
    """(g_columns): one for each element, two for a split one."""
    marked = elements.join(split.select("element").distinct().withColumn("_split", F.lit(1)), "element", "left")
    return marked.agg(F.sum(F.when(F.col("_split").isNotNull(), 2).otherwise(1)).cast("long").alias("g_columns"))


def peaks(lines: DataFrame, inst: Instrument, efficiency: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """(channel, g_name, value) of the elements' peaks: for each line inside the axis, its strength times a Gaussian, the
    detector's efficiency and an absorption factor (element, line, factor). A split element gives a row of lines below
    its energy and one of the rest. Names without a positive value are left out, a split one with both of its rows."""
    size, scale, offset = inst.axis_size, inst.axis_scale, inst.axis_offset
    inside = lines.where(F.col("element").isin(list(inst.elements)) & (F.col("energy") > offset) & (F.col("energy") < offset + size * scale))
    seen = nearest(inside, F.col("energy"), efficiency, "energy", "efficiency", "_eff")
    if factors is not None:
        seen = seen.join(factors.select("element", "line", "factor"), ["element", "line"], "left")
    else:
        seen = seen.withColumn("factor", F.lit(1.0))
    limit = F.coalesce(*(F.when(F.col("element") == e, F.lit(float(t))) for e, t in zip(inst.split_elements, inst.split_energies, strict=True)), F.lit(None).cast("double"))
    band = F.when(limit.isNull(), "").when(F.col("energy") < limit, "_low").otherwise("_high")
    wide = seen.select("element", F.concat("element", band).alias("g_name"), "energy", (F.col("cs") * F.col("_eff") * F.coalesce("factor", F.lit(1.0))).alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("channel"))
    x = P.energy_at(F.col("channel").cast("double"), size, scale, offset)
    width = P.peak_width(F.col("energy"), inst.width_slope, inst.width_intercept)
    sums = wide.withColumn("_v", P.gaussian(x, F.col("energy"), width) * F.col("_k")).groupBy("element", "g_name", "channel").agg(F.sum("_v").alias("value"))
    tops = sums.groupBy("element", "g_name").agg(F.max("value").alias("_top")).where("_top > 0").groupBy("element").agg(F.count(F.lit(1)).alias("_rows"))
    need = F.when(F.col("element").isin(list(inst.split_elements)), 2).otherwise(1)
    return sums.join(tops.where(F.col("_rows") == need).select("element"), "element").select("channel", "g_name", "value")


def background(spark: SparkSession, inst: Instrument, efficiency: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """(channel, g_name, value) of the two background columns, times efficiency and (channel, factor) of absorption."""
    axis = energy_axis(spark, inst.axis_size, inst.axis_scale, inst.axis_offset)
    seen = nearest(axis, F.col("energy"), efficiency, "energy", "efficiency", "_eff")
    seen = seen.join(factors.select("channel", "factor"), "channel", "left") if factors is not None else seen.withColumn("factor", F.lit(1.0))
    k = F.col("_eff") * F.coalesce("factor", F.lit(1.0))
    two = F.array(*(F.struct(F.lit(n).alias("g_name"), (f(F.col("energy"), inst.beam_energy) * k).alias("value")) for n, f in zip(BACKGROUND, (P.background_0, P.background_1), strict=True)))
    return seen.select("channel", F.explode(two).alias("b")).select("channel", "b.g_name", "b.value")


def normalised(g: DataFrame) -> DataFrame:
    """Columns over their norms; the elements' norms are replaced by their mean."""
    norms = g.groupBy("g_name").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    own = ~F.col("g_name").isin(*BACKGROUND)
    mean = norms.where(own).agg(F.avg("_norm").alias("_mean"))
    by = norms.join(F.broadcast(mean)).select("g_name", F.when(own, F.col("_mean")).otherwise(F.col("_norm")).alias("_by"))
    return g.join(by, "g_name").select("channel", "g_name", F.try_divide(F.col("value"), F.col("_by")).alias("value"))


def energies(inst: Instrument) -> list[float]:
    """The energy of each channel."""
    return [i * (inst.axis_size * inst.axis_scale / (inst.axis_size - 1)) + inst.axis_offset for i in range(inst.axis_size)]


def mixture(inst: Instrument) -> tuple[list[str], list[float]]:
    """Elements and concentrations that absorb the background: those given, alike if without concentrations, or all alike."""
    own = list(inst.absorption_elements or inst.elements)
    given = list(inst.absorption_concentrations) if inst.absorption_elements else []
    return own, given if any(given) else [1.0] * len(own)


def dictionary(spark: SparkSession, inst: Instrument, lines: DataFrame, efficiency: DataFrame, macs: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """G by problem: the identity, peaks, or peaks and background. With internal absorption and a thickness, lines are
    weakened by their own element and the background by the mixture; that needs macs and the periodic table."""
    if inst.problem == ProblemType.IDENTITY:
        return spark.range(inst.axis_size).select(F.col("id").cast("int").alias("channel"), F.col("id").cast("string").alias("g_name"), F.lit(1.0).alias("value"))
    of_lines = of_axis = None
    if inst.absorption == Absorption.INTERNAL and inst.thickness:
        if macs is None or table is None:
            raise ValueError("internal absorption needs absorption coefficients and a periodic table")
        of_lines = absorption.line_factors(lines.where(F.col("element").isin(list(inst.elements))), macs, table, inst.thickness, inst.elevation)
        of_axis = absorption.axis_factors(macs, table, *mixture(inst), energies(inst), inst.thickness, inst.elevation, inst.density)
    g = peaks(lines, inst, efficiency, of_lines)
    if inst.problem == ProblemType.BREMSSTRAHLUNG:
        g = g.union(background(spark, inst, efficiency, of_axis))
    return normalised(g)


def refreshed_background(spark: SparkSession, inst: Instrument, efficiency: DataFrame, g: DataFrame, factors: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """G with the background columns made anew from absorption factors of the present mean composition, over their own
    norms, or over those that they had with the factors `first`."""
    new = background(spark, inst, efficiency, factors)
    if first is None:
        return g.where(~F.col("g_name").isin(*BACKGROUND)).union(normalised(new))
    norms = background(spark, inst, efficiency, first).groupBy("g_name").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    new = new.join(norms, "g_name").select("channel", "g_name", F.try_divide("value", "_norm").alias("value"))
    return g.where(~F.col("g_name").isin(*BACKGROUND)).union(new)


@dataclass(frozen=True)
class Dictionary:
    """G as channels x columns, with names in the order of the instrument's elements (low before high), then the background;
    of the identity in the order of channels. refreshed(w): the same with the background absorbed by W's mean composition."""

    g: np.ndarray
    names: tuple[str, ...]
    background_rows: int
    refreshed: Callable[[np.ndarray], Dictionary] | None = None


def build(spark: SparkSession, inst: Instrument, lines: DataFrame, efficiency: DataFrame, macs: DataFrame | None = None, table: DataFrame | None = None) -> Dictionary:
    """The dictionary of an instrument, ready for estimators. What is collected has the size of channels x columns."""
    long = dictionary(spark, inst, lines, efficiency, macs, table)
    identity = inst.problem == ProblemType.IDENTITY
    order = [str(i) for i in range(inst.axis_size)] if identity else [n for e in inst.elements for n in (e, f"{e}_low", f"{e}_high")] + list(BACKGROUND)

    def dense(rows: DataFrame) -> tuple[np.ndarray, tuple[str, ...]]:
        t = rows.toPandas()
        names = tuple(n for n in order if n in set(t["g_name"]))
        g = np.zeros((inst.axis_size, len(names)))
        g[t["channel"].to_numpy(), [names.index(n) for n in t["g_name"]]] = t["value"]
        return g, names

    g, names = dense(long)
    count = sum(n in BACKGROUND for n in names)

    def refreshed(w: np.ndarray) -> Dictionary:
        chosen = simplex_rows(names[: len(names) - count], inst.absorption_elements or None)
        own, share = [e for _, e in chosen], np.asarray(w)[[i for i, _ in chosen]].mean(axis=1)
        factors = lambda elements, q: absorption.axis_factors(macs, table, elements, q, energies(inst), inst.thickness, inst.elevation, inst.density)
        empty = spark.createDataFrame([], "channel int, g_name string, value double")
        new, _ = dense(refreshed_background(spark, inst, efficiency, empty, factors(own, 100 * share / share.sum()), factors(*mixture(inst))))
        return Dictionary(np.hstack([g[:, : len(names) - count], new]), names, count, refreshed)

    can = count and inst.absorption == Absorption.INTERNAL and inst.thickness
    return Dictionary(g, names, count, refreshed if can else None)
