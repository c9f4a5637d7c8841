"""Compositions in atomic percent, one array<double> for each pixel in the order of a list of elements: all narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MeanType
from ..functions import text
from ..functions import vectors as V


def element_values(table: DataFrame, elements: Sequence[str]) -> dict[str, list[float]]:
    """atomic_mass, density and number of the elements, in their order; fails on an unknown one."""
    rows = {r["element"]: r for r in table.where(F.col("element").isin(list(elements))).select("element", "atomic_mass", "density", "number").collect()}
    if missing := [e for e in elements if e not in rows]:
        raise ValueError(f"not in the periodic table: {', '.join(missing)}")
    return {k: [float(rows[e][k]) for e in elements] for k in ("atomic_mass", "density", "number")}


def weight_percent(atomic: Column, masses: Sequence[float]) -> Column:
    """Weight percent; all 0 where the sum is 0."""
    weighed = F.zip_with(atomic, V.literal(masses), lambda a, m: a * m)
    parts = lambda w, s: F.transform(w, lambda x: F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide(x * 100.0, s)))
    return V.once(weighed, lambda w: V.once(V.total(w), lambda s: parts(w, s)))


def mixture_density(weight: Column, densities: Sequence[float], mean: MeanType = MeanType.HARMONIC) -> Column:
    """Density of a mixture by weight; 0 where nothing is there. A harmonic mean needs known densities."""
    if mean == MeanType.HARMONIC:
        if any(d == 0 for d in densities):
            raise ValueError("the density of an element is unknown")
        volume = V.total(F.zip_with(weight, V.literal(densities), lambda w, d: w / d))
        return F.coalesce(F.try_divide(V.total(weight), volume), F.lit(0.0))
    if mean == MeanType.WEIGHTED:
        return F.coalesce(F.try_divide(V.dot(weight, V.literal(densities)), V.total(weight)), F.lit(0.0))
    raise ValueError(f"unknown mean {mean}")


def mean_atomic_number(atomic: Column, numbers: Sequence[float]) -> Column:
    return V.dot(atomic, V.literal(numbers)) / 100.0


def simplex_rows(names: Sequence[str], selected: Sequence[str] | None = None) -> list[tuple[int, str]]:
    """(row, element) of dictionary rows that count in a composition, in the order of `selected` if it is given."""
    own = [(i, n.removesuffix("_high")) for i, n in enumerate(names) if not n.endswith("_low")]
    return own if selected is None else [(i, e) for s in selected for i, e in own if e == s]


def quantification(h: Column, w: Sequence[Sequence[float]], rows: Sequence[int]) -> Column:
    """Atomic percent of the chosen rows of W times h; nulls where they sum to 0."""
    return V.share(V.matvec(V.literal([w[i] for i in rows]), h))


def with_maps(pixels: DataFrame, q: str, elements: Sequence[str], table: DataFrame) -> DataFrame:
    """Add density (g/cm3) and mean_z from the compositions in column q."""
    v = element_values(table, elements)
    size = F.size(q) == len(elements)
    right = F.when(size, F.col(q)).otherwise(F.raise_error(F.lit("compositions and elements differ in number")))
    return pixels.withColumns({"density": mixture_density(weight_percent(right, v["atomic_mass"]), v["density"]), "mean_z": mean_atomic_number(F.col(q), v["number"])})


def explained_intensity(g: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """(g_name, comp, w, intensity): W times the sum of G's column times the sum of H's row.

    g(channel, g_name, value), w(g_name, comp, value), h(pixel_id, h array). Only sums cross the shuffle.
    """
    columns = g.groupBy("g_name").agg(F.sum("value").alias("_g"))
    rows = h.select(F.posexplode("h").alias("comp", "_v")).groupBy("comp").agg(F.sum("_v").alias("_h"))
    joined = w.join(columns, "g_name").join(rows, "comp")
    return joined.select("g_name", "comp", F.col("value").alias("w"), (F.col("value") * F.col("_g") * F.col("_h")).alias("intensity"))


def concentration_report(intensity: DataFrame, background: Sequence[str] = (), selected: Sequence[str] | None = None) -> DataFrame:
    """(element, comp, at_percent, std_percent): shares of the chosen rows in each phase, and Poisson errors 100 / sqrt(N)."""
    rows = intensity.where(text.is_simplex_row(F.col("g_name")) & ~F.col("g_name").isin(list(background)))
    rows = rows.withColumn("element", text.element_of(F.col("g_name")))
    if selected is not None:
        rows = rows.where(F.col("element").isin(list(selected)))
    at = F.try_divide(F.col("w") * 100.0, F.sum("w").over(Window.partitionBy("comp")))
    error = F.try_divide(F.lit(100.0), F.sqrt("intensity"))
    return rows.select("element", "comp", at.alias("at_percent"), error.alias("std_percent"))
