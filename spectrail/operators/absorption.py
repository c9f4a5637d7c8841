"""X-ray absorption: coefficients of mixtures and the correction (1 - exp(-chi)) / chi of each pixel and channel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as P
from ..functions import vectors as V
from .composition import element_values, mixture_density, weight_percent
from .kernels import matrix
from .lookups import lookup


def coefficients(macs: DataFrame, elements: Sequence[str], energies: Sequence[float]) -> np.ndarray:
    """Elements x energies: the coefficient at the closest tabulated energy. Fails on an unknown element."""
    out = np.empty((len(elements), len(energies)))
    rows = macs.where(F.col("element").isin(list(elements))).groupBy("element").agg(F.array_sort(F.collect_list(F.struct("energy", "mac"))).alias("t")).collect()
    tables = {r["element"]: np.array([(x["energy"], x["mac"]) for x in r["t"]]) for r in rows}
    for i, e in enumerate(elements):
        if e not in tables:
            raise ValueError(f"no absorption coefficients of {e}")
        t = tables[e]
        out[i] = t[np.abs(t[:, :1] - np.asarray(energies)).argmin(axis=0), 1]
    return out


def mixture_coefficient(weight: Column, macs: Sequence[float]) -> Column:
    """Mean of the elements' coefficients at one energy, by weight; null without weight."""
    return F.try_divide(V.dot(weight, V.literal(macs)), V.total(weight))


def correction(q: Column, macs: Sequence[float], masses: Sequence[float], densities: Sequence[float], thickness_nm: Column | float, take_off: float, density: Column | None = None) -> Column:
    """The factor at one energy of compositions in atomic percent; 1 at thickness 0. The mixture's density unless given."""
    weight = weight_percent(q, masses)
    rho = density if density is not None else mixture_density(weight, densities)
    t = P.col(thickness_nm) * P.NM_PER_CM
    return F.when(t == 0, F.lit(1.0)).otherwise(P.absorption_factor(mixture_coefficient(weight, macs), rho, t, take_off))


def line_factors(lines: DataFrame, macs: DataFrame, table: DataFrame, thickness_nm: float, take_off: float) -> DataFrame:
    """(element, line, factor): absorption of each line in its own element, at the closest tabulated energy, with the
    element's density. Fails on an element without coefficients or density."""
    by = macs.groupBy("element").agg(F.array_sort(F.collect_list(F.struct(F.col("energy").alias("k"), F.col("mac").alias("v")))).alias("_t"))
    rows = lookup(lookup(lines.select("element", "line", "energy"), table.select("element", "density")), by)
    mac = F.get(F.col("_t.v"), V.nearest(F.col("_t.k"), F.col("energy")))
    factor = F.lit(1.0) if thickness_nm == 0 else P.absorption_factor(mac, F.col("density"), thickness_nm * P.NM_PER_CM, take_off)
    return rows.select("element", "line", factor.alias("factor"))


def axis_factors(macs: DataFrame, table: DataFrame, elements: Sequence[str], concentrations: Sequence[float], energies: Sequence[float], thickness_nm: float, take_off: float, density: float = 0.0) -> DataFrame:
    """(channel, factor): absorption of each channel in a mixture of atomic concentrations, of which only the ratios count.
    The mixture's density unless one is given; without elements the cube law, which needs a density."""
    spark = macs.sparkSession
    if not elements:
        axis = spark.createDataFrame([(i, float(e)) for i, e in enumerate(energies)], "channel int, energy double")
        return axis.select("channel", P.absorption_factor(P.cube_law(F.col("energy")), density, thickness_nm * P.NM_PER_CM, take_off).alias("factor"))
    v = element_values(table, elements)
    one = spark.createDataFrame([(0, [float(c) for c in concentrations], float(thickness_nm))], "pixel_id long, q array<double>, t double")
    a = correction_spectra(one, "q", "t", coefficients(macs, elements, energies), v["atomic_mass"], v["density"], take_off, density or None)
    return a.select(F.posexplode("a").alias("channel", "factor"))


def correction_spectra(pixels: DataFrame, q: str, thickness: str, macs: np.ndarray, masses: Sequence[float], densities: Sequence[float], take_off: float, density: float | None = None) -> DataFrame:
    """(pixel_id, a): factors of all channels, from compositions q in atomic percent and thickness in nm. Narrow; the
    table of elements x channels goes to each task once. density: in place of the mixture's."""
    if density is None and any(d == 0 for d in densities):
        raise ValueError("the density of an element is unknown")
    spark = pixels.sparkSession
    shared = spark.sparkContext.broadcast((np.asarray(macs), np.asarray(masses), np.asarray(densities)))
    sine = math.sin(math.radians(take_off))

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, m, d = shared.value
        for b in batches:
            q = matrix(b.column(1), len(m)).T
            t = np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)) * P.NM_PER_CM
            w = np.nan_to_num(q) * m
            s = w.sum(axis=1, keepdims=True)
            w = np.divide(w, s, out=np.zeros_like(w), where=s != 0)
            if density is None:
                volume = (w / d).sum(axis=1)
                rho = np.divide(w.sum(axis=1), volume, out=np.zeros(len(w)), where=volume != 0)
            else:
                rho = np.full(len(w), density)
            chi = (w @ mu) * (rho * t / sine)[:, None]
            a = np.where(chi > 0, -np.expm1(-chi) / np.where(chi > 0, chi, 1.0), 1.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["pixel_id", "a"])

    rows = pixels.select(F.col("pixel_id").cast("long"), F.col(q), F.col(thickness).cast("double"))
    return rows.mapInArrow(factors, "pixel_id long, a array<double>")
