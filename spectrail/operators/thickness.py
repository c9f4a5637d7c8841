"""Thickness maps from low-loss spectra: ln(all / zero loss) times a mean free path. Narrow; halves of channels round up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FreePath
from ..functions import physics as P
from ..functions import vectors as V


def integrals(spectrum: Column, zero_loss: float, scale: float, offset: float, axis: Sequence[float] | None = None) -> tuple[Column, Column]:
    """The integral of a spectrum and of its part up to the zero-loss threshold, that channel included."""
    count = P.energy_index(zero_loss, scale, offset) + 1
    part = F.slice(spectrum, F.lit(1), count)
    if axis is None:
        return V.simpson(spectrum, scale), V.simpson(part, scale)
    x = V.literal(axis)
    return V.simpson_at(spectrum, x), V.simpson_at(part, F.slice(x, F.lit(1), count))


def thickness(whole: Column, zero: Column, mode: FreePath, beam: float, beta: float, alpha: float = 0.0, density: Column | None = None, mean_z: Column | None = None) -> Column:
    """nm; null where an integral isn't positive. By density or by mean atomic number, of which exactly one is given."""
    if (density is None) == (mean_z is None):
        raise ValueError("give exactly one of density and mean_z")
    ratio = P.log_intensity_ratio(whole, zero)
    if FreePath(mode) == FreePath.DENSITY:
        if density is None:
            raise ValueError("this mode needs a density")
        return ratio * P.angular_correction(density, beam, alpha, beta) * P.free_path_by_density(density, beam)
    if mean_z is None:
        raise ValueError("this mode needs a mean atomic number")
    return ratio * P.free_path_by_number(mean_z, beam, beta)


def thickness_map(pixels: DataFrame, spectrum: str, zero_loss: float, scale: float, offset: float, beam: float, beta: float, alpha: float = 0.0, density: str | None = None, mean_z: str | None = None, axis: Sequence[float] | None = None) -> DataFrame:
    """pixels with thickness (nm), from the column density or mean_z."""
    whole, zero = integrals(F.col(spectrum), zero_loss, scale, offset, axis)
    mode = FreePath.DENSITY if density else FreePath.MEAN_ATOMIC_NUMBER
    t = thickness(whole, zero, mode, beam, beta, alpha, F.col(density) if density else None, F.col(mean_z) if mean_z else None)
    return pixels.withColumn("thickness", t)
