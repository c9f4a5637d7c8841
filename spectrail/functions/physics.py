"""Physics of X-ray and electron-energy-loss spectra as column expressions. Arguments are columns or numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full width at half maximum over standard deviation, outer angle in mrad, nm in a cm.
FWHM, OUTER_ANGLE, NM_PER_CM = 2.3548, 20.0, 1e-7


def col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def energy_at(channel: Column, size: int, scale: float, offset: float) -> Column:
    """Energy of a channel counted from 0, on an axis that includes both ends: the step is size * scale / (size - 1)."""
    return channel * (size * scale / (size - 1)) + offset


def energy_index(energy: Column | float, scale: float, offset: float) -> Column:
    """The channel of an energy; halves round away from zero."""
    return F.round((col(energy) - offset) / scale).cast("int")


def gaussian(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    s = col(sigma)
    return F.exp(-F.pow(x - col(mu), F.lit(2.0)) / (s * s * 2.0)) / (s * math.sqrt(2 * math.pi))


def peak_width(energy: Column, slope: float, intercept: float) -> Column:
    """Standard deviation of a line's peak."""
    return (energy * slope + intercept) / FWHM


def background_0(x: Column, beam: float, b: float = 1.0) -> Column:
    left = F.lit(beam) - x
    return left * b / (x * beam) * (F.lit(1.0) - left / beam)


def background_1(x: Column, beam: float, b: float = 1.0) -> Column:
    left = F.lit(beam) - x
    return left * left * b / (x * beam**2)


def absorption_factor(mu: Column, density: Column | float, thickness_cm: Column | float, take_off_degrees: float) -> Column:
    """(1 - exp(-chi)) / chi with chi = mu * density * thickness / sin(take-off angle); 1 where chi is 0."""
    chi = mu * col(density) * col(thickness_cm) / math.sin(math.radians(take_off_degrees))
    return F.coalesce(F.try_divide(F.lit(1.0) - F.exp(-chi), chi), F.lit(1.0))


def cube_law(energy: Column) -> Column:
    """The mass-absorption coefficient where no element is known."""
    return F.lit(1.0) / F.pow(energy, F.lit(3.0))


def relativistic(beam: Column | float) -> Column:
    e = col(beam)
    return (e / 1022.0 + 1.0) / F.pow(e / 511.0 + 1.0, F.lit(2.0))


def characteristic_angle(density: Column | float, beam: Column | float) -> Column:
    return F.pow(col(density), F.lit(0.3)) * 5.5 / (relativistic(beam) * col(beam))


def _log_ratio(density: Column | float, beam: Column | float) -> Column:
    angle = characteristic_angle(density, beam)
    return F.ln(F.lit(OUTER_ANGLE**2) / (angle * angle))


def free_path_by_density(density: Column | float, beam: Column | float) -> Column:
    rate = F.pow(col(density), F.lit(0.3)) * 11.0 / (relativistic(beam) * col(beam) * 200.0) * _log_ratio(density, beam)
    return F.lit(1.0) / rate


def free_path_by_number(mean_z: Column | float, beam: Column | float, beta: Column | float) -> Column:
    loss = F.pow(col(mean_z), F.lit(0.36)) * 7.6
    return relativistic(beam) * col(beam) * 106.0 / (loss * F.ln(col(beta) * col(beam) * 2.0 / loss))


def angular_correction(density: Column | float, beam: Column | float, alpha: float, beta: float) -> Column:
    angle = characteristic_angle(density, beam)
    ends = alpha**2 + beta**2 + abs(alpha**2 - beta**2)
    inner = (angle * angle * 2.0 + ends) * (OUTER_ANGLE**2 / (ends + 2 * OUTER_ANGLE**2)) / (angle * angle)
    return _log_ratio(density, beam) / F.ln(inner)


def log_intensity_ratio(whole: Column, zero_loss: Column) -> Column:
    """ln(whole / zero loss); null where either isn't positive."""
    return F.when((whole > 0) & (zero_loss > 0), F.ln(F.try_divide(whole, zero_loss)))
