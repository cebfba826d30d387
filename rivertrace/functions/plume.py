"""One-dimensional advection-dispersion of an instantaneous spill."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DISPERSION_M2_S = 10.0  # fixed value: longitudinal dispersion coefficient
NOMINAL_SOURCE_DISTANCE_M = 100.0  # fixed value: distance used at the source itself


def puff(
    distance_m: Column, velocity: Column, area_m2: Column, k_per_day: Column, mass_kg: Column, hours: Column,
    dispersion: float = DISPERSION_M2_S,
) -> Column:
    """Concentration in mg/L of a Gaussian puff after ``hours``, with first-order decay."""
    seconds = F.greatest(hours * 3600.0, F.lit(1.0))
    spread = seconds * (4 * dispersion)
    offset = distance_m - velocity * seconds
    height = mass_kg * 1e6 / (area_m2 * F.sqrt(spread * math.pi))
    return F.greatest(
        height * F.exp(-(offset * offset) / spread) * F.exp(-k_per_day * seconds / 86400.0), F.lit(0.0)
    )
