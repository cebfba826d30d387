"""Fluorescence peaks on the excitation/emission grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grid of excitation and emission wavelengths in nm (first, last, points).
EXCITATION = (200.0, 500.0, 61)
EMISSION = (250.0, 600.0, 71)


def peak_at(lex: Column, lem: Column, peak_lex: Column, peak_lem: Column, amp: Column, sigma: Column) -> Column:
    dx, dm = lex - peak_lex, lem - peak_lem
    return amp * F.exp(-(dx * dx + dm * dm) / (2 * sigma * sigma))


def spectrum_at(spectrum: Column, lex: Column, lem: Column) -> Column:
    """Sum of all peaks of a spectrum at one grid cell."""
    return F.aggregate(
        spectrum,
        F.lit(0.0),
        lambda total, p: total + peak_at(lex, lem, p["lex"], p["lem"], p["amp"], p["sigma"]),
    )
