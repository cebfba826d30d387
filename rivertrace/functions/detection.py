"""Column expressions shared by the detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(zscore: Column, value: Column, baseline: Column) -> Column:
    """high at |z| >= 5 or value >= 2x baseline, medium at |z| >= 3, else low."""
    ratio = value / F.greatest(baseline, F.lit(1e-9))
    return (
        F.when((F.abs(zscore) >= 5.0) | (ratio >= 2.0), "high")
        .when(F.abs(zscore) >= 3.0, "medium")
        .otherwise("low")
    )
