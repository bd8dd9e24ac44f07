"""Page image quality from measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the score, the scan test and the preparation gate.
SHARPNESS, CONTRAST, ROTATION, NOISE = 100.0, 50.0, 2.0, 30.0
SCAN_SHARPNESS, SCAN_CONTRAST, SCAN_NOISE = 150.0, 60.0, 15.0
SCAN_BONUS = 10.0
GATE = 70.0


def is_scan(sharpness: Column, contrast: Column, noise: Column) -> Column:
    """At least two of: sharp, rich in contrast, low in noise."""
    marks = [sharpness > SCAN_SHARPNESS, contrast > SCAN_CONTRAST, noise < SCAN_NOISE]
    return sum((m.cast("int") for m in marks), F.lit(0)) >= 2


def score(sharpness: Column, contrast: Column, rotation: Column, noise: Column, scan: Column) -> Column:
    def cost(condition: Column, amount: Column) -> Column:
        return F.when(condition, amount).otherwise(0.0)

    raw = (
        F.lit(100.0)
        - cost(sharpness < SHARPNESS, (F.lit(SHARPNESS) - sharpness) / 2)
        - cost(contrast < CONTRAST, (F.lit(CONTRAST) - contrast) / 2)
        - cost(F.abs(rotation) > ROTATION, F.abs(rotation) * 2)
        - cost(noise > NOISE, noise - NOISE)
        + F.when(scan, SCAN_BONUS).otherwise(0.0)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))


def preparation(rating: Column, contrast: Column, rotation: Column, noise: Column, scan: Column) -> Column:
    """Steps in fixed order for a page below the gate; nothing for the others."""
    steps = F.array_compact(
        F.array(
            F.when(F.abs(rotation) > ROTATION, "deskew"),
            F.when(noise > NOISE, "denoise"),
            F.when(contrast < CONTRAST, "contrast"),
            F.when(~scan, "crop"),
        )
    )
    return F.when(rating < GATE, steps).otherwise(F.array().cast("array<string>"))
