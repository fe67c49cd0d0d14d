"""Colour metrics on sRGB columns in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WCAG luminance and the sRGB / CIE Lab (D65, 2 degrees) definitions.
LUMINANCE = (0.2126, 0.7152, 0.0722)
WCAG_CUT, LAB_CUT = 0.03928, 0.04045
TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
WHITE = (0.95047, 1.0, 1.08883)


def _linear(c: Column, cut: float) -> Column:
    return F.when(c <= cut, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    parts = [_linear(c, WCAG_CUT) * w for c, w in zip((r, g, b), LUMINANCE)]
    return parts[0] + parts[1] + parts[2]


def contrast_ratio(lum_a: Column, lum_b: Column) -> Column:
    return (F.greatest(lum_a, lum_b) + 0.05) / (F.least(lum_a, lum_b) + 0.05)


def lab(r: Column, g: Column, b: Column) -> Column:
    """Struct L, a, b."""
    rgb = [_linear(c, LAB_CUT) for c in (r, g, b)]

    def axis(row, white):
        t = (rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]) / white
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)

    x, y, z = (axis(row, white) for row, white in zip(TO_XYZ, WHITE))
    return F.struct(
        (y * 116.0 - 16.0).alias("L"), ((x - y) * 500.0).alias("a"), ((y - z) * 200.0).alias("b")
    )


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum((F.pow(p[c] - q[c], F.lit(2)) for c in ("a", "b")), F.pow(p["L"] - q["L"], F.lit(2))))
