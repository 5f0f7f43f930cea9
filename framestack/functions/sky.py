"""Photometry and positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(ratio: Column) -> Column:
    return F.when(ratio > 0, -2.5 * F.log10(ratio))


def airmass(altitude: Column) -> Column:
    """From the altitude in degrees (a plane-parallel sky with a horizon term); null below the horizon."""
    z = F.radians(altitude + 244 / (165 + 47 * F.pow(F.greatest(altitude, F.lit(0.0)), 1.1)))
    return F.when((altitude > 0) & (altitude <= 90), 1 / F.sin(z))


def pixel_scale(pixel_um: Column, focal_mm: Column) -> Column:
    """Arcseconds a pixel."""
    return F.when((pixel_um > 0) & (focal_mm > 0), 206.265 * pixel_um / focal_mm)


def sexagesimal(c: Column) -> Column:
    """Degrees (or hours) from d:m:s or d m s; the sign is that of the first part, also of -0."""
    p = F.split(F.trim(c), r"[:\s]+")
    part = lambda i: F.coalesce(F.abs(F.get(p, F.lit(i)).try_cast("double")), F.lit(0.0))
    sign = F.when(F.trim(c).startswith("-"), -1.0).otherwise(1.0)
    return F.when(F.get(p, F.lit(0)).try_cast("double").isNotNull(), sign * (part(0) + part(1) / 60 + part(2) / 3600))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle in degrees between two positions in degrees."""
    d, a = F.radians((dec2 - dec1) / 2), F.radians((ra2 - ra1) / 2)
    h = F.pow(F.sin(d), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(a), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def mean_angle(degrees: Column) -> Column:
    """Circular mean (an aggregate), 0 to 360."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))), F.lit(360.0))


def gnomonic(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Tangent-plane coordinates in degrees about (ra0, dec0); null on the far side."""
    a, d, s, c = F.radians(ra - ra0), F.radians(dec), math.sin(math.radians(dec0)), math.cos(math.radians(dec0))
    cosine = s * F.sin(d) + c * F.cos(d) * F.cos(a)
    ok = cosine > 1e-9
    return F.when(ok, F.degrees(F.cos(d) * F.sin(a) / cosine)), F.when(ok, F.degrees((c * F.sin(d) - s * F.cos(d) * F.cos(a)) / cosine))


def homography(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """(x, y) through a 3 x 3 matrix given by rows; null where it maps to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    ok = F.abs(w) > 1e-12
    return F.when(ok, (m[0] * x + m[1] * y + m[2]) / w), F.when(ok, (m[3] * x + m[4] * y + m[5]) / w)


def midtones(x: Column, m: float) -> Column:
    """The midtones transfer of values from 0 to 1: 0, m and 1 go to 0, one half and 1."""
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return (m - 1) * x / ((2 * m - 1) * x - m)


def asinh_stretch(x: Column, softening: float = 0.05) -> Column:
    return F.asinh(F.greatest(x, F.lit(0.0)) / softening) / math.asinh(1 / softening)


def luminance_ratio(channels: list[Column], wanted: Column) -> list[Column]:
    """RGB scaled so that its mean is the wanted luminance."""
    own = sum(channels) / len(channels)
    return [F.when(own > 0, c * wanted / own) for c in channels]
