"""Geodetic and authalic latitude by sine series (Karney, On auxiliary latitudes, eqs. A19 and A20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_F = 1 / 298.257223563
#: Published polynomials of the third flattening, by term of the series, lowest power first.
TO_AUTHALIC = (
    (-4 / 3, -4 / 45, 88 / 315, 538 / 4725, 20824 / 467775, -44732 / 2837835),
    (0, 34 / 45, 8 / 105, -2482 / 14175, -37192 / 467775, -12467764 / 212837625),
    (0, 0, -1532 / 2835, -898 / 14175, 54968 / 467775, 100320856 / 1915538625),
    (0, 0, 0, 6007 / 14175, 24496 / 467775, -5884124 / 70945875),
    (0, 0, 0, 0, -23356 / 66825, -839792 / 19348875),
    (0, 0, 0, 0, 0, 570284222 / 1915538625),
)
TO_GEODETIC = (
    (4 / 3, 4 / 45, -16 / 35, -2582 / 14175, 60136 / 467775, 28112932 / 212837625),
    (0, 46 / 45, 152 / 945, -11966 / 14175, -21016 / 51975, 251310128 / 638512875),
    (0, 0, 3044 / 2835, 3802 / 14175, -94388 / 66825, -8797648 / 10945935),
    (0, 0, 0, 6059 / 4725, 41072 / 93555, -1472637812 / 638512875),
    (0, 0, 0, 0, 768272 / 467775, 455935736 / 638512875),
    (0, 0, 0, 0, 0, 4210684958 / 1915538625),
)
#: The meridian arc unit as a polynomial of the squared third flattening.
ARC = (1.0, 1 / 4, 1 / 64, 1 / 256, 25 / 16384, 49 / 65536, 441 / 1048576)


def third_flattening(f: float) -> float:
    return f / (2 - f)


def polynomial(x: float, coefficients) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def arc_unit(f: float = WGS84_F) -> float:
    n = third_flattening(f)
    return polynomial(n * n, ARC) / (1 + n)


def series(f: float, polynomials=TO_AUTHALIC) -> list[float]:
    """The series' coefficients, of sin 2x, sin 4x, ..."""
    n = third_flattening(f)
    return [n * polynomial(n, p) for p in polynomials]


def fourier_sin(angle: Column, coefficients: list[float]) -> Column:
    return sum((F.lit(c) * F.sin(angle * (k + 1)) for k, c in enumerate(coefficients)), F.lit(0.0))


def _convert(latitude: Column, coefficients: list[float], degrees: bool) -> Column:
    x = F.radians(latitude) if degrees else latitude
    y = x + fourier_sin(2 * x, coefficients)
    return F.degrees(y) if degrees else y


def geodetic_to_authalic(latitude: Column, degrees: bool = True, f: float = WGS84_F, polynomials=TO_AUTHALIC) -> Column:
    return _convert(latitude, series(f, polynomials), degrees)


def authalic_to_geodetic(latitude: Column, degrees: bool = True, f: float = WGS84_F, polynomials=TO_GEODETIC) -> Column:
    return _convert(latitude, series(f, polynomials), degrees)
