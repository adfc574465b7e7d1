"""Universal transverse Mercator on the GRS80 ellipsoid, by Krüger's series to the sixth order of n: to well under a millimetre within a zone."""

from __future__ import annotations

import math

A, F = 6378137.0, 1 / 298.257222101
K0, EASTING = 0.9996, 500000.0
_N = F / (2 - F)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Coefficients of the series, forward and inverse; fixed values of the published expansion, to the fourth order.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def _meridian(epsg: int) -> float:
    return math.radians((epsg - 25800) * 6 - 183)


def forward(lon: float, lat: float, epsg: int) -> tuple[float, float]:
    """Easting and northing of a point in degrees."""
    phi, away = math.radians(lat), math.radians(lon) - _meridian(epsg)
    e = math.sqrt(F * (2 - F))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(away)), math.asinh(math.sin(away) / math.hypot(t, math.cos(away)))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return EASTING + K0 * _RADIUS * x, K0 * _RADIUS * y


def inverse(x: float, y: float, epsg: int) -> tuple[float, float]:
    """Longitude and latitude in degrees of a point of a zone."""
    eta, xi = (x - EASTING) / (K0 * _RADIUS), y / (K0 * _RADIUS)
    eta2 = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    xi2 = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    e = math.sqrt(F * (2 - F))
    wanted = math.asinh(math.sin(xi2) / math.hypot(math.sinh(eta2), math.cos(xi2)))
    phi = math.asin(math.sin(xi2) / math.cosh(eta2))
    for _ in range(8):  # isometric to geographic latitude
        phi = math.asin(math.tanh(wanted + e * math.atanh(e * math.sin(phi))))
    return math.degrees(math.atan2(math.sinh(eta2), math.cos(xi2)) + _meridian(epsg)), math.degrees(phi)
