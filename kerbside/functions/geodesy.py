"""Map coordinates as Column functions: UTM, Web Mercator, short distances on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, UTM, and metres in a degree as two short-distance rules use them.
A, FLATTENING = 6378137.0, 1 / 298.257223563
K0, EASTING, NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0
METRES_LON, METRES_LAT, METRES_DEGREE = 88800.0, 111000.0, 111320.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order in the third flattening
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) in metres of WGS 84 degrees."""
    phi, lam = F.radians(lat), F.radians(lon - float(zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + K0 * _RADIUS * e, (NORTHING_SOUTH if south else 0.0) + K0 * _RADIUS * n


def from_utm(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lon, lat) in WGS 84 degrees."""
    xi0, eta0 = (northing - (NORTHING_SOUTH if south else 0.0)) / (K0 * _RADIUS), (easting - EASTING) / (K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return float(zone * 6 - 183) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def local_to_utm(x: Column, y: Column, origin_easting: Column, origin_northing: Column) -> tuple[Column, Column]:
    """A camera's local metres as UTM."""
    return origin_easting + x, origin_northing + y


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres."""
    return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of Web Mercator metres."""
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def mercator_resolution(zoom: Column) -> Column:
    """Metres of a pixel of 256-pixel tiles at the equator."""
    return 2 * math.pi * A / 256.0 / F.pow(F.lit(2.0), zoom)


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """(column, row) of the tile that holds a point."""
    n = float(2**zoom)
    phi = F.radians(lat)
    return F.floor((lon + 180.0) / 360.0 * n), F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n)


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres at the latitudes where a degree of longitude has METRES_LON."""
    return F.hypot((lon1 - lon2) * METRES_LON, (lat1 - lat2) * METRES_LAT)


def cosine_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres with longitude scaled by the cosine of the first point's latitude."""
    return F.hypot((lon1 - lon2) * METRES_DEGREE * F.cos(F.radians(lat1)), (lat1 - lat2) * METRES_DEGREE)
