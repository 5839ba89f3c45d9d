"""Geodesy as column arithmetic, and with numpy where it iterates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS-84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
#: Rounds of the direct geodesic's series; each gains three digits at least.
ROUNDS = 8
#: Metres in a degree of latitude on the local plane.
DEGREE_M = 111_320.0


def to_plane(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres east (x) and north (y) of an origin, on a plane that touches there."""
    return F.struct(((lon - lon0) * DEGREE_M * math.cos(math.radians(lat0))).alias("x"), ((lat - lat0) * DEGREE_M).alias("y"))


def from_plane(x: Column, y: Column, lat0: float, lon0: float) -> Column:
    return F.struct((y / DEGREE_M + lat0).alias("lat"), (x / (DEGREE_M * math.cos(math.radians(lat0))) + lon0).alias("lon"))


def _direct(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, metres: pd.Series) -> pd.DataFrame:
    """On the auxiliary sphere, with both series in the one small parameter k (the published nested form)."""
    start, course, length = np.radians(lat.to_numpy(float)), np.radians(azimuth.to_numpy(float)), metres.to_numpy(float)
    reduced = np.arctan2((1 - FLATTENING) * np.sin(start), np.cos(start))
    node = np.cos(reduced) * np.sin(course)  # sine of the course where the geodesic crosses the equator
    rise = 1 - node**2
    from_node = np.arctan2(np.sin(reduced), np.cos(reduced) * np.cos(course))
    root = np.sqrt(1 + E2 / (1 - E2) * rise)
    k = (root - 1) / (root + 1)
    scale, bend = (1 + k**2 / 4) / (1 - k), k * (1 - 3 * k**2 / 8)
    mean_arc = length / (B * scale)
    arc = mean_arc
    for _ in range(ROUNDS):
        middle = np.cos(2 * from_node + arc)
        inner = np.cos(arc) * (2 * middle**2 - 1) - bend / 6 * middle * (4 * np.sin(arc) ** 2 - 3) * (4 * middle**2 - 3)
        arc = mean_arc + bend * np.sin(arc) * (middle + bend / 4 * inner)
    height = np.sqrt(rise) * np.sin(from_node + arc)  # of the end above the equator's plane
    towards = np.cos(reduced) * np.cos(course) * np.cos(arc) - np.sin(reduced) * np.sin(arc)
    end = np.arctan2(height, (1 - FLATTENING) * np.hypot(node, towards))
    turned = np.arctan2(np.sin(arc) * np.sin(course), np.cos(reduced) * np.cos(arc) - np.sin(reduced) * np.sin(arc) * np.cos(course))
    c = FLATTENING / 16 * rise * (4 + FLATTENING * (4 - 3 * rise))
    middle = np.cos(2 * from_node + arc)
    slip = (1 - c) * FLATTENING * node * (arc + c * np.sin(arc) * (middle + c * np.cos(arc) * (2 * middle**2 - 1)))
    reached = np.degrees(turned - slip) + lon.to_numpy(float)
    return pd.DataFrame({"lat": np.degrees(end), "lon": reached - 360 * np.floor((reached + 180) / 360), "azimuth": np.degrees(np.arctan2(node, towards)) % 360})


def direct(lat: Column, lon: Column, azimuth: Column, metres: Column) -> Column:
    """Where a geodesic of a length and a start azimuth ends on the ellipsoid, and its azimuth there (Vincenty's series, a batch at once)."""
    return F.pandas_udf(_direct, "lat double, lon double, azimuth double")(lat, lon, azimuth, metres)


# Fixed values of the grid: the alphabet of its letters, without I and O.
_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
# Fixed values of the transverse Mercator projection by its series in n: scale on the meridian and metres added to the east.
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


def transverse_mercator(lat: Column, from_meridian: Column) -> Column:
    """east and north (of the equator) in metres, by the series in the third flattening up to its fourth power; angles in degrees."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = math.sqrt(E2)
    s, turn = F.sin(F.radians(lat)), F.radians(from_meridian)
    conformal = F.sinh(F.atanh(s) - e * F.atanh(e * s))  # tangent of the conformal latitude
    xi, eta = F.atan2(conformal, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + conformal * conformal))
    east = eta + sum(a[j] * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j in range(4))
    north = xi + sum(a[j] * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j in range(4))
    return F.struct((K0 * radius * east + FALSE_EAST).alias("east"), (K0 * radius * north).alias("north"))


def grid_reference(lat: Column, lon: Column, digits: int = 5) -> Column:
    """A grid reference such as 31UDQ4825111932, null outside 80 S to 84 N.

    The exceptions about Norway and Svalbard are not made. The numbers are cut, not rounded,
    so that no square has 100 km of either.
    """
    turned = lon - F.floor((lon + 180) / 360) * 360
    zone = (F.floor(turned / 6) + 31).cast("int")
    at = transverse_mercator(lat, turned - (zone * 6 - 183))
    east, north = at["east"], F.when(lat < 0, at["north"] + FALSE_NORTH).otherwise(at["north"])
    letter = lambda k: F.substring(F.lit(_LETTERS), k.cast("int") + 1, F.lit(1))
    band = letter(F.least(F.floor(lat / 8) + 12, F.lit(21)))
    column = letter((zone - 1) % 3 * 8 + F.floor(east / 100_000) - 1)
    row = letter((F.floor(north / 100_000) + (zone - 1) % 2 * 5) % 20)
    scale = 10 ** (5 - digits)
    part = lambda v: F.lpad(F.floor(v % 100_000 / scale).cast("string"), digits, "0")
    return F.when(lat.between(-80, 84), F.concat(zone.cast("string"), band, column, row, part(east), part(north)))


def nice_step(extent: Column, lines: int = 6) -> Column:
    """The least of 1, 2 and 5 times a power of ten that cuts an extent into at most so many parts; null unless it is positive."""
    raw = F.when(extent > 0, extent / lines)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power)
