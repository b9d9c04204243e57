"""Places, projections, tiles and the sun as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0


def mercator_to_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def mercator_to_lng(x: Column) -> Column:
    return F.degrees(x / EARTH)


def utm_to_latlng(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """WGS84 latitude and longitude of UTM coordinates, by the footpoint-latitude series (Snyder, Map Projections, 1987)."""
    f, k0 = 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    second = e2 / (1 - e2)
    root = math.sqrt(1 - e2)
    n = (1 - root) / (1 + root)
    arc = EARTH * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    y = F.when(south, northing - 1e7).otherwise(northing)
    mu = y / k0 / arc
    foot = mu
    for times, weight in ((2, 3 * n / 2 - 27 * n**3 / 32), (4, 21 * n**2 / 16 - 55 * n**4 / 32), (6, 151 * n**3 / 96), (8, 1097 * n**4 / 512)):
        foot = foot + F.sin(mu * times) * weight
    sin2, cos, tan2 = F.pow(F.sin(foot), 2), F.cos(foot), F.pow(F.tan(foot), 2)
    c = cos * cos * second
    prime = F.lit(EARTH) / F.sqrt(1 - sin2 * e2)
    meridian = F.lit(EARTH * (1 - e2)) / F.pow(1 - sin2 * e2, 1.5)
    d = (easting - 5e5) / (prime * k0)
    north = d**2 / 2 - (5 + 3 * tan2 + 10 * c - 4 * c * c - 9 * second) * d**4 / 24 + (61 + 90 * tan2 + 298 * c + 45 * tan2 * tan2 - 252 * second - 3 * c * c) * d**6 / 720
    east = d - (1 + 2 * tan2 + c) * d**3 / 6 + (5 - 2 * c + 28 * tan2 - 3 * c * c + 8 * second + 24 * tan2 * tan2) * d**5 / 120
    lat = foot - prime * F.tan(foot) / meridian * north
    return F.degrees(lat), (zone - 1) * 6 - 177 + F.degrees(east / cos)


def sun(lat: Column, lng: Column, epoch_seconds: Column) -> tuple[Column, Column]:
    """Elevation and azimuth in degrees, from the low-precision almanac."""
    # Mean anomaly and longitude, equation of centre, obliquity and sidereal time since J2000.
    d = epoch_seconds / 86400.0 + 2440587.5 - 2451545.0
    g = F.radians(d * 0.98560028 + 357.529)
    ecliptic = F.radians(d * 0.98564736 + 280.459 + F.sin(g) * 1.915 + F.sin(g * 2) * 0.02)
    tilt = F.radians(F.lit(23.439) - d * 3.6e-7)
    right = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    decl = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.pmod(d * 24.06570982441908 + 18.697374558, F.lit(24.0))
    hour = F.radians(sidereal * 15 + lng) - right
    phi = F.radians(lat)
    elevation = F.asin(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour))
    azimuth = F.atan2(-F.sin(hour), F.tan(decl) * F.cos(phi) - F.sin(phi) * F.cos(hour))
    return F.degrees(elevation), F.pmod(F.degrees(azimuth), F.lit(360.0))


def terrarium_metres(red: Column, green: Column, blue: Column) -> Column:
    """Elevation in metres of a terrarium tile's pixel."""
    return red * 256 + green + blue / 256 - 32768


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest difference of two azimuths."""
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def lattice(lat: Column, lng: Column, span: float, n: int) -> Column:
    """Array of ``row_no, col_no, lat, lng`` on an n by n grid around a point, north first; columns widen with latitude."""
    step = 2 * span / (n - 1)
    row = lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda j: F.struct(i.alias("row_no"), j.alias("col_no"), (lat + span - i * step).alias("lat"), (lng + (j * step - span) / F.cos(F.radians(lat))).alias("lng")),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row))


def tile_of_hilbert_id(tile_id: Column, max_zoom: int = 20) -> Column:
    """``z, x, y`` of a tile number that counts zoom by zoom along the Hilbert curve."""
    zoom = F.lit(0)
    for z in range(1, max_zoom + 1):
        zoom = zoom + (tile_id >= (4**z - 1) // 3).cast("int")
    start = F.struct((tile_id - F.floor((F.pow(F.lit(4.0), zoom) - 1) / 3 + 0.5).cast("bigint")).alias("t"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))

    def turn(a, k):
        side = F.pow(F.lit(2.0), k).cast("bigint")
        rx = F.pmod(F.floor(a["t"] / 2), F.lit(2)).cast("bigint")
        ry = F.pmod(a["t"], F.lit(2)).bitwiseXOR(rx).cast("bigint")
        x = F.when((ry == 0) & (rx == 1), side - 1 - a["x"]).otherwise(a["x"])
        y = F.when((ry == 0) & (rx == 1), side - 1 - a["y"]).otherwise(a["y"])
        nx, ny = F.when(ry == 0, y).otherwise(x), F.when(ry == 0, x).otherwise(y)
        return F.struct(F.floor(a["t"] / 4).cast("bigint").alias("t"), (nx + side * rx).alias("x"), (ny + side * ry).alias("y"))

    steps = F.when(zoom > 0, F.sequence(F.lit(0), zoom - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, start, turn)
    return F.struct(zoom.cast("bigint").alias("z"), end["x"].alias("x"), end["y"].alias("y"))


def mixed_radix(index: Column, shape: list[int]) -> Column:
    """Coordinates of a row-major index."""
    out, below = [], 1
    for n in reversed(shape):
        out.append(F.pmod(F.floor(index / below), F.lit(n)).cast("bigint"))
        below *= n
    return F.array(*reversed(out))


def ramp(x: Column, stops: list[tuple[float, int]]) -> Column:
    """Piecewise linear interpolation between stops, held at both ends, rounded halves up."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(x < x1, (x - x0) / (x1 - x0) * (y1 - y0) + y0).otherwise(out)
    return F.floor(F.when(x <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out) + 0.5).cast("bigint")
