"""Column expressions for ids, lengths and projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
RADIUS = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar(a: Column, b: Column) -> Column:
    """Distance of two (x, y) structs."""
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def neighbours(points: Column) -> Column:
    """Consecutive pairs (a, b) of an array."""
    n = F.size(points)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def path_length(points: Column, distance=planar) -> Column:
    """Length of a polyline."""
    return F.aggregate(neighbours(points), F.lit(0.0), lambda acc, p: acc + distance(p["a"], p["b"]))


def geodesic(a: Column, b: Column) -> Column:
    """Haversine distance of two (x = lon, y = lat) structs."""
    return haversine(a["x"], a["y"], b["x"], b["y"])


def stations(points: Column, distance=planar) -> Column:
    """Running distance from the start at each point of a polyline."""
    return F.aggregate(
        neighbours(points),
        F.array(F.lit(0.0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + distance(p["a"], p["b"]))),
    )


def fnv1a64(text: Column) -> Column:
    """FNV-1a hash of 64 bits of a text's UTF-8 bytes, as unsigned decimal text.

    The hash is kept in two halves of 32 bits, since the prime is 2^40 + 435.
    """
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, octet: Column) -> Column:
        low = h["lo"].bitwiseXOR(octet)
        wide = low * 435
        hi = (h["hi"] * 435 + F.shiftright(wide, 32) + low * 256).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return F.struct(hi.alias("hi"), wide.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("lo"))

    whole = F.aggregate(octets, start, step)
    # a one-element array binds the hash once
    return F.transform(F.array(whole), lambda h: (h["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + h["lo"]).cast("decimal(20,0)").cast("string"))[0]


# The WGS 84 ellipsoid and the scale and false easting of UTM.
A, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """(x, y) in metres by Krueger's series."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    north = F.when(south, F.lit(1e7)).otherwise(0.0)
    return F.struct((EASTING + SCALE * _RECTIFYING * x).alias("x"), (north + SCALE * _RECTIFYING * y).alias("y"))


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """(x = lon, y = lat) in degrees."""
    north = F.when(south, F.lit(1e7)).otherwise(0.0)
    xi, eta = (y - north) / (SCALE * _RECTIFYING), (x - EASTING) / (SCALE * _RECTIFYING)
    u, v = xi, eta
    for k, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for k, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + zone * 6 - 183).alias("x"), F.degrees(phi).alias("y"))


def to_mercator(lon: Column, lat: Column) -> Column:
    return F.struct((F.radians(lon) * A).alias("x"), (A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x / A).alias("x"), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2).alias("y"))


def truthy(c: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "0", "no", "false")


def leading_number(c: Column) -> Column:
    """The number at the start of a text, else null."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^[+-]?[0-9]+(?:\.[0-9]*)?", 0), F.lit("")).cast("double")


def leading_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"^[+-]?[0-9]+", 0), F.lit("")).cast("int")
