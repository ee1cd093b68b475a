"""Distances, areas and shapes on the sphere as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would skip nulls


def path_length_m(points: Column) -> Column:
    """points: array of structs x, y; the sum of its steps from left to right."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine_m(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)


def destination(lon: Column, lat: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """Where a course of `metres` with this bearing (radians) ends."""
    d, p = metres / RADIUS, F.radians(lat)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(bearing))
    lon2 = F.radians(lon) + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return (F.degrees(lon2) + 540.0) % 360.0 - 180.0, F.degrees(lat2)


def circle(lon: Column, lat: Column, metres: Column, steps: int = 64) -> Column:
    """A closed ring of steps + 1 positions."""

    def at(i: Column) -> Column:
        x, y = destination(lon, lat, i * (2 * math.pi / steps), metres)
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)
    return F.concat(ring, F.slice(ring, 1, 1))


def circle_measure(metres: Column) -> tuple[Column, Column]:
    """Circumference and area of a circle on the sphere."""
    return 2 * math.pi * RADIUS * F.sin(metres / RADIUS), 2 * math.pi * RADIUS**2 * (1 - F.cos(metres / RADIUS))


def ring_area_m2(ring: Column) -> Column:
    """ring: array of structs x, y, closed or not. The smaller side of the sphere counts."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))

    def part(a: Column, b: Column) -> Column:
        d = F.radians(b["x"] - a["x"])
        d = F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)
        return d * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))

    total = F.abs(F.aggregate(F.zip_with(ring, shifted, part), F.lit(0.0), lambda acc, v: acc + v)) * (RADIUS**2 / 2)
    return F.least(total, F.lit(4 * math.pi * RADIUS**2) - total)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Positions about 50 km apart, 64 steps at most; both ends alone if they coincide or are opposite."""
    def vector(lon: Column, lat: Column) -> Column:
        p, q = F.radians(lat), F.radians(lon)
        return F.array(F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))

    def bind(value: Column, use) -> Column:
        """use(value), with the value computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def path(v: Column) -> Column:
        angle, steps = v["d"] / RADIUS, F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(v["d"] / 50000.0))).cast("int")

        def at(i: Column) -> Column:
            a, b = F.sin((1 - i / steps) * angle) / F.sin(angle), F.sin(i / steps * angle) / F.sin(angle)
            xyz = F.zip_with(v["u"], v["v"], lambda p, q: a * p + b * q)
            return bind(xyz, lambda c: F.struct(F.degrees(F.atan2(c[1], c[0])).alias("x"), F.degrees(F.atan2(c[2], F.sqrt(c[0] * c[0] + c[1] * c[1]))).alias("y")))

        ends = F.array(F.struct(lon1.alias("x"), lat1.alias("y")), F.struct(lon2.alias("x"), lat2.alias("y")))
        return F.when((angle < 1e-6) | (F.abs(angle - math.pi) < 1e-6), ends).otherwise(F.transform(F.sequence(F.lit(0), steps), at))

    return bind(F.struct(haversine_m(lon1, lat1, lon2, lat2).alias("d"), vector(lon1, lat1).alias("u"), vector(lon2, lat2).alias("v")), path)


def two_decimals(n: Column) -> Column:
    """A number with two decimals, by its exact binary value (1.005 is less than it reads); a tie goes to the even digit."""
    return F.call_function("format_number", n, F.lit("0.00"))


def label_metres(metres: Column) -> Column:
    return F.when(metres >= 1000, F.concat(two_decimals(metres / 1000), F.lit(" km"))).otherwise(F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m")))


def label_area(square: Column) -> Column:
    return F.when(square >= 1e6, F.concat(two_decimals(square / 1e6), F.lit(" km²"))).otherwise(F.concat(F.floor(square + 0.5).cast("string"), F.lit(" m²")))


def abbreviated(count: Column) -> Column:
    """12 345 as 12k, 1 234 as 1.2k, 999 as 999."""
    tenths = F.floor(count / 100.0 + 0.5)
    short = F.when(tenths % 10 == 0, F.floor(tenths / 10).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
    return F.when(count >= 10000, F.concat(F.floor(count / 1000.0 + 0.5).cast("string"), F.lit("k"))).when(count >= 1000, F.concat(short, F.lit("k"))).otherwise(count.cast("string"))
