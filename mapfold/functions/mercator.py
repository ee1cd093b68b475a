"""Web Mercator and tile arithmetic as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.05112878
EARTH_RADIUS = 6378137.0


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def world_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def world_y(lat: Column) -> Column:
    s = F.sin(F.radians(clamp(lat, -MAX_LAT, MAX_LAT)))
    return 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def lon_of_world(x: Column, wrap: bool = True) -> Column:
    x = F.pmod(x, F.lit(1.0)) if wrap else x
    return x * 360.0 - 180.0


def lat_of_world(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y))))


def tile_x(lon: Column, z: int) -> Column:
    """Column of the tile, wrapped around the world."""
    return F.pmod(F.floor(world_x(lon) * (1 << z)), F.lit(1 << z))


def tile_y(lat: Column, z: int) -> Column:
    return clamp(F.floor(world_y(lat) * (1 << z)), 0, (1 << z) - 1)


def tile_bounds(z: Column, x: Column, y: Column, crs: str = "4326") -> tuple[Column, Column, Column, Column]:
    """West, south, east, north, in degrees or (crs 3857) in metres."""
    n = F.pow(F.lit(2.0), z)
    if crs == "3857":
        half = math.pi * EARTH_RADIUS
        return x / n * (2 * half) - half, half - (y + 1) / n * (2 * half), (x + 1) / n * (2 * half) - half, half - y / n * (2 * half)
    return lon_of_world(x / n, False), lat_of_world((y + 1) / n), lon_of_world((x + 1) / n, False), lat_of_world(y / n)


def tile_url(template: str, z: Column, x: Column, y: Column, scheme: str = "xyz", subdomains: str = "abc") -> Column:
    """{z} {x} {y} {-y} {s}; scheme tms turns {y} over, {-y} is always turned over."""
    over = (F.pow(F.lit(2), z) - 1 - y).cast("long")
    url = F.lit(template)
    values = {"{-y}": over, "{y}": over if scheme == "tms" else y, "{x}": x, "{z}": z}
    if "{s}" in template:
        values["{s}"] = F.get(F.split(F.lit(subdomains), ""), F.pmod(x + y, F.lit(len(subdomains))).cast("int"))
    for name, value in values.items():
        if name in template:
            url = F.replace(url, F.lit(name), value.cast("string"))
    return url


def wrap_lon(lon: Column, closed: str = "west") -> Column:
    """Longitude in [-180, 180), or in (-180, 180] with closed='east'."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when(wrapped == -180.0, 180.0).otherwise(wrapped) if closed == "east" else wrapped


def hilbert_id(z: int, x: Column, y: Column) -> Column:
    """The place of a tile in the order of archives: all smaller zooms, then the Hilbert curve of this one.

    The curve's steps are the zoom's bits, so the expression has z terms and
    no Python; null outside of the grid.
    """
    d, tx, ty = F.lit((4**z - 1) // 3).cast("long"), x.cast("long"), y.cast("long")
    state = F.struct(d.alias("d"), tx.alias("x"), ty.alias("y"))

    def step(acc: Column, s: Column) -> Column:
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        nd = acc["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        fx, fy = F.when(rx == 1, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(rx == 1, s - 1 - acc["y"]).otherwise(acc["y"])
        turn = ry == 0
        return F.struct(nd.alias("d"), F.when(turn, fy).otherwise(acc["x"]).alias("x"), F.when(turn, fx).otherwise(acc["y"]).alias("y"))

    sides = F.array(*(F.lit(1 << k).cast("long") for k in range(z - 1, -1, -1))) if z else F.array().cast("array<long>")
    inside = (tx >= 0) & (tx < 1 << z) & (ty >= 0) & (ty < 1 << z)
    return F.when(inside, F.aggregate(sides, state, step)["d"])
