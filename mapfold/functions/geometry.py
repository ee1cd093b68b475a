"""Parts of features as Columns: a part is an array of structs x, y; a feature has an array of parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mercator import MAX_LAT, clamp

KINDS = {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 3, "MultiPolygon": 3}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(w: Column, s: Column, e: Column, n: Column, inner: bool = False) -> Column:
    """A closed ring, counter-clockwise, or clockwise for a hole."""
    corners = [point(w, s), point(e, s), point(e, n), point(w, n), point(w, s)]
    return F.array(*(corners[::-1] if inner else corners))


def geom_kind(geometry_type: Column) -> Column:
    """1 for points, 2 for lines, 3 for polygons, null for what has no parts of its own."""
    return F.coalesce(*(F.when(geometry_type == k, F.lit(v)) for k, v in KINDS.items()))


def bbox(parts: Column) -> Column:
    """w, s, e, n over all positions; null without any."""
    flat = F.flatten(parts)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.when(F.size(flat) > 0, F.struct(F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n")))


def coord_count(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.size(p))


def normalized(parts: Column) -> Column:
    """Positions as numbers, latitudes clamped to the Mercator range."""
    return F.transform(parts, lambda part: F.transform(part, lambda p: F.struct(p["x"].cast("double").alias("x"), clamp(p["y"].cast("double"), -MAX_LAT, MAX_LAT).alias("y"))))


def signed_area(ring: Column) -> Column:
    """Shoelace area relative to the first vertex; positive for counter-clockwise rings."""
    first = F.get(ring, 0)
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda a, b: (a["x"] - first["x"]) * (b["y"] - first["y"]) - (b["x"] - first["x"]) * (a["y"] - first["y"]))
    return F.aggregate(crosses, F.lit(0.0), lambda acc, v: acc + v) / 2


def normalize_winding(ring: Column, inner: Column) -> Column:
    """Outer rings counter-clockwise, inner ones clockwise."""
    return F.when((signed_area(ring) < 0) != inner, F.reverse(ring)).otherwise(ring)


def polygon_anchor(parts: Column) -> Column:
    box = bbox(parts)
    return point((box["w"] + box["e"]) / 2, (box["s"] + box["n"]) / 2)


def lod_tolerance(zoom: int, scale: float) -> float:
    """Tolerance of simplification at a zoom, in units of 1/scale, in half octaves; 0 below half a unit."""
    import math

    pixels = max(0.3, min(4.0, max(0.0, (12 - zoom) * 0.8)))
    value = pixels / scale
    value = 2 ** (math.floor(math.log2(value) * 2) / 2)
    return 0.0 if value < 0.5 else value


def clean_label(text: Column, most: int = 160) -> Column:
    """Control characters become spaces, runs of white space one; trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), 1, most)
