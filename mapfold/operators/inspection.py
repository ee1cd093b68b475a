"""Inspection of GeoJSON features of any form: every issue with its path and message, as rows.

A feature that a few Columns show to be plain is never taken apart; only its
rings are tested for crossings. The nests of others are opened level by level, a
row for each part, so no row or task holds more than a feature. What filters ask
for is written before them, as Spark would work it out again for each mention in
a filter: features with whether they are plain, geometries with their kind, and
issues. Numbers as text, true and false count as numbers, and null as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.expressions import NUMBERS
from ..functions.mercator import MAX_LAT
from ..sources.geojson import feature_code, positions, text_of
from .validate import which_cross

#: Collections may be nested so deep.
DEPTH = 32
LAST = (1 << 31) - 1
MESSAGES = {
    "feature": "not a feature",
    "geometry": "not a geometry",
    "geometry-type": "not a geometry type",
    "geometry-depth": "collections nested too deep",
    "coordinates": "not an array of coordinates",
    "coordinate": "not two finite numbers",
    "polygon": "no ring",
    "line-length": "fewer than two positions",
    "ring-length": "fewer than four positions",
    "ring-open": "the last position isn't the first",
    "self-intersection": "two edges cross",
    "mercator-range": "beyond the displayed range",
    "feature-limit": "more features than allowed",
    "coordinate-limit": "more positions than allowed",
}
WARNINGS = ("mercator-range",)
HEAD = ["feature_seq", "fid", "path", "at"]


class Inspection(NamedTuple):
    """issues: feature_seq, fid, severity, code, path, message, at; at orders a feature's issues as a reader meets them.

    summary: one row of valid, feature_count, coordinate_count, errors, warnings.
    """

    issues: DataFrame
    summary: DataFrame


def items_of(v: Column) -> Column:
    """The items of an array, or null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def number_of(v: Column) -> Column:
    """A finite number or null."""
    kind, text = F.schema_of_variant(v), F.trim(F.try_variant_get(v, "$", "string"))
    told = F.when(text == "", 0.0).when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    n = F.when(kind.isin(*NUMBERS) | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double")).when(kind == "STRING", told).when(kind == "VOID", 0.0).when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0))
    return F.when(F.abs(n) < float("inf"), n)


def place_of(position: Column, k: int) -> Column:
    """Coordinate k of a position of two values at least, or null; values that aren't all numbers are looked at one by one."""
    values = F.try_variant_get(position, "$", "array<double>")
    number = F.get(values, F.lit(k))
    told = F.when((F.size(values) >= 2) & (F.abs(number) < float("inf")), number)
    # nulls among numbers don't show in the schema
    numbers = F.schema_of_variant(position).rlike(r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\))>$")
    return F.when(numbers & number.isNotNull(), told).when(F.size(items_of(position)) >= 2, number_of(F.try_variant_get(position, f"$[{k}]", "variant")))


def same(a: Column, b: Column) -> Column:
    """Whether two values are one number, text or other scalar; both may be absent."""
    ka, kb = F.schema_of_variant(a), F.schema_of_variant(b)
    numbers = [k.isin(*NUMBERS) | k.startswith("DECIMAL") for k in (ka, kb)]
    nested = ka.startswith("ARRAY") | ka.startswith("OBJECT")
    equal = F.when(numbers[0] & numbers[1], F.try_variant_get(a, "$", "double") == F.try_variant_get(b, "$", "double")).otherwise((ka == kb) & ~nested & (F.to_json(a) == F.to_json(b)))
    return (a.isNull() & b.isNull()) | F.coalesce(equal, F.lit(False))


def plain(v: Column) -> Column:
    """Whether a feature is without issues but for crossings; false where that can't be told at once."""
    geometry = F.try_variant_get(v, "$.geometry", "variant")
    kind, flat = text_of(geometry, "$.type"), positions(geometry)
    beyond = F.exists(flat, lambda p: (F.abs(F.get(p, F.lit(0))) > 180) | (F.abs(F.get(p, F.lit(1))) > MAX_LAT) | (F.abs(F.get(p, F.lit(0))) == float("inf")) | (F.abs(F.get(p, F.lit(1))) == float("inf")))
    empty = F.when(kind == "Polygon", F.size(items_of(F.try_variant_get(geometry, "$.coordinates", "variant"))) == 0)
    empty = empty.when(kind == "MultiPolygon", (F.size(items_of(F.try_variant_get(geometry, "$.coordinates", "variant"))) == 0) | F.exists(F.try_variant_get(geometry, "$.coordinates", "array<array<variant>>"), lambda p: F.size(p) == 0)).otherwise(False)
    return F.coalesce(feature_code(v).isNull() & ~F.is_variant_null(geometry) & (kind != "GeometryCollection") & ~beyond & ~empty, F.lit(False))


def opened(rows: DataFrame, name: str = "") -> DataFrame:
    """A row for each item of v, an array; other values give none."""
    inner = rows.select(*HEAD, F.posexplode(items_of(F.col("v"))).alias("k", "v"))
    return inner.withColumns({"path": F.concat("path", F.lit(f"{name}["), "k", F.lit("]")), "at": F.concat("at", F.array("k"))}).drop("k")


def issue(rows: DataFrame, code: str | Column, *after: int) -> DataFrame:
    """Issues of rows; `after` puts them behind those of parts."""
    at = F.concat("at", F.array(*map(F.lit, after))) if after else F.col("at")
    return rows.select("feature_seq", "fid", (F.lit(code) if isinstance(code, str) else code).alias("code"), "path", at.alias("at"))


def geometries(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The geometries of features (HEAD, v) other than collections, and the issues of collections: a round for each depth in use."""
    nests = features.select("feature_seq", "fid", F.concat("path", F.lit(".geometry")).alias("path"), "at", F.try_variant_get("v", "$.geometry", "variant").alias("v")).filter("v is not null and not is_variant_null(v)")
    leaves, found, depth = [], [], 0
    while True:
        collection = F.coalesce(text_of(F.col("v"), "$.type") == "GeometryCollection", F.lit(False))
        leaves.append(nests.filter(~collection))
        inner = nests.filter(collection).withColumn("v", F.try_variant_get("v", "$.geometries", "variant"))
        found.append(issue(inner.filter(items_of(F.col("v")).isNull()), "geometry"))
        depth += 1
        nests = opened(inner, ".geometries").checkpoint()
        if nests.isEmpty():
            break
        if depth > DEPTH:
            found.append(issue(nests, "geometry-depth"))
            break
        nests = nests.filter("not is_variant_null(v)")
    return reduce(DataFrame.unionByName, leaves).checkpoint(), reduce(DataFrame.unionByName, found)


def rings_of(geometry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rings of polygons among geometry (HEAD, kind, v: the coordinates), and the issues of polygons without any."""
    some = F.coalesce(F.size(items_of(F.col("v"))) > 0, F.lit(False))
    areas = geometry.filter(F.col("kind").isin("Polygon", "MultiPolygon"))
    many = opened(areas.filter((F.col("kind") == "MultiPolygon") & some))
    found = issue(areas.filter(~some).withColumn("path", F.regexp_replace("path", r"\.coordinates$", "")), "polygon").unionByName(issue(many.filter(~some).withColumn("path", F.regexp_replace("path", r"\.coordinates\[\d+\]$", "")), "polygon"))
    return opened(areas.filter((F.col("kind") == "Polygon") & some).drop("kind").unionByName(many.filter(some))), found


def crossing(rings: DataFrame, most: int | None) -> DataFrame:
    """Issues of rings (HEAD, v) that cross themselves; rings of over `most` positions aren't tested, if it is given."""
    fit = F.size(items_of(F.col("v")))
    tested = rings.filter((fit >= 4) & (F.lit(most is None) | (fit <= (most or 0))))
    axis = lambda k: F.transform(items_of(F.col("v")), lambda p: F.coalesce(place_of(p, k), F.lit(float("nan"))))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with np.errstate(invalid="ignore"):
                hit = which_cross([np.column_stack([x, y]).astype(float) for x, y in zip(frame["x"], frame["y"])])
            yield frame.loc[hit, HEAD]

    kept = tested.select(*HEAD, axis(0).alias("x"), axis(1).alias("y"))
    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in HEAD)
    return issue(kept.mapInPandas(work, schema), "self-intersection", LAST, 1)


def inspect(features: DataFrame, most_features: int | None = None, most_coordinates: int | None = None, most_ring: int | None = None) -> Inspection:
    """All issues of features(feature_seq, v VARIANT); paths begin with the feature's number.

    Limits give an issue of no feature, and drop nothing: browsers allow 10,000
    features and 100,000 positions, and test rings of up to 256. A null v is no
    feature. An empty table is valid.
    """
    rows = features.select("feature_seq", F.try_variant_get("v", "$.id", "string").alias("fid"), F.concat(F.lit("$.features["), "feature_seq", F.lit("]")).alias("path"), F.array().cast("array<int>").alias("at"), "v")
    rows = rows.withColumn("simple", plain(F.col("v"))).checkpoint()
    clean, odd = rows.filter("simple").drop("simple"), rows.filter("not simple").drop("simple")
    is_feature = F.coalesce(text_of(F.col("v"), "$.type") == "Feature", F.lit(False))
    leaves, nested = geometries(odd.filter(is_feature))
    kind = text_of(F.col("v"), "$.type")
    structure = F.schema_of_variant("v")
    coords = F.try_variant_get("v", "$.coordinates", "variant")
    typed = leaves.select(*HEAD, F.when(~structure.startswith("ARRAY") & ~structure.startswith("OBJECT"), "geometry").when(kind.isNull() | ~kind.isin("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"), "geometry-type").alias("code"), kind.alias("kind"), coords.alias("v")).checkpoint()
    wrong = issue(typed.filter("code is not null"), F.col("code"))
    geometry = typed.filter("code is null").drop("code")
    inside = geometry.withColumn("path", F.concat("path", F.lit(".coordinates")))
    short = issue(geometry.filter((F.col("kind") == "LineString") & (F.coalesce(F.size(items_of(F.col("v"))), F.lit(-1)) < 2)), "line-length")
    array = items_of(F.col("v")).isNotNull()
    two = inside.filter("kind = 'MultiLineString'").drop("kind")
    one = inside.filter("kind in ('MultiPoint', 'LineString')").drop("kind").unionByName(opened(two))
    rings, no_rings = rings_of(inside)
    full = F.coalesce(F.size(items_of(F.col("v"))) >= 4, F.lit(False))
    ends = [F.try_variant_get("v", "$[0]", "variant"), F.element_at(items_of(F.col("v")), -1)]
    part = lambda v, k: F.try_variant_get(v, f"$[{k}]", "variant")
    is_open = items_of(ends[0]).isNotNull() & items_of(ends[1]).isNotNull() & ~(same(part(ends[0], 0), part(ends[1], 0)) & same(part(ends[0], 1), part(ends[1], 1)))
    points = inside.filter("kind = 'Point'").drop("kind").unionByName(opened(one)).unionByName(opened(rings.filter(full)))
    placed = points.withColumns({"x": place_of(F.col("v"), 0), "y": place_of(F.col("v"), 1)})
    told = F.when(F.col("x").isNull() | F.col("y").isNull(), "coordinate").when((F.abs("x") > 180) | (F.abs("y") > MAX_LAT), "mercator-range")
    shapes = clean.select("feature_seq", "fid", F.concat("path", F.lit(".geometry.coordinates")).alias("path"), "at", text_of(F.col("v"), "$.geometry.type").alias("kind"), F.try_variant_get("v", "$.geometry.coordinates", "variant").alias("v"))
    tables = [
        issue(odd.filter(~is_feature), "feature"),
        nested,
        wrong,
        short,
        issue(two.filter(~array), "coordinates", -1),
        issue(one.filter(~array), "coordinates", -1),
        no_rings,
        issue(rings.filter(~full), "ring-length"),
        issue(rings.filter(full & is_open), "ring-open", LAST, 0),
        issue(placed.select(*HEAD, F.explode(F.when(told.isNotNull(), F.array(told))).alias("code")), F.col("code")),
        crossing(rings_of(shapes)[0].unionByName(rings), most_ring),
    ]
    found = reduce(DataFrame.unionByName, tables)
    counted = clean.agg(F.count("*").alias("f"), F.sum(F.size(positions(F.try_variant_get("v", "$.geometry", "variant")))).cast("long").alias("c"))
    counted = counted.unionByName(odd.agg(F.count("*").alias("f"), F.lit(0).cast("long").alias("c"))).unionByName(points.agg(F.lit(0).cast("long").alias("f"), F.count("*").alias("c")))
    counts = counted.agg(F.sum("f").alias("feature_count"), F.coalesce(F.sum("c"), F.lit(0)).alias("coordinate_count"))
    for column, most, code, path in (("feature_count", most_features, "feature-limit", "$.features"), ("coordinate_count", most_coordinates, "coordinate-limit", "$")):
        if most is not None:
            over = counts.filter(F.col(column) > most).select(F.lit(-1).cast("long").alias("feature_seq"), F.lit(None).cast("string").alias("fid"), F.lit(code).alias("code"), F.lit(path).alias("path"), F.array().cast("array<int>").alias("at"))
            found = found.unionByName(over)
    message = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    issues = found.select("feature_seq", "fid", F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error").alias("severity"), "code", "path", message[F.col("code")].alias("message"), "at").checkpoint()
    kinds = issues.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))
    summary = counts.join(kinds).select((F.col("errors") == 0).alias("valid"), "feature_count", "coordinate_count", "errors", "warnings")  # one row with one row
    return Inspection(issues, summary)


def first_issues(issues: DataFrame, most: int = 50) -> list[Row]:
    """The first `most` issues in reading order; if there are errors, one at least is among them, in the last place if need be."""
    order = ["feature_seq", "at", "code"]
    first = issues.orderBy(*order).limit(most).collect()
    if most == 0 or any(r.severity == "error" for r in first):
        return first
    error = issues.filter("severity = 'error'").orderBy(*order).limit(1).collect()
    return [*first[: most - 1], *error] if error else first
