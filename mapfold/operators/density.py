"""Points by tile and by cell, bounds and extents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mercator as M

#: Pixels on a side of the tiles that heat is summed in.
TILE = 256


def even_parts(name: str) -> tuple[Column, Column]:
    """What doubles are cut to, multiples of 2 ** -20 that add up without rounding to 2 ** 33, and their rests, too small for their rounding to matter."""
    n = F.col(name).cast("double")
    cut = F.when(F.abs(n) < 2.0**32, F.rint(n * 2.0**20) / 2.0**20).otherwise(n)
    return cut, F.when(F.abs(n) < 2.0**32, n - cut).otherwise(F.when(n.isNotNull(), 0.0))


def even_sum(name: str) -> Column:
    """The sum of doubles, the same in any order but for what is far below their last shown digit."""
    cut, rest = even_parts(name)
    return F.sum(cut) + F.sum(rest)


def tile_counts(points: DataFrame, z: int, weight: str = "weight") -> DataFrame:
    """z, x, y, n, weight of the tiles that have points."""
    keyed = points.select(M.tile_x(F.col("lon"), z).alias("x"), M.tile_y(F.col("lat"), z).alias("y"), F.col(weight).alias("w"))
    return keyed.groupBy("x", "y").agg(F.count("*").alias("n"), even_sum("w").alias("weight")).select(F.lit(z).alias("z"), "x", "y", "n", "weight")


def tile_pyramid(points: DataFrame, low: int, high: int) -> DataFrame:
    """Counts of all zooms: the highest from the points, the others from the tiles four of which they hold."""
    finest = tile_counts(points, high)
    levels = finest.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    up = lambda c: F.expr(f"shiftright({c}, {high} - z)")
    return levels.groupBy("z", up("x").alias("x"), up("y").alias("y")).agg(F.sum("n").alias("n"))


def filter_time(points: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Points with weight whose time is from start to end, both included; without a range times may be null."""
    if start is not None and end is not None and start > end:
        raise ValueError("start is after end")
    kept = points.filter(F.col("weight") != 0)
    if start is not None:
        kept = kept.filter(F.col("time_ms") >= start)
    return kept if end is None else kept.filter(F.col("time_ms") <= end)


def heat_cells(points: DataFrame, z: int, cell: float = 4, intensity: float = 1.0, tile: int = 512) -> DataFrame:
    """cx, cy, weight, x, y (the centre, in world pixels) and alpha of the cells of `cell` pixels that have points."""
    cell, intensity = min(32, max(1, cell)), min(5.0, max(0.0, intensity))
    pixels = tile * (1 << z)
    keyed = points.select(F.floor(M.world_x(F.col("lon")) * pixels / cell).alias("cx"), F.floor(M.world_y(F.col("lat")) * pixels / cell).alias("cy"), "weight")
    cells = keyed.groupBy("cx", "cy").agg(even_sum("weight").alias("weight"))
    return cells.select("cx", "cy", "weight", ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"), M.clamp(F.col("weight") * intensity, 0.0, 1.0).alias("alpha"))


def stamped(cells: DataFrame, reach: int, stamp: Callable[[float, int], np.ndarray]) -> DataFrame:
    """px, py, density: the stamps of cells(ox, oy, strength, n), squares of 2 reach + 1 pixels about ox, oy, added up.

    Cells are dealt to the tiles of TILE pixels that their stamps touch, so a
    pixel is summed in one task, which holds one tile at a time, however many
    cells it has. Pixels without a density above zero give no row.
    """
    side = lambda c: F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))
    dealt = cells.select("ox", "oy", F.col("strength").cast("double").alias("strength"), F.col("n").cast("long").alias("n"))
    dealt = dealt.withColumn("tx", F.explode(side("ox"))).withColumn("ty", F.explode(side("oy")))
    dealt = dealt.repartition("tx", "ty").sortWithinPartitions("tx", "ty")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, grid = None, np.zeros((TILE, TILE))

        def done() -> pa.RecordBatch:
            y, x = np.nonzero(grid > 0)
            return pa.RecordBatch.from_arrays([pa.array(x + tile[0] * TILE), pa.array(y + tile[1] * TILE), pa.array(grid[y, x])], ["px", "py", "density"])

        for batch in batches:
            for ox, oy, strength, n, tx, ty in zip(*(c.to_pylist() for c in batch.columns)):
                if (tx, ty) != tile:
                    if tile is not None:
                        yield done()
                    tile, grid = (tx, ty), np.zeros((TILE, TILE))
                # the part of the stamp that is in the tile
                x, y = ox - reach - tx * TILE, oy - reach - ty * TILE
                low, left = max(0, y), max(0, x)
                whole = stamp(strength, n)
                part = whole[low - y : TILE - y, left - x : TILE - x]
                grid[low : low + part.shape[0], left : left + part.shape[1]] += part
        if tile is not None:
            yield done()

    return dealt.mapInArrow(work, "px long, py long, density double")


def heat_density(cells: DataFrame, radius: int = 30, cap: float = 1.0) -> DataFrame:
    """px, py, density: each cell's alpha spread over a cone of `radius` pixels, added up and capped."""
    radius = min(150, max(2, radius))
    away = np.arange(-radius, radius + 1)
    cone = np.maximum(0, 1 - np.sqrt(away[:, None] ** 2 + away**2) / radius)
    held = cells.filter("alpha > 0").select(F.floor("x").alias("ox"), F.floor("y").alias("oy"), F.col("alpha").alias("strength"), F.lit(1).alias("n"))
    return stamped(held, radius, lambda alpha, n: alpha * cone).select("px", "py", F.least(F.lit(cap), "density").alias("density"))


def style_heat(points: DataFrame, z: int, radius: int = 30, intensity: float = 1.0, tile: int = 512) -> DataFrame:
    """px, py, density by the Gaussian kernel of style layers: weight * intensity * 0.3989422804 * exp(-4.5 t²), each held at 1."""
    pixels, peak = tile * (1 << z), 0.3989422804
    at = points.select(F.floor(M.world_x(F.col("lon")) * pixels).alias("ox"), F.floor(M.world_y(F.col("lat")) * pixels).alias("oy"), (F.col("weight") * intensity).alias("strength")).filter("strength > 0")
    # points that are nowhere held at 1 are added by pixel, others by strength
    held = F.when(F.col("strength") * peak > 1, F.col("strength"))
    at = at.groupBy("ox", "oy", held.alias("held")).agg(F.count("*").alias("n"), F.sum("strength").alias("sum"))
    at = at.select("ox", "oy", F.coalesce("held", "sum").alias("strength"), F.when(F.col("held").isNotNull(), F.col("n")).otherwise(0).alias("n"))
    away = np.arange(1 - radius, radius)
    t2 = (away[:, None] ** 2 + away**2) / (radius * radius)
    bell = np.where(t2 < 1, peak * np.exp(-4.5 * t2), 0.0)
    return stamped(at, radius - 1, lambda strength, n: np.minimum(1.0, strength * bell) * n if n else strength * bell)


def extent(features: DataFrame, *by: str) -> DataFrame:
    """w, s, e, n over w, s, e, n of each group."""
    return features.groupBy(*by).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))


def bounds(points: DataFrame, bins: int = 3600) -> DataFrame:
    """w, s, e, n of all points; w > e where the narrowest interval crosses the antimeridian.

    The interval is the complement of the widest gap between longitudes, the
    first of the widest. Longitudes are put in bins; the widest gap is either
    within a bin or between neighbouring filled bins, so no task sorts them all
    and `bins` rows are what is left for the last step.
    """
    at = points.select(F.pmod(F.col("lon"), F.lit(360.0)).alias("lon"), "lat").withColumn("bin", F.floor(F.col("lon") * bins / 360.0))
    in_bin = Window.partitionBy("bin").orderBy("lon")
    distinct = at.groupBy("bin", "lon").agg(F.min("lat").alias("s"), F.max("lat").alias("n"))
    gaps = distinct.withColumn("after", F.lead("lon").over(in_bin)).withColumn("gap", F.col("after") - F.col("lon"))
    # greatest gap of a bin, the first of equal ones: struct order is by gap, then by the smaller start
    per_bin = gaps.groupBy("bin").agg(F.min("lon").alias("low"), F.max("lon").alias("high"), F.min("s").alias("s"), F.max("n").alias("n"), F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("lon")).alias("start"), "after"))).alias("inner"))
    line = Window.orderBy("bin")  # `bins` rows at most
    first = F.min("low").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = F.coalesce(F.lead("low").over(line), first + 360.0)
    between = per_bin.withColumn("outer", F.struct((after - F.col("high")).alias("gap"), (-F.col("high")).alias("start"), after.alias("after")))
    best = between.agg(F.max(F.greatest(F.coalesce("inner", "outer"), "outer")).alias("g"), F.min("s").alias("s"), F.max("n").alias("n")).filter("g is not null")
    return best.select(M.wrap_lon(F.col("g.after"), "east").alias("w"), "s", M.wrap_lon(-F.col("g.start"), "east").alias("e"), "n")


def filter_bbox(features: DataFrame, west: float, south: float, east: float, north: float, pixels: int = 800) -> DataFrame:
    """Features (w, s, e, n) that a padded view may show, in any copy of the world."""
    while east < west:
        east += 360
    span, tall = east - west, north - south
    if span < 1e-6 or 3 * span >= 360:
        return features
    pad, pad_y = max(1e-6, span, span * 160 / pixels), max(1e-6, tall, tall * 160 / pixels)
    across = F.lit(False)
    for shift in (-720, -360, 0, 360, 720):
        across = across | ((F.col("e") + shift >= west - pad) & (F.col("w") + shift <= east + pad))
    rows = (F.col("n") >= south - pad_y) & (F.col("s") <= north + pad_y)
    return features.filter((rows & across) | (F.col("w") < -180) | (F.col("e") > 180))


def contains(west: Column, south: Column, east: Column, north: Column, lon: Column, lat: Column) -> Column:
    """Whether bounds hold a position, edges included; west > east crosses the antimeridian."""
    across = F.when(west <= east, (lon >= west) & (lon <= east)).otherwise((lon >= west) | (lon <= east))
    return across & (lat >= south) & (lat <= north)


def feature_tiles(features: DataFrame, z: int, buffer: float = 1 / 8) -> DataFrame:
    """features with w, s, e, n: a row for each tile x, y of zoom z, grown by `buffer`, that the box overlaps."""
    n = 1 << z
    low_x, high_x = M.world_x(F.col("w")) * n, M.world_x(F.col("e")) * n
    low_y, high_y = M.world_y(F.col("n")) * n, M.world_y(F.col("s")) * n
    first = lambda c: F.greatest(F.lit(0), F.ceil(c - 1 - buffer)).cast("long")
    last = lambda c: F.least(F.lit(n - 1), F.floor(c + buffer)).cast("long")
    span = lambda a, b: F.when(first(a) <= last(b), F.sequence(first(a), last(b)))
    return features.withColumn("z", F.lit(z)).withColumn("x", F.explode(span(low_x, high_x))).withColumn("y", F.explode(span(low_y, high_y)))
