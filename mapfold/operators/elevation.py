"""Elevation tiles: decoding, colour relief and hill shading, one tile a row, whole tiles in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Factors of red, green and blue, and what is taken off.
ENCODINGS = {"mapbox": (6553.6, 25.6, 0.1, 10000.0), "terrarium": (256.0, 1.0, 1 / 256, 32768.0)}

# Fixed values of the published shading formula: below these zooms slopes are damped by so much a zoom, at others by DAMPED.
DAMPINGS, DAMPED = ((2, 0.4), (4.5, 0.35)), 0.3
# The zoom from which nothing is damped, the binary logarithm of the scale, the factor and limit of slopes, and the curve of exaggeration.
UNDAMPED, SCALE, SLOPE, STEEPEST, CURVE = 15, 28.2562, 0.625, 4, (1.875, 1.75)


def heights(rgba: bytes, encoding: tuple[float, float, float, float]) -> np.ndarray:
    """Elevations of a tile as (size, size); not a number where alpha is 0."""
    pixels = np.frombuffer(rgba, np.uint8).reshape(-1, 4).astype(float)
    side = math.isqrt(len(pixels))
    flat = pixels[:, :3] @ np.array(encoding[:3]) - encoding[3]
    return np.where(pixels[:, 3] == 0, np.nan, flat).reshape(side, side)


def relief(height: np.ndarray, stops: list[tuple[float, tuple[float, float, float, float]]]) -> np.ndarray:
    """RGBA bytes (size, size, 4) by ascending (elevation, (r, g, b, alpha)) stops, blended premultiplied and held at the ends."""
    levels = np.array([s for s, _ in stops], float)
    colors = np.array([(r * a, g * a, b * a, a) for _, (r, g, b, a) in stops], float)
    safe = np.nan_to_num(height)
    blended = np.stack([np.interp(safe, levels, colors[:, c]) for c in range(4)], axis=-1)
    alpha = blended[..., 3:]
    rgb = np.where(alpha > 0, blended[..., :3] / np.where(alpha > 0, alpha, 1), 0)
    out = np.rint(np.clip(np.concatenate([rgb, alpha * 255], axis=-1), 0, 255)).astype(np.uint8)
    out[np.isnan(height) | (alpha[..., 0] <= 0)] = 0
    return out


def hillshade(height: np.ndarray, z: int, y: int, direction: float = 335.0, exaggeration: float = 0.5, shadow=(0, 0, 0, 1), highlight=(255, 255, 255, 1), accent=(0, 0, 0, 1)) -> np.ndarray:
    """RGBA bytes (size, size, 4) of the standard shading of web maps; clear where there is no data."""
    size = len(height)
    if exaggeration <= 0:
        return np.zeros((size, size, 4), np.uint8)
    h = height.astype(np.float32).astype(float)
    grown = np.pad(h, 1, mode="edge")
    side = lambda dy, dx: grown[1 + dy : 1 + dy + size, 1 + dx : 1 + dx + size]
    near = {(dy, dx): np.where(np.isnan(side(dy, dx)), h, side(dy, dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    sobel = lambda a, b: sum(w * (near[p] - near[q]) for w, p, q in zip((1, 2, 1), a, b))
    edge = np.where((np.arange(size) == 0) | (np.arange(size) == size - 1), 2.0, 1.0)
    damped = min(0.0, z - UNDAMPED) * next((share for below, share in DAMPINGS if z < below), DAMPED)
    unit = 2 ** (damped + SCALE - z) / size
    latitude = np.arctan(np.sinh(math.pi * (1 - 2 * (y + (np.arange(size) + 0.5) / size) / 2**z)))
    stretch = np.cos(latitude)[:, None]
    dx = np.clip(sobel([(-1, 1), (0, 1), (1, 1)], [(-1, -1), (0, -1), (1, -1)]) * edge[None, :] / unit, -STEEPEST, STEEPEST) / stretch
    dy = np.clip(sobel([(1, -1), (1, 0), (1, 1)], [(-1, -1), (-1, 0), (-1, 1)]) * edge[:, None] / unit, -STEEPEST, STEEPEST) / stretch
    slope = np.arctan(SLOPE * np.hypot(dx, dy))
    aspect = np.where(dx != 0, np.arctan2(dy, -dx), np.where(dy > 0, math.pi / 2, -math.pi / 2))
    steep = slope
    if exaggeration != 0.5:
        base = CURVE[0] - CURVE[1] * exaggeration
        steep = (base**slope - 1) / (base ** (math.pi / 2) - 1) * (math.pi / 2)
    strength = min(1.0, 2 * exaggeration)
    light = np.abs(np.mod((aspect + math.radians(direction) + math.pi) / math.pi + 0.5, 2) - 1)[..., None]
    dark, bright, tint = (np.array([*(c * v[3] for c in v[:3]), v[3]], float) for v in (shadow, highlight, accent))
    shade = (dark + (bright - dark) * light) * (np.sin(steep) * strength)[..., None]
    under = tint * ((1 - np.cos(steep)) * strength)[..., None]
    mixed = under * (1 - shade[..., 3:]) + shade
    alpha = mixed[..., 3:]
    rgb = np.where(alpha > 0, mixed[..., :3] / np.where(alpha > 0, alpha, 1), 0)
    out = np.rint(np.clip(np.nan_to_num(np.concatenate([rgb, alpha * 255], axis=-1)), 0, 255)).astype(np.uint8)
    out[np.isnan(h) | ~(alpha[..., 0] > 0)] = 0
    return out


def elevations(tiles: DataFrame, encoding: str = "mapbox", custom: tuple[float, float, float, float] | None = None) -> DataFrame:
    """tile_id, heights (array<float>, null where there is no data) of tiles(tile_id, rgba). Unknown encodings are mapbox's."""
    factors = custom or ENCODINGS.get(encoding, ENCODINGS["mapbox"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [heights(r.as_py(), factors).ravel() for r in batch.column(1)]
            values = [pa.array(h, pa.float64(), mask=np.isnan(h)) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.to_pylist() for v in values], pa.list_(pa.float64()))], ["tile_id", "heights"])

    return tiles.select("tile_id", "rgba").mapInArrow(work, "tile_id long, heights array<double>")


def shaded(tiles: DataFrame, encoding: str = "mapbox", stops: list | None = None, **settings) -> DataFrame:
    """tile_id, rgba of tiles(tile_id, z, y, rgba): colour relief if stops are given, else hill shading."""
    factors = ENCODINGS.get(encoding, ENCODINGS["mapbox"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, y, rgba in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                h = heights(rgba, factors)
                out.append((relief(h, stops) if stops else hillshade(h, z, y, **settings)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["tile_id", "rgba"])

    return tiles.select("tile_id", "z", "y", "rgba").mapInArrow(work, "tile_id long, rgba binary")


def made_tiles(rows: DataFrame, size: int = 8) -> DataFrame:
    """tile_id, z, y, rgba for each tile_id of rows: a pattern of size² pixels."""
    pixel = lambda i: F.concat(*(F.lpad(F.hex(v.cast("long")), 2, "0") for v in (F.lit(128), (F.col("tile_id") * 7 + i * 3) % 256, (F.col("tile_id") + i) % 256, F.when(i % 11 == 5, 0).otherwise(255))))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pixel), "")
    return rows.select("tile_id", F.lit(9).alias("z"), (F.col("tile_id") % 512).cast("int").alias("y"), F.unhex(hexed).alias("rgba"))
