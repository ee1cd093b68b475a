"""Checks of features, points and tracks: tables of issues, never exceptions from tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Row, compile_expression
from ..functions.mercator import MAX_LAT


def issues(features: DataFrame) -> DataFrame:
    """feature_seq, severity, code of features(feature_seq, geom_type, parts), a row for each code of a feature."""
    parts = F.col("parts")
    flat = F.flatten(parts)
    line, ring = F.col("geom_type").endswith("LineString"), F.col("geom_type").endswith("Polygon")
    bad = F.exists(flat, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    beyond = F.exists(flat, lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > MAX_LAT))
    found = F.array(
        F.when(bad, F.struct(F.lit("error").alias("severity"), F.lit("coordinate").alias("code"))),
        F.when(line & F.exists(parts, lambda p: F.size(p) < 2), F.struct(F.lit("error").alias("severity"), F.lit("line-length").alias("code"))),
        F.when(ring & F.exists(parts, lambda p: F.size(p) < 4), F.struct(F.lit("error").alias("severity"), F.lit("ring-length").alias("code"))),
        F.when(ring & F.exists(parts, lambda p: F.get(p, F.lit(0)) != F.element_at(p, -1)), F.struct(F.lit("error").alias("severity"), F.lit("ring-open").alias("code"))),
        F.when(~F.coalesce(bad, F.lit(False)) & beyond, F.struct(F.lit("warning").alias("severity"), F.lit("mercator-range").alias("code"))),
    )
    plain = features.select("feature_seq", F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select("feature_seq", "i.severity", "i.code")
    return plain.unionByName(crossings(features.filter(ring)))


def crosses(ring: np.ndarray, block: int = 256) -> bool:
    """Whether two edges of a closed ring (n, 2) cross; those that share an end don't.

    Edges are put in the order of their western ends, and a block of them meets
    those that begin before it ends.
    """
    order = np.argsort(np.minimum(ring[:-1, 0], ring[1:, 0]), kind="stable")
    a, b = ring[:-1][order], ring[1:][order]
    west, east = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for start in range(0, len(a), block):
        end = int(np.searchsorted(west, east[start : start + block].max(), "right"))
        ai, bi = a[start : start + block, None], b[start : start + block, None]
        for other in range(start, end, 16 * block):
            aj, bj = a[None, other : min(end, other + 16 * block)], b[None, other : min(end, other + 16 * block)]
            if ((side(ai, bi, aj) * side(ai, bi, bj) < 0) & (side(aj, bj, ai) * side(aj, bj, bi) < 0)).any():
                return True
    return False


def which_cross(rings: Sequence[np.ndarray], pairs: int = 1 << 20) -> np.ndarray:
    """crosses(ring) of each of the rings (n, 2); those of one small size are tested at once, by `pairs` pairs of edges at most."""
    sizes, hit = np.array([len(r) for r in rings], int), np.zeros(len(rings), bool)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        if n > 64:
            hit[places] = [crosses(rings[i]) for i in places]
            continue
        step = max(1, pairs // max(1, n * n))
        for some in (places[k : k + step] for k in range(0, len(places), step)):
            ring = np.stack([rings[i] for i in some])
            a, b = ring[:, :-1], ring[:, 1:]
            ai, bi, aj, bj = a[:, :, None], b[:, :, None], a[:, None], b[:, None]
            hit[some] = ((side(ai, bi, aj) * side(ai, bi, bj) < 0) & (side(aj, bj, ai) * side(aj, bj, bi) < 0)).any(axis=(1, 2))
    return hit


def crossings(polygons: DataFrame, most: int | None = None) -> DataFrame:
    """feature_seq, severity, code of polygons with a ring that crosses itself; rings of over `most` positions aren't tested, if it is given."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tested = [[ring for ring in parts if len(ring) >= 4 and (most is None or len(ring) <= most)] for parts in frame["parts"]]
            owner = np.repeat(np.arange(len(frame)), [len(parts) for parts in tested])
            hit = np.zeros(len(frame), bool)
            hit[owner[which_cross([np.array([(p["x"], p["y"]) for p in ring], float) for parts in tested for ring in parts])]] = True
            yield pd.DataFrame({"feature_seq": frame["feature_seq"][hit], "severity": "error", "code": "self-intersection"})

    return polygons.select("feature_seq", "parts").mapInPandas(work, "feature_seq long, severity string, code string")


def summary(features: DataFrame) -> DataFrame:
    """feature_count, coordinate_count, warnings, errors."""
    counts = features.agg(F.count("*").alias("feature_count"), F.sum("coord_count").alias("coordinate_count"))
    found = issues(features).agg(F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.count(F.when(F.col("severity") == "error", 1)).alias("errors"))
    return counts.join(found)  # one row with one row


def top_issues(found: DataFrame, most: int = 50) -> DataFrame:
    """The first issues, with one error at least if there is any."""
    first = found.orderBy("feature_seq", "code").limit(most)
    if most == 0 or first.filter("severity = 'error'").limit(1).count():
        return first
    error = found.filter("severity = 'error'").orderBy("feature_seq", "code").limit(1)
    room = most - error.count()
    return found.filter("severity <> 'error'").orderBy("feature_seq", "code").limit(room).unionByName(error)


def check_budget(features: DataFrame, most_features: int, most_coordinates: int) -> DataFrame:
    """One row: features, coordinates; an error if there are more than allowed."""
    row = features.agg(F.count("*").alias("features"), F.coalesce(F.sum("coord_count"), F.lit(0)).alias("coordinates"))
    n, c = row.first()
    if n > most_features or c > most_coordinates:
        raise ValueError(f"{n} features and {c} coordinates are more than {most_features} and {most_coordinates}")
    return row


def heat_points(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw with weight and time as text: points with weight double and time_ms, and the rows that are refused.

    The weight is 1 by default and must be finite and not negative; a time is
    null, a number of milliseconds, or a date.
    """
    weight = F.when(F.col("weight").isNull(), 1.0).otherwise(F.col("weight").try_cast("double"))
    text = F.trim("time")
    time = F.coalesce(text.try_cast("double").cast("long"), F.unix_millis(F.try_to_timestamp(text)))
    rows = raw.withColumn("_w", weight).withColumn("_t", time)
    wrong = F.col("_w").isNull() | F.isnan("_w") | (F.col("_w") < 0) | (F.col("_w") == float("inf")) | (F.col("_t").isNull() & F.col("time").isNotNull() & (text != ""))
    keep = [c for c in raw.columns if c not in ("weight", "time")]
    return rows.filter(~wrong).select(*keep, F.col("_w").alias("weight"), F.col("_t").alias("time_ms")), rows.filter(wrong).select(*raw.columns)


def heat_features(features: DataFrame, weight: str = "weight", time: str = "time") -> tuple[DataFrame, DataFrame]:
    """features(feature_id, geometry_type, parts, props) as points, and feature_id and code of those that are refused.

    Points are feature_id, lon, lat, weight and time_ms, one for each position
    of Point and MultiPoint features; other types have none and are no error.
    `weight` and `time` name properties. A weight is 1 if it is null or absent,
    and must be a finite number, or text of one, that isn't negative; a time is
    null, empty, a number of milliseconds, or a date, in UTC without a zone.
    Codes: weight, time, and coordinates for a position without finite numbers;
    a feature with an error has no points.
    """
    read = lambda name: compile_expression(["get", name], Row(props=F.col("props")))
    w, t, inf = read(weight), read(time), float("inf")
    number = F.coalesce(w.num, w.bool.cast("double"), F.when(F.trim(w.str) == "", 0.0), F.trim(w.str).try_cast("double"))
    number = F.when(w.is_null(), 1.0).otherwise(number)
    millis = F.coalesce(t.num.cast("long"), F.unix_millis(F.try_to_timestamp(t.str)))
    finite = lambda c: F.coalesce((F.abs(c) < inf), F.lit(False))
    at = F.when(F.col("geometry_type").isin("Point", "MultiPoint"), F.flatten("parts"))
    rows = features.select("feature_id", at.alias("at"), number.alias("weight"), millis.alias("time_ms"), (t.is_null() | (t.str == "")).alias("timeless")).filter("at is not null")
    code = F.when(~finite(F.col("weight")) | (F.col("weight") < 0), "weight").when(F.col("time_ms").isNull() & ~F.coalesce("timeless", F.lit(False)), "time")
    code = code.when(F.exists("at", lambda p: ~(finite(p["x"]) & finite(p["y"]))), "coordinates")
    rows = rows.withColumn("code", code)
    points = rows.filter("code is null").select("feature_id", F.explode("at").alias("p"), "weight", "time_ms")
    return points.select("feature_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), "weight", "time_ms"), rows.filter("code is not null").select("feature_id", "code")


def track_errors(frames: DataFrame) -> DataFrame:
    """frames(entity_id, event_id, time_ms, lon, lat) with a code: time (repeated), range or clock (beyond 7 days or below 0)."""
    again = frames.groupBy("entity_id", "time_ms").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = frames.join(again, ["entity_id", "time_ms"], "left")
    code = F.when(F.col("_n").isNotNull(), "time").when((F.abs("lon") > 180) | (F.abs("lat") > 90), "range").when((F.col("time_ms") < 0) | (F.col("time_ms") > 7 * 86_400_000), "clock")
    return rows.withColumn("code", code).filter("code is not null").drop("_n")
