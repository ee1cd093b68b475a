"""Tile counts, heat, bounds and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density as D
from .inputs import scaled, scaled_sql, sql, table, view
from .registry import query
from .scalars import X, Y, zone_features

WORLD, CITY, ZONES = sql("pts_world"), sql("pts_city"), sql("zones")


def tile(z: int) -> str:
    n = 1 << z
    return f"((CAST(floor({X} * {n}) AS BIGINT) % {n}) + {n}) % {n} AS x, greatest(0, least({n - 1}, CAST(floor({Y} * {n}) AS BIGINT))) AS y"


@query(f"SELECT CAST(8 AS INTEGER) AS z, x, y, count(*) AS n, {scaled_sql('sum(weight)')} AS weight FROM (SELECT {tile(8)}, weight FROM {WORLD}) GROUP BY x, y")
def agg_tile_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.tile_counts(view(spark, d, "pts_world"), 8).withColumn("weight", scaled(F.col("weight")))


@query(f"SELECT CAST(z AS INTEGER) AS z, x >> (8 - z) AS x, y >> (8 - z) AS y, count(*) AS n FROM (SELECT {tile(8)} FROM {WORLD}), (SELECT unnest(range(0, 9)) AS z) GROUP BY 1, 2, 3")
def agg_tile_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return D.tile_pyramid(view(spark, d, "pts_world"), 0, 8).withColumn("n", F.col("n").cast("long"))


PART = "time_ms BETWEEN 1704412800000 AND 1705276800000"


@query(f"SELECT event_id, time_ms FROM {WORLD} WHERE {PART} AND weight <> 0")
def flt_time(spark: SparkSession, d: str) -> DataFrame:
    return D.filter_time(view(spark, d, "pts_world"), 1704412800000, 1705276800000).select("event_id", "time_ms")


CELLS = f"(SELECT CAST(floor({X} * 1048576 / 4) AS BIGINT) AS cx, CAST(floor({Y} * 1048576 / 4) AS BIGINT) AS cy, sum(weight) AS weight FROM {CITY} WHERE {PART} AND weight <> 0 GROUP BY 1, 2)"


def city_cells(spark: SparkSession, d: str) -> DataFrame:
    return D.heat_cells(D.filter_time(view(spark, d, "pts_city"), 1704412800000, 1705276800000), 11, 4, 0.002)


@query(f"SELECT cx, cy, {scaled_sql('weight')} AS weight, {scaled_sql('(cx + 0.5) * 4')} AS x, {scaled_sql('(cy + 0.5) * 4')} AS y, {scaled_sql('greatest(0, least(1, weight * 0.002))')} AS alpha FROM {CELLS}")
def agg_heat_cells(spark: SparkSession, d: str) -> DataFrame:
    return city_cells(spark, d).select("cx", "cy", *(scaled(F.col(c)).alias(c) for c in ("weight", "x", "y", "alpha")))


@query(f"""SELECT px, py, {scaled_sql('least(1, sum(v))')} AS density FROM (
SELECT CAST(floor((cx + 0.5) * 4) AS BIGINT) + dx AS px, CAST(floor((cy + 0.5) * 4) AS BIGINT) + dy AS py, greatest(0, least(1, weight * 0.002)) * (1 - sqrt(dx * dx + dy * dy) / 12) AS v
FROM {CELLS}, (SELECT unnest(range(-12, 13)) AS dx), (SELECT unnest(range(-12, 13)) AS dy)) WHERE v > 0 GROUP BY px, py""")
def agg_heat_raster(spark: SparkSession, d: str) -> DataFrame:
    return D.heat_density(city_cells(spark, d), 12).withColumn("density", scaled(F.col("density")))


@query(f"""SELECT px, py, {scaled_sql('sum(least(1, strength * 0.3989422804 * exp(-4.5 * (dx * dx + dy * dy) / 64e0)))')} AS density FROM (
SELECT CAST(floor({X} * 524288) AS BIGINT) + dx AS px, CAST(floor({Y} * 524288) AS BIGINT) + dy AS py, weight * 0.01 AS strength, dx, dy
FROM {CITY}, (SELECT unnest(range(-7, 8)) AS dx), (SELECT unnest(range(-7, 8)) AS dy)) WHERE strength > 0 AND (dx * dx + dy * dy) / 64e0 < 1 GROUP BY px, py""")
def agg_heat_gauss(spark: SparkSession, d: str) -> DataFrame:
    return D.style_heat(view(spark, d, "pts_city"), 10, 8, 0.01).withColumn("density", scaled(F.col("density")))


@query(f"SELECT region, {scaled_sql('min(w)')} AS w, {scaled_sql('min(s)')} AS s, {scaled_sql('max(e)')} AS e, {scaled_sql('max(n)')} AS n FROM {ZONES} GROUP BY region")
def agg_extent(spark: SparkSession, d: str) -> DataFrame:
    return D.extent(view(spark, d, "zones"), "region").select("region", *(scaled(F.col(c)).alias(c) for c in "wsen"))


@query(f"""WITH p AS (SELECT ((lon % 360) + 360) % 360 AS lon, lat FROM {WORLD} WHERE lon < -100 OR lon > 120),
g AS (SELECT lon, coalesce(lead(lon) OVER (ORDER BY lon), (SELECT min(lon) + 360 FROM p)) AS after FROM p),
b AS (SELECT * FROM g ORDER BY after - lon DESC, lon LIMIT 1)
SELECT {scaled_sql('CASE WHEN after % 360 > 180 THEN after % 360 - 360 ELSE after % 360 END')} AS w, {scaled_sql('(SELECT min(lat) FROM p)')} AS s,
{scaled_sql('CASE WHEN lon > 180 THEN lon - 360 ELSE lon END')} AS e, {scaled_sql('(SELECT max(lat) FROM p)')} AS n FROM b""")
def agg_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of the points on either side of the antimeridian."""
    return D.bounds(view(spark, d, "pts_world").filter("lon < -100 OR lon > 120")).select(*(scaled(F.col(c)).alias(c) for c in "wsen"))


@query(f"""SELECT zone_id FROM {ZONES}, (SELECT unnest([-720, -360, 0, 360, 720]) AS shift)
WHERE n >= 10 - 20 AND s <= 30 + 20 AND e + shift >= 170 - 30 AND w + shift <= 200 + 30 GROUP BY zone_id""")
def flt_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Zones that a view across the antimeridian may show."""
    return D.filter_bbox(view(spark, d, "zones"), 170, 10, -160, 30).select("zone_id")


@query(f"SELECT event_id, (lon >= 170 OR lon <= -160) AND lat BETWEEN -10 AND 40 AS inside FROM {WORLD}")
def flt_contains(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    return p.select("event_id", D.contains(F.lit(170), F.lit(-10), F.lit(-160), F.lit(40), p.lon, p.lat).alias("inside"))


@query(f"SELECT x, y, count(*) AS n FROM (SELECT {tile(6)} FROM {WORLD}) WHERE (x + 1) / 64e0 > 0.4 AND x / 64e0 < 0.75 AND (y + 1) / 64e0 > 0.2 AND y / 64e0 < 0.6 GROUP BY x, y")
def flt_tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that overlap world bounds, their edges left out."""
    t = D.tile_counts(view(spark, d, "pts_world"), 6).select("x", "y", "n")
    return t.filter((F.col("x") + 1 > 0.4 * 64) & (F.col("x") < 0.75 * 64) & (F.col("y") + 1 > 0.2 * 64) & (F.col("y") < 0.6 * 64))


WY = Y.replace("lat", "{}")


@query(f"""WITH b AS (SELECT zone_id, (w + 180) / 360 * 32 AS x0, (e + 180) / 360 * 32 AS x1, {WY.replace('{}', 'n')} * 32 AS y0, {WY.replace('{}', 's')} * 32 AS y1 FROM {ZONES})
SELECT zone_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM b, (SELECT unnest(range(0, 32)) AS x), (SELECT unnest(range(0, 32)) AS y)
WHERE x1 >= x - 0.125 AND x0 <= x + 1.125 AND y1 >= y - 0.125 AND y0 <= y + 1.125""")
def join_feature_tiles(spark: SparkSession, d: str) -> DataFrame:
    return D.feature_tiles(view(spark, d, "zones"), 5).select("zone_id", F.col("x").cast("int"), F.col("y").cast("int"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') OR contains(lower(p_type), 'e') ORDER BY p_partkey LIMIT 20")
def flt_search(spark: SparkSession, d: str) -> DataFrame:
    return search(table(spark, d, "part"), " E ", ["p_name", "p_type"], "p_partkey").select("p_partkey", "p_name")


def search(features: DataFrame, text: str, keys: list[str], order: str, limit: int = 20) -> DataFrame:
    """The first features, in order, that have the trimmed text in any of the keys, in any case."""
    wanted = text.strip().lower()
    if not wanted:
        return features.filter(F.lit(False))
    found = F.lit(False)
    for key in keys:
        found = found | F.coalesce(F.lower(F.col(key).cast("string")).contains(wanted), F.lit(False))
    return features.filter(found).orderBy(order).limit(limit)


@query(f"""SELECT z.zone_id, count(*) AS n FROM {ZONES} z JOIN {WORLD} p ON p.lon >= z.w AND p.lon <= z.e AND p.lat >= z.s AND p.lat <= z.n
AND NOT (z.zone_id % 2 = 0 AND p.lon > z.w + 20 AND p.lon < z.e - 20 AND p.lat > z.s + 8 AND p.lat < z.n - 8) GROUP BY z.zone_id""")
def join_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import points_in_polygons

    zones = zone_features(spark, d).select(F.col("zone_id").alias("poly_id"), "parts")
    hits = points_in_polygons(view(spark, d, "pts_world").select(F.col("event_id").alias("point_id"), "lon", "lat"), zones)
    return hits.groupBy(F.col("poly_id").alias("zone_id")).agg(F.count("*").alias("n"))
