"""Scalar and per-geometry functions over whole tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import geometry as geo
from ..functions import mercator as M
from .inputs import scaled, scaled_sql, sql, view
from .registry import query

WORLD = sql("pts_world")
X = "((lon + 180) / 360)"
Y = "(0.5 - ln((1 + sin(radians(greatest(-85.05112878, least(85.05112878, lat))))) / (1 - sin(radians(greatest(-85.05112878, least(85.05112878, lat)))))) / (4 * pi()))"
R = "6371008.8"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * {R} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


@query(f"SELECT event_id, {scaled_sql(X, 10**6)} AS wx, {scaled_sql(Y, 10**6)} AS wy FROM {WORLD}")
def sc_world(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    return p.select("event_id", scaled(M.world_x(p.lon), 10**6).alias("wx"), scaled(M.world_y(p.lat), 10**6).alias("wy"))


@query(f"""SELECT event_id, {scaled_sql("(x - floor(x)) * 360 - 180")} AS lon, {scaled_sql("degrees(atan(sinh(pi() * (1 - 2 * y))))")} AS lat
FROM (SELECT event_id, (event_id % 3000) / 1000e0 - 1 AS x, (event_id % 997) / 997e0 AS y FROM {WORLD})""")
def sc_lonlat(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world").selectExpr("event_id", "(event_id % 3000) / 1000e0 - 1 AS x", "(event_id % 997) / 997e0 AS y")
    return p.select("event_id", scaled(M.lon_of_world(p.x)).alias("lon"), scaled(M.lat_of_world(p.y)).alias("lat"))


@query(f"SELECT event_id, ((CAST(floor({X} * 1024) AS BIGINT) % 1024) + 1024) % 1024 AS x, greatest(0, least(1023, CAST(floor({Y} * 1024) AS BIGINT))) AS y FROM {WORLD}")
def sc_tile(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    return p.select("event_id", M.tile_x(p.lon, 10).alias("x"), M.tile_y(p.lat, 10).alias("y"))


TILES = f"(SELECT event_id, CAST(event_id % 12 AS INTEGER) AS z, CAST(event_id * 31 % CAST(pow(2, event_id % 12) AS BIGINT) AS BIGINT) AS x, CAST(event_id * 17 % CAST(pow(2, event_id % 12) AS BIGINT) AS BIGINT) AS y FROM {WORLD})"


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pts_world").selectExpr("event_id", "CAST(event_id % 12 AS INT) AS z", "event_id * 31 % CAST(pow(2, event_id % 12) AS BIGINT) AS x", "event_id * 17 % CAST(pow(2, event_id % 12) AS BIGINT) AS y")


@query(f"""SELECT event_id, z, x, y, {scaled_sql("x / pow(2e0, z) * 360 - 180")} AS w, {scaled_sql("degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2e0, z)))))")} AS s,
{scaled_sql("(x + 1) / pow(2e0, z) * 360 - 180")} AS e, {scaled_sql("degrees(atan(sinh(pi() * (1 - 2 * y / pow(2e0, z)))))")} AS n,
{scaled_sql("x / pow(2e0, z) * (2 * pi() * 6378137e0) - pi() * 6378137e0")} AS west_mm FROM {TILES}""")
def sc_tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d)
    degrees, metres = M.tile_bounds(t.z, t.x, t.y), M.tile_bounds(t.z, t.x, t.y, "3857")
    return t.select("event_id", "z", "x", "y", *(scaled(v).alias(k) for k, v in zip("wsen", degrees)), scaled(metres[0]).alias("west_mm"))


@query(f"""SELECT event_id, 'https://' || substr('abc', CAST((x + y) % 3 AS INTEGER) + 1, 1) || '.example.org/' || z || '/' || x || '/' || (CAST(pow(2, z) AS BIGINT) - 1 - y) || '.png' AS tms,
'/' || z || '/' || y || '/' || (CAST(pow(2, z) AS BIGINT) - 1 - y) AS both FROM {TILES}""")
def sc_tile_url(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d)
    return t.select("event_id", M.tile_url("https://{s}.example.org/{z}/{x}/{y}.png", t.z, t.x, t.y, "tms").alias("tms"), M.tile_url("/{z}/{y}/{-y}", t.z, t.x, t.y).alias("both"))


@query(f"""WITH RECURSIVE c AS (
 SELECT event_id, x AS x0, y AS y0, x, y, CAST((pow(4, 9) - 1) / 3 AS BIGINT) AS d, CAST(256 AS BIGINT) AS s
 FROM (SELECT event_id, ((CAST(floor({X} * 512) AS BIGINT) % 512) + 512) % 512 AS x, greatest(0, least(511, CAST(floor({Y} * 512) AS BIGINT))) AS y FROM {WORLD})
 UNION ALL
 SELECT event_id, x0, y0,
  CASE WHEN y & s = 0 THEN (CASE WHEN x & s > 0 THEN s - 1 - y ELSE y END) ELSE x END,
  CASE WHEN y & s = 0 THEN (CASE WHEN x & s > 0 THEN s - 1 - x ELSE x END) ELSE y END,
  d + s * s * xor(CASE WHEN x & s > 0 THEN 3 ELSE 0 END, CASE WHEN y & s > 0 THEN 1 ELSE 0 END), s // 2 FROM c WHERE s >= 1)
SELECT event_id, d AS tile_id FROM c WHERE s = 0""")
def sc_hilbert(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    return p.select("event_id", M.hilbert_id(9, M.tile_x(p.lon, 9), M.tile_y(p.lat, 9)).alias("tile_id"))


@query(f"""SELECT event_id, {scaled_sql("v - floor((v + 180) / 360) * 360")} AS west_closed,
{scaled_sql("CASE WHEN v - floor((v + 180) / 360) * 360 = -180 THEN 180 ELSE v - floor((v + 180) / 360) * 360 END")} AS east_closed FROM (SELECT event_id, lon * 3 AS v FROM {WORLD})""")
def sc_wrap_lon(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world").select("event_id", (F.col("lon") * 3).alias("v"))
    return p.select("event_id", scaled(M.wrap_lon(p.v)).alias("west_closed"), scaled(M.wrap_lon(p.v, "east")).alias("east_closed"))


@query(f"SELECT event_id, {scaled_sql(hav('lon', 'lat', '11.5', '48.1'), 10)} AS decimetres FROM {WORLD}")
def sc_haversine(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    return p.select("event_id", scaled(G.haversine_m(p.lon, p.lat, F.lit(11.5), F.lit(48.1)), 10).alias("decimetres"))


CITY = sql("pts_city")


@query(f"""SELECT user_id, {scaled_sql("coalesce(sum(step), 0)", 10)} AS decimetres, count(*) AS positions FROM (
SELECT user_id, {hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS step FROM {CITY} WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, event_id)) GROUP BY user_id""")
def sc_path_len(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_city")
    lines = p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("time_ms", "event_id", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("line"))
    return lines.select("user_id", scaled(G.path_length_m(F.col("line")), 10).alias("decimetres"), F.size("line").cast("long").alias("positions"))


@query(f"""SELECT event_id, {scaled_sql("step", 10)} AS step, {scaled_sql("sum(step) OVER (PARTITION BY user_id ORDER BY time_ms, event_id)", 1)} AS metres FROM (
SELECT event_id, user_id, time_ms, coalesce({hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0) AS step FROM {CITY} WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, event_id))""")
def win_segments(spark: SparkSession, d: str) -> DataFrame:
    """Length of each segment of a line and the distance along it."""
    line = Window.partitionBy("user_id").orderBy("time_ms", "event_id")
    p = view(spark, d, "pts_city").withColumn("step", F.coalesce(G.haversine_m(F.lag("lon").over(line), F.lag("lat").over(line), F.col("lon"), F.col("lat")), F.lit(0.0)))
    return p.select("event_id", scaled(F.col("step"), 10).alias("step"), scaled(F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0)), 1).alias("metres"))


LAT2 = f"asin(sin(p) * cos(m / {R}) + cos(p) * sin(m / {R}) * cos(b))"


@query(f"""SELECT event_id, {scaled_sql("lon2 - floor((lon2 + 180) / 360) * 360")} AS lon, {scaled_sql("degrees(lat2)")} AS lat FROM (
SELECT event_id, lat2, degrees(radians(lon) + atan2(sin(b) * sin(m / {R}) * cos(p), cos(m / {R}) - sin(p) * sin(lat2))) AS lon2 FROM (
SELECT *, {LAT2} AS lat2 FROM (SELECT event_id, lon, radians(lat) AS p, (event_id % 628) / 100e0 AS b, 1000e0 * (event_id % 5000) AS m FROM {WORLD})))""")
def sc_destination(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    lon, lat = G.destination(p.lon, p.lat, (p.event_id % 628) / F.lit(100.0), 1000.0 * (p.event_id % 5000))
    return p.select("event_id", scaled(lon).alias("lon"), scaled(lat).alias("lat"))


@query(f"""SELECT event_id, CAST(65 AS INTEGER) AS positions, {scaled_sql(f"2 * pi() * {R} * sin(m / {R})", 1)} AS circumference, {scaled_sql(f"2 * pi() * {R} * {R} * (1 - cos(m / {R})) / 1e6", 1)} AS km2,
{scaled_sql(f"degrees(asin(sin(p) * cos(m / {R}) + cos(p) * sin(m / {R})))")} AS north FROM (SELECT event_id, radians(lat) AS p, 1000e0 * (event_id % 500 + 1) AS m FROM {CITY})""")
def sc_circle(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_city").withColumn("m", 1000.0 * (F.col("event_id") % 500 + 1))
    around, area = G.circle_measure(p.m)
    ring = G.circle(p.lon, p.lat, p.m)
    p = p.select("event_id", "m", ring.alias("ring"))
    return p.select("event_id", F.size("ring").alias("positions"), scaled(around, 1).alias("circumference"), scaled(area / 1e6, 1).alias("km2"), scaled(F.array_max(F.transform("ring", lambda q: q["y"]))).alias("north"))


ZONES = sql("zones")


@query(f"""SELECT zone_id, {scaled_sql(f"least(a, 4 * pi() * {R} * {R} - a) / 1e6", 1)} AS km2 FROM (
SELECT zone_id, abs(radians(e - w) * (2 + 2 * sin(radians(s))) + radians(w - e) * (2 + 2 * sin(radians(n)))) * {R} * {R} / 2 AS a FROM {ZONES})""")
def sc_ring_area(spark: SparkSession, d: str) -> DataFrame:
    z = view(spark, d, "zones")
    return z.select("zone_id", scaled(G.ring_area_m2(geo.rectangle(z.w, z.s, z.e, z.n)) / 1e6, 1).alias("km2"))


@query(f"""WITH p AS (SELECT event_id, lon, lat, {hav('lon', 'lat', '11.5', '48.1')} AS m FROM {WORLD})
SELECT event_id, CAST(CASE WHEN m / {R} < 1e-6 OR abs(m / {R} - pi()) < 1e-6 THEN 2 ELSE greatest(1, least(64, ceil(m / 50000))) + 1 END AS INTEGER) AS positions FROM p""")
def sc_great_circle(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    return p.select("event_id", F.size(G.great_circle(p.lon, p.lat, F.lit(11.5), F.lit(48.1))).alias("positions"))


@query(f"""SELECT event_id, CASE WHEN m >= 1000 THEN printf('%.2f', m / 1000) || ' km' ELSE CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR) || ' m' END AS metres,
CASE WHEN m * 50 >= 1e6 THEN printf('%.2f', m * 50 / 1e6) || ' km²' ELSE CAST(CAST(floor(m * 50 + 0.5) AS BIGINT) AS VARCHAR) || ' m²' END AS area,
CASE WHEN event_id >= 10000 THEN CAST(CAST(floor(event_id / 1000e0 + 0.5) AS BIGINT) AS VARCHAR) || 'k'
     WHEN event_id >= 1000 THEN CAST(floor(event_id / 100e0 + 0.5) / 10 AS VARCHAR).regexp_replace('[.]0$', '') || 'k' ELSE CAST(event_id AS VARCHAR) END AS many
FROM (SELECT event_id, (event_id % 40000) / 16e0 AS m FROM {WORLD})""")
def sc_label_units(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world").selectExpr("event_id", "(event_id % 40000) / 16e0 AS m")
    return p.select("event_id", G.label_metres(p.m).alias("metres"), G.label_area(p.m * 50).alias("area"), G.abbreviated(p.event_id).alias("many"))


def zone_features(spark: SparkSession, d: str) -> DataFrame:
    """zone_id, name, region, w, s, e, n and parts: the rectangle and, for every second zone, a hole in its middle third."""
    z = view(spark, d, "zones")
    third_x, third_y = (z.e - z.w) / 3, (z.n - z.s) / 3
    outer = geo.rectangle(z.w, z.s, z.e, z.n)
    hole = geo.rectangle(z.w + third_x, z.s + third_y, z.e - third_x, z.n - third_y, inner=True)
    return z.withColumn("parts", F.when(z.zone_id % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer)))


@query(f"""SELECT zone_id, CAST(part AS INTEGER) AS part, CAST(5 AS INTEGER) AS positions, {scaled_sql("CASE WHEN part = 0 THEN (e - w) * (n - s) ELSE -(e - w) * (n - s) / 9 END")} AS area
FROM {ZONES}, (SELECT unnest([0, 1]) AS part) WHERE part = 0 OR zone_id % 2 = 0""")
def sc_geom_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of features, one row each; sc_winding's signed area tells holes."""
    z = zone_features(spark, d).select("zone_id", F.posexplode("parts").alias("part", "ring"))
    return z.select("zone_id", "part", F.size("ring").alias("positions"), scaled(geo.signed_area(F.col("ring"))).alias("area"))


@query(f"SELECT zone_id, {scaled_sql('w')} AS w, {scaled_sql('s')} AS s, {scaled_sql('e')} AS e, {scaled_sql('n')} AS n, CAST(CASE WHEN zone_id % 2 = 0 THEN 10 ELSE 5 END AS INTEGER) AS positions FROM {ZONES}")
def sc_bbox(spark: SparkSession, d: str) -> DataFrame:
    z = zone_features(spark, d).withColumn("box", geo.bbox(F.col("parts")))
    return z.select("zone_id", *(scaled(F.col(f"box.{k}")).alias(k) for k in "wsen"), geo.coord_count(F.col("parts")).alias("positions"))


@query(f"""SELECT zone_id, CAST(part AS INTEGER) AS part, {scaled_sql("CASE WHEN part = 0 THEN (e - w) * (n - s) ELSE -(e - w) * (n - s) / 9 END")} AS area FROM {ZONES}, (SELECT unnest([0, 1]) AS part) WHERE part = 0 OR zone_id % 2 = 0""")
def sc_winding(spark: SparkSession, d: str) -> DataFrame:
    """Rings turned around by zone, then wound as outer and inner rings again."""
    z = zone_features(spark, d).select("zone_id", F.posexplode("parts").alias("part", "ring"))
    z = z.withColumn("ring", F.when(F.col("zone_id") % 3 == 0, F.reverse("ring")).otherwise(F.col("ring")))
    return z.select("zone_id", "part", scaled(geo.signed_area(geo.normalize_winding(F.col("ring"), F.col("part") > 0))).alias("area"))


@query(f"SELECT zone_id, {scaled_sql('(w + e) / 2')} AS x, {scaled_sql('(s + n) / 2')} AS y FROM {ZONES}")
def sc_anchor(spark: SparkSession, d: str) -> DataFrame:
    z = zone_features(spark, d).withColumn("at", geo.polygon_anchor(F.col("parts")))
    return z.select("zone_id", scaled(F.col("at.x")).alias("x"), scaled(F.col("at.y")).alias("y"))


@query(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')), 1, 160) AS label,
lower(substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')), 1, 160)) AS folded FROM documents""")
def sc_clean_text(spark: SparkSession, d: str) -> DataFrame:
    from .inputs import table

    return table(spark, d, "documents").select("doc_id", geo.clean_label(F.col("text")).alias("label")).withColumn("folded", F.lower("label"))


@query(f"""SELECT user_id, {scaled_sql("least(14, least(log2(800 / (512 * greatest(x1 - x0, 1e-9))), log2(600 / (512 * greatest(y1 - y0, 1e-9)))))")} AS zoom,
{scaled_sql("(x0 + x1) / 2 * 360 - 180")} AS lon, {scaled_sql("degrees(atan(sinh(pi() * (1 - (y0 + y1)))))")} AS lat
FROM (SELECT user_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT user_id, {X} AS x, {Y} AS y FROM {CITY}) GROUP BY user_id)""")
def sc_fit_zoom(spark: SparkSession, d: str) -> DataFrame:
    """The camera that shows all positions of a user on 800 by 600 pixels."""
    p = view(spark, d, "pts_city").select("user_id", M.world_x(F.col("lon")).alias("x"), M.world_y(F.col("lat")).alias("y"))
    b = p.groupBy("user_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    fit = lambda pixels, a, b: F.log2(pixels / (512 * F.greatest(F.col(b) - F.col(a), F.lit(1e-9))))
    zoom = F.least(F.lit(14.0), fit(F.lit(800.0), "x0", "x1"), fit(F.lit(600.0), "y0", "y1"))
    return b.select("user_id", scaled(zoom).alias("zoom"), scaled(M.lon_of_world((b.x0 + b.x1) / 2, False)).alias("lon"), scaled(M.lat_of_world((b.y0 + b.y1) / 2)).alias("lat"))


VIEW_TILES = f"""SELECT event_id, zoom, ((x % CAST(pow(2, zoom) AS BIGINT)) + CAST(pow(2, zoom) AS BIGINT)) % CAST(pow(2, zoom) AS BIGINT) AS x, y FROM (
 SELECT event_id, zoom, unnest(range(CAST(floor(wx * pow(2, zoom) - 0.78125) AS BIGINT) - 1, CAST(floor(wx * pow(2, zoom) + 0.78125) AS BIGINT) + 2)) AS x, y FROM (
 SELECT event_id, zoom, wx, unnest(range(greatest(0, CAST(floor(wy * pow(2, zoom) - 0.5859375) AS BIGINT) - 1), least(CAST(pow(2, zoom) AS BIGINT) - 1, CAST(floor(wy * pow(2, zoom) + 0.5859375) AS BIGINT) + 1) + 1)) AS y
 FROM (SELECT event_id, zoom, {X} AS wx, {Y} AS wy FROM {sql("views")} WHERE zoom >= 3)))"""


def view_tiles(views: DataFrame, width: int = 800, height: int = 600, tile: int = 512, buffer: int = 1) -> DataFrame:
    """views with lon, lat, zoom: a row for each tile x, y that the view shows, `buffer` tiles more on each side."""
    n = F.pow(F.lit(2.0), F.col("zoom"))
    wx, wy = M.world_x(F.col("lon")) * n, M.world_y(F.col("lat")) * n
    low = lambda c, half: F.floor(c - half) - buffer
    high = lambda c, half: F.floor(c + half) + buffer
    half_x, half_y, last = width / 2 / tile, height / 2 / tile, (n - 1).cast("long")
    rows = views.withColumn("x", F.explode(F.sequence(low(wx, half_x), high(wx, half_x))))
    rows = rows.withColumn("y", F.explode(F.filter(F.sequence(low(wy, half_y), high(wy, half_y)), lambda y: (y >= 0) & (y <= last))))
    return rows.withColumn("x", F.pmod(F.col("x"), n.cast("long")))


@query(VIEW_TILES)
def sc_view_tiles(spark: SparkSession, d: str) -> DataFrame:
    return view_tiles(view(spark, d, "views").filter("zoom >= 3")).select("event_id", "zoom", "x", "y")


@query(f"SELECT DISTINCT zoom, x, y FROM ({VIEW_TILES})")
def set_distinct_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that any view asks for."""
    return view_tiles(view(spark, d, "views").filter("zoom >= 3")).select("zoom", "x", "y").distinct()


