"""Style layers over the city: what they paint, groups that they can't tell apart, and hits in paint order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import styled
from .inputs import scaled, scaled_sql, sql, view
from .registry import query
from .scenes import shared
from .spatial import LINES, city_lines

CITY = sql("pts_city")
#: Pixels a degree.
PX = 100_000
K = ["get", "k"]
LAYERS = [
    {"id": "ground", "type": "background"},
    {"id": "areas", "type": "fill", "source-layer": "area", "paint": {"fill-opacity": ["case", ["<", K, 10], 0, 0.6]}},
    {"id": "heat", "type": "heatmap", "source-layer": "dot"},
    {"id": "paths", "type": "line", "source-layer": "path", "filter": ["!=", "k", 3], "paint": {"line-width": ["interpolate", ["linear"], K, 0, 46.6, 4, 126.6], "line-color": ["match", K, [0, 1], "#ff0000", "#0000ff"]}},
    {"id": "gone", "type": "line", "source-layer": "path", "layout": {"visibility": "none"}},
    {"id": "near", "type": "circle", "source-layer": "dot", "minzoom": 15},
    {"id": "dots", "type": "circle", "source-layer": "dot", "paint": {"circle-radius": ["step", K, 15.5, 2, 25.5, 4, 35.5], "circle-opacity": ["case", ["==", ["get", "type"], "view"], 0, 1], "circle-stroke-width": ["case", ["==", ["%", K, 2], 1], 2, 0]}},
]
#: Corners of areas lie between the steps of positions.
AREA = {"w": "11.403105e0 + (user_id % 20) * 0.02e0", "s": "48.001105e0 + (user_id % 13) * 0.02e0", "e": "11.404695e0 + (user_id % 20) * 0.02e0", "n": "48.005695e0 + (user_id % 13) * 0.02e0"}
AREAS_SQL = f"(SELECT DISTINCT user_id, {', '.join(f'{v} AS {k}' for k, v in AREA.items())} FROM events)"
RADIUS = "CASE WHEN event_id % 6 < 2 THEN 15.5e0 WHEN event_id % 6 < 4 THEN 25.5e0 ELSE 35.5e0 END"
STROKE = "CASE WHEN event_id % 2 = 1 THEN 2e0 ELSE 0e0 END"
OPACITY = "CASE WHEN event_type = 'view' THEN 0e0 ELSE 1e0 END"


def features(spark: SparkSession, d: str) -> DataFrame:
    """A dot for each event, a path for each user's step to the next event, an area for each user, in pixels."""
    p = view(spark, d, "pts_city")
    at = lambda x, y: F.struct((F.expr(x) * PX).alias("x"), (F.expr(y) * PX).alias("y"))
    props = lambda k, kind: F.to_variant_object(F.struct(F.expr(k).alias("k"), F.expr(kind).alias("type")))
    row = lambda rows, name, seq, geometry, parts, k, kind: rows.select(F.concat(F.lit(f"{name}-"), seq).alias("feature_id"), F.col(seq).cast("long").alias("feature_seq"), F.lit(name).alias("source_layer"), F.lit(geometry).alias("geometry_type"), parts.alias("parts"), props(k, kind).alias("props"))
    dots = row(p, "dot", "event_id", "Point", F.array(F.array(at("lon", "lat"))), "event_id % 6", "event_type")
    paths = row(city_lines(spark, d), "path", "line_id", "LineString", F.array(F.array(at("ax", "ay"), at("bx", "by"))), "line_id % 5", "'path'")
    corners = F.array(F.array(*(at(AREA[x], AREA[y]) for x, y in ("ws", "es", "en", "wn", "ws"))))
    areas = row(p.select("user_id").distinct(), "area", "user_id", "Polygon", corners, "user_id % 20", "'area'")
    return dots.unionByName(paths).unionByName(areas)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pts_city").select(F.col("event_id").alias("point_id"), (F.col("lon") * PX).alias("x"), (F.col("lat") * PX).alias("y"))


WIDTH = "46.6e0 + (line_id % 5) / 4e0 * 80"
PAINTED = f"""(SELECT 'dot-' || event_id AS feature_id, 'dots' AS layer, '#000000' AS color, {OPACITY} AS opacity, CAST(NULL AS DOUBLE) AS width, {RADIUS} AS radius, {STROKE} AS stroke FROM {CITY}
UNION ALL SELECT 'dot-' || event_id, 'heat', '#000000', 1e0, NULL, 30e0, NULL FROM {CITY}
UNION ALL SELECT 'path-' || line_id, 'paths', CASE WHEN line_id % 5 < 2 THEN '#ff0000' ELSE '#0000ff' END, 1e0, {WIDTH}, NULL, NULL FROM {LINES} WHERE line_id % 5 <> 3
UNION ALL SELECT 'area-' || user_id, 'areas', '#000000', CASE WHEN user_id % 20 < 10 THEN 0e0 ELSE 0.6e0 END, NULL, NULL, NULL FROM {AREAS_SQL})"""


@query(f"SELECT feature_id, layer, color, {', '.join(f'{scaled_sql(c)} AS {c}' for c in ('opacity', 'width', 'radius', 'stroke'))} FROM {PAINTED}")
def join_style_paint(spark: SparkSession, d: str) -> DataFrame:
    """What each layer paints of each feature, with defaults and bounds."""
    paint = styled.resolve_style(features(spark, d), LAYERS, 12)
    return paint.select("feature_id", "layer", "color", *(scaled(F.col(c)).alias(c) for c in ("opacity", "width", "radius", "stroke")))


@query(f"""SELECT 'dots' AS layer, count(*) AS n, {scaled_sql('radius')} AS radius, {scaled_sql('opacity')} AS opacity FROM (SELECT event_id % 6 AS k, event_type, {RADIUS} AS radius, {OPACITY} AS opacity FROM {CITY}) GROUP BY k, event_type, radius, opacity
UNION ALL SELECT 'heat', count(*), 30000, 1000 FROM {CITY} HAVING count(*) > 0
UNION ALL SELECT 'paths', count(*), NULL, 1000 FROM {LINES} WHERE line_id % 5 <> 3 GROUP BY line_id % 5
UNION ALL SELECT 'areas', count(*), NULL, CASE WHEN user_id % 20 < 10 THEN 0 ELSE 600 END FROM {AREAS_SQL} GROUP BY user_id % 20""")
def agg_style_reads(spark: SparkSession, d: str) -> DataFrame:
    """Features that agree in what a layer reads, as groups, each evaluated once."""
    members = styled.style_members(features(spark, d), LAYERS, 12)
    return styled.style_groups(members, LAYERS, 12).select("layer", "n", scaled(F.col("radius")).alias("radius"), scaled(F.col("opacity")).alias("opacity"))


def hits_sql(areas: str, dots: str) -> str:
    """Hits of the layers areas (place 1), paths (3) and dots (6); areas and dots have conditions of their own."""
    reach = "(radius + stroke / 2 + 3) / 100000"
    return f"""(SELECT p.event_id AS point_id, 'dots' AS layer, 6 AS place, 'dot-' || f.event_id AS feature_id, f.event_id AS feature_seq FROM {CITY} p
 JOIN (SELECT *, {RADIUS} AS radius, {STROKE} AS stroke FROM {CITY} WHERE (event_type <> 'view' OR event_id % 2 = 1) AND {dots}) f
 ON p.lon BETWEEN f.lon - 0.0005 AND f.lon + 0.0005 AND p.lat BETWEEN f.lat - 0.0005 AND f.lat + 0.0005 WHERE sqrt(pow(p.lon - f.lon, 2) + pow(p.lat - f.lat, 2)) <= {reach}
UNION SELECT p.event_id, 'areas', 1, 'area-' || a.user_id, a.user_id FROM {CITY} p JOIN (SELECT * FROM {AREAS_SQL} WHERE user_id % 20 >= 10 AND {areas}) a ON p.lon BETWEEN a.w AND a.e AND p.lat BETWEEN a.s AND a.n)"""


PATH_HITS = f"""(SELECT DISTINCT point_id, 'paths' AS layer, 3 AS place, 'path-' || line_id AS feature_id, line_id AS feature_seq FROM (
SELECT point_id, line_id, {WIDTH} AS width, sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2)) AS dist FROM (
SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM (
SELECT p.event_id AS point_id, p.lon AS x, p.lat AS y, line_id, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM {CITY} p, {LINES} l WHERE line_id % 5 NOT IN (2, 3)
AND p.lon BETWEEN least(ax, bx) - 0.0021 AND greatest(ax, bx) + 0.0021 AND p.lat BETWEEN least(ay, by_) - 0.0021 AND greatest(ay, by_) + 0.0021))) WHERE dist <= (width / 2 + 3) / 100000)"""


@query(f"""SELECT point_id, layer, feature_id, row_number() OVER (PARTITION BY point_id ORDER BY place DESC, feature_seq DESC) AS rank FROM (
SELECT * FROM {hits_sql('user_id % 20 <> 2', 'event_id % 6 <> 2')} UNION ALL SELECT * FROM {PATH_HITS})""")
def join_layer_hits(spark: SparkSession, d: str) -> DataFrame:
    """What is painted under each point, the topmost first, without the features of k 2."""
    shared(spark, "hits")
    return styled.top_layer_hits(asked(spark, d), features(spark, d), LAYERS, 12, where=["!=", K, 2]).select("point_id", "layer", "feature_id", "rank")


@query(f"SELECT point_id, layer, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY place DESC, feature_seq DESC) AS k FROM {hits_sql('true', 'true')}) WHERE k = 1")
def top_layer_hits(spark: SparkSession, d: str) -> DataFrame:
    """The topmost of areas and dots under each point."""
    shared(spark, "hits")
    return styled.top_layer_hits(asked(spark, d), features(spark, d), LAYERS, 12, 1, only=["areas", "dots", "heat", "gone"]).select("point_id", "layer", "feature_id")
