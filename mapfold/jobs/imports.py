"""Importing elements, arcs and features, and validating them, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inspection as I
from ..operators import validate as V
from ..operators.spatial import with_next
from ..sources import geojson as J
from ..sources import osm as O
from .inputs import WAYS_SQL, scaled, scaled_sql, sql, table, view, ways
from .registry import query
from .scenes import shared

NODES, WORLD = sql("osm_nodes"), sql("pts_world")


def some_nodes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "osm_nodes").filter("node_id % 50 <> 0")


@query(f"""SELECT way_id, count(*) AS n, {scaled_sql('sum(lon * (pos + 1))', 100)} AS x, {scaled_sql('sum(lat * (pos + 1))', 100)} AS y FROM {WAYS_SQL} w LEFT JOIN {NODES} n ON n.node_id = w.node_id AND n.node_id % 50 <> 0
GROUP BY way_id HAVING count(*) = count(lon) AND count(*) >= 2""")
def join_way_nodes(spark: SparkSession, d: str) -> DataFrame:
    lines = O.way_lines(ways(spark, d), some_nodes(spark, d))
    weighed = lambda c: F.aggregate(F.transform("line", lambda p, i: p[c] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return lines.select("way_id", F.size("line").cast("long").alias("n"), scaled(weighed("x"), 100).alias("x"), scaled(weighed("y"), 100).alias("y"))


@query(f"SELECT n.node_id FROM {NODES} n WHERE tag IS NOT NULL OR node_id NOT IN (SELECT node_id FROM {WAYS_SQL})")
def join_helper_nodes(spark: SparkSession, d: str) -> DataFrame:
    return O.helper_nodes(view(spark, d, "osm_nodes"), ways(spark, d)).select("node_id")


MEMBERS_SQL = "(SELECT o_custkey AS relation_id, CAST(o_orderkey AS BIGINT) AS pos, CASE WHEN o_orderkey % 11 = 0 THEN 'node' ELSE 'way' END AS type, o_orderkey AS ref, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'inner' WHEN 2 THEN 'label' ELSE 'outer' END AS role FROM orders)"
GOOD_WAYS = f"(SELECT way_id FROM {WAYS_SQL} w LEFT JOIN {NODES} n ON n.node_id = w.node_id AND n.node_id % 50 <> 0 GROUP BY way_id HAVING count(*) = count(lon) AND count(*) >= 2)"


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_custkey AS relation_id", "o_orderkey AS pos", "CASE WHEN o_orderkey % 11 = 0 THEN 'node' ELSE 'way' END AS type", "o_orderkey AS ref", "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'inner' WHEN 2 THEN 'label' ELSE 'outer' END AS role")


RELATION_SQL = f"""(SELECT relation_id, pos, ref, r AS role, CASE WHEN type <> 'way' THEN 'not-a-way' WHEN r NOT IN ('outer', 'inner') THEN 'role' WHEN g.way_id IS NULL THEN 'missing-way' END AS code
FROM (SELECT *, CASE WHEN role = '' THEN 'outer' ELSE role END AS r FROM {MEMBERS_SQL}) m LEFT JOIN {GOOD_WAYS} g ON g.way_id = m.ref WHERE type = 'way' OR r IN ('outer', 'inner'))"""


@query(f"SELECT relation_id, pos, role, code FROM {RELATION_SQL}")
def join_relation_ways(spark: SparkSession, d: str) -> DataFrame:
    lines = O.way_lines(ways(spark, d), some_nodes(spark, d))
    return O.relation_lines(members(spark, d), lines).select("relation_id", "pos", "role", "code")


@query(f"SELECT way_id FROM {GOOD_WAYS} WHERE way_id % 4 = 0 OR way_id NOT IN (SELECT ref FROM {RELATION_SQL} WHERE relation_id NOT IN (SELECT relation_id FROM {RELATION_SQL} WHERE code IS NOT NULL))")
def join_member_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways without the untagged members of relations that have no error; every fourth way counts as tagged."""
    lines = O.way_lines(ways(spark, d), some_nodes(spark, d))
    rows = O.relation_lines(members(spark, d), lines).select("relation_id", "ref", "code")
    failed = rows.filter("code is not null").select("relation_id").distinct()
    swallowed = rows.join(failed, "relation_id", "left_anti").select(F.col("ref").alias("way_id")).distinct()
    return lines.select("way_id").join(swallowed.filter("way_id % 4 <> 0"), "way_id", "left_anti")


@query(f"""WITH w AS (SELECT way_id, count(*) AS n, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS z FROM (SELECT way_id, pos, node_id % 40 + 1 AS node_id FROM {WAYS_SQL}) GROUP BY way_id HAVING count(*) >= 2)
SELECT way_id, CASE WHEN n >= 4 AND a = z AND (o_orderpriority LIKE '1%' OR (o_orderpriority LIKE '2%' AND o_orderstatus <> 'F')) THEN 'Polygon' ELSE 'LineString' END AS geom_type FROM w JOIN orders ON o_orderkey = way_id""")
def join_osm_class(spark: SparkSession, d: str) -> DataFrame:
    lines = O.way_lines(ways(spark, d).withColumn("node_id", F.col("node_id") % 40 + 1), view(spark, d, "osm_nodes"))
    tags = table(spark, d, "orders").selectExpr("o_orderkey AS way_id", "CASE WHEN o_orderpriority LIKE '1%' THEN map('building', 'yes') WHEN o_orderpriority LIKE '2%' THEN map('landuse', 'farm', 'area', CASE WHEN o_orderstatus = 'F' THEN 'no' END) ELSE map('highway', 'path') END AS tags")
    return O.way_class(lines.join(tags, "way_id")).select("way_id", "geom_type")


ARCS_SQL = "(SELECT way_id AS arc_id, pos, node_id % 21 - 10 AS x, node_id % 17 - 8 AS y FROM " + WAYS_SQL + ")"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    return ways(spark, d).selectExpr("way_id AS arc_id", "pos", "node_id % 21 - 10 AS x", "node_id % 17 - 8 AS y")


@query(f"SELECT arc_id, pos, {scaled_sql('sum(x) OVER w * 0.1 + 10')} AS x, {scaled_sql('sum(y) OVER w * 0.5 + 40')} AS y FROM {ARCS_SQL} WINDOW w AS (PARTITION BY arc_id ORDER BY pos)")
def win_topo_delta(spark: SparkSession, d: str) -> DataFrame:
    return O.delta_arcs(deltas(spark, d), (0.1, 0.5), (10.0, 40.0)).select("arc_id", "pos", scaled(F.col("x")).alias("x"), scaled(F.col("y")).alias("y"))


@query(f"SELECT arc_id AS line_id, 2 * count(*) - 1 AS n, {scaled_sql('2 * sum(px) - arg_max(px, pos)')} AS x FROM (SELECT arc_id, pos, sum(x) OVER (PARTITION BY arc_id ORDER BY pos) AS px FROM {ARCS_SQL}) GROUP BY arc_id")
def agg_topo_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Each arc there and back again: the vertex where it turns is there once."""
    arcs = O.delta_arcs(deltas(spark, d), (1.0, 1.0))
    refs = arcs.select(F.col("arc_id").alias("line_id")).distinct().withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("arc", F.when(F.col("seq") == 0, F.col("line_id")).otherwise(-F.col("line_id") - 1))
    lines = O.stitch_arcs(refs, arcs)
    return lines.select("line_id", F.size("line").cast("long").alias("n"), scaled(F.aggregate("line", F.lit(0.0), lambda a, p: a + p["x"])).alias("x"))


@query(f"""WITH e AS (SELECT user_id, event_id, xor(event_id, 5461) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM {sql('pts_city')}),
l AS (SELECT user_id, min(seq) AS ring, arg_min(r, seq) AS r0, arg_min(event_id % 3 = 0, seq) AS back FROM e GROUP BY user_id),
p AS (SELECT e.user_id AS relation_id, ring, event_id, n, CASE WHEN back THEN (r0 + 1 - r + n) % n ELSE (r - r0 + n) % n END AS place FROM e JOIN l ON e.user_id = l.user_id WHERE n >= 3)
SELECT relation_id, ring, place, event_id AS x, NULL AS code FROM p UNION ALL SELECT relation_id, ring, n, event_id, NULL FROM p WHERE place = 0
UNION ALL SELECT DISTINCT user_id, NULL, NULL, NULL, 'open-outer' FROM e WHERE n < 3""")
def agg_ring_walks(spark: SparkSession, d: str) -> DataFrame:
    """One ring through all events of a user, from ways between two events each, in any order and a third of them turned around."""
    shared(spark, "rings")
    p = view(spark, d, "pts_city").select("user_id", "event_id")
    steps = with_next(p, "user_id", "event_id", [], 4096).filter("next is not null").select("user_id", "event_id", F.col("next.event_id").alias("to"))
    back = p.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.min("event_id").alias("to"))
    at = lambda c: F.struct(F.col(c).cast("double").alias("x"), F.lit(0.0).alias("y"))
    line = F.when(F.col("event_id") % 3 == 0, F.array(at("to"), at("event_id"))).otherwise(F.array(at("event_id"), at("to")))
    ways_ = steps.unionByName(back).select(F.col("user_id").alias("relation_id"), F.col("event_id").bitwiseXOR(F.lit(5461)).alias("pos"), F.lit("outer").alias("role"), line.alias("line"), F.lit(None).cast("string").alias("code"))
    rings, errors = O.relation_positions(ways_)
    found = rings.select("relation_id", "ring", "place", F.col("x").cast("long").alias("x"), F.lit(None).cast("string").alias("code"))
    return found.unionByName(errors, allowMissingColumns=True)


@query()
def agg_rings(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the two ways between stops a and b of an order, out and back: one ring each."""
    nodes = view(spark, d, "osm_nodes")
    lines = ways(spark, d).filter("pos < 4").join(nodes, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("s")).filter("size(s) = 4")
    line = F.transform("s", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    halves = lines.select(F.col("way_id").alias("relation_id"), F.posexplode(F.array(F.slice(line, 1, 3), F.array(F.element_at(line, 1), F.element_at(line, 4), F.element_at(line, 3)))).alias("pos", "line"))
    rings = O.relation_rings(halves.withColumn("role", F.lit("outer")).withColumn("code", F.lit(None).cast("string")))
    return rings.select("relation_id", "role", "ring_no", F.size("ring").alias("n"), "code")


@query(f"""SELECT '{{"type":"Feature","properties":{{"kind":"' || event_type || '","n":' || user_id || '}},"geometry":{{"type":"Point","coordinates":[' || event_id || ',' || (event_id % 90) || ']}}' || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN ',"id":' || event_id ELSE ',"id":"e' || event_id || '"' END || '}}' AS feature FROM events""")
def io_geojson_out(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    geometry = F.concat(F.lit('{"type":"Point","coordinates":['), "event_id", F.lit(","), F.col("event_id") % 90, F.lit("]}"))
    props = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n")))
    fid = F.when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 2, F.concat(F.lit("e"), "event_id"))
    return e.select(J.feature_json(fid, F.when(F.col("event_id") % 3 == 1, "num").otherwise("str"), geometry, props).alias("feature"))


def event_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as GeoJSON records of all kinds, good and bad."""
    point = "concat('{\"type\":\"Point\",\"coordinates\":[', event_id % 180, ',', event_id % 90, ']}')"
    text = f"""CASE event_id % 8
      WHEN 0 THEN {point}
      WHEN 1 THEN concat('{{"type":"Feature","id":', event_id, ',"properties":null,"geometry":', {point}, '}}')
      WHEN 2 THEN concat('{{"type":"Feature","id":"', event_id, '","properties":{{"a":1}},"geometry":null}}')
      WHEN 3 THEN concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":', {point}, '}},{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[0,0],[1,', event_id % 9, ']]}}}}]}}')
      WHEN 4 THEN concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":', {point}, '}},{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[0,0]]}}}}]}}')
      WHEN 5 THEN '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}}}'
      WHEN 6 THEN '{{"type":"Feature","properties":{{}}}}'
      ELSE '{{"type":' END"""
    return table(spark, d, "events").selectExpr("'events' AS source", "event_id AS record", f"try_parse_json({text}) AS v")


@query("""SELECT event_id AS record, 0 AS place, CASE event_id % 8 WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CAST(event_id AS VARCHAR) END AS fid, CASE event_id % 8 WHEN 1 THEN 'num' WHEN 2 THEN 'str' END AS fid_type, CASE WHEN event_id % 8 <> 2 THEN 'Point' END AS geom_type,
CASE event_id % 8 WHEN 1 THEN 'null' WHEN 2 THEN '{"a":1}' ELSE '{}' END AS props FROM events WHERE event_id % 8 < 4
UNION ALL SELECT event_id, 1, NULL, NULL, 'LineString', '{}' FROM events WHERE event_id % 8 = 3""")
def io_geojson(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = J.to_rows(event_records(spark, d))
    return rows.select(F.expr("feature_seq div 4294967296").alias("record"), F.expr("int(feature_seq % 4294967296)").alias("place"), "fid", "fid_type", "geom_type", F.to_json("props").alias("props"))


@query("SELECT event_id AS record, CASE event_id % 8 WHEN 4 THEN 'line-length' WHEN 5 THEN 'ring-open' WHEN 6 THEN 'geometry' ELSE 'json' END AS code FROM events WHERE event_id % 8 >= 4")
def udf_on_error(spark: SparkSession, d: str) -> DataFrame:
    """Records that are refused, whole."""
    return J.to_rows(event_records(spark, d))[1].select("record", "code")


BAD = f"(SELECT event_id, lon * 1.1 AS lon, lat * 1.05 AS lat FROM {WORLD})"


@query(f"""SELECT count(*) AS feature_count, sum(CASE WHEN event_id % 5 = 0 THEN 3 ELSE 1 END) AS coordinate_count, count(*) FILTER (WHERE abs(lon) > 180 OR abs(lat) > 85.05112878 OR (event_id % 5 = 0 AND (abs(lon) > 180 OR abs(lat) > 85.05112878))) AS warnings,
count(*) FILTER (WHERE event_id % 35 = 0) AS errors FROM {BAD}""")
def val_inspect_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(inspected(spark, d))


def inspected(spark: SparkSession, d: str) -> DataFrame:
    """Points, and lines of three positions of which every seventh has one only."""
    p = view(spark, d, "pts_world").selectExpr("event_id AS feature_seq", "lon * 1.1e0 AS x", "lat * 1.05e0 AS y")
    at = F.struct("x", "y")
    part = F.when(F.col("feature_seq") % 35 == 0, F.array(at)).when(F.col("feature_seq") % 5 == 0, F.array(at, at, at)).otherwise(F.array(at))
    kind = F.when(F.col("feature_seq") % 5 == 0, "LineString").otherwise("Point")
    # a broken line still counts three coordinates in the file
    return p.select("feature_seq", kind.alias("geom_type"), F.array(part).alias("parts"), F.when(F.col("feature_seq") % 5 == 0, 3).otherwise(1).alias("coord_count"))


@query(f"""SELECT event_id AS feature_seq, 'error' AS severity, 'line-length' AS code FROM {BAD} WHERE event_id % 35 = 0
UNION ALL SELECT event_id, 'warning', 'mercator-range' FROM {BAD} WHERE abs(lon) > 180 OR abs(lat) > 85.05112878""")
def val_inspect(spark: SparkSession, d: str) -> DataFrame:
    return V.issues(inspected(spark, d)).select("feature_seq", "severity", "code")


#: forms of features, by event_id % 9, and the code and path of what is wrong with each
FORMS = {
    0: ('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}', None, None),
    1: ('{"type":"Feature","id":"far","geometry":{"type":"Point","coordinates":[200,2]}}', "mercator-range", ".geometry.coordinates"),
    2: ('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2]]}}', "line-length", ".geometry"),
    3: ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}', "ring-open", ".geometry.coordinates[0]"),
    4: ('{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"LineString","coordinates":[[0,0],["x",1]]}]}}', "coordinate", ".geometry.geometries[1].coordinates[1]"),
    5: ('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[]]}}', "polygon", ".geometry"),
    6: ('{"type":"Feature","geometry":{"type":"Circle","coordinates":[1,2]}}', "geometry-type", ".geometry"),
    7: ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,2],[2,0],[0,2],[0,0]]]}}', "self-intersection", ".geometry.coordinates[0]"),
    8: ('{"type":"Thing"}', "feature", ""),
}


def formed(spark: SparkSession, d: str) -> DataFrame:
    """A feature of one of the forms for each event."""
    text = F.get(F.array(*(F.lit(FORMS[k][0]) for k in range(9))), (F.col("event_id") % 9).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("feature_seq"), F.parse_json(text).alias("v"))


FORMED = ", ".join(f"({k}, '{code}', '{path}')" for k, (_, code, path) in FORMS.items() if code)


@query(f"SELECT event_id AS feature_seq, CASE WHEN k = 1 THEN 'far' END AS fid, CASE WHEN k = 1 THEN 'warning' ELSE 'error' END AS severity, code, '$.features[' || event_id || ']' || path AS path FROM events JOIN (VALUES {FORMED}) AS f(k, code, path) ON event_id % 9 = k")
def val_inspect_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of features of all forms, with its path."""
    shared(spark, "inspection")
    return I.inspect(formed(spark, d)).issues.select("feature_seq", "fid", "severity", "code", "path")


@query("""SELECT false AS valid, count(*) AS feature_count, sum([1, 1, 1, 4, 3, 0, 0, 5, 0][event_id % 9 + 1]) AS coordinate_count, count(*) FILTER (WHERE event_id % 9 > 1) + CASE WHEN count(*) > 500 THEN 1 ELSE 0 END AS errors, count(*) FILTER (WHERE event_id % 9 = 1) AS warnings FROM events""")
def val_inspect_totals(spark: SparkSession, d: str) -> DataFrame:
    """Whether all is valid, and the totals, with a limit of 500 features, which is an error."""
    shared(spark, "inspection")
    return I.inspect(formed(spark, d), most_features=500).summary


@query(f"SELECT event_id, {scaled_sql('lon')} AS x, {scaled_sql('greatest(-85.05112878, least(85.05112878, lat))')} AS y FROM {BAD}")
def val_normalize(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.geometry import normalized

    p = view(spark, d, "pts_world").selectExpr("event_id", "array(array(named_struct('x', string(lon * 1.1e0), 'y', string(lat * 1.05e0)))) AS parts")
    p = p.select("event_id", F.get(F.get(normalized(F.col("parts")), F.lit(0)), F.lit(0)).alias("q"))
    return p.select("event_id", scaled(F.col("q.x")).alias("x"), scaled(F.col("q.y")).alias("y"))


@query(f"SELECT event_id, {scaled_sql('coalesce(CASE WHEN event_id % 6 <> 0 THEN weight END, 1)')} AS weight, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN time_ms WHEN 2 THEN time_ms // 1000 * 1000 ELSE time_ms END AS time_ms FROM {WORLD}")
def val_heat_points(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_world")
    stamp = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 2, stamp).otherwise(F.col("time_ms").cast("string"))
    raw = p.select("event_id", "lon", "lat", F.when(F.col("event_id") % 6 != 0, F.col("weight")).cast("string").alias("weight"), text.alias("time"))
    return V.heat_points(raw)[0].select("event_id", scaled(F.col("weight")).alias("weight"), "time_ms")


HEAT_TIME = "CASE event_id % 4 WHEN 1 THEN time_ms WHEN 2 THEN time_ms // 1000 * 1000 END"


@query(f"""WITH p AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 1e0 WHEN 1 THEN -1e0 WHEN 2 THEN event_id % 100 / 4e0 ELSE event_id % 50 END AS w FROM {WORLD} WHERE event_id % 5 <> 4)
SELECT event_id, {scaled_sql('lon')} AS lon, {scaled_sql('w')} AS weight, {HEAT_TIME} AS time_ms, NULL AS code FROM p WHERE w >= 0 AND event_id % 8 <> 7
UNION ALL SELECT event_id, {scaled_sql('lon / 2')}, {scaled_sql('w')}, {HEAT_TIME}, NULL FROM p WHERE w >= 0 AND event_id % 8 <> 7 AND event_id % 5 = 0
UNION ALL SELECT event_id, NULL, NULL, NULL, CASE WHEN w < 0 THEN 'weight' ELSE 'time' END FROM p WHERE w < 0 OR event_id % 8 = 7""")
def val_heat_features(spark: SparkSession, d: str) -> DataFrame:
    """Point and MultiPoint features as heat points, with the features that are refused."""
    p = view(spark, d, "pts_world")
    at = lambda x: F.struct(x.alias("x"), F.col("lat").alias("y"))
    many, line = F.col("event_id") % 5 == 0, F.col("event_id") % 5 == 4
    parts = F.when(many, F.array(F.array(at(F.col("lon"))), F.array(at(F.col("lon") / 2)))).otherwise(F.array(F.array(at(F.col("lon")))))
    weight = F.expr("CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '-1' WHEN 2 THEN concat('\"', event_id % 100 / 4, '\"') ELSE string(event_id % 50) END")
    stamp = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd HH:mm:ss")
    time = F.when(F.col("event_id") % 8 == 7, '"soon"').when(F.col("event_id") % 4 == 1, F.col("time_ms").cast("string")).when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), stamp, F.lit('"'))).otherwise('""')
    props = F.parse_json(F.concat(F.lit('{"weight":'), weight, F.lit(',"time":'), time, F.lit("}")))
    kind = F.when(many, "MultiPoint").when(line, "LineString").otherwise("Point")
    points, refused = V.heat_features(p.select(F.col("event_id").alias("feature_id"), kind.alias("geometry_type"), parts.alias("parts"), props.alias("props")))
    found = points.select(F.col("feature_id").alias("event_id"), scaled(F.col("lon")).alias("lon"), scaled(F.col("weight")).alias("weight"), "time_ms")
    return found.unionByName(refused.withColumnRenamed("feature_id", "event_id"), allowMissingColumns=True)


@query("SELECT count(*) AS features, count(*) + 2 * count(*) FILTER (WHERE event_id % 5 = 0) AS coordinates FROM events")
def val_budget(spark: SparkSession, d: str) -> DataFrame:
    return V.check_budget(inspected(spark, d), 10**9, 10**10)


@query("SELECT user_id AS entity_id, event_id, 'time' AS code FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_id // 50) AS n FROM events) WHERE n > 1")
def val_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Frames of an entity at the same time."""
    return V.track_errors(table(spark, d, "events").selectExpr("user_id AS entity_id", "event_id", "event_id div 50 AS time_ms", "10e0 AS lon", "10e0 AS lat")).select("entity_id", "event_id", "code")


@query("SELECT min(event_id) AS feature_seq, 'error' AS severity FROM events WHERE event_id % 35 = 0")
def top_issues(spark: SparkSession, d: str) -> DataFrame:
    """One issue: an error, as there are errors."""
    return V.top_issues(V.issues(inspected(spark, d)), 1).select("feature_seq", "severity")
