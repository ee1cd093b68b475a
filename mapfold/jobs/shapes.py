"""Shapes, labels, codecs, set operations and user hooks over whole tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..operators import changes, cluster, graph, spatial
from ..operators import shapes as H
from ..operators.shapes import runs
from ..sources import geojson as J
from ..sources import osm as O
from ..sources import tiles as T
from . import density as density_jobs
from .changes import OPEN_ARCS_SQL, SHOWN_SQL, open_edges, routes_sql, shown_routes
from .inputs import GEDGES_SQL, gedges, scaled, scaled_sql, sql, table, view
from .registry import query
from .scenes import city_items, shared
from .scalars import X, Y, zone_features

WORLD, CITY, ZONES, FRAMES = sql("pts_world"), sql("pts_city"), sql("zones"), sql("keyframes")


def lines(spark: SparkSession, d: str, every: int = 1) -> DataFrame:
    """line_id, line: the way of each user through the city."""
    p = view(spark, d, "pts_city").filter(f"event_id % {every} = 0")
    return p.groupBy(F.col("user_id").alias("line_id")).agg(F.array_sort(F.collect_list(F.struct("time_ms", "event_id", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("s")).select("line_id", F.transform("s", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


@query()
def sc_simplify(spark: SparkSession, d: str) -> DataFrame:
    return H.simplify(lines(spark, d), 0.001).select("line_id", F.size("line").alias("positions"))


@query(f"""SELECT zone_id, {scaled_sql('greatest(0, least(e, 60) - greatest(w, -60)) * greatest(0, least(n, 60) - greatest(s, -60))', 10)} AS area FROM {ZONES}""")
def sc_clip_tile(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.geometry import signed_area

    z = zone_features(spark, d).select("zone_id", F.get("parts", F.lit(0)).alias("line"))
    return H.clip(z, -60, 60).select("zone_id", scaled(F.abs(F.coalesce(F.when(F.size("line") > 2, signed_area(F.col("line"))), F.lit(0.0))), 10).alias("area"))


@query(f"SELECT zone_id, {scaled_sql('w')} AS x, {scaled_sql('s + 2')} AS y, CAST(2 AS INTEGER) AS positions FROM {ZONES}")
def sc_offset_line(spark: SparkSession, d: str) -> DataFrame:
    """The southern edges of the zones, drawn two degrees beside them."""
    z = zone_features(spark, d).select("zone_id", F.slice(F.get("parts", F.lit(0)), 1, 2).alias("line"))
    rows = H.offset_lines(z, 2.0)
    return rows.select("zone_id", scaled(F.col("line")[0]["x"]).alias("x"), scaled(F.col("line")[0]["y"]).alias("y"), F.size("line").alias("positions"))


@query(f"""SELECT zone_id AS line_id, CAST(k AS INTEGER) AS place, {scaled_sql('w + (k + 0.5) * (e - w) / 6')} AS x, {scaled_sql('s')} AS y FROM {ZONES}, (SELECT unnest(range(0, 6)) AS k)""")
def sc_line_anchors(spark: SparkSession, d: str) -> DataFrame:
    z = zone_features(spark, d).select(F.col("zone_id").alias("line_id"), F.slice(F.get("parts", F.lit(0)), 1, 2).alias("line"))
    return H.line_anchors(z, 10.0).select("line_id", "place", scaled(F.col("x")).alias("x"), scaled(F.col("y")).alias("y"))


@query(f"""SELECT user_id AS line_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 1)) AS k) GROUP BY user_id""")
def udtf_anchors(spark: SparkSession, d: str) -> DataFrame:
    """One anchor a line, as without spacing."""
    return H.line_anchors(lines(spark, d), 0).groupBy("line_id").agg(F.count("*").alias("n"))


@query(f"""SELECT zone_id AS view_id, kind, {scaled_sql('v')} AS value FROM (
SELECT zone_id, 'meridian' AS kind, unnest(range(CAST(ceil(w / 10) AS BIGINT), CAST(floor(e / 10) AS BIGINT) + 1)) * 10 AS v FROM {ZONES}
UNION ALL SELECT zone_id, 'parallel', unnest(range(CAST(ceil(greatest(s, -85) / 10) AS BIGINT), CAST(floor(least(n, 85) / 10) AS BIGINT) + 1)) * 10 FROM {ZONES})""")
def sc_graticule(spark: SparkSession, d: str) -> DataFrame:
    return H.graticule(view(spark, d, "zones").withColumnRenamed("zone_id", "view_id"), 10.0).select("view_id", "kind", scaled(F.col("value")).alias("value"))


@query(f"SELECT event_id, CAST(floor(k / 127e0 * 255 + 0.5) AS INTEGER) AS red, CAST(floor(255 - k / 127e0 * 255 + 0.5) AS INTEGER) AS blue FROM (SELECT event_id, event_id % 128 AS k FROM events)")
def sc_color(spark: SparkSession, d: str) -> DataFrame:
    """A colour table of 128 entries, looked up by each event."""
    colors = H.color_table([(0.0, "blue"), (1.0, "#f00")], 128)
    at = (F.col("event_id") % 128).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(c[k]) for c in colors)), at)
    return table(spark, d, "events").select("event_id", pick(0).alias("red"), pick(2).alias("blue"))


@query(f"SELECT event_id, {scaled_sql('lon + 0.0013', 100)} AS lon, {scaled_sql('lat + 0.0013', 100)} AS lat FROM {WORLD}")
def sc_tile_to_geo(spark: SparkSession, d: str) -> DataFrame:
    """Points put in tile units of zoom 20 and back."""
    p, n = view(spark, d, "pts_world"), 1 << 20
    wx, wy = M.world_x(p.lon) * n, M.world_y(p.lat) * n
    f = p.select("event_id", F.lit(20).alias("z"), F.floor(wx).alias("x"), F.floor(wy).alias("y"), F.lit(4096).alias("extent"), F.array(F.array(F.struct(((wx - F.floor(wx)) * 4096).alias("x"), ((wy - F.floor(wy)) * 4096).alias("y")))).alias("parts"))
    return H.tile_to_lonlat(f).select("event_id", scaled(F.col("parts")[0][0]["x"] + 0.0013, 100).alias("lon"), scaled(F.col("parts")[0][0]["y"] + 0.0013, 100).alias("lat"))


@query()
def agg_merge_lines(spark: SparkSession, d: str) -> DataFrame:
    """The segments of a user's way, joined again."""
    shared(spark, "lines")
    p = view(spark, d, "pts_city")
    way = Window.partitionBy("user_id").orderBy("time_ms", "event_id")
    at = lambda c: F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")) if c == 0 else F.struct(F.lead("lon").over(way).alias("x"), F.lead("lat").over(way).alias("y"))
    s = p.select("user_id", "event_id", F.array(at(0), at(1)).alias("line")).filter("line[1].x is not null")
    return H.merged_lines(s.withColumnRenamed("event_id", "seq"), "user_id").select("user_id", "line_no", F.size("line").alias("positions"))


@query()
def agg_label_thin(spark: SparkSession, d: str) -> DataFrame:
    shared(spark, "labels")
    p, n = view(spark, d, "pts_city"), 1 << 12
    wx, wy = M.world_x(p.lon) * n, M.world_y(p.lat) * n
    box = p.select(F.floor(wx).alias("x"), F.floor(wy).alias("y"), F.col("event_id").alias("label_id"), (F.col("event_id") % 3).alias("priority"), F.col("weight").alias("sort_key"), ((wx - F.floor(wx)) * 512).alias("w"), ((wy - F.floor(wy)) * 512).alias("s"))
    return H.thin_labels(box.withColumn("e", F.col("w") + 40).withColumn("n", F.col("s") + 12), ["x", "y"])


def all_rings() -> str:
    return f"(SELECT region AS relation_id, zone_id AS ring_id, w, s, e, n FROM {ZONES})"


@query(f"""WITH o AS {all_rings()} SELECT h.relation_id, h.ring_id AS hole_id, (SELECT o.ring_id FROM o WHERE o.relation_id = h.relation_id AND h.w + 20 > o.w AND h.w + 20 < o.e AND h.s + 8 > o.s AND h.s + 8 < o.n) AS outer_id FROM o h""")
def join_rings_holes(spark: SparkSession, d: str) -> DataFrame:
    """The middle thirds of all zones as holes of the zones of their region."""
    from ..functions.geometry import rectangle

    z = view(spark, d, "zones")
    tx, ty = (z.e - z.w) / 3, (z.n - z.s) / 3
    outer = z.select(F.col("region").alias("relation_id"), F.col("zone_id").alias("ring_id"), F.lit("outer").alias("role"), rectangle(z.w, z.s, z.e, z.n).alias("ring"))
    inner = z.select(F.col("region").alias("relation_id"), F.col("zone_id").alias("ring_id"), F.lit("inner").alias("role"), rectangle(z.w + tx, z.s + ty, z.e - tx, z.n - ty).alias("ring"))
    return H.holes_to_outers(outer.unionByName(inner))


@query(f"SELECT event_id, lon, lat FROM (SELECT event_id, {scaled_sql('lon')} AS lon, {scaled_sql('lat')} AS lat FROM {WORLD} UNION ALL SELECT event_id, {scaled_sql('lon')}, {scaled_sql('lat')} FROM {CITY})")
def set_union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two sources, nothing dropped."""
    both = view(spark, d, "pts_world").unionByName(view(spark, d, "pts_city"))
    return both.select("event_id", scaled(F.col("lon")).alias("lon"), scaled(F.col("lat")).alias("lat"))


#: layer type -> kinds (1 points, 2 lines, 3 polygons) that it draws
KINDS = {"heatmap": (1,), "circle": (1,), "symbol": (1, 2, 3), "fill": (3,), "fill-extrusion": (3,), "line": (2,)}


@query("SELECT event_id, event_id % 3 + 1 AS kind, t AS type FROM events, (SELECT unnest(['heatmap', 'circle', 'symbol', 'fill', 'fill-extrusion', 'line']) AS t) WHERE t = 'symbol' OR (event_id % 3 = 0 AND t IN ('heatmap', 'circle')) OR (event_id % 3 = 1 AND t = 'line') OR (event_id % 3 = 2 AND t IN ('fill', 'fill-extrusion'))")
def flt_type(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 3 + 1
    types = F.filter(F.array(*(F.when(kind.isin(*kinds), F.lit(t)) for t, kinds in KINDS.items())), lambda t: t.isNotNull())
    return table(spark, d, "events").select("event_id", kind.alias("kind"), F.explode(types).alias("type"))


@query("SELECT event_id FROM events WHERE event_id % 12 >= event_id % 7 AND event_id % 12 < 11 AND event_id % 5 <> 0")
def flt_zoom(spark: SparkSession, d: str) -> DataFrame:
    """Views that show their layer: visible, from minzoom on and below maxzoom."""
    e = table(spark, d, "events").selectExpr("event_id", "event_id % 12 AS zoom", "event_id % 7 AS minzoom", "11 AS maxzoom", "CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'visible' END AS visibility")
    return e.filter("visibility <> 'none' AND zoom >= minzoom AND zoom < maxzoom").select("event_id")


@query("SELECT event_id, CASE WHEN coalesce(k, 0) <= 20 THEN 2000 WHEN k < 80 THEN CAST(floor((2 + (k - 20) / 60 * 6) * 1000 + 0.5) AS BIGINT) ELSE 8000 END AS radius FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)")
def ex_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A value of the overlay's subset, with a default and a clamp."""
    from ..functions.expressions import Row, compile_expression

    e = table(spark, d, "events").select("event_id", F.parse_json("props").alias("p"))
    v = compile_expression(["coalesce", ["interpolate", ["linear"], ["get", "k"], 20, 2, 80, 8], 2], Row(props=e["p"]))
    return e.select("event_id", scaled(M.clamp(v.num, 0.0, 50.0)).alias("radius"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 5")
def top_search(spark: SparkSession, d: str) -> DataFrame:
    return density_jobs.search(table(spark, d, "part"), "A", ["p_name"], "p_partkey", 5).select("p_partkey", "p_name")


HITS = f"""(SELECT p.event_id AS point_id, f.event_id AS feature_id, f.event_type AS layer FROM {CITY} p JOIN {CITY} f ON (p.lon - f.lon) * (p.lon - f.lon) + (p.lat - f.lat) * (p.lat - f.lat) <= 0.0005 * 0.0005
WHERE f.event_type IN ('click', 'view', 'purchase'))"""
ORDER = "CASE layer WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END"


def city_dots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points, and the features of the layers click, view and purchase as dots, the last on top."""
    p = view(spark, d, "pts_city").withColumnsRenamed({"lon": "x", "lat": "y", "event_type": "layer"})
    drawn = p.filter("layer in ('click', 'view', 'purchase')")
    return p.select(F.col("event_id").alias("point_id"), "x", "y"), drawn.select(F.col("event_id").alias("dot_id"), "x", "y", "layer", F.expr(ORDER).alias("place"))


@query(f"SELECT point_id, feature_id, layer, row_number() OVER (PARTITION BY point_id ORDER BY {ORDER} DESC, feature_id DESC) AS rank FROM {HITS}")
def join_query_layers(spark: SparkSession, d: str) -> DataFrame:
    """Features under every point."""
    found = spatial.ranked_near(*city_dots(spark, d), 0.0005, ["place"])
    return found.select("point_id", F.col("dot_id").alias("feature_id"), "layer", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT point_id, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY {ORDER} DESC, feature_id DESC) AS k FROM {HITS}) WHERE k = 1")
def top_hits(spark: SparkSession, d: str) -> DataFrame:
    return spatial.top_near(*city_dots(spark, d), 0.0005, ["place"]).withColumnRenamed("dot_id", "feature_id")


@query()
def join_query_source(spark: SparkSession, d: str) -> DataFrame:
    """Level 9 of a clustered source: clusters of at least 20 points, with the zones, which aren't points."""
    shared(spark, "clusters")
    level = cluster.cluster_points(city_items(spark, d), 50, 10, min_zoom=9).levels.filter("z = 9 and n >= 20")
    zones = view(spark, d, "zones").select(F.col("zone_id").cast("long").alias("item_id"), F.lit("polygon").alias("kind"), F.lit(1).cast("long").alias("n"))
    return level.select("item_id", F.lit("cluster").alias("kind"), "n").unionByName(zones)


@query(f"SELECT CAST(z AS INTEGER) AS z, count(*) AS lines FROM (SELECT unnest(range(8, 11)) AS z), (SELECT 1 FROM {ZONES}) GROUP BY z")
def set_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """Features that can't be clustered are on each level, unchanged."""
    shared(spark, "clusters")
    levels = cluster.cluster_points(city_items(spark, d), 50, 10, min_zoom=8).levels.select("z", "item_id", F.lit("point").alias("kind"))
    other = view(spark, d, "zones").select(F.explode(F.sequence(F.lit(8), F.lit(10))).alias("z"), F.col("zone_id").cast("long").alias("item_id"), F.lit("polygon").alias("kind"))
    return levels.unionByName(other).filter("kind = 'polygon'").groupBy("z").agg(F.count("*").alias("lines"))


@query()
def win_cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of clusters in the order in which they are made: by zoom from the highest, then by seed."""
    shared(spark, "clusters")
    made = cluster.cluster_points(city_items(spark, d), 50, 12, min_zoom=8).levels.filter("made")
    ordered = made.withColumn("at", (F.lit(12) - F.col("z")) * F.lit(1 << 40) + F.col("seq"))
    return changes.ranked(ordered, "at", 1 << 20).select("item_id", F.col("_rank").alias("cluster_id"))


@query()
def top_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves 11 to 20 of each cluster of zooms 10 and 11, depth first."""
    shared(spark, "clusters")
    return cluster.leaves_in_order(cluster.cluster_points(city_items(spark, d), 50, 11, min_zoom=10), 10, 10)


@query()
def udaf_reducer(spark: SparkSession, d: str) -> DataFrame:
    """Reducers of properties, carried through the levels to the clusters of zoom 9: +, *, max, min, all, any."""
    shared(spark, "clusters")
    seen = table(spark, d, "events").select(F.col("event_id").alias("item_id"), (F.col("event_type") == "view").alias("all"))
    items = city_items(spark, d).join(seen, "item_id").withColumns({"max": F.col("value"), "min": F.col("value"), "any": F.col("all"), "product": 1 + (F.col("item_id") % 3) / 1000})
    kinds = {"value": "+", "product": "*", "max": "max", "min": "min", "all": "all", "any": "any"}
    level = cluster.cluster_points(items, 50, 11, min_zoom=9, reducers=kinds).levels.filter("z = 9 and n > 1")
    return level.select(F.col("item_id").alias("cluster_id"), scaled(F.col("value"), 10).alias("sum"), scaled(F.col("product")).alias("product"), scaled(F.col("max")).alias("max"), scaled(F.col("min")).alias("min"), (F.col("all") > 0).alias("all"), (F.col("any") > 0).alias("any"))


@query(f"SELECT edge_id, CASE WHEN cost % 7 = 0 THEN NULL ELSE CAST(floor(cost * 1.5 + 0.5) AS BIGINT) END AS cost FROM {GEDGES_SQL}")
def udf_edge_cost(spark: SparkSession, d: str) -> DataFrame:
    """A user's cost function; what isn't finite or is negative can't be used."""

    @F.pandas_udf("double")
    def price(cost: pd.Series) -> pd.Series:
        return (cost * 1.5).where(cost % 7 != 0, float("inf"))

    v = price("cost")
    return gedges(spark, d).withColumn("v", v).select("edge_id", F.when((F.col("v") >= 0) & (F.col("v") < float("inf")), scaled(F.col("v"), 1)).alias("cost"))


@query(f"WITH RECURSIVE {routes_sql(OPEN_ARCS_SQL, 'SELECT DISTINCT from_id AS origin, to_id AS target FROM ' + GEDGES_SQL + ' WHERE NOT closed')} SELECT origin, node AS target, cost, {SHOWN_SQL} FROM r")
def gr_adjacency_route(spark: SparkSession, d: str) -> DataFrame:
    """Routes to the ends of all arcs of each node on a graph given as lists of arcs by node: directed."""
    nested = open_edges(spark, d).filter("cost is not null").groupBy("from_id").agg(F.collect_list(F.struct("to_id", "cost", "edge_id")).alias("arcs"))
    flat = nested.select("from_id", F.explode("arcs").alias("a")).select("a.edge_id", "from_id", "a.to_id", "a.cost", F.lit(True).alias("one_way"))
    pairs = flat.select(F.col("from_id").alias("origin"), F.col("to_id").alias("target")).distinct()
    return shown_routes(graph.routes(pairs, flat))


def tiled(spark: SparkSession, d: str, encode=T.encode_points) -> DataFrame:
    """z, x, y, data: the world's points as vector tiles of zoom 6, by event type."""
    p, n = view(spark, d, "pts_world"), 64
    wx, wy = M.world_x(p.lon) * n, M.world_y(p.lat) * n
    rows = p.select(F.lit(6).alias("z"), F.pmod(F.floor(wx), F.lit(n)).alias("x"), F.floor(wy).alias("y"), "event_id", F.floor((wx - F.floor(wx)) * 4096).cast("int").alias("px"), F.floor((wy - F.floor(wy)) * 4096).cast("int").alias("py"), "event_type")
    # a tile of many points is several blobs of bounded size
    packed = rows.groupBy("z", "x", "y", F.expr("event_id div 65536")).agg(F.array_sort(F.collect_list(F.struct("event_id", "px", "py", "event_type"))).alias("items"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in runs(batch.column("items").value_lengths().to_pylist()):
                part = batch.slice(start, n)
                data = [encode("events", list(zip(*(items.values.field(c).to_pylist() for c in ("event_id", "px", "py", "event_type"))))) for items in part.column("items")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("z", "x", "y")), pa.array(data, pa.binary())], ["z", "x", "y", "data"])

    return packed.mapInArrow(work, "z int, x long, y long, data binary")


@query(f"SELECT event_id AS fid, CAST(floor((wx - floor(wx)) * 4096) AS INTEGER) AS px, CAST(floor((wy - floor(wy)) * 4096) AS INTEGER) AS py, '{{\"kind\":\"' || event_type || '\"}}' AS props FROM (SELECT event_id, event_type, {X} * 64 AS wx, {Y} * 64 AS wy FROM {WORLD})")
def io_mvt(spark: SparkSession, d: str) -> DataFrame:
    """Points written as vector tiles and decoded again."""
    return T.decode_mvt(tiled(spark, d)).select("fid", F.col("parts")[0][0]["x"].alias("px"), F.col("parts")[0][0]["y"].alias("py"), "props")


@query(f"SELECT event_id AS fid, CAST(floor((wx - floor(wx)) * 4096) AS INTEGER) AS px, CAST(floor((wy - floor(wy)) * 4096) AS INTEGER) AS py, '{{\"kind\":\"' || event_type || '\"}}' AS props FROM (SELECT event_id, event_type, {X} * 64 AS wx, {Y} * 64 AS wy FROM {WORLD})")
def io_mmt(spark: SparkSession, d: str) -> DataFrame:
    """Points written as columnar tiles and decoded again."""
    return T.decode_mvt(tiled(spark, d, T.encode_columnar_points), T.decode_columnar).select("fid", F.col("parts")[0][0]["x"].alias("px"), F.col("parts")[0][0]["y"].alias("py"), "props")


@query("SELECT count(*) AS features, 0 AS errors FROM events")
def udf_decoder(spark: SparkSession, d: str) -> DataFrame:
    """A user's decoder, of tiles that hold JSON."""

    def decode(data: bytes) -> list[tuple]:
        return [("own", 4096, i, f["id"], 1, [[(f["x"], f["y"])]], "{}") for i, f in enumerate(json.loads(data))]

    rows = table(spark, d, "events").groupBy(F.lit(30).alias("z"), F.lit(0).alias("x"), F.expr("event_id div 1000").alias("y")).agg(F.to_json(F.collect_list(F.struct(F.col("event_id").alias("id"), F.lit(1).alias("x"), F.lit(2).alias("y")))).cast("binary").alias("data"))
    return T.decode_mvt(rows, decode).agg(F.count("layer").alias("features"), F.count("error").cast("int").alias("errors"))


@query("SELECT p_partkey * 3 AS tile_id, CAST(least(3, p_size % 4 + 1) AS BIGINT) AS run, p_partkey * 100 AS \"offset\", CAST(p_size AS BIGINT) AS length FROM part")
def io_pmtiles_index(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entries of archives' directories, a thousand keys each, encoded and read again."""
    entries = table(spark, d, "part").selectExpr("p_partkey div 1000 AS archive", "p_partkey * 3 AS tile_id", "bigint(least(3, p_size % 4 + 1)) AS run", "p_partkey * 100 AS offset", "bigint(p_size) AS length")
    packed = entries.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("tile_id", "run", "offset", "length"))).alias("e"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for e in frame["e"]:
                blob = T.encode_directory([(r["tile_id"], r["run"], r["offset"], r["length"]) for r in e])
                yield pd.DataFrame(T.directory(blob), columns=["tile_id", "run", "offset", "length"])

    return packed.mapInPandas(work, "tile_id long, run long, offset long, length long")


@query("""SELECT user_id, event_id % 4 AS kind, count(*) AS n FROM events WHERE event_id % 4 < 2 GROUP BY 1, 2 UNION ALL SELECT user_id, 9, count(*) FROM events WHERE event_id % 4 = 2 GROUP BY 1""")
def io_geojson_seq(spark: SparkSession, d: str) -> DataFrame:
    """A sequence a user: points, features, broken records (kind 9) and blank ones."""
    record = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"type":"Point","coordinates":[1,2]}' WHEN 1 THEN concat('{"type":"Feature","id":', event_id, ',"geometry":null}') WHEN 2 THEN '{"type":' ELSE ' ' END""")
    files = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("source")).agg(F.concat(F.lit("\n\x1e"), F.concat_ws("\n\x1e", F.collect_list(record))).alias("value"))
    rows, errors = J.sequence_rows(files)
    good = rows.select("source", F.when(F.col("geom_type") == "Point", 0).otherwise(1).alias("kind"))
    return good.unionByName(errors.select("source", F.lit(9).alias("kind"))).groupBy(F.col("source").cast("long").alias("user_id"), F.col("kind").cast("long").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'geojsonseq' WHEN 1 THEN 'osm' WHEN 2 THEN 'topojson' WHEN 3 THEN 'geojson' END AS format FROM events")
def io_detect(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("""CASE event_id % 5 WHEN 0 THEN concat(' \n', char(30), '{}') WHEN 1 THEN '{"elements":[]}' WHEN 2 THEN '{"type":"Topology"}' WHEN 3 THEN '{"type":"Feature"}' ELSE '{"type":"x"}' END""")
    return table(spark, d, "events").select("event_id", J.format_of(text).alias("format"))


@query("SELECT l_orderkey AS id, count(*) AS refs, sum(l_partkey) AS total FROM lineitem GROUP BY l_orderkey")
def io_osm(spark: SparkSession, d: str) -> DataFrame:
    """Orders as OSM ways in JSON, a file for each thousand, read again."""
    element = F.to_json(F.struct(F.lit("way").alias("type"), F.col("l_orderkey").alias("id"), F.col("refs").alias("nodes")))
    way = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs"))
    files = way.groupBy(F.expr("string(l_orderkey div 1000)").alias("source")).agg(F.concat(F.lit('{"elements":['), F.concat_ws(",", F.collect_list(element)), F.lit("]}")).alias("value"))
    rows = O.elements_of(files.select("source", F.try_parse_json("value").alias("v")))
    return rows.select("id", F.size("nodes").cast("long").alias("refs"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT event_id, CAST(3 AS INTEGER) AS positions, CAST(floor((10 + event_id % 90 * 0.1) * 1000 + 0.5) AS BIGINT) AS x, CAST(floor((40 + 2 * 0.5) * 1000 + 0.5) AS BIGINT) AS y FROM events")
def io_topojson(spark: SparkSession, d: str) -> DataFrame:
    """A topology an event: two arcs that meet, joined to a line."""
    events = table(spark, d, "events")
    x = "event_id % 90"
    text = F.expr(f"""concat('{{"type":"Topology","transform":{{"scale":[0.1,0.5],"translate":[10,40]}},"arcs":[[[0,0],[', {x}, ',0]],[[', {x}, ',2],[0,-2]]],"objects":{{"a":{{"type":"LineString","arcs":[0,-2]}}}}}}')""")
    files = events.select(F.col("event_id").cast("string").alias("source"), F.try_parse_json(text).alias("v"))
    rows = O.topology_lines(files)
    return rows.select(F.col("source").cast("long").alias("event_id"), F.size("line").alias("positions"), scaled(F.element_at("line", -1)["x"]).alias("x"), scaled(F.element_at("line", -1)["y"]).alias("y"))


@query(f"""SELECT entity_id, time_ms FROM {FRAMES} f WHERE NOT (entity_id % 10 = 3 AND time_ms < 1704500000000)""")
def st_entity_set(spark: SparkSession, d: str) -> DataFrame:
    """Frames after entities were removed at a time: what they had before is gone, and unknown ones don't matter."""
    frames = view(spark, d, "keyframes").select("entity_id", "time_ms")
    gone = frames.select("entity_id").distinct().filter("entity_id % 10 = 3").union(spark.range(-5, 0).toDF("entity_id")).withColumn("at", F.lit(1704500000000))
    return frames.join(F.broadcast(gone) if gone.limit(10_001).count() <= 10_000 else gone, "entity_id", "left").filter("at is null or time_ms >= at").select("entity_id", "time_ms")
