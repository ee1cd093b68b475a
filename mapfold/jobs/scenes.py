"""Clusters, elevation, tile codecs and streams over whole tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..operators import cluster as K
from ..operators import elevation as E
from ..operators.density import even_parts
from ..streaming import entities
from ..streaming import updates as U
from .changes import ENTITIES_SQL, STATE_SQL, entity_rows, shown_track, state_changes
from .inputs import scaled, scaled_sql, sql, table, view
from .registry import query
from .scalars import X, Y

WORLD = sql("pts_world")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mapfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mapfold/{name}-{uuid.uuid4().hex}"


def city_items(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pts_city")
    return p.select(F.col("event_id").alias("item_id"), F.col("event_id").alias("seq"), M.world_x(p.lon).alias("x"), M.world_y(p.lat).alias("y"), F.col("weight").alias("value"))


@query()
def agg_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all zooms from 14 down: number of points and the sum of a property."""
    shared(spark, "clusters")
    levels = K.cluster_points(city_items(spark, d), 50, 14).levels
    return levels.select("z", "item_id", "n", scaled(F.col("x"), 10**9).alias("x"), scaled(F.col("y"), 10**9).alias("y"), scaled(F.col("value")).alias("value"))


@query(f"""SELECT CAST(unnest(range(8, 15)) AS INTEGER) AS z, (SELECT count(*) FROM events) AS points, {scaled_sql('(SELECT sum(value) FROM events)', 10)} AS total, {scaled_sql('(SELECT max(value) FROM events)')} AS most, {scaled_sql('(SELECT min(value) FROM events)')} AS least,
(SELECT CAST(bool_and(event_id % 2 = 0) AS INTEGER) FROM events) AS even, (SELECT CAST(bool_or(event_id % 97 = 5) AS INTEGER) FROM events) AS odd, {scaled_sql('(SELECT sum(ln(1 + (event_id % 3) / 1000e0)) FROM events)')} AS product""")
def agg_cluster_props(spark: SparkSession, d: str) -> DataFrame:
    """Each level holds all points, and what reducers make of their properties: sum, extremes, all, any and product."""
    shared(spark, "clusters")
    items = city_items(spark, d).withColumns({"most": F.col("value"), "least": F.col("value"), "even": F.col("item_id") % 2 == 0, "odd": F.col("item_id") % 97 == 5, "product": 1 + (F.col("item_id") % 3) / 1000})
    # a sum of doubles depends on the order of clusters; of its two parts it doesn't
    items = items.withColumns(dict(zip(("value", "rest"), even_parts("value"))))
    kinds = {"value": "+", "rest": "+", "most": "max", "least": "min", "even": "all", "odd": "any", "product": "log*"}
    levels = K.cluster_points(items, 50, 14, min_zoom=8, reducers=kinds).levels
    whole = levels.groupBy("z").agg(F.sum("n").alias("points"), (F.sum("value") + F.sum("rest")).alias("total"), F.max("most").alias("most"), F.min("least").alias("least"), F.min("even").cast("int").alias("even"), F.max("odd").cast("int").alias("odd"), F.sum("product").alias("product"))
    return whole.select("z", "points", scaled(F.col("total"), 10).alias("total"), scaled(F.col("most")).alias("most"), scaled(F.col("least")).alias("least"), "even", "odd", scaled(F.col("product")).alias("product"))


@query()
def agg_cluster_tile(spark: SparkSession, d: str) -> DataFrame:
    shared(spark, "clusters")
    p = view(spark, d, "pts_city")
    n = 1 << 12
    x, y = M.world_x(p.lon) * n, M.world_y(p.lat) * n
    rows = p.select(F.lit(12).alias("z"), F.floor(x).alias("x"), F.floor(y).alias("y"), F.col("event_id").alias("item_id"), F.col("event_id").alias("seq"), ((x - F.floor(x)) * 4096).alias("px"), ((y - F.floor(y)) * 4096).alias("py"), F.col("weight").alias("value"))
    return K.cluster_tiles(rows).select("z", "x", "y", "seq", "n", scaled(F.col("px"), 100).alias("px"), scaled(F.col("py"), 100).alias("py"))


@query()
def agg_cluster_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The first ten leaves of each cluster of zooms 8 to 12, depth first."""
    shared(spark, "clusters")
    return K.leaves_in_order(K.cluster_points(city_items(spark, d), 50, 12, min_zoom=8)).select("cluster_id", "item_id", "rank")


@query()
def agg_cluster_children(spark: SparkSession, d: str) -> DataFrame:
    """The children of each cluster of zooms 8 to 12, in order, points and clusters."""
    shared(spark, "clusters")
    items = city_items(spark, d)
    found = K.children(K.cluster_points(items, 50, 12, min_zoom=8), items)
    return found.select("cluster_id", "rank", "item_id", scaled(F.col("x"), 10**9).alias("x"), scaled(F.col("y"), 10**9).alias("y"), "n", "cluster")


PIXELS = "(SELECT DISTINCT user_id AS tile_id FROM events), (SELECT unnest(range(0, 64)) AS i)"


@query(f"""SELECT tile_id, CAST(i AS INTEGER) AS i, CASE WHEN i % 11 <> 5 THEN {scaled_sql('128 * 256 + (tile_id * 7 + i * 3) % 256 + ((tile_id + i) % 256) / 256e0 - 32768', 256)} END AS height FROM {PIXELS}""")
def dem_decode(spark: SparkSession, d: str) -> DataFrame:
    tiles = E.made_tiles(table(spark, d, "events").select(F.col("user_id").alias("tile_id")).distinct())
    return E.elevations(tiles, "terrarium").select("tile_id", F.posexplode("heights").alias("i", "h")).select("tile_id", "i", scaled(F.col("h"), 256).alias("height"))


@query()
def dem_relief(spark: SparkSession, d: str) -> DataFrame:
    tiles = E.made_tiles(table(spark, d, "events").select(F.col("user_id").alias("tile_id")).distinct())
    stops = [(0.0, (0, 0, 0, 1.0)), (100.0, (0, 255, 0, 1.0)), (250.0, (255, 0, 0, 0.5))]
    return E.shaded(tiles, "terrarium", stops).select("tile_id", F.hex("rgba").alias("rgba"))


@query()
def dem_hillshade(spark: SparkSession, d: str) -> DataFrame:
    tiles = E.made_tiles(table(spark, d, "events").select(F.col("user_id").alias("tile_id")).distinct())
    return E.shaded(tiles, "terrarium").select("tile_id", F.hex("rgba").alias("rgba"))


@query(f"SELECT source, fid, key, value FROM {STATE_SQL}")
def st_feature_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """st_feature_state from a stream of the events' files."""
    stream = U.read_table_stream(spark, d, "events").selectExpr(
        "event_type AS source", "CASE WHEN event_id % 997 = 5 THEN NULL ELSE user_id END AS fid", "CASE WHEN event_id % 97 = 3 OR event_id % 997 = 5 THEN NULL ELSE concat('k', event_id % 5) END AS key",
        "event_id AS value", "CASE WHEN event_id % 11 = 0 OR event_id % 97 = 3 OR event_id % 997 = 5 THEN 'remove' ELSE 'set' END AS op", "event_id AS seq",
    )
    assert stream.columns == state_changes(spark, d).columns
    return U.feature_state(stream, shared(spark, "state"), shared(spark, "state-progress"))


@query(ENTITIES_SQL)
def st_entity_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """st_entity_state from a stream of the events' files, by state that is kept by entity."""
    lon, lat = "((event_id * 7919 + user_id * 104729) % 360000) / 1000e0 - 180 AS lon", "((event_id * 6271 + user_id * 1299709) % 170000) / 1000e0 - 85 AS lat"
    frames = U.read_table_stream(spark, d, "events").selectExpr("user_id AS entity_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS time_ms", lon, lat, "event_type AS status", "event_id")
    own, patches = entity_rows(frames)
    rows = own.withColumns({"patch": F.lit(0), "seq": F.lit(0).cast("long")}).unionByName(patches.withColumn("patch", F.lit(1)))
    return shown_track(entities.tracks(rows, shared(spark, "tracks"), shared(spark, "tracks-progress")))


@query("SELECT event_id, user_id FROM events")
def st_inject(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed twice over; each id comes through once."""
    events = U.read_table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    out = shared(spark, "injected")
    U.injected(twice).select("event_id", "user_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared(spark, "inject-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("""SELECT CASE WHEN o_orderkey % 10 = 2 THEN 'new-' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS fid, CASE WHEN o_orderkey % 10 = 1 THEN 'moved' WHEN o_orderkey % 10 = 2 THEN 'added' ELSE 'at' END AS geometry
FROM (SELECT o_orderkey FROM orders UNION ALL SELECT NULL WHERE false) WHERE o_orderkey % 10 NOT IN (0, 2)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'at' FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT 'new-' || o_orderkey, 'added' FROM orders WHERE o_orderkey % 10 = 2""")
def st_source_updates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as features, changed by a stream of diffs made of them."""
    features = table(spark, d, "orders").selectExpr("string(o_orderkey) AS fid", "'at' AS geometry", "map('s', o_orderstatus) AS props")
    diffs = U.read_table_stream(spark, d, "orders").filter("o_orderkey % 10 <= 2").selectExpr(
        "CASE o_orderkey % 10 WHEN 0 THEN 'remove' WHEN 1 THEN 'update' ELSE 'add' END AS op", "CASE o_orderkey % 10 WHEN 2 THEN concat('new-', o_orderkey) ELSE string(o_orderkey) END AS fid",
        "CASE o_orderkey % 10 WHEN 1 THEN 'moved' WHEN 2 THEN 'added' END AS geometry", "false AS clear", "array('x') AS unset", "map('t', 'u') AS props",
    )
    return U.source_updates(features, diffs, shared(spark, "source"), shared(spark, "source-progress")).select("fid", "geometry")


@query(f"""SELECT CAST((epoch_us(ts) // 86400000000) AS BIGINT) AS day, ((CAST(floor({X} * 16) AS BIGINT) % 16) + 16) % 16 AS x, greatest(0, least(15, CAST(floor({Y} * 16) AS BIGINT))) AS y, count(*) AS n
FROM {WORLD} JOIN events USING (event_id) GROUP BY 1, 2, 3""")
def st_tile_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tile counts by day from a stream; complete output, so late events count too."""
    events = U.read_table_stream(spark, d, "events")
    lon, lat = "((event_id * 7919 + user_id * 104729) % 360000) / 1000e0 - 180 AS lon", "((event_id * 6271 + user_id * 1299709) % 170000) / 1000e0 - 85 AS lat"
    rows = U.tile_windows(events.selectExpr("CAST(ts AS TIMESTAMP) AS ts", lon, lat, "value AS weight"), 4)
    out = shared(spark, "windows")

    def whole(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    rows.writeStream.outputMode("complete").foreachBatch(whole).option("checkpointLocation", shared(spark, "window-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.expr("unix_seconds(start) div 86400").alias("day"), "x", "y", "n")
