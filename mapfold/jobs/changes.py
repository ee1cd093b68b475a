"""Diffs, state, edit logs, replay and graphs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import graph as G
from ..operators import scenario as S
from .inputs import GEDGES_SQL, gedges, scaled, scaled_sql, sql, table, view
from .registry import query
from .scalars import hav

FRAMES, GNODES = sql("keyframes"), sql("gnodes")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
def win_osm_last(spark: SparkSession, d: str) -> DataFrame:
    """Of rows that state an element again, the last one."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return C.last_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def win_history(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_last(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 20)


@query("""WITH f AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'fix-' || (event_id // 70 + 1) ELSE CAST(event_id // 2 AS VARCHAR) END AS fid FROM events),
m AS (SELECT *, fid IS NULL OR row_number() OVER (PARTITION BY fid ORDER BY event_id) > 1 AS again FROM f),
taken AS (SELECT fid FROM m WHERE NOT again),
free AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, (SELECT count(*) * 2 FROM events))) AS n) WHERE 'fix-' || n NOT IN (SELECT fid FROM taken)),
fresh AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM m WHERE again)
SELECT m.event_id, CASE WHEN again THEN 'fix-' || n ELSE fid END AS fid FROM m LEFT JOIN fresh USING (event_id) LEFT JOIN free USING (k)""")
def val_repair_ids(spark: SparkSession, d: str) -> DataFrame:
    fid = "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 7 = 0 THEN concat('fix-', event_id div 70 + 1) ELSE string(event_id div 2) END AS fid"
    return C.repair_ids(table(spark, d, "events").selectExpr("event_id", fid), "fix", "event_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS fid, CASE WHEN o_orderkey % 10 = 1 AND o_orderkey % 3 = 0 THEN 'moved' ELSE 'at ' || o_custkey END AS geometry,
CASE WHEN o_orderkey % 10 <> 1 THEN 'priority=' || o_orderpriority || ',status=' || o_orderstatus
     WHEN o_orderkey % 4 = 1 THEN 'note=new' ELSE 'note=new,status=X' END AS props FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT 'new-' || o_orderkey, 'added', 'status=' || o_orderstatus FROM orders WHERE o_orderkey % 10 = 2""")
def set_apply_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    features = orders.selectExpr("string(o_orderkey) AS fid", "concat('at ', o_custkey) AS geometry", "map('status', o_orderstatus, 'priority', o_orderpriority) AS props")
    diff = orders.selectExpr("o_orderkey", "o_orderstatus", "o_orderkey % 10 AS k").filter("k <= 2").selectExpr(
        "CASE k WHEN 0 THEN 'remove' WHEN 1 THEN 'update' ELSE 'add' END AS op",
        "CASE k WHEN 2 THEN concat('new-', o_orderkey) ELSE string(o_orderkey) END AS fid",
        "CASE WHEN k = 2 THEN 'added' WHEN o_orderkey % 3 = 0 THEN 'moved' END AS geometry",
        "o_orderkey % 4 = 1 AS clear",
        "array('priority') AS unset",
        "CASE WHEN k = 2 THEN map('status', o_orderstatus) WHEN o_orderkey % 4 = 1 THEN map('note', 'new') ELSE map('note', 'new', 'status', 'X') END AS props",
    )
    rows = C.apply_diff(features, diff)
    return rows.select("fid", "geometry", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("props"))


CHANGES_SQL = """(SELECT event_type AS source, CASE WHEN event_id % 997 = 5 THEN NULL ELSE user_id END AS fid, CASE WHEN event_id % 97 = 3 OR event_id % 997 = 5 THEN NULL ELSE 'k' || (event_id % 5) END AS key,
event_id AS value, CASE WHEN event_id % 11 = 0 OR event_id % 97 = 3 OR event_id % 997 = 5 THEN 'remove' ELSE 'set' END AS op, event_id AS seq FROM events)"""


def state_changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_type AS source", "CASE WHEN event_id % 997 = 5 THEN NULL ELSE user_id END AS fid", "CASE WHEN event_id % 97 = 3 OR event_id % 997 = 5 THEN NULL ELSE concat('k', event_id % 5) END AS key",
        "event_id AS value", "CASE WHEN event_id % 11 = 0 OR event_id % 97 = 3 OR event_id % 997 = 5 THEN 'remove' ELSE 'set' END AS op", "event_id AS seq",
    )


STATE_SQL = f"""(SELECT source, fid, key, value FROM (SELECT *, row_number() OVER (PARTITION BY source, fid, key ORDER BY seq DESC) AS k FROM {CHANGES_SQL} WHERE key IS NOT NULL) c
WHERE k = 1 AND op = 'set' AND NOT EXISTS (SELECT 1 FROM {CHANGES_SQL} r WHERE r.op = 'remove' AND r.key IS NULL AND r.source = c.source AND (r.fid = c.fid OR r.fid IS NULL) AND r.seq > c.seq))"""


@query(f"SELECT * FROM {STATE_SQL}")
def st_feature_state(spark: SparkSession, d: str) -> DataFrame:
    return C.feature_state(state_changes(spark, d))


@query(f"""SELECT f.source, f.fid, s.k AS set_keys FROM (SELECT DISTINCT event_type AS source, user_id AS fid FROM events) f
LEFT JOIN (SELECT source, fid, string_agg(key, ',' ORDER BY key) AS k FROM {STATE_SQL} GROUP BY source, fid) s ON s.source = f.source AND s.fid = f.fid""")
def join_state(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("fid")).distinct()
    rows = C.with_feature_state(features, C.feature_state(state_changes(spark, d)))
    return rows.select("source", "fid", F.array_join(F.array_sort(F.map_keys("state")), ",").alias("set_keys"))


@query(f"""SELECT entity_id AS scenario_id, event_id, 1704067200000 + CAST(ceil((time_ms - 1704067200000) / 3600000e0) AS BIGINT) * CAST(3600000 AS BIGINT) AS tick_ms FROM {FRAMES} WHERE time_ms <= 1704067200000 + 2592000000""")
def st_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Events that each hour's tick of a replay clock emits."""
    frames = view(spark, d, "keyframes").withColumnRenamed("entity_id", "scenario_id")
    ticks = frames.select("scenario_id").distinct().withColumn("time_ms", F.explode(F.expr("transform(sequence(0, 720), h -> 1704067200000 + bigint(h) * 3600000)")))
    return C.dispatch(frames, ticks)


WAY = "pos.x + step * share"
ENTITIES_SQL = f"""WITH fr AS (SELECT entity_id, time_ms, lon, lat, status, event_id, lead(time_ms) OVER w AS t1, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM {FRAMES} WINDOW w AS (PARTITION BY entity_id ORDER BY time_ms)),
b AS (SELECT entity_id, time_ms, 0 AS p, CAST(NULL AS BIGINT) AS seq, lon, lat, status, event_id AS k, CAST(NULL AS BIGINT) AS pk, time_ms AS f FROM fr
UNION ALL SELECT entity_id, time_ms + (event_id % 2) * 600000, 1, event_id, CASE WHEN event_id % 4 = 0 THEN 10e0 END, CASE WHEN event_id % 4 = 0 THEN 20e0 END, CASE WHEN event_id % 8 <> 0 THEN 'patched' END, NULL, CASE WHEN event_id % 5 <> 0 THEN event_id END, NULL FROM {FRAMES} WHERE event_id % 9 = 0),
s AS (SELECT *, max(f) OVER (PARTITION BY entity_id ORDER BY time_ms, p, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0 FROM b),
v AS (SELECT entity_id, time_ms, p, seq, t0, lon, lat, last_value(CASE WHEN lon IS NOT NULL THEN {{'t': time_ms, 'x': lon, 'y': lat}} END IGNORE NULLS) OVER w AS pos,
last_value(CASE WHEN p = 0 OR status IS NOT NULL THEN {{'s': status}} END IGNORE NULLS) OVER w AS st, last_value(k IGNORE NULLS) OVER w AS k, last_value(pk IGNORE NULLS) OVER w AS pk
FROM s WINDOW w AS (PARTITION BY entity_id, t0 ORDER BY time_ms, p, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
j AS (SELECT v.*, t1, lat1, (v.time_ms - pos.t) / (t1 - pos.t)::DOUBLE AS share, CASE WHEN lon1 - pos.x > 180 THEN lon1 - pos.x - 360 WHEN lon1 - pos.x < -180 THEN lon1 - pos.x + 360 ELSE lon1 - pos.x END AS step,
row_number() OVER (PARTITION BY v.entity_id, v.time_ms ORDER BY p DESC, seq DESC) AS place FROM v JOIN fr ON fr.entity_id = v.entity_id AND fr.time_ms = v.t0)
SELECT entity_id, time_ms, {scaled_sql(f"CASE WHEN lon IS NOT NULL THEN lon WHEN t1 IS NOT NULL THEN {WAY} - floor(({WAY} + 180) / 360) * 360 ELSE pos.x END")} AS lon,
{scaled_sql("CASE WHEN lon IS NOT NULL THEN lat WHEN t1 IS NOT NULL THEN pos.y + (lat1 - pos.y) * share ELSE pos.y END")} AS lat, st.s AS status, 'k=' || k || coalesce(',p=' || pk, '') AS props FROM j WHERE place = 1"""


def entity_rows(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and patches made of keyframes (with event_id)."""
    own = frames.selectExpr("entity_id", "time_ms", "lon", "lat", "status", "map('k', string(event_id)) AS props")
    patches = frames.filter("event_id % 9 = 0").selectExpr(
        "entity_id", "time_ms + (event_id % 2) * 600000 AS time_ms", "event_id AS seq", "CASE WHEN event_id % 4 = 0 THEN 10e0 END AS lon", "CASE WHEN event_id % 4 = 0 THEN 20e0 END AS lat",
        "CASE WHEN event_id % 8 <> 0 THEN 'patched' END AS status", "CASE WHEN event_id % 5 <> 0 THEN map('p', string(event_id)) ELSE CAST(map() AS map<string,string>) END AS props",
    )
    return own, patches


def shown_track(track: DataFrame) -> DataFrame:
    props = F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("props")
    return track.select("entity_id", "time_ms", scaled(F.col("lon")).alias("lon"), scaled(F.col("lat")).alias("lat"), "status", props)


@query(ENTITIES_SQL)
def st_entity_state(spark: SparkSession, d: str) -> DataFrame:
    """Tracks after patches, each of which sees those before it."""
    return shown_track(S.entity_frames(*entity_rows(view(spark, d, "keyframes")))[0])


OPS = ["event_id AS seq", "(user_id * 7 + event_id % 3) % 300 AS entity_id", "CASE WHEN event_id % 5 < 2 THEN 'remove' ELSE 'add' END AS op", "event_id % 11 = 0 AS late"]


@query(f"""WITH o AS (SELECT {', '.join(OPS)} FROM events), g AS (SELECT * FROM o WHERE NOT (op = 'add' AND late)),
q AS (SELECT *, lag(op) OVER (PARTITION BY entity_id ORDER BY seq) AS prev, entity_id IN (SELECT user_id FROM events) AS there, last_value(op) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
max(CASE WHEN op = 'remove' THEN seq END) OVER (PARTITION BY entity_id) AS gone FROM g),
w AS (SELECT *, op = 'add' AND (prev = 'add' OR (prev IS NULL AND there)) AS twice FROM q)
SELECT 'frame' AS kind, entity_id, time_ms, CAST(NULL AS VARCHAR) AS code FROM {FRAMES} WHERE entity_id NOT IN (SELECT entity_id FROM w WHERE op = 'remove')
UNION ALL SELECT 'frame', entity_id, seq * 10 + k, NULL FROM w, (SELECT unnest([0, 1]) AS k) WHERE op = 'add' AND NOT twice AND final = 'add' AND (gone IS NULL OR seq > gone)
UNION ALL SELECT 'error', entity_id, seq, 'duplicate' FROM w WHERE twice UNION ALL SELECT 'error', entity_id, seq, 'duration' FROM o WHERE op = 'add' AND late""")
def st_entity_ops(spark: SparkSession, d: str) -> DataFrame:
    """Entities added and removed by a log, with the errors of the log."""
    frames = entity_rows(view(spark, d, "keyframes"))[0]
    ops = table(spark, d, "events").selectExpr(*OPS)
    end = 1 << 60
    added = ops.filter("op = 'add'").select("seq", F.explode(F.expr(f"array(seq * 10, CASE WHEN late THEN {end + 1} ELSE seq * 10 + 1 END)")).alias("time_ms"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit("new").alias("status"), F.expr("map('n', string(seq))").alias("props"))
    tracks, errors = S.entity_set(frames, ops, added, end)
    return tracks.select(F.lit("frame").alias("kind"), "entity_id", "time_ms", F.lit(None).cast("string").alias("code")).unionByName(errors.select(F.lit("error").alias("kind"), "entity_id", F.col("seq").alias("time_ms"), "code"))


@query("""WITH i AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'injected-' || (event_id % 500) ELSE 'own-' || (event_id % 700) END AS id, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 1000 END AS t, event_id % 1000 AS clock FROM events),
n AS (SELECT seq, coalesce(t, clock) AS t, coalesce(id, 'injected-' || (1 + coalesce(sum(CASE WHEN id IS NULL THEN 2 ELSE 1 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS id FROM i),
e AS (SELECT 'own-' || (o_orderkey % 90) AS id, o_orderkey % 90 AS t FROM orders GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) = 1 AND id NOT IN (SELECT id FROM e) AS fresh FROM n WHERE t <= 950)
SELECT id AS event_id, t AS time_ms, CAST(NULL AS VARCHAR) AS code FROM e UNION ALL SELECT id, t, NULL FROM g WHERE fresh UNION ALL SELECT id, seq, 'duplicate' FROM g WHERE NOT fresh UNION ALL SELECT id, seq, 'duration' FROM n WHERE t > 950""")
def st_inject_timeline(spark: SparkSession, d: str) -> DataFrame:
    """A timeline after injected events, with default times and ids, and the errors."""
    events = table(spark, d, "orders").selectExpr("concat('own-', o_orderkey % 90) AS event_id", "o_orderkey % 90 AS time_ms").distinct()
    asked = table(spark, d, "events").selectExpr(
        "event_id AS seq", "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN concat('injected-', event_id % 500) ELSE concat('own-', event_id % 700) END AS event_id",
        "CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 1000 END AS time_ms", "event_id % 1000 AS clock_ms",
    )
    timeline, errors = S.inject(events, asked, 950)
    return timeline.withColumn("code", F.lit(None).cast("string")).unionByName(errors.select("event_id", F.col("seq").alias("time_ms"), "code"))


@query()
def st_edit_log(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as edits of a document."""
    steps = table(spark, d, "events").selectExpr(
        "user_id AS doc_id", "event_id AS seq",
        "CASE WHEN event_id % 7 IN (0, 1, 2) THEN 'add' WHEN event_id % 7 = 3 THEN 'update' WHEN event_id % 7 = 4 THEN 'remove' WHEN event_id % 7 = 5 THEN 'undo' WHEN event_id % 101 = 6 THEN 'clear' ELSE 'redo' END AS op",
        "string(event_id % 13) AS fid", "event_type AS value",
    )
    return C.edit_log(steps)


@query("""SELECT DISTINCT z, ((x % 64) + 64) % 64 AS x, y FROM (
SELECT 6 AS z, CAST(floor(event_id * 31 % 64 + 0.5 + sin(b) * step + cos(b) * side) AS BIGINT) AS x, CAST(floor(event_id * 17 % 64 + 0.5 - cos(b) * step + sin(b) * side) AS BIGINT) AS y
FROM (SELECT event_id, (event_id % 628) / 100e0 AS b FROM events), (SELECT unnest(range(0, 5)) AS step), (SELECT unnest(range(-1, 2)) AS side)) WHERE y >= 0 AND y < 64""")
def st_corridor(spark: SparkSession, d: str) -> DataFrame:
    """Tiles ahead of moving positions."""
    at = table(spark, d, "events").selectExpr("6 AS z", "event_id * 31 % 64 AS x", "event_id * 17 % 64 AS y", "(event_id % 628) / 100e0 AS bearing")
    return C.corridor(at, F.lit(4.0)).select("z", "x", "y").distinct()


@query("""WITH m AS (SELECT event_id, sin(radians(event_id % 360)) AS sx, cos(radians(event_id % 360)) AS cx, (lon + 180) / 360 * 4096 AS px, (0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * 4096 AS py,
CAST(ceil(least(16e0, greatest(0e0, CASE WHEN user_id % 7 <> 0 THEN (user_id % 50) * 60e0 / (2 * pi() * 6371008.8 * cos(radians(lat)) / 4096) ELSE 0e0 END))) AS BIGINT) AS steps FROM """ + sql("pts_city") + """ WHERE event_id % 9 <> 0),
t AS (SELECT event_id, steps, CAST(floor(px + sx * step + cx * side + 0.5) AS BIGINT) AS x, CAST(floor(py - cx * step + sx * side + 0.5) AS BIGINT) AS y FROM m, (SELECT unnest(range(1, 17)) AS step), (SELECT unnest(range(-1, 2)) AS side) WHERE step <= steps)
SELECT DISTINCT event_id, ((x % 4096) + 4096) % 4096 AS x, y FROM t WHERE y >= 0 AND y < 4096""")
def st_corridor_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that moving positions reach within a minute at their own speeds."""
    p = view(spark, d, "pts_city").selectExpr("event_id", "12 AS z", "lon", "lat", "CASE WHEN event_id % 9 <> 0 THEN event_id % 360 END AS heading", "CASE WHEN user_id % 7 <> 0 THEN user_id % 50 END AS speed", "60 AS seconds")
    return C.corridor_ahead(p).select("event_id", "x", "y")


COST = 8_000_000
ARCS_SQL = f"""SELECT from_id AS src, to_id AS dst, cost, edge_id FROM {GEDGES_SQL} WHERE NOT closed AND cost <= {COST}"""
BACK_SQL = f"""SELECT to_id, from_id, cost, edge_id FROM {GEDGES_SQL} WHERE NOT closed AND NOT one_way AND cost <= {COST}"""


def reach_sql(arcs: str) -> str:
    """r: cost, stops and path (nodes and edges) of each origin's best ways to all nodes: the cheapest, of these the shortest, of these by the last edge's id."""
    return f"""e AS MATERIALIZED ({arcs}),
l(origin, node, cost, hops) USING KEY (origin, node) AS (SELECT node_id, node_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {GNODES}
UNION SELECT n.origin, n.node, n.label.cost, n.label.hops FROM (SELECT l.origin, e.dst AS node, min({{'cost': l.cost + e.cost, 'hops': l.hops + 1}}) AS label FROM l JOIN e ON e.src = l.node WHERE l.cost + e.cost <= {COST} GROUP BY l.origin, e.dst) n
LEFT JOIN recurring.l k ON k.origin = n.origin AND k.node = n.node WHERE k.cost IS NULL OR n.label < {{'cost': k.cost, 'hops': k.hops}}),
t AS MATERIALIZED (SELECT b.origin, b.node, min({{'edge': s.edge_id, 'prev': s.src}}) AS step FROM l b JOIN (SELECT a.origin, e.dst, a.cost + e.cost AS cost, a.hops + 1 AS hops, e.edge_id, e.src FROM l a JOIN e ON e.src = a.node) s
ON s.origin = b.origin AND s.dst = b.node AND s.cost = b.cost AND s.hops = b.hops GROUP BY b.origin, b.node),
w AS (SELECT origin, node, node AS at, [CAST(node AS BIGINT)] AS stops, CAST([] AS BIGINT[]) AS path FROM l
UNION ALL SELECT w.origin, w.node, t.step.prev, list_prepend(t.step.prev, stops), list_prepend(t.step.edge, path) FROM w JOIN t ON t.origin = w.origin AND t.node = w.at WHERE w.at <> w.origin),
r AS MATERIALIZED (SELECT w.origin, w.node, l.cost, stops, path FROM w JOIN l ON l.origin = w.origin AND l.node = w.node WHERE w.at = w.origin)"""


REACH_SQL = reach_sql(f"{ARCS_SQL} UNION ALL {BACK_SQL}")


def open_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = gedges(spark, d).withColumns({"distance": F.lit(None).cast("double"), "speed_kph": F.lit(None).cast("double"), "time": F.lit(None).cast("double")})
    return edges.withColumn("cost", G.edge_cost().cast("long"))


def origins(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "gnodes").select(F.col("node_id").alias("origin"))


@query(f"WITH RECURSIVE {REACH_SQL} SELECT origin, node, cost FROM r")
def gr_reachable(spark: SparkSession, d: str) -> DataFrame:
    """From every node."""
    return G.reachable(origins(spark, d), open_edges(spark, d), COST)


@query(f"WITH RECURSIVE {REACH_SQL} SELECT a.origin, g.edge_id FROM {GEDGES_SQL} g JOIN r a ON a.node = g.from_id JOIN r b ON b.node = g.to_id AND b.origin = a.origin WHERE NOT g.closed")
def join_reachable_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = open_edges(spark, d)
    return G.reachable_edges(G.reachable(origins(spark, d), edges, COST), edges)


def shown_routes(found: DataFrame) -> DataFrame:
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("origin", "target", F.col("cost").cast("long").alias("cost"), ids("node_ids"), ids("edge_ids"))


SHOWN_SQL = "array_to_string(r.stops, ',') AS node_ids, array_to_string(r.path, ',') AS edge_ids"


def routes_sql(arcs: str, asked: str) -> str:
    """o: what is asked (origin, target), and r as in reach_sql of these alone, whatever they cost."""
    return f"""o AS MATERIALIZED ({asked}), e AS MATERIALIZED ({arcs}),
l(origin, node, cost, hops) USING KEY (origin, node) AS (SELECT DISTINCT CAST(origin AS BIGINT), CAST(origin AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
UNION SELECT n.origin, n.node, n.label.cost, n.label.hops FROM (SELECT l.origin, e.dst AS node, min({{'cost': l.cost + e.cost, 'hops': l.hops + 1}}) AS label FROM l JOIN e ON e.src = l.node GROUP BY l.origin, e.dst) n
LEFT JOIN recurring.l k ON k.origin = n.origin AND k.node = n.node WHERE k.cost IS NULL OR n.label < {{'cost': k.cost, 'hops': k.hops}}),
w AS (SELECT l.origin, l.node, l.node AS stop, l.cost, l.hops, l.cost AS total, [CAST(l.node AS BIGINT)] AS stops, CAST([] AS BIGINT[]) AS path FROM l JOIN o ON o.origin = l.origin AND o.target = l.node
UNION ALL SELECT origin, node, step.prev, step.cost, step.hops, total, list_prepend(step.prev, stops), list_prepend(step.edge, path) FROM (
SELECT w.origin, w.node, w.stops, w.path, w.total, min({{'edge': e.edge_id, 'prev': e.src, 'cost': a.cost, 'hops': a.hops}}) AS step FROM w JOIN e ON e.dst = w.stop
JOIN l a ON a.origin = w.origin AND a.node = e.src AND a.cost + e.cost = w.cost AND a.hops + 1 = w.hops WHERE w.stop <> w.origin GROUP BY w.origin, w.node, w.stops, w.path, w.total)),
r AS MATERIALIZED (SELECT origin, node, total AS cost, stops, path FROM w WHERE w.stop = w.origin)"""


OPEN_ARCS_SQL = f"SELECT from_id AS src, to_id AS dst, cost, edge_id FROM {GEDGES_SQL} WHERE NOT closed"
OPEN_BACK_SQL = f"SELECT to_id, from_id, cost, edge_id FROM {GEDGES_SQL} WHERE NOT closed AND NOT one_way"
ASKED_SQL = f"SELECT DISTINCT node_id AS origin, (node_id * k + 3) % (SELECT count(*) FROM customer) AS target FROM {GNODES}, (SELECT unnest([0, 7, 11, 13]) AS k)"


@query(f"WITH RECURSIVE {routes_sql(f'{OPEN_ARCS_SQL} UNION ALL {OPEN_BACK_SQL}', ASKED_SQL)} SELECT o.origin, o.target, r.cost, {SHOWN_SQL} FROM o LEFT JOIN r ON r.origin = o.origin AND r.node = o.target")
def gr_route(spark: SparkSession, d: str) -> DataFrame:
    """Routes from every node to four others, whatever they cost."""
    return shown_routes(G.routes(asked_routes(spark, d), open_edges(spark, d)))


def asked_routes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    return origins(spark, d).crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.array(*map(F.lit, (0, 7, 11, 13))))).selectExpr("origin", "(origin * k + 3) % n AS target").distinct()


@query(f"""WITH RECURSIVE {REACH_SQL}, s AS (SELECT origin, node AS target, unnest(path) AS edge_id FROM r),
g AS (SELECT edge_id, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS metres FROM {GEDGES_SQL} JOIN {GNODES} a ON a.node_id = from_id JOIN {GNODES} b ON b.node_id = to_id),
m AS (SELECT origin, target, sum(metres) AS metres FROM s JOIN g USING (edge_id) GROUP BY origin, target)
SELECT r.origin, r.node AS target, {scaled_sql('coalesce(metres, 0)', 10)} AS decimetres, CAST(len(stops) AS INTEGER) AS positions, {scaled_sql('first.lon', 100)} AS x, {scaled_sql('last.lat', 100)} AS y
FROM r LEFT JOIN m ON m.origin = r.origin AND m.target = r.node JOIN {GNODES} first ON first.node_id = r.origin JOIN {GNODES} last ON last.node_id = r.node""")
def gr_route_shape(spark: SparkSession, d: str) -> DataFrame:
    """The lines and lengths of the routes from every node to all that it reaches: edges are straight between their nodes."""
    nodes, edges = view(spark, d, "gnodes"), open_edges(spark, d)
    pairs = G.reachable(origins(spark, d), edges, COST).select("origin", F.col("node").alias("target"))
    end = lambda c, at: nodes.select(F.col("node_id").alias(c), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias(at))
    shapes = G.with_distance(nodes, edges).join(end("from_id", "a"), "from_id").join(end("to_id", "b"), "to_id").withColumn("line", F.array("a", "b"))
    found = G.route_shapes(G.routes(pairs, edges, COST), nodes, shapes)
    return found.select("origin", "target", scaled(F.col("distance"), 10).alias("decimetres"), F.size("line").alias("positions"), scaled(F.get("line", F.lit(0))["x"], 100).alias("x"), scaled(F.element_at("line", -1)["y"], 100).alias("y"))


@query(f"""SELECT edge_id, CASE WHEN closed OR mode = 'foot' THEN NULL ELSE cost END AS usable, CASE WHEN closed THEN NULL ELSE {scaled_sql("cost / 1000e0 / (CASE WHEN mode = 'bike' THEN 15 ELSE 30 END / 3.6)")} END AS ms FROM {GEDGES_SQL}""")
def gr_edge_cost(spark: SparkSession, d: str) -> DataFrame:
    edges = gedges(spark, d).withColumns({"distance": F.col("cost") / 1000.0, "speed_kph": F.when(F.col("mode") == "bike", 15.0), "time": F.lit(None).cast("double"), "modes": F.when(F.col("mode") == "foot", F.array(F.lit("foot")))})
    return edges.select("edge_id", G.edge_cost("cost", "car").cast("long").alias("usable"), scaled(G.edge_cost("time")).alias("ms"))


@query(f"""SELECT g.edge_id, coalesce(arg_max(p.cost, p.seq) FILTER (WHERE p.cost IS NOT NULL), any_value(g.cost)) AS cost, coalesce(arg_max(p.closed, p.seq) FILTER (WHERE p.closed IS NOT NULL), any_value(g.closed)) AS closed
FROM {GEDGES_SQL} g LEFT JOIN (SELECT event_id * 3 % 20000 AS edge_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id END AS cost, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS closed FROM events) p USING (edge_id) GROUP BY g.edge_id""")
def gr_edge_state(spark: SparkSession, d: str) -> DataFrame:
    patches = table(spark, d, "events").selectExpr("event_id * 3 % 20000 AS edge_id", "event_id AS seq", "CASE WHEN event_id % 3 = 0 THEN event_id END AS cost", "CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS closed")
    return G.patch_edges(gedges(spark, d), patches).select("edge_id", "cost", "closed")


@query(f"""SELECT edge_id, 'from' AS code FROM {GEDGES_SQL} WHERE from_id NOT IN (SELECT node_id FROM {GNODES} WHERE node_id % 37 <> 0)
UNION ALL SELECT edge_id, 'to' FROM {GEDGES_SQL} WHERE to_id NOT IN (SELECT node_id FROM {GNODES} WHERE node_id % 37 <> 0)""")
def val_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges that lack a node once every 37th is gone."""
    return G.graph_errors(view(spark, d, "gnodes").filter("node_id % 37 <> 0"), gedges(spark, d))


@query(f"""SELECT edge_id, {scaled_sql(hav('a.lon', 'a.lat', 'b.lon', 'b.lat'), 10)} AS decimetres FROM {GEDGES_SQL} g JOIN {GNODES} a ON a.node_id = from_id JOIN {GNODES} b ON b.node_id = to_id""")
def gr_graph_out(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the length of their shapes."""
    edges = gedges(spark, d).withColumn("distance", F.lit(None).cast("double"))
    return G.with_distance(view(spark, d, "gnodes"), edges).select("edge_id", scaled(F.col("distance"), 10).alias("decimetres"))
