"""Steps whose rows are more than their inputs show, and values at the edge of a digit."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mapfold.functions import geodesy
from mapfold.operators import changes, cluster, density, graph, shapes, spatial
from mapfold.sources import tiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ticks_are_never_broadcast(spark):
    events = spark.range(50).selectExpr("id % 5 AS scenario_id", "id AS event_id", "id * 7 AS time_ms")
    ticks = events.select("scenario_id").distinct().withColumn("time_ms", F.explode(F.sequence(F.lit(0), F.lit(400), F.lit(3)).cast("array<long>")))
    got = changes.dispatch(events, ticks)
    assert "BroadcastHashJoin" not in plan(got)
    assert {r.event_id: r.tick_ms for r in got.collect()} == {i: -(-i * 7 // 3) * 3 for i in range(50)}


def test_blocks_by_the_most_ticks_and_events_of_a_scenario(spark):
    events = spark.range(10).selectExpr("id % 2 AS scenario_id", "id AS event_id", "id AS time_ms")
    ticks = spark.range(1000).selectExpr("id % 4 div 3 AS scenario_id", "id AS time_ms")
    assert changes.tick_blocks(events, ticks) == 12  # 750 ticks
    assert changes.tick_blocks(events, ticks, 5) == 5
    assert changes.tick_blocks(events.limit(0), ticks.limit(0)) == 1


def test_two_decimals_by_the_exact_value(spark):
    values = [1.005, 1.015, 1.125, 2.375, 1.0, 999.995, 12345.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(geodesy.two_decimals(F.col("v")).alias("s")).collect()] == [f"{v:.2f}" for v in values]
    assert df.limit(1).select(geodesy.label_metres(F.col("v") * 1000).alias("s")).first().s == "1.00 km"


def test_sums_are_the_same_in_any_order(spark):
    rng = random.Random(5)
    values = [rng.randrange(0, 10_000) / 100 for _ in range(4001)]
    values += [-v for v in values[:4000]]
    want = values[4000]
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3 + seed)
        assert df.agg(density.even_sum("v").alias("s")).first().s == want
    odd = spark.createDataFrame([(1, float("inf")), (1, 1.0), (2, None), (3, None), (3, 2.5), (4, 1e300), (4, 1e299)], "k long, v double")
    assert {r.k: r.s for r in odd.groupBy("k").agg(density.even_sum("v").alias("s")).collect()} == {1: float("inf"), 2: None, 3: 2.5, 4: 1e300 + 1e299}


def test_equal_positions_are_asked_once(spark):
    """Many points of few positions, some without a position or an id."""
    at = [(i, float(i % 3), 0.0) for i in range(60)] + [(60, None, 0.0), (None, 1.0, 0.0)]
    points = spark.createDataFrame(at, "point_id long, x double, y double")
    asked, members = spatial.asked_once(points, "point_id", ["x", "y"])
    assert sorted(r.point_id for r in asked.collect()) == [0, 1, 2] and members.count() == 60
    segments = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 0.0), (8, 2.0, 0.5, 2.0, 1.0)], "line_id long, ax double, ay double, bx double, by double")
    near = spatial.points_near_segments(points, segments, 0.5)
    want = {(i, 7 if i % 3 < 2 else 8, 0.0 if i % 3 < 2 else 0.5) for i in range(60)}
    assert sorted(tuple(r) for r in near.collect()) == sorted(want)
    nodes = spark.createDataFrame([(1, 0.1, 0.0), (2, 2.1, 0.0)], "node_id long, lon double, lat double")
    for few in (0, 10):
        found = spatial.nearest_node(points.withColumnsRenamed({"x": "lon", "y": "lat"}), nodes, few=few)
        assert "BroadcastHashJoin" not in plan(found)
        assert {r.point_id: r.node_id for r in found.collect()} == {i: 1 if i % 3 < 2 else 2 for i in range(60)}


def test_boxes_and_hits_of_many_are_never_broadcast(spark):
    boxes = spark.range(40).selectExpr("id AS box_id", "double(id % 4) AS w", "0D AS s", "id % 4 + 0.5D AS e", "1D AS n")
    segments = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 0.0)], "line_id long, ax double, ay double, bx double, by double")
    got = spatial.segments_in_boxes(segments, boxes)
    assert sorted(r.box_id for r in got.collect()) == [i for i in range(40) if i % 4 < 2]
    assert "_asked" not in got.columns
    # what holds many rows, asked or met, is shuffled; only the levels in use are broadcast
    assert plan(got).count("SortMergeJoin") >= 2


def test_parts_of_routes_are_never_broadcast(spark):
    found = spark.createDataFrame([(1, 3, [1, 2, 3], [10, 11])], "origin long, target long, node_ids array<long>, edge_ids array<long>")
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in (1, 2, 3)], "node_id long, lon double, lat double")
    line = lambda a, b: [(float(a), 0.0), (float(b), 0.0)]
    edges = spark.createDataFrame([(10, 1, 5.0, line(1, 2)), (11, 3, 6.0, line(3, 2))], "edge_id long, from_id long, distance double, line array<struct<x:double,y:double>>")
    got = graph.route_shapes(found, nodes, edges)
    assert plan(got).count("SortMergeJoin") >= 2
    r = got.first()
    assert r.distance == 11.0 and [p.x for p in r.line] == [1.0, 2.0, 3.0]


def test_rounds_move_only_what_they_try(spark):
    """What is known is read where it was written, in layers or merged, and gives the heap's trees."""
    arcs = [(i, i % 12, (i * 7 + 1) % 12, 1 + i % 4, i % 5 == 0) for i in range(40)]
    dear = [(100 + i, i % 12, (i + 5) % 12, 50, False) for i in range(60)]
    edges = spark.createDataFrame(arcs + dear, "edge_id long, from_id long, to_id long, cost long, one_way boolean").filter("from_id <> to_id")
    origins = spark.range(13).toDF("origin")
    # edges that no way within 9 can take don't count
    assert graph.broadcast_adjacency(edges, 9, 40) is not None and graph.broadcast_adjacency(edges, 50, 40) is None
    want = {tuple(r) for r in graph.cheapest(origins, edges, 9).select(*graph.TREE).collect()}
    for layers in (1, 8):
        got = graph.cheapest_by_joins(origins, edges, 9, layers)
        assert "Exchange" not in plan(got)
        rows = got.select(*graph.TREE).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    met = graph.reachable_edges(got, edges)
    at = {(o, n) for o, n, *_ in want}
    assert sorted(tuple(r) for r in met.collect()) == sorted((o, e.edge_id) for o in range(13) for e in edges.collect() if {(o, e.from_id), (o, e.to_id)} <= at)


def test_products_beyond_the_greatest_double(spark, tmp_path):
    """agg_cluster_props at a size whose product no double holds: by its SQL, sums of logarithms."""
    items = spark.range(60).selectExpr("id AS item_id", "id AS seq", "0.5D + id % 2 * 0.25D AS x", "0.5D AS y", "if(id = 7, 0D, 1e200D) AS big")
    for few in (0, 1000):
        level = cluster.cluster_points(items, 50, 3, min_zoom=3, few=few, reducers={"big": "log*"}).levels.collect()
        assert sorted(round(r.big) for r in level) == sorted(round(n * 200 * math.log(10)) for n in (30, 29))


def test_a_tile_is_looked_up_once(spark):
    """However many requests ask for it; requests without a tile stay."""
    requests = spark.range(500).selectExpr("id AS request_id", "if(id = 3, NULL, id % 7) AS tile_id")
    entries = spark.createDataFrame([(0, 2, 10, 5), (4, 1, 20, 6), (5, 0, 30, 7)], "tile_id long, run long, offset long, length long")
    found = spatial.archive_lookup(requests, entries)
    assert plan(found).index("Window") > plan(found).index("SortMergeJoin")  # below the join with the requests
    want = {0: (10, 5), 1: (10, 5), 4: (20, 6)}
    rows = found.collect()
    assert len(rows) == 500
    for r in rows:
        assert r.tile_id == (None if r.request_id == 3 else r.request_id % 7)
        assert (r.offset, r.length) == want.get(r.tile_id, (None, None))


def test_hits_are_ranked_by_position(spark, sf_dir):
    """Ranks are made before the rows of a position's points, which nothing shuffles."""
    from mapfold.jobs import registry

    ranked = plan(registry.queries()["join_query_layers"](spark, sf_dir))
    assert ranked.index("SortMergeJoin") < ranked.index("Window")
    assert "Window" not in plan(registry.queries()["top_hits"](spark, sf_dir))
    points = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(30)] + [(30, None, 0.0)], "point_id long, x double, y double")
    held = [(i, float(i % 4) + 0.25 * (i % 2), 0.0, i % 5 % 3) for i in range(40)]
    dots = spark.createDataFrame([*held, (40, None, 0.0, 9)], "dot_id long, x double, y double, place int")
    want = set()
    for p in range(30):
        near = sorted(((place, k) for k, x, _, place in held if abs(x - p % 3) <= 0.5), reverse=True)
        want |= {(p, k, r) for r, (_, k) in enumerate(near, 1)}
    got = spatial.ranked_near(points, dots, 0.5, ["place"])
    rows = got.select("point_id", "dot_id", "rank").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert {tuple(r) for r in spatial.top_near(points, dots, 0.5, ["place"]).collect()} == {(p, k) for p, k, r in want if r == 1}


def test_nearest_search_keeps_few_boxes(monkeypatch):
    """Points amid a grid of nodes: boxes overlap, so the first way down may end far off."""
    c = np.arange(90_000)
    tree = spatial.NodeTree(10 + (c % 200) / 100, 47 + np.floor(c / 200) / 100)
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(11.4, 11.8, 200), rng.uniform(48, 48.26, 200)
    most, far = [0], spatial.NodeTree.far
    monkeypatch.setattr(spatial.NodeTree, "far", lambda self, p, n, level: most.append(n.size) or far(self, p, n, level))
    q, n = tree.nearest(lon, lat)
    assert max(most) < 200 * 200
    want = {(i, k) for i in range(200) for k in (int(np.rint((lat[i] - 47) * 100)) * 200 + int(np.rint((lon[i] - 10) * 100)),)}
    assert want <= set(zip(q.tolist(), n.tolist()))


def test_runs_of_rows_by_size():
    assert list(shapes.runs([3, 3, 3, 9, 0, 1], 6)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(shapes.runs([])) == [] and list(shapes.runs([0])) == [(0, 1)]


def test_lines_are_changed_in_runs(spark, monkeypatch):
    rows = [(i, [(float(k), float(i)) for k in range(i % 5)] if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "line_id long, line array<struct<x:double,y:double>>").coalesce(1)
    got = {r.line_id: r.line and [(p.x, p.y) for p in r.line] for r in shapes.each_line(df, lambda p: p[::-1] * 2).collect()}
    assert {k: v or None for k, v in got.items()} == {i: [(2 * x, 2 * y) for x, y in line[::-1]] if line else None for i, line in rows}
    assert got[7] is None and got[5] == []


def test_tiles_are_handed_on_before_the_batch_is_done(spark):
    df = spark.range(40).selectExpr("3 AS z", "id AS x", "id AS y", "encode(string(id), 'utf-8') AS data").coalesce(1)

    def decode(data):
        if data == b"39":
            raise ValueError("bad")
        return [("own", 4096, i, i, 1, [[(1, 2)]], "{}") for i in range(1000)]

    got = tiles.decode_mvt(df, decode)

    class Caught:  # stands for a table, and keeps the function that tasks run
        select = lambda self, *names: self
        mapInArrow = lambda self, work, schema: work

    batch = pa.RecordBatch.from_pydict({"z": pa.array([3] * 40, pa.int32()), "x": list(range(40)), "y": list(range(40)), "data": [str(i).encode() for i in range(40)]})
    made = [b.num_rows for b in tiles.decode_mvt(Caught(), decode)(iter([batch]))]
    assert max(made) == 5000 and sum(made) == 39_001
    assert got.filter("error is null").count() == 39_000 and got.filter("error is not null").count() == 1


def test_totals_are_the_same_in_any_order(spark, tmp_path):
    """agg_cluster_props: a total between two digits, which a plain sum of doubles falls short of in some order of clusters."""
    import datetime

    from mapfold.jobs import registry

    for seed in (3, 4, 5):
        rng = random.Random(seed)
        cents = [rng.randrange(0, 6_000_000) for _ in range(4000)]
        cents[-1] += (5 - sum(cents)) % 10
        rows = [(i * 7, datetime.datetime(2024, 1, 5), i % 97, "view", c / 100, "{}") for i, c in enumerate(cents)]
        folder = str(tmp_path / str(seed))
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
        got = registry.queries()["agg_cluster_props"](spark, folder).select("z", "points", "total").collect()
        assert sorted(tuple(r) for r in got) == [(z, 4000, sum(cents) // 10 + 1) for z in range(8, 15)]


def test_routes_from_both_ends(spark):
    """Many equal ways, nodes without arcs and pairs without a way: as by one search from the origin, and by joins."""
    rng = random.Random(2)
    arcs = [(i, rng.randrange(40), rng.randrange(44), rng.randrange(0, 3), i % 3 == 0) for i in range(110)]
    arcs += [(200 + i, 50 + i, 51 + i, 1, i % 2 == 0) for i in range(12)]
    edges = spark.createDataFrame(arcs, "edge_id long, from_id long, to_id long, cost long, one_way boolean").filter("from_id <> to_id")
    pairs = spark.range(66 * 20).selectExpr("id % 66 AS origin", "(id div 66) * 7 % 66 AS target").distinct()
    want = {r.origin * 100 + r.target: tuple(r) for r in graph.routes(pairs, edges, 10**6).collect()}
    assert len({k for k, r in want.items() if r[2] is not None}) > 300 and any(r[2] is None for r in want.values())
    for most in (None, 0):
        rows = graph.routes(pairs, edges, most_edges=most).collect()
        assert len(rows) == len(want) and {r.origin * 100 + r.target: tuple(r) for r in rows} == want


def test_routes_whatever_they_cost(spark, sf_dir):
    """gr_adjacency_route answers every open arc's ends, gr_route every pair that is asked, as far as there is a way."""
    from mapfold.jobs import registry
    from mapfold.jobs.changes import asked_routes, open_edges

    edges = open_edges(spark, sf_dir).filter("cost is not null")
    cost = {(r.from_id, r.to_id): r.cost for r in edges.collect()}
    rows = registry.queries()["gr_adjacency_route"](spark, sf_dir).collect()
    assert {(r.origin, r.target) for r in rows} == set(cost) and len(rows) == len(cost)
    assert all(r.cost <= cost[r.origin, r.target] for r in rows) and any(r.cost > 8_000_000 for r in rows)
    routes = registry.queries()["gr_route"](spark, sf_dir).collect()
    assert len(routes) == asked_routes(spark, sf_dir).count() and sum(r.cost is None for r in routes) < len(routes) / 10


def test_crowded_cells_meet_in_groups(spark, monkeypatch):
    """Positions, boxes, segments and areas of one cell in many groups and blocks: as by plain loops, and each line once a group."""
    from mapfold.operators import cells

    for name, size in (("ASKED", 7), ("HELD", 9), ("PAIRS", 20)):
        monkeypatch.setattr(cells, name, size)
    rng = random.Random(4)
    spot = lambda: (rng.randrange(60) / 64, rng.randrange(60) / 64)
    points = [(i, *spot()) for i in range(60)]
    lines = [(i % 17, *spot(), *spot()) for i in range(70)] + [(i % 17, *p, p[0], p[1] + 0.01) for i, p in enumerate(spot() for _ in range(30))] + [(3, 0.5, 0.5, 0.5, 0.5)]
    p, s = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(lines, "line_id long, ax double, ay double, bx double, by double")
    near = {}
    for i, x, y in points:
        for k, ax, ay, bx, by in lines:
            dx, dy = bx - ax, by - ay
            t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            far = math.sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)
            if far <= 0.05:
                near[i, k] = min(far, near.get((i, k), 1))
    got = spatial.points_near_segments(p, s, 0.05)
    assert "MapInArrow" in plan(got)
    rows = got.collect()
    assert len(rows) == len(near) and {(r.point_id, r.line_id): r.distance for r in rows} == near
    boxes = [(i, x, y, x + i % 3 / 40, y + i % 5 / 4) for i, x, y in points]
    touched = segments_by_sql(spark, lines, boxes)
    rows = spatial.segments_in_boxes(s, spark.createDataFrame(boxes, "box_id long, w double, s double, e double, n double")).collect()
    assert len(rows) == len(touched) and {tuple(r) for r in rows} == touched and touched
    rings = [(k, [[spot() for _ in range(3 + k % 3)] for _ in range(1 + k % 2)]) for k in range(25)] + [(99, [[]]), (98, [])]
    areas = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in parts]) for k, parts in rings], "poly_id long, parts array<array<struct<x:double,y:double>>>")
    x, y = (np.array([q[c] for q in points]) for c in (1, 2))
    for rule in ("nonzero", "evenodd"):
        want = {(points[i][0], k) for k, parts in rings if k < 90 for i in np.flatnonzero(spatial.in_rings(x, y, [np.array(r) for r in parts], rule))}
        assert {tuple(r) for r in spatial.in_areas(p, areas, rule).collect()} == want and want


def segments_by_sql(spark, lines, boxes):
    """Pairs of boxes and segments by the Columns of the slab test, all against all."""
    s = spark.createDataFrame(lines, "line_id long, ax double, ay double, bx double, by double")
    b = spark.createDataFrame(boxes, "box_id long, w double, s double, e double, n double")
    return {tuple(r) for r in s.crossJoin(b).filter(spatial.segment_touches_box(*(F.col(c) for c in ("ax", "ay", "bx", "by", "w", "s", "e", "n")))).select("box_id", "line_id").collect()}


def test_layer_hits_are_ranked_by_position(spark, sf_dir):
    """Ranks and tops are made before the rows of a position's points."""
    from mapfold.jobs import registry

    ranked = plan(registry.queries()["join_layer_hits"](spark, sf_dir))
    assert ranked.index("SortMergeJoin") < ranked.index("Window")
    top = plan(registry.queries()["top_layer_hits"](spark, sf_dir))
    assert top.index("SortMergeJoin") < top.index("Aggregate")
