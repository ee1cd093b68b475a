"""Operators against small twins and hand-made values."""

import gzip
import heapq
import json
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapfold.functions import expressions as X
from mapfold.functions import geometry
from mapfold.operators import changes, cluster, density, elevation, graph, shapes, spatial, validate
from mapfold.sources import geojson, osm, tiles
from mapfold.streaming import updates


def evaluate(spark, expression, props=None, zoom=0.0):
    df = spark.createDataFrame([(json.dumps(props or {}),)], "p string").select(F.parse_json("p").alias("p"))
    v = X.compile_expression(expression, X.Row(props=F.col("p"), zoom=zoom))
    r = df.select(v.num.alias("n"), v.str.alias("s"), v.bool.alias("b"), v.json.alias("j")).first()
    return next((x for x in (r.n, r.s, r.b, r.j) if x is not None), None)


@pytest.mark.parametrize(
    ("expression", "props", "want"),
    [
        (["rgb", 255, 127.6, 0], None, "rgba(255,128,0,1)"),
        (["slice", "Munich", 0, 3], None, "Mun"),
        (["format", ["get", "ref"], {}, " ", {}, "E45", {}], {"ref": "A9"}, "A9 E45"),
        (["number-format", 1234.6, {"max-fraction-digits": 0}], None, "1,235"),
        (["get", "missing"], None, None),
        (["has", "gone"], {"gone": None}, True),
        (["typeof", ["get", "a"]], {"a": [1]}, "array"),
        (["at", 1, ["get", "a"]], {"a": [1, "two", 3]}, "two"),
        (["in", 3, ["get", "a"]], {"a": [1, "two", 3]}, True),
        (["==", ["get", "a"], "1"], {"a": 1}, False),
        (["/", 1, 0], None, math.inf),
        (["round", -2.5], None, -3.0),
        (["+", 1, "x"], None, None),
        (["to-string", 1.5], None, "1.5"),
        (["to-number", ""], None, None),
        (["match", ["get", "a"], "1", "text", 1, "number", "none"], {"a": 1}, "number"),
        (["step", ["get", "a"], "low", 10, "high"], {"a": "x"}, "low"),
        (["case", ["get", "a"], 1, 2], {"a": 1}, 2.0),
        (["let", "x", 3, ["*", ["var", "x"], ["var", "x"]]], None, 9.0),
        (["interpolate", ["linear"], ["zoom"], 0, 2, 10, 12], None, 7.0),
        (X.legacy_function({"stops": [[0, 2], [10, 12]]}), None, 7.0),
        (X.fill_tokens("{name} ({n})"), {"name": "a", "n": 3}, "a (3)"),
        (["to-color", "hsl(120, 100%, 50%)"], None, "rgba(0,255,0,1)"),
        (["length", "äb"], None, 2.0),
        (["index-of", "c", "abc"], None, 2.0),
    ],
)
def test_expressions(spark, expression, props, want):
    assert evaluate(spark, expression, props, 5.0) == want


def test_bad_expressions(spark):
    for bad in (["nope", 1], ["var", "x"], ["interpolate", ["linear"], 1, 5, 0, 5, 1], [1, 2]):
        with pytest.raises((ValueError, KeyError)):
            X.compile_expression(bad, X.Row())


def test_filters_are_never_null(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate([{}, {"a": None}, {"a": 1}, {"a": "1"}])], "i int, p string").select("i", F.parse_json("p").alias("p"))
    row = X.Row(props=F.col("p"))
    keep = lambda f: [r.i for r in df.filter(X.compile_filter(f, row)).orderBy("i").collect()]
    assert keep(["!=", "a", 1]) == [0, 1, 3] and keep(["none", ["<", "a", 5]]) == [0, 1, 3]
    assert keep(["==", ["get", "a"], 1]) == [2] and keep(["!", ["has", "a"]]) == [0] and keep(None) == [0, 1, 2, 3]


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": 7, "properties": {"label": "München\n中心"}, "geometry": {"type": "Point", "coordinates": [12, 48]}}, {"type": "Feature", "id": "7", "properties": None, "geometry": None}]}, ensure_ascii=False))
    rows, errors = geojson.read_geojson(spark, str(tmp_path / "a.json"))
    got = rows.select("fid", "fid_type", "geom_type", F.to_json("props").alias("p")).collect()
    assert [tuple(r) for r in got] == [("7", "num", "Point", '{"label":"München\\n中心"}'), ("7", "str", None, "null")] and errors.count() == 0
    geojson.write_feature_lines(rows, str(tmp_path / "out"))
    again, _ = geojson.read_feature_lines(spark, str(tmp_path / "out"))
    assert sorted(r.fid_type for r in again.collect()) == ["num", "str"]


def test_geojson_sequence(spark, tmp_path):
    point = lambda i: json.dumps({"type": "Feature", "id": i, "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    (tmp_path / "s.json").write_text("\n\x1e" + point("first") + "\n\x1e{bad\n\x1e \n\x1e" + point("third") + "\n")
    rows, errors = geojson.read_geojson_seq(spark, str(tmp_path), "collect")
    assert sorted(r.fid for r in rows.collect()) == ["first", "third"]
    assert [(r.record, r.code) for r in errors.collect()] == [(2, "json")]
    with pytest.raises(ValueError, match="record 2"):
        geojson.read_geojson_seq(spark, str(tmp_path))
    (tmp_path / "o.json").write_text('{"elements":[]}')
    (tmp_path / "t.json").write_text('{"type":"Topology"}')
    found = {r.source.rsplit("/", 1)[1]: r.format for r in geojson.detect(spark, str(tmp_path)).collect()}
    assert found == {"s.json": "geojsonseq", "o.json": "osm", "t.json": "topojson"}


def test_osm_elements(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lon": 1.0, "lat": 2.0}, {"type": "node", "id": 1, "lon": 13.0, "lat": 49.0}, {"type": "way", "id": 5, "nodes": [1, 2], "tags": {"highway": "path"}}]
    (tmp_path / "x.json").write_text(json.dumps({"elements": elements}))
    last = osm.last_statements(osm.read_elements(spark, str(tmp_path))).filter("type = 'node'").first()
    assert (last.lon, last.lat, last.idx) == (13.0, 49.0, 1)
    (tmp_path / "x.json").write_text(json.dumps({"elements": [], "remark": "timed out"}))
    with pytest.raises(ValueError, match="remark"):
        osm.read_elements(spark, str(tmp_path))


def test_rings():
    a, b, c, d = (0, 0), (1, 0), (1, 1), (0, 1)
    rings = osm.stitch([[a, b], [c, b], [c, d, a]])
    assert len(rings) == 1 and rings[0][0] == rings[0][-1] and set(rings[0]) == {a, b, c, d}
    assert osm.stitch([[a, b, c]]) is None and osm.stitch([[a, b], [b, a]]) is None
    assert osm.stitch([[a, b, c, a], [a, b], [b, d], [d, a]]) is not None


def test_topology(spark):
    deltas = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 10, 0), (1, 0, 10, 0), (1, 1, 0, 2)], "arc_id long, pos int, x long, y long")
    arcs = osm.delta_arcs(deltas, (0.1, 0.5), (10.0, 40.0))
    refs = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, -2), (2, 1, -1), (3, 0, 0), (3, 1, 0)], "line_id long, seq int, arc long")
    got = {r.line_id: [(round(p.x, 9), round(p.y, 9)) for p in r.line] for r in osm.stitch_arcs(refs, arcs).collect()}
    assert got == {1: [(10, 40), (11, 40), (11, 41)], 2: [(11, 41), (11, 40), (10, 40)]}


def points(spark, n, seed=1):
    rng = random.Random(seed)
    return [(i, i, rng.choice([0.2, 0.5]) + rng.random() * 0.002, 0.3 + rng.random() * 0.002, float(i)) for i in range(n)]


def twin_levels(rows, radius, low, high, least):
    """The scan as a plain double loop over all points."""
    items = [(i, s, x, y, 1, v) for i, s, x, y, v in rows]
    out = []
    for z in range(high, low - 1, -1):
        reach, used, level = radius / (512 * 2**z), set(), []
        for k, p in enumerate(items):
            if k in used:
                continue
            used.add(k)
            near = [m for m, q in enumerate(items) if m not in used and (q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2 <= reach**2]
            total = p[4] + sum(items[m][4] for m in near)
            if not near or total < least:
                level.append(p)
                continue
            used.update(near)
            group = [p, *(items[m] for m in near)]
            level.append((-(p[1] + 1) * 32 - z, p[1], sum(q[2] * q[4] for q in group) / total, sum(q[3] * q[4] for q in group) / total, total, sum(q[5] for q in group)))
        items = level
        out += [(z, i, s, round(x, 12), round(y, 12), n, round(v, 6)) for i, s, x, y, n, v in level]
    return out


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("few", [10_000, 30])
def test_clusters_equal_a_plain_scan(spark, few, least):
    rows = points(spark, 150)
    df = spark.createDataFrame(rows, "item_id long, seq long, x double, y double, value double").repartition(5)
    got = [(r.z, r.item_id, r.seq, round(r.x, 12), round(r.y, 12), r.n, round(r.value, 6)) for r in cluster.cluster_points(df, 50, 12, least, min_zoom=8, few=few).levels.collect()]
    assert sorted(got) == sorted(twin_levels(rows, 50, 8, 12, least))


@pytest.mark.parametrize("rounds", [0, 2, 12])
def test_takers_of_a_chain_and_a_crowd(spark, rounds, monkeypatch):
    """Items in a row, each of which waits for the one before, and many at one place."""
    rows = [(i, i, i * 0.004, 0.5, 1.0) for i in range(60)] + [(i, i, 0.7 + (i % 3) * 1e-6, 0.7, 1.0) for i in range(60, 160)]
    monkeypatch.setattr(cluster.takers, "__defaults__", (rounds,))
    df = spark.createDataFrame(rows, "item_id long, seq long, x double, y double, value double")
    found = cluster.cluster_points(df, 50, 4, min_zoom=4, few=3)
    got = [(r.z, r.item_id, r.seq, round(r.x, 12), round(r.y, 12), r.n, round(r.value, 6)) for r in found.levels.collect()]
    assert sorted(got) == sorted(twin_levels(rows, 50, 4, 4, 2))
    assert found.links.groupBy("cluster_id").count().agg({"count": "sum"}).first()[0] == sum(r[5] for r in got if r[1] < 0)


@pytest.mark.parametrize("few", [10_000, 20])
def test_leaves_in_order(spark, few):
    """All leaves of five levels, and ranges of them, whichever engine makes the clusters; none of an empty table."""
    df = spark.createDataFrame(points(spark, 150), "item_id long, seq long, x double, y double, value double")
    found = cluster.cluster_points(df, 50, 12, min_zoom=8, few=few)
    kids = {}
    for r in sorted(found.links.collect(), key=lambda r: (r.place, r.child_seq)):
        kids.setdefault(r.cluster_id, []).append(r.child_id)
    walk = lambda i: [leaf for c in kids[i] for leaf in walk(c)] if i in kids else [i]
    want = {(c, i, k) for c in kids for k, i in enumerate(walk(c), 1)}
    assert {tuple(r) for r in cluster.leaves_in_order(found, None).collect()} == want and want
    assert {tuple(r) for r in cluster.leaves_in_order(found, 3, 2).collect()} == {w for w in want if 3 <= w[2] <= 5}
    nothing = cluster.cluster_points(df.limit(0), 50, 12, min_zoom=11)
    assert cluster.leaves_in_order(nothing).count() == 0 and cluster.children(nothing, df).count() == 0


@pytest.mark.parametrize("few", [10_000, 20])
def test_reducers_are_carried_through_the_levels(spark, few):
    rows = [(i, s, x, y, v, v, v, 1 + v / 1000, i % 2 == 0, i % 50 == 7) for i, s, x, y, v in points(spark, 120)]
    df = spark.createDataFrame(rows, "item_id long, seq long, x double, y double, total double, most double, least double, product double, every boolean, some boolean")
    kinds = {"total": "+", "most": "max", "least": "min", "product": "*", "every": "all", "some": "any"}
    found = cluster.cluster_points(df, 50, 12, min_zoom=8, few=few, reducers=kinds)
    of = {r[0]: r for r in rows}
    below = {}
    for r in cluster.leaves(found.links).collect():
        below.setdefault(r.cluster_id, []).append(of[r.item_id])
    made = found.levels.filter("made").collect()
    assert made and all(len(below[r.item_id]) == r.n for r in made)
    for r in made:
        v = [x[4] for x in below[r.item_id]]
        assert (round(r.total, 6), r.most, r.least) == (round(sum(v), 6), max(v), min(v))
        assert round(r.product, 6) == round(math.prod(1 + x / 1000 for x in v), 6)
        assert (r.every, r.some) == (float(all(x[8] for x in below[r.item_id])), float(any(x[9] for x in below[r.item_id])))


def test_cluster_tree(spark):
    df = spark.createDataFrame(points(spark, 100), "item_id long, seq long, x double, y double, value double")
    levels, links = cluster.cluster_points(df, 50, 10, min_zoom=4)
    below = {}
    for r in cluster.leaves(links).collect():
        below.setdefault(r.cluster_id, set()).add(r.item_id)
    sizes = {r.item_id: r.n for r in levels.filter("made").collect()}
    assert {c: len(v) for c, v in below.items()} == sizes
    assert all(5 <= r.zoom <= 11 for r in cluster.expansion_zoom(levels, 10).collect())


@pytest.mark.parametrize("few", [10_000, 5])
def test_clusters_of_tiles_equal_a_plain_scan(spark, few):
    rng = random.Random(6)
    rows = [(3, i % 4, 0, i, i, rng.uniform(0, 4096), rng.uniform(0, 4096), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "z int, x long, y long, item_id long, seq long, px double, py double, value double")
    got = sorted((r.x, r.seq, round(r.px, 6), round(r.py, 6), r.n, r.value) for r in cluster.cluster_tiles(df, few=few).collect())
    want = []
    for x in range(4):
        mine = [(r[3], r[4], r[5], r[6], r[7]) for r in rows if r[1] == x]
        # a radius of 50 in tiles of 512: the twin's reach at zoom 0 is radius / 512
        want += [(x, s, round(px, 6), round(py, 6), n, v) for _, _, s, px, py, n, v in twin_levels(mine, 50 * 4096, 0, 0, 2)]
    assert got == sorted(want)


def test_cell_components_join_corners(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0)], "cx long, cy long")
    labels = {}
    for r in cluster.cell_components(cells).collect():
        labels.setdefault(tuple(r.label), set()).add((r.cx, r.cy))
    assert set(map(frozenset, labels.values())) == {frozenset({(0, 0), (1, 1), (2, 2)}), frozenset({(5, 5), (5, 6)}), frozenset({(9, 0)})}


def test_point_in_polygon_rules():
    square, hole = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float), np.array([(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)], float)
    x, y = np.array([2, 0.5, 4, 5, 1], float), np.array([2, 0.5, 2, 5, 2], float)
    for rule in ("nonzero", "evenodd"):
        assert spatial.in_rings(x, y, [square, hole], rule).tolist() == [False, True, True, False, True]


@pytest.mark.parametrize("few", [10_000, 2])
def test_nearest_by_rings_or_broadcast(spark, few):
    rng = random.Random(2)
    nodes = [(i, rng.uniform(-180, 180), rng.uniform(-80, 80)) for i in range(60)]
    asked = [(i, rng.uniform(-170, 170), rng.uniform(-70, 70)) for i in range(25)]
    far = lambda a, b: math.asin(min(1, math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
    got = {r.point_id: r.node_id for r in spatial.nearest_node(spark.createDataFrame(asked, "point_id long, lon double, lat double"), spark.createDataFrame(nodes, "node_id long, lon double, lat double"), cell=20, few=few).collect()}
    # across the antimeridian the rings don't look, so points near it may differ
    want = {a[0]: min(nodes, key=lambda n: (far(a, n), n[0]))[0] for a in asked}
    inner = [a[0] for a in asked if abs(a[1]) < 120]
    assert {i: got[i] for i in inner} == {i: want[i] for i in inner}


@pytest.mark.parametrize("cell", [0.25, 20, 50])
def test_nearest_node_across_the_antimeridian(spark, cell):
    points = spark.createDataFrame([(1, 179.9, 10.0), (2, -179.9, -20.0), (3, 0.0, 0.0)], "point_id long, lon double, lat double")
    nodes = spark.createDataFrame([(1, -179.95, 10.0), (2, 179.7, 10.0), (3, 179.99, -20.0), (4, -179.6, -20.0), (5, 0.1, 0.0)], "node_id long, lon double, lat double")
    assert {r.point_id: r.node_id for r in spatial.nearest_node(points, nodes, cell=cell, few=0).collect()} == {1: 1, 2: 3, 3: 5}


@pytest.mark.parametrize("blocks", [1, 7, 1024])
def test_snapshots_and_ticks_equal_plain_loops(spark, blocks):
    """An entity with most of the rows, gaps of many blocks, and frames before and after all times."""
    rng = random.Random(3)
    frames = sorted({(0 if rng.random() < 0.7 else rng.randrange(1, 6), rng.randrange(-500, 2000)) for _ in range(300)})
    rows = [(e, t, float(t % 90), float(t % 40), f"s{t}") for e, t in frames]
    times = sorted({rng.randrange(0, 1500) for _ in range(40)})
    got = {(r.entity_id, r.time_ms): (round(r.lon, 6), round(r.lat, 6), r.status) for r in spatial.snapshot(spark.createDataFrame(rows, "entity_id long, time_ms long, lon double, lat double, status string"), spark.createDataFrame([(t,) for t in times], "time_ms long"), blocks).collect()}
    want = {}
    for e in range(6):
        line = [r for r in rows if r[0] == e]
        for t in times:
            past = [r for r in line if r[1] <= t]
            if past:
                a, b = past[-1], next((r for r in line if r[1] > t), None)
                k = (t - a[1]) / (b[1] - a[1]) if b else 0
                want[e, t] = (round(a[2] + (b[2] - a[2]) * k, 6), round(a[3] + (b[3] - a[3]) * k, 6), a[4]) if b else (a[2], a[3], a[4])
    assert got == want and len(want) > 100
    events = spark.createDataFrame([(e, i, t) for i, (e, t) in enumerate(frames)], "scenario_id long, event_id long, time_ms long")
    ticks = [(e, t) for e in range(6) for t in times if (t + e) % 3]
    emitted = {(r.scenario_id, r.event_id): r.tick_ms for r in changes.dispatch(events, spark.createDataFrame(ticks, "scenario_id long, time_ms long"), blocks).collect()}
    plain = {(e, i): min((k for s, k in ticks if s == e and k >= t), default=None) for i, (e, t) in enumerate(frames)}
    assert emitted == {k: v for k, v in plain.items() if v is not None}


@pytest.mark.parametrize("most", [10**6, 0])
def test_points_in_polygons_by_broadcast_or_join(spark, most):
    square = lambda x, y, r: [[{"x": x + a * r, "y": y + b * r} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]
    polygons = spark.createDataFrame([(i, square(float(i), 0.0, 1.5)) for i in range(5)] + [(9, square(-50.0, -50.0, 100.0))], "poly_id long, parts array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, i * 0.25, 0.5) for i in range(24)], "point_id long, lon double, lat double")
    want = {(i, p) for i in range(24) for p in range(5) if p <= i * 0.25 <= p + 1.5} | {(i, 9) for i in range(24)}
    assert {tuple(r) for r in spatial.points_in_polygons(points, polygons, most_positions=most).collect()} == want


def test_bounds_cross_the_antimeridian(spark):
    row = density.bounds(spark.createDataFrame([(170.0, -8.0), (175.0, 2.0), (-170.0, 12.0)], "lon double, lat double")).first()
    assert (row.w, row.s, row.e, row.n) == (170, -8, -170, 12)
    assert density.bounds(spark.createDataFrame([], "lon double, lat double")).collect() == []
    one = density.bounds(spark.createDataFrame([(5.0, 1.0)], "lon double, lat double")).first()
    assert (one.w, one.e) == (5, 5)


EDGES = "edge_id long, from_id long, to_id long, cost long, one_way boolean"


def test_routes(spark):
    edges = spark.createDataFrame([(1, 1, 2, 2, False), (2, 3, 2, 3, False), (3, 3, 4, 1, True), (4, 1, 4, 9, False), (5, 4, 5, 1, False)], EDGES)
    pairs = spark.createDataFrame([(1, 4), (4, 3), (1, 1), (1, 9), (5, 1)], "origin long, target long")
    for most in (10, 0):
        rows = {(r.origin, r.target): r for r in graph.routes(pairs, edges, 20, most).collect()}
        assert {k: r.cost for k, r in rows.items()} == {(1, 4): 6, (4, 3): 14, (1, 1): 0, (1, 9): None, (5, 1): 10}
        assert list(rows[1, 4].node_ids) == [1, 2, 3, 4] and list(rows[1, 4].edge_ids) == [1, 2, 3]
        assert list(rows[1, 1].node_ids) == [1] and list(rows[1, 1].edge_ids) == [] and rows[1, 9].node_ids is None
    near = graph.routes(pairs, edges, 5).filter("origin = 1 and target = 4").first()
    assert near.cost is None


def test_both_engines_agree_on_random_graphs(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(40), rng.randrange(40), rng.randrange(1, 50), rng.random() < 0.3) for i in range(120)]
    edges = spark.createDataFrame([r for r in rows if r[1] != r[2]], EDGES)
    want = {}
    for origin in (0, 7):
        best, heap = {}, [(0, origin)]
        while heap:
            c, at = heapq.heappop(heap)
            if at in best or c > 90:
                continue
            best[at] = c
            for _, a, b, w, one in rows:
                if a == at and a != b:
                    heapq.heappush(heap, (c + w, b))
                if b == at and a != b and not one:
                    heapq.heappush(heap, (c + w, a))
        want |= {(origin, n): c for n, c in best.items()}
    origins = spark.createDataFrame([(0,), (7,)], "origin long")
    assert {(r.origin, r.node): r.cost for r in graph.reachable(origins, edges, 90).collect()} == want
    pairs = spark.createDataFrame([(o, t) for o in (0, 7) for t in range(40)], "origin long, target long")
    found = [{(r.origin, r.target): (r.cost, r.node_ids, r.edge_ids) for r in graph.routes(pairs, edges, 90, most).collect()} for most in (graph.MOST_EDGES, 0)]
    assert {k: v[0] for k, v in found[0].items() if v[0] is not None} == want
    # a route's nodes and edges are the same from both engines, ties included
    assert found[0] == found[1]
    trees = [sorted(map(tuple, graph.cheapest(origins, edges, 90, most).collect()), key=str) for most in (graph.MOST_EDGES, 0)]
    assert trees[0] == trees[1]


def test_route_shapes(spark):
    """Edges walked backwards, a joint that is there once, positions that repeat within an edge, gaps, and a route without edges."""
    a, b, c, d = (11.0, 48.0), (12.0, 48.0), (13.0, 48.0), (14.0, 48.0)
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate((a, b, c, d))], "node_id long, lon double, lat double")
    lines = [(1, 0, 1, 1, False, 10.0, [a, (11.5, 48.0), b]), (2, 2, 1, 2, False, 20.0, [c, c, (12.5, 48.0), b]), (3, 2, 3, 3, False, 30.0, [(13.1, 48.0), d])]
    edges = spark.createDataFrame(lines, f"{EDGES}, distance double, line array<struct<x:double,y:double>>")
    pairs = spark.createDataFrame([(0, 3), (3, 0), (0, 0), (0, 9)], "origin long, target long")
    want = [a, (11.5, 48.0), b, (12.5, 48.0), c, c, (13.1, 48.0), d]
    for most in (10, 0):
        found = graph.route_shapes(graph.routes(pairs, edges, 100, most), nodes, edges)
        rows = {(r.origin, r.target): (r.cost, r.distance, r.line and [tuple(p) for p in r.line]) for r in found.collect()}
        assert rows == {(0, 3): (6, 60, want), (3, 0): (6, 60, want[::-1]), (0, 0): (0, 0, [a]), (0, 9): (None, None, None)}


def test_starts_are_snapped_to_nodes(spark):
    nodes = spark.createDataFrame([(1, 10.0, 48.0), (2, 11.0, 48.0), (3, -179.9, 0.0)], "node_id long, lon double, lat double")
    asked = spark.createDataFrame([(1, 2, None, None), (2, None, 10.1, 48.0), (3, 99, 179.9, 0.0)], "request_id long, node_id long, lon double, lat double")
    rows = {r.request_id: (r.node_id, r.start_distance) for r in graph.snapped(asked, nodes).collect()}
    assert rows[1] == (2, 0) and rows[2][0] == 1 and rows[3][0] == 3 and 7_000 < rows[2][1] < 8_000


def test_nearest_engines_give_the_same_rows(spark):
    """Both engines over the whole world, its seam and poles, with nodes that are equally near."""
    rng = random.Random(8)
    nodes = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(200)] + [(500, 50.0, 10.0), (400, 50.0, 10.0)]
    asked = [(i, rng.choice([-180.0, 180.0, rng.uniform(-180, 180)]), rng.choice([-89.9, 89.9, rng.uniform(-90, 90)])) for i in range(60)] + [(99, 50.0, 10.0)]
    p, n = spark.createDataFrame(asked, "point_id long, lon double, lat double"), spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    found = [{r.point_id: (r.node_id, round(r.metres, 3)) for r in spatial.nearest_node(p, n, cell=30, few=few).collect()} for few in (10**6, 0)]
    assert found[0] == found[1] and found[0][99] == (400, 0) and len(found[0]) == 61
    assert spatial.nearest_node(p, n.limit(0)).collect() == []


def twin_merge(parts):
    """Lines taken from the end, each extended at both ends by the last that fits, over and over."""
    waiting, out = list(enumerate(parts)), []
    while waiting:
        k, line = waiting.pop()
        again = True
        while again:
            again = False
            for i in range(len(waiting) - 1, -1, -1):
                other = waiting[i][1]
                if line[-1] == other[0]:
                    line = line + other[1:]
                elif other[-1] == line[0]:
                    line = other + line[1:]
                else:
                    continue
                del waiting[i]
                again = True
        out.append((k, line))
    return out


@pytest.mark.parametrize("most", [None, 60])
def test_merged_lines_equal_a_plain_loop(spark, most):
    rng = random.Random(11)
    rows = [(g, i, [(float(rng.randrange(n)), 0.0), (float(rng.randrange(n)), 1.0) if i % 9 == 0 else (float(rng.randrange(n)), 0.0)]) for g, n, size in ((1, 12, 50), (2, 300, 80), (3, 3, 6)) for i in range(size)]
    df = spark.createDataFrame(rows, "g long, seq long, line array<struct<x:double,y:double>>")
    got = sorted((r.g, r.line_no, [tuple(p) for p in r.line]) for r in shapes.merged_lines(df, "g", most).collect())
    want = []
    for g in (1, 2, 3):
        mine = [line for k, _, line in rows if k == g]
        if most is not None and len(mine) > most:
            merged = list(enumerate(mine))[::-1]
        else:
            merged = twin_merge(mine)
        want += [(g, i, line) for i, (_, line) in enumerate(sorted(merged, key=lambda m: -m[0]))]
    assert got == sorted(want)


def test_labels_may_overlap_or_leave_their_place(spark):
    rows = [(1, 1, 5, 0.0, 0.0, 0.0, 2.0, 2.0, False, False), (1, 2, 4, 0.0, 1.0, 1.0, 3.0, 3.0, True, False), (1, 3, 3, 0.0, 2.5, 2.5, 4.0, 4.0, False, False), (1, 4, 9, 0.0, 9.0, 9.0, 10.0, 10.0, False, True), (1, 5, 1, 0.0, 9.0, 9.0, 10.0, 10.0, False, False)]
    df = spark.createDataFrame(rows, "g long, label_id long, priority long, sort_key double, w double, s double, e double, n double, allow_overlap boolean, ignore_placement boolean")
    assert sorted(r.label_id for r in shapes.thin_labels(df, ["g"]).collect()) == [1, 2, 4, 5]
    assert sorted(r.label_id for r in shapes.thin_labels(df.drop("allow_overlap", "ignore_placement"), ["g"], most=3).collect()) == [1, 4]
    many = spark.range(5000).selectExpr("1 AS g", "id AS label_id", "0 AS priority", "double(id) AS sort_key", "3.0D * id AS w", "0D AS s", "3.0D * id + 1 AS e", "1D AS n")
    assert shapes.thin_labels(many, ["g"]).count() == 5000


def test_long_rings_are_tested_for_crossings():
    turn = np.linspace(0, 2 * np.pi, 3001)
    ring = np.column_stack([np.cos(turn), np.sin(turn)])
    ring[-1] = ring[0]
    assert not validate.crosses(ring)
    ring[1500] = (2.0, 0.5)
    assert validate.crosses(ring)


def test_named_colours():
    assert len(expressions_colours()) == 149 and X.parse_color("RebeccaPurple") == (102, 51, 153, 1) and X.parse_color("mediumseagreen") == (60, 179, 113, 1)


def expressions_colours():
    from mapfold.functions import expressions

    return expressions.NAMED


def test_sequences_are_split_between_tasks(spark, tmp_path):
    point = lambda i: json.dumps({"type": "Feature", "id": f"f{i}", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    (tmp_path / "a.json").write_text("\n" + "".join(f"\x1e{point(i)}\n" for i in range(400)) + "\x1e{bad\n")
    (tmp_path / "b.json").write_text("leading\x1e" + point(999))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, errors = geojson.read_sequence(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        assert sorted(r.fid for r in rows.collect()) == sorted([f"f{i}" for i in range(400)] + ["f999"])
        assert sorted((r.source.rsplit("/", 1)[1], r.code) for r in errors.collect()) == [("a.json", "json"), ("b.json", "leading-text")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tile_ids_of_all_kinds():
    assert tiles.id_columns(None) == (None, None, None) and tiles.id_columns(5) == (5, "5", "num") and tiles.id_columns(5.0) == (5, "5", "num")
    assert tiles.id_columns("a") == (None, "a", "str") and tiles.id_columns(1.5) == (None, "1.5", "num") and tiles.id_columns(2**63) == (None, str(2**63), "num")


def test_diff_order_and_errors(spark):
    schema = "fid string, geometry string, props map<string,string>"
    features = spark.createDataFrame([("1", "a", {"k": "v"}), ("2", "b", None)], schema)
    diff = spark.createDataFrame([("update", "1", None, None, ["k"], {"n": "1"}), ("remove", "2", None, None, None, None), ("add", "2", "new", None, None, {"x": "y"}), ("update", "9", "z", None, None, None)], "op string, fid string, geometry string, clear boolean, unset array<string>, props map<string,string>")
    got = {r.fid: (r.geometry, r.props) for r in changes.apply_diff(features, diff).collect()}
    assert got == {"1": ("a", {"n": "1"}), "2": ("new", {"x": "y"})}
    everything = diff.unionByName(spark.createDataFrame([("remove_all", None, None, None, None, None)], diff.schema))
    assert [r.fid for r in changes.apply_diff(features, everything).collect()] == ["2"]
    again = spark.createDataFrame([("add", "1", None, None, None, None), ("add", None, None, None, None, None)], diff.schema)
    assert {(r.fid, r.code) for r in changes.unknown_or_repeated(features, again).collect()} == {("1", "existing_id"), (None, "null_id")}


def test_replay():
    steps = [("add", "a", "1"), ("add", "b", "1"), ("undo", None, None), ("redo", None, None), ("remove", "a", None), ("undo", None, None), ("clear", None, None), ("undo", None, None), ("undo", None, None), ("update", "z", "1")]
    now, undo, redo = changes.replay(steps)
    assert (sorted(now), undo, redo) == (["a"], 1, 2)
    assert changes.replay([("add", str(i), "x") for i in range(9)] + [("undo", None, None)] * 9, history=3)[0].keys() == {str(i) for i in range(6)}


def test_issues(spark):
    ring = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    rows = [(1, "Polygon", [ring]), (2, "Polygon", [ring[:3]]), (3, "LineString", [[(0.0, 0.0)]]), (4, "Point", [[(200.0, 5.0)]]), (5, "Point", [[(1.0, None)]]), (6, "Polygon", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])]
    df = spark.createDataFrame(rows, "feature_seq long, geom_type string, parts array<array<struct<x:double,y:double>>>")
    assert sorted((r.feature_seq, r.code) for r in validate.issues(df).collect()) == [(1, "self-intersection"), (2, "ring-length"), (2, "ring-open"), (3, "line-length"), (4, "mercator-range"), (5, "coordinate")]
    top = validate.top_issues(validate.issues(df.filter("feature_seq >= 4")), 1).collect()
    assert [r.severity for r in top] == ["error"]


def test_heat_points(spark):
    df = spark.createDataFrame([(1, None, None), (2, "2.5", "1000"), (3, "-1", None), (4, "x", None), (5, "1", "2024-01-02 03:04:05"), (6, "1", "soon")], "i long, weight string, time string")
    good, bad = validate.heat_points(df)
    assert {r.i: (r.weight, r.time_ms) for r in good.collect()} == {1: (1.0, None), 2: (2.5, 1000), 5: (1.0, 1704164645000)}
    assert {r.i for r in bad.collect()} == {3, 4, 6}


def test_relief_and_shading():
    stops = [(0.0, (0, 0, 0, 1.0)), (1000.0, (255, 0, 0, 1.0)), (2000.0, (255, 0, 0, 0.5))]
    h = np.array([[-500.0, 0.0, 500.0], [1000.0, 1500.0, 3000.0], [np.nan, 0.0, 0.0]])
    out = elevation.relief(h, stops)
    assert out[0, 0].tolist() == [0, 0, 0, 255] and out[1, 0].tolist() == [255, 0, 0, 255] and out[1, 2].tolist() == [255, 0, 0, 128] and out[2, 0, 3] == 0
    slope = np.tile(np.arange(16) * 3000.0, (16, 1))
    west, east = elevation.hillshade(slope, 10, 300, 270.0), elevation.hillshade(slope, 10, 300, 90.0)
    tone = lambda s: float((s[4:-4, 4:-4, 0] * (s[4:-4, 4:-4, 3] / 255)).mean())
    assert tone(west) > tone(east) + 20
    assert elevation.hillshade(np.zeros((4, 4)), 10, 300)[..., 3].max() == 0 and elevation.hillshade(slope, 10, 300, exaggeration=0).max() == 0
    assert elevation.heights(bytes([128, 10, 64, 255] * 4), elevation.ENCODINGS["terrarium"])[0, 0] == 10.25


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    return b"".join(varint(k << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for k, v in fields)


def vector_tile(version=2, tags=(0, 0)):
    geometry = b"".join(map(varint, [9, 0, 0, 10, 8192, 0]))
    feature = message((1, 2**60), (2, bytes(tags)), (3, 2), (4, geometry))
    layer = message((1, b"roads"), (2, feature), (3, b"kind"), (4, message((1, b"main"))), (5, 4096), (15, version))
    return message((3, layer))


def test_vector_tiles(spark):
    df = spark.createDataFrame([(1, 0, 0, bytearray(vector_tile())), (1, 0, 1, bytearray(vector_tile(1))), (1, 1, 0, bytearray(vector_tile(tags=(0, 7)))), (1, 1, 1, bytearray(vector_tile()[:-2]))], "z int, x long, y long, data binary")
    rows = tiles.decode_mvt(df).orderBy("x", "y").collect()
    assert (rows[0].layer, rows[0].fid, rows[0].kind, rows[0].props) == ("roads", 2**60, 2, '{"kind":"main"}')
    assert [(p.x, p.y) for p in rows[0].parts[0]] == [(0, 0), (4096, 0)]
    assert all(r.error for r in rows[1:])


def test_tile_archives(spark):
    leaf = b"".join(map(varint, [2, 5, 3, 1, 2, 10, 20, 1, 0]))
    packed_leaf = gzip.compress(leaf)
    root = gzip.compress(b"".join(map(varint, [2, 0, 5, 1, 0, 7, len(packed_leaf), 1, 1])))
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, 127 + len(root), len(packed_leaf), 1000, 0) + bytes(25) + bytes([2, 1, 1, 0, 3]) + bytes(25)
    whole = head + root + packed_leaf
    df = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(b"nothing" * 30))], "path string, content binary")
    rows = tiles.read_archive_index(df).orderBy("source", "tile_id").collect()
    assert [(r.tile_id, r.run, r.offset, r.length) for r in rows[:3]] == [(0, 1, 1000, 7), (5, 1, 1000, 10), (8, 2, 1010, 20)]
    assert rows[3].error


def test_tile_archives_are_read_by_ranges(spark, tmp_path):
    leaf = gzip.compress(b"".join(map(varint, [2, 5, 3, 1, 2, 10, 20, 1, 0])))
    root = gzip.compress(b"".join(map(varint, [2, 0, 5, 1, 0, 7, len(leaf), 1, 1])))
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, 127 + len(root), len(leaf), 1000, 0) + bytes(25) + bytes([2, 1, 1, 0, 3]) + bytes(25)
    (tmp_path / "a.pmtiles").write_bytes(head + root + leaf)
    (tmp_path / "b.pmtiles").write_bytes(b"nothing" * 30)
    uris = spark.createDataFrame([(f"file://{tmp_path}/{n}.pmtiles",) for n in "abc"], "source string")
    rows = tiles.read_archives(uris).orderBy("source", "tile_id").collect()
    assert [(r.tile_id, r.run, r.offset, r.length) for r in rows[:3]] == [(0, 1, 1000, 7), (5, 1, 1000, 10), (8, 2, 1010, 20)]
    assert len(rows) == 5 and rows[3].error and rows[4].error
    deep = [r.error for r in tiles.read_archives(uris.filter("source like '%a.pmtiles'"), 0).collect() if r.error]
    assert deep == ["directories are too deep"]


def test_tolerance():
    assert geometry.lod_tolerance(14, 0.1) > 0 and geometry.lod_tolerance(14, 100) == 0


def test_kernels():
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 1)], float)
    assert shapes.simplified(line, 0.1, False).tolist() == [[0, 0], [2, 0], [3, 1]]
    triangle = np.array([(0, 0), (0.01, 0), (0, 0.01), (0, 0)], float)
    assert len(shapes.simplified(triangle, 5, True)) == 4
    square = shapes.clipped(np.array([(-1, -1), (3, -1), (3, 3), (-1, 3)], float), 0, 2)
    assert sorted(map(tuple, square.tolist())) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert len(shapes.clipped(np.array([(5, 5), (6, 5), (6, 6)], float), 0, 2)) == 0
    assert shapes.merge_lines([[(0, 0), (1, 0)], [(2, 0), (3, 0)], [(1, 0), (2, 0)]]) == [[(0, 0), (1, 0), (2, 0), (3, 0)]]
    # taken from the end of the list
    assert shapes.merge_lines([[(0, 0), (1, 0)], [(2, 0), (1, 0)]]) == [[(2, 0), (1, 0)], [(0, 0), (1, 0)]]
    # A from 0 to 1, B from 2 to 1, C from 1 to 3: C is taken first and B, the last that fits, leads to it
    assert shapes.merge_lines([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(1, 0), (3, 0)]]) == [[(2, 0), (1, 0), (3, 0)], [(0, 0), (1, 0)]]
    assert shapes.place_labels([(0, 0, 0, 0, 2, 2, False, False), (1, 0, 1, 1, 3, 3, False, False), (0, 1, 3, 3, 4, 4, False, False), (0, 2, 0, 0, 1, 1, True, True)]) == [False, True, True, True]
    assert shapes.grid_interval(2) == 30 and shapes.grid_interval(10) == 0.1 and shapes.grid_interval(10, 80) == 1
    assert len(shapes.color_table([(0, "transparent"), (1, "red")])) == 256


def test_streamed_state_goes_on_after_a_restart(spark, tmp_path):
    first = spark.createDataFrame([("1", "at", {"a": "b"})], "fid string, geometry string, props map<string,string>")
    schema = "op string, fid string, geometry string, clear boolean, unset array<string>, props map<string,string>"
    folder, state, progress = (f"{tmp_path}/{n}" for n in ("diffs.parquet", "state", "progress"))
    row = lambda fid, at: spark.createDataFrame([("update" if fid == "1" else "add", fid, at, None, None, {})], schema).coalesce(1)
    row("1", "moved").write.parquet(folder)
    # a table that is a folder of files is read too
    run = lambda: {r.fid: r.geometry for r in updates.source_updates(first, updates.read_table_stream(spark, str(tmp_path), "diffs"), state, progress).collect()}
    assert run() == {"1": "moved"}
    assert run() == {"1": "moved"}
    row("2", "new").write.mode("append").parquet(folder)
    assert run() == {"1": "moved", "2": "new"}
    assert len(updates.versions(spark, state)) == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        updates.read_table_stream(spark, str(tmp_path), "nothing")


def test_windows_of_history_and_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "x-1"), (5, None)], "feature_seq long, fid string")
    assert [r.fid for r in changes.repair_ids(df, "x").orderBy("feature_seq").collect()] == ["a", "x-2", "x-3", "x-1", "x-4"]
    assert changes.keep_last(df, "fid", "feature_seq", 0).count() == 0


def test_columnar_tiles():
    data = tiles.encode_columnar_points("p", [(7, 3, -4, "a"), (-9, 5, 6, "b"), (2**40, 0, 0, "a")])
    assert [(r[3], r[5], r[6]) for r in tiles.decode_columnar(data)] == [(7, [[(3, -4)]], '{"kind":"a"}'), (-9, [[(5, 6)]], '{"kind":"b"}'), (2**40, [[(0, 0)]], '{"kind":"a"}')]
    for bad in (data + b"x", data[:-1], b"MMT\x02" + data[4:]):
        with pytest.raises(ValueError):
            tiles.decode_columnar(bad)


def test_area_tags(spark):
    rows = [(1, {"building": "no"}), (2, {"building": "yes"}), (3, {"landuse": "farm", "area": "no"}), (4, {"highway": "path", "area": "yes"}), (5, {"natural": "water"}), (6, {"natural": "tree"}), (7, {"leisure": "track"}), (8, {"leisure": "park"}), (9, {"shop": ""}), (10, {})]
    df = spark.createDataFrame(rows, "i int, tags map<string,string>")
    assert {r.i for r in df.filter(osm.is_area(F.col("tags"))).collect()} == {2, 4, 5, 8}


def test_lines_are_ordered_by_their_ends_a_group_at_a_time():
    """groups cut by batches, of which Python sees the ends alone."""
    rows = [(1, 1, 1, 5, 0.0, 1.0), (1, 1, 2, 6, 1.0, 2.0), (1, 1, 3, 9, 7.0, 0.0), (1, 2, 1, 7, 4.0, 5.0), (2, 1, 1, 5, 0.0, 1.0), (2, 1, 2, 8, 1.0, 3.0)]
    names = ["g", "label", "k", "seq", "_ax", "_ay", "_bx", "_by"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((g, label, k, seq, a, 0.0, b, 0.0) for g, label, k, seq, a, b in rows))], names)
    want = [(1, 1, 3, 9, 0), (1, 1, 1, 9, 1), (1, 1, 2, 9, 2), (1, 2, 1, 7, 0), (2, 1, 1, 8, 0), (2, 1, 2, 8, 1)]
    for step in (1, 2, 6):
        out = list(shapes.orders(batch.slice(i, step) for i in range(0, 6, step)))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want and len(out) == 3
