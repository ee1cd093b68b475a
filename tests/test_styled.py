"""Style layers: what they read, groups against rows one by one, and hits against plain geometry."""

import json
import math
import random

from pyspark.sql import functions as F

from mapfold.operators import styled

SCHEMA = "feature_id string, feature_seq long, source_layer string, geometry_type string, parts array<array<struct<x:double,y:double>>>, p string"


def features(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("props", F.parse_json("p")).drop("p")


def point(x, y):
    return [[(float(x), float(y))]]


def test_reads():
    assert styled.reads(["match", ["get", "a"], ["get", "b"], ["get", "c"], 1]) == {("get", "a"), ("get", "c")}  # labels read nothing
    assert styled.reads(["all", ["==", "$type", "Point"], ["in", "k", 1, 2], ["has", "v"]]) == {("geometry-type", ""), ("get", "k"), ("get", "v")}
    assert styled.reads(["interpolate", ["linear"], ["zoom"], 0, ["get", "w"], 9, ["literal", ["get", "x"]]]) == {("get", "w")}
    assert styled.reads(["let", "n", ["id"], ["concat", ["var", "n"], ["feature-state", "on"]]]) == {("id", ""), ("feature-state", "")}
    assert styled.reads(["get", "a", ["properties"]]) == {("properties", "")}
    assert styled.reads({"property": "w", "stops": [[0, 1], [9, 5]]}) == {("get", "w")}
    layer = {"id": "a", "type": "symbol", "layout": {"text-field": ["get", "name"], "text-size": ["get", "s"]}}
    assert styled.layer_reads(layer) == [("get", "s")]


def test_properties_of_any_name(spark):
    from mapfold.functions.expressions import Row, compile_expression

    names = ['a"b', "a'b", "a\"'b", "a\\b", "", "a]b", "$", "a.b"]
    df = spark.createDataFrame([(json.dumps({n: i + 1 for i, n in enumerate(names)}),)], "p string").select(F.parse_json("p").alias("p"))
    got = df.select(*(compile_expression(["get", n], Row(props=F.col("p"))).num.alias(f"c{i}") for i, n in enumerate(names))).first()
    assert list(got) == [float(i + 1) for i in range(len(names))]


def test_groups_give_what_rows_give(spark):
    rng = random.Random(5)
    values = [None, True, "3", 3, 3.5, "", [1], {"a": 1}, "NaN", 1e300]
    rows = []
    for i in range(300):
        props = {k: rng.choice(values) for k in ("r", 'o"\\]', ".t") if rng.random() < 0.8}
        rows.append((f"f{i % 290}", i, "s", rng.choice(["Point", "MultiPoint", "Polygon", None]), point(i, i), json.dumps(props)))
    rows.append((None, None, None, "Point", None, None))
    layers = [
        {"id": "c", "type": "circle", "paint": {"circle-radius": ["get", "r"], "circle-opacity": ["case", ["has", 'o"\\]'], ["to-number", ["get", 'o"\\]'], 0.5], 1], "circle-stroke-width": ["case", ["==", ["typeof", ["get", ".t"]], "string"], 2, -1]}},
        {"id": "ids", "type": "circle", "filter": ["has", "r"], "paint": {"circle-radius": ["length", ["id"]], "circle-color": ["case", ["==", ["geometry-type"], "Point"], "red", "blue"]}},
        {"id": "all", "type": "symbol", "paint": {"text-size": ["length", ["to-string", ["properties"]]]}},
        {"id": "plain", "type": "fill", "paint": {"fill-color": "#123456"}},
        {"id": "off", "type": "circle", "layout": {"visibility": "none"}},
    ]
    df = features(spark, rows)
    single = styled.resolve_style(df, layers, 9)
    members = styled.style_members(df, layers, 9)
    groups = styled.style_groups(members, layers, 9)
    key = ["layer", "feature_id", "feature_seq"]
    joined = members.join(groups, ["layer", "place", "seen"]).select(*key, *styled.PAINT)
    want, got = (sorted(map(repr, map(tuple, d.select(*key, *styled.PAINT).collect()))) for d in (single, joined))
    kinds = [(r[3], "r" in json.loads(r[5] or "{}")) for r in rows]
    typed = sum(k is not None for k, _ in kinds)  # without a type of geometry nothing is drawn
    assert got == want and len(want) == typed + sum(k == "Polygon" for k, _ in kinds) + sum((1 + r) * (k in ("Point", "MultiPoint")) for k, r in kinds)
    by_layer = {r["layer"]: (r["g"], r["n"]) for r in groups.groupBy("layer").agg(F.count("*").alias("g"), F.sum("n").alias("n")).collect()}
    assert by_layer["plain"][0] == 1 and by_layer["plain"][1] > 50
    assert by_layer["all"][0] <= by_layer["all"][1] == typed
    assert "off" not in by_layer
    # values of different types are groups of their own
    c = members.filter("layer = 'c'").select("seen").distinct().count()
    assert by_layer["c"][0] == c > 100


def test_no_layer_and_no_feature(spark):
    df = features(spark, [("a", 1, "s", "Point", point(0, 0), "{}")])
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "point_id long, x double, y double")
    dots = [{"id": "d", "type": "circle"}]
    for layers in ([], [{"id": "b", "type": "background"}], [{"id": "d", "type": "circle", "minzoom": 10}]):
        assert styled.resolve_style(df, layers, 9).isEmpty()
        assert styled.style_groups(styled.style_members(df, layers, 9), layers, 9).isEmpty()
        assert styled.layer_hits(points, df, layers, 9).isEmpty()
    assert styled.layer_hits(points, df.limit(0), dots, 9).isEmpty()
    assert [r["point_id"] for r in styled.layer_hits(points, df, dots, 9).collect()] == [1]


def test_hits_follow_paint(spark):
    square = [[(100.0, 100.0), (140.0, 100.0), (140.0, 140.0), (100.0, 140.0), (100.0, 100.0)]]
    rows = [
        ("a:b", 7, "s", "Polygon", square, '{"o": 1}'), ("hidden", 8, "s", "Polygon", square, '{"o": 0}'),
        ("line", 9, "s", "LineString", [[(0.0, 0.0), (50.0, 0.0)]], '{"o": 1}'), ("ring", 10, "s", "Point", point(200, 200), '{"o": 0}'),
        ("pair", 11, "s", "MultiPoint", [[(300.0, 0.0)], [(400.0, 0.0)]], '{"o": 1}'), ("nothing", 12, "s", "Polygon", [], '{"o": 1}'), (None, 13, "s", "Point", point(200, 200), "{}"),
    ]
    opacity = ["get", "o"]
    layers = [
        {"id": "fill", "type": "fill-extrusion", "paint": {"fill-extrusion-opacity": opacity}},
        {"id": "line", "type": "line", "paint": {"line-width": 4}},
        {"id": "dot", "type": "circle", "paint": {"circle-opacity": opacity, "circle-stroke-width": 2}},
        {"id": "heat", "type": "heatmap", "paint": {"heatmap-radius": 200}},
        {"id": "text", "type": "symbol", "paint": {"text-opacity": opacity, "text-size": 20}},
    ]
    df = features(spark, rows)
    asked = {1: (101, 101), 2: (120, 120), 3: (25, 4), 4: (25, 6), 5: (207, 200), 6: (212, 200), 7: (405, 0), 8: (300, 12), 9: (25, 12)}
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in asked.items()], "point_id long, x double, y double")
    hits = styled.layer_hits(points, df, layers, 9, tolerance=3)
    got = {k: [] for k in asked}
    for r in styled.ranked_hits(hits).orderBy("point_id", "rank").collect():
        got[r["point_id"]].append((r["layer"], r["feature_id"]))
    assert got == {
        1: [("fill", "a:b")], 2: [("text", "a:b"), ("fill", "a:b")], 3: [("text", "line"), ("line", "line")], 4: [("text", "line")], 5: [("dot", "ring")], 6: [],
        7: [("dot", "pair")], 8: [("text", "pair")], 9: [("text", "line")],
    }
    only = styled.layer_hits(points, df, layers, 9, only=["fill", "heat"], where=["==", ["get", "o"], 1])
    assert sorted((r["point_id"], r["feature_id"]) for r in only.collect()) == [(1, "a:b"), (2, "a:b")]


def test_hits_equal_plain_distances_and_ranks(spark):
    rng = random.Random(8)
    dots = [(f"d{i}", i, rng.choice("ab"), "Point", point(rng.randrange(200), rng.randrange(200)), json.dumps({"r": rng.choice([0, 2.25, 7.25, None])})) for i in range(400)]
    layers = [{"id": s, "type": "circle", "source-layer": s, "paint": {"circle-radius": ["get", "r"]}} for s in "ba"]
    asked = [(i, float(rng.randrange(200)), float(rng.randrange(200))) for i in range(60)]
    points = spark.createDataFrame(asked, "point_id long, x double, y double")
    want = []
    for i, x, y in asked:
        found = []
        for name, seq, source, _, parts, p in dots:
            r = json.loads(p)["r"]
            if math.dist((x, y), parts[0][0]) <= (5 if r is None else r) + 3:
                found.append(("ba".index(source), seq, name))
        want += [(i, n + 1, name) for n, (_, _, name) in enumerate(sorted(found, reverse=True))]
    hits = styled.layer_hits(points, features(spark, dots), layers, 0).checkpoint()
    rows = lambda df: sorted((r["point_id"], r["rank"], r["feature_id"]) for r in df.collect())
    assert rows(styled.ranked_hits(hits)) == sorted(want)
    assert rows(styled.ranked_hits(hits, 1)) == sorted(w for w in want if w[1] == 1)
    few = styled.ranked_hits(hits, 3)
    assert rows(few) == sorted(w for w in want if w[1] <= 3)
    # ranks are limited before the shuffle
    assert "WindowGroupLimit" in few._jdf.queryExecution().toString()
