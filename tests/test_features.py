"""Arrays between stops, tiles ahead of what moves, and features as heat points."""

import json

from pyspark.sql import functions as F

from mapfold.functions.expressions import Row, compile_expression
from mapfold.operators import changes, validate


def test_arrays_blend_item_by_item(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (5.0,), (10.0,), (None,)], "k double").select("k", F.to_variant_object(F.struct("k")).alias("p"))
    ramp = lambda a, b: compile_expression(["interpolate", ["linear"], ["get", "k"], 0, ["literal", a], 10, ["literal", b]], Row(props=F.col("p"))).json
    got = df.select("k", ramp([0, [1, 2], "a\"", True, "#000"], [8, [3, 0], "b", None, "#fff"]).alias("v"), ramp([1, 2], [3]).alias("other")).collect()
    read = {r["k"]: json.loads(r["v"]) if r["v"] else None for r in got}
    assert read[0.0][:4] == [0, [1, 2], 'a"', True] and read[10.0][:4] == [8, [3, 0], "b", None]
    assert read[2.5][:4] == [2, [1.5, 1.5], 'a"', True] and read[5.0][:4] == [4, [2, 1], "b", None]
    assert read[2.5][4].startswith("rgba(64,64,64") and read[None] is None
    assert {r["k"]: r["other"] for r in got} == {0.0: "[1,2]", 2.5: "[1,2]", 5.0: "[3]", 10.0: "[3]", None: None}  # of two lengths


def test_tiles_ahead(spark):
    rows = [("still", 4, 1.0, 1.0, 90.0, 0.0, 60.0), ("east", 4, 1.0, -1.0, 90.0, 50_000.0, 60.0), ("over", 4, 179.0, -1.0, 90.0, 50_000.0, 60.0), ("fast", 4, 1.0, -1.0, 90.0, 1e9, 1e9), ("top", 4, 1.0, 85.0, 0.0, 50_000.0, 60.0), ("lost", 4, 1.0, 1.0, None, 9.0, 9.0), ("null", 4, 1.0, 1.0, 90.0, None, 60.0)]
    moving = spark.createDataFrame(rows, "name string, z int, lon double, lat double, heading double, speed double, seconds double")
    got = {}
    for r in changes.corridor_ahead(moving, width=0).collect():
        got.setdefault(r["name"], []).append((r["x"], r["y"]))
    # 3,000 km are 1.2 tiles of 2,505 km: two steps from 8.04, or from 15.96, each rounded
    assert sorted(got["east"]) == [(9, 8), (10, 8)] and sorted(got["over"]) == [(1, 8), (2, 8)]
    assert len(got["fast"]) == 16 and not {"still", "lost", "top", "null"} & got.keys()
    assert {r["name"] for r in changes.corridor_ahead(moving, distance=1).collect()} == {"still", "east", "over", "fast", "null"}  # north of the top row is nothing


def test_heat_features(spark):
    nan = float("nan")
    rows = [
        (1, "Point", [[(1.0, 2.0)]], "{}"), (2, "MultiPoint", [[(1.0, 2.0)], [(3.0, 4.0), (5.0, 6.0)]], '{"weight": "2.5", "time": 7}'), (3, "LineString", [[(1.0, 2.0)]], '{"weight": -1}'),
        (4, "Point", [[(1.0, 2.0)]], '{"weight": -1}'), (5, "Point", [[(1.0, 2.0)]], '{"weight": "x"}'), (6, "Point", [[(nan, 2.0)]], '{"weight": null}'), (7, "Point", [[(1.0, 2.0)]], '{"time": "never"}'),
        (8, "Point", [[(1.0, 2.0)]], '{"time": "1970-01-01 00:00:01", "weight": true}'), (9, None, None, None), (10, "MultiPoint", [], '{"weight": ""}'), (11, "Point", [[(1.0, 2.0)]], '{"weight": [1]}'), (12, "Point", [[(1.0, 2.0)]], None), (12, "Point", [[(1.0, None)]], '{"time": ""}'),
    ]
    df = spark.createDataFrame(rows, "feature_id long, geometry_type string, parts array<array<struct<x:double,y:double>>>, p string").withColumn("props", F.parse_json("p"))
    points, refused = validate.heat_features(df)
    assert sorted(map(tuple, points.collect()), key=str) == sorted([(1, 1.0, 2.0, 1.0, None), (2, 1.0, 2.0, 2.5, 7), (2, 3.0, 4.0, 2.5, 7), (2, 5.0, 6.0, 2.5, 7), (8, 1.0, 2.0, 1.0, 1000), (12, 1.0, 2.0, 1.0, None)], key=str)
    assert sorted(map(tuple, refused.collect())) == [(4, "weight"), (5, "weight"), (6, "coordinates"), (7, "time"), (11, "weight"), (12, "coordinates")]
