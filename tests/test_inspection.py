"""Inspection of features against a plain recursive walk."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapfold.operators import inspection, validate


def number(v):
    """A finite number that a coordinate counts as, or None."""
    if v is None:
        return 0.0
    if isinstance(v, (bool, int, float)):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, str):
        try:
            return float(v) if v.strip() else 0.0
        except ValueError:
            return None
    return None


def same(a, b, k):
    """Whether two positions have one value at k, or both none; arrays and objects are never the same."""
    x, y = (p[k] if len(p) > k else "absent" for p in (a, b))
    return x == y and isinstance(x, bool) == isinstance(y, bool) and not isinstance(x, (list, dict))


def walk(feature, k):
    """(feature, code, path) in reading order, and the number of positions."""
    out, count = [], 0

    def say(code, path):
        out.append((k, code, path))

    def point(v, path):
        nonlocal count
        count += 1
        xy = [number(c) for c in v[:2]] if isinstance(v, list) and len(v) >= 2 else [None]
        if None in xy:
            say("coordinate", path)
        elif abs(xy[0]) > 180 or abs(xy[1]) > 85.05112878:
            say("mercator-range", path)

    def nest(v, depth, path):
        if depth == 0:
            point(v, path)
        elif not isinstance(v, list):
            say("coordinates", path)
        else:
            for i, x in enumerate(v):
                nest(x, depth - 1, f"{path}[{i}]")

    def crossing(ring):
        p = [[number(c) for c in q[:2]] if isinstance(q, list) and len(q) >= 2 else [None] for q in ring]
        side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        edges = [(a, b) for a, b in zip(p, p[1:]) if None not in a + b]
        return any(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for i, (a, b) in enumerate(edges) for c, d in edges[:i])

    def geometry(g, path, depth=0):
        if depth > 32:
            say("geometry-depth", path)
        elif g is None:
            return
        elif not isinstance(g, (dict, list)):
            say("geometry", path)
        elif isinstance(g, list) or g.get("type") not in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"):
            say("geometry-type", path)
        elif g["type"] == "GeometryCollection":
            if not isinstance(g.get("geometries"), list):
                say("geometry", path)
            for i, x in enumerate(g.get("geometries") if isinstance(g.get("geometries"), list) else []):
                geometry(x, f"{path}.geometries[{i}]", depth + 1)
        elif g["type"] in ("Polygon", "MultiPolygon"):
            c = g.get("coordinates")
            if not isinstance(c, list) or not c:
                return say("polygon", path)
            for i, rings in enumerate(c if g["type"] == "MultiPolygon" else [c]):
                if not isinstance(rings, list) or not rings:
                    say("polygon", path)
                    continue
                for j, ring in enumerate(rings):
                    at = f"{path}.coordinates" + (f"[{i}]" if g["type"] == "MultiPolygon" else "") + f"[{j}]"
                    if not isinstance(ring, list) or len(ring) < 4:
                        say("ring-length", at)
                        continue
                    for m, p in enumerate(ring):
                        point(p, f"{at}[{m}]")
                    a, b = ring[0], ring[-1]
                    if isinstance(a, list) and isinstance(b, list) and not (same(a, b, 0) and same(a, b, 1)):
                        say("ring-open", at)
                    if crossing(ring):
                        say("self-intersection", at)
        else:
            c = g.get("coordinates")
            if g["type"] == "LineString" and (not isinstance(c, list) or len(c) < 2):
                say("line-length", path)
            nest(c, {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2}[g["type"]], path + ".coordinates")

    if not isinstance(feature, dict) or feature.get("type") != "Feature":
        say("feature", f"$.features[{k}]")
    else:
        geometry(feature.get("geometry"), f"$.features[{k}].geometry")
    return out, count


def made(rng):
    """A feature, good or bad in many ways."""
    position = lambda: rng.choice([[rng.randint(-9, 9), rng.randint(-9, 9)]] * 12 + [[200, 1], [1, 89.5], ["3", "4"], ["x", 1], [None, 2], [1], "p", None, {}, [True, 5, 6], ["", 1], [[], 1], [1e5, "1e1"]])
    some = lambda low, high, f: [f() for _ in range(rng.randint(low, high))]
    odd = lambda v: rng.choice([v] * 15 + [None, 5, "c", {}, []])

    def ring():
        r = some(2, 7, position)
        return odd(r + [r[0]] if rng.random() < 0.8 else r)

    def geometry(depth=0):
        kind = rng.choice(["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection", "Polygon"])
        if rng.random() < 0.05:
            return rng.choice([None, 5, "g", [], {}, {"type": "Circle"}, {"type": kind}])
        if kind == "GeometryCollection":
            return {"type": kind, "geometries": odd(some(0, 3, lambda: geometry(depth + 1)) if depth < 3 else [])}
        parts = {"Point": position, "MultiPoint": lambda: some(0, 3, position), "LineString": lambda: some(0, 4, position), "MultiLineString": lambda: some(0, 3, lambda: odd(some(0, 3, position)))}
        parts |= {"Polygon": lambda: some(0, 2, ring), "MultiPolygon": lambda: some(0, 2, lambda: odd(some(0, 2, ring)))}
        return {"type": kind, "coordinates": odd(parts[kind]())}

    if rng.random() < 0.05:
        return rng.choice([None, 5, [], {}, {"type": "Point", "coordinates": [1, 2]}, {"type": "Feature"}])
    return {"type": "Feature", "id": rng.choice([7, "a", None]), "geometry": geometry()}


def deep(n):
    g = {"type": "Point", "coordinates": [1, 2]}
    for _ in range(n):
        g = {"type": "GeometryCollection", "geometries": [g]}
    return {"type": "Feature", "geometry": g}


def frame(spark, features):
    rows = [(k, None if f is None else json.dumps(f)) for k, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature_seq long, text string").select("feature_seq", F.parse_json("text").alias("v"))


def test_all_issues_in_reading_order(spark):
    rng = random.Random(5)
    features = [made(rng) for _ in range(400)] + [deep(2), deep(34)]
    found = inspection.inspect(frame(spark, features), most_features=10, most_coordinates=10**6)
    want, count = [], 0
    for k, f in enumerate(features):
        mine, n = walk(f, k)
        want, count = want + mine, count + n
    got = sorted(found.issues.collect(), key=lambda r: (r.feature_seq, r["at"], r.code))
    assert (got[0].feature_seq, got[0].code, got[0].path) == (-1, "feature-limit", "$.features")
    assert [(r.feature_seq, r.code, r.path) for r in got[1:]] == want
    assert {r.code for r in got} == set(inspection.MESSAGES) - {"coordinate-limit"} and all(r.message == inspection.MESSAGES[r.code] for r in got)
    warnings = sum(code == "mercator-range" for _, code, _ in want)
    assert tuple(found.summary.first()) == (False, len(features), count, len(want) - warnings + 1, warnings)


def test_limits_and_first_issues(spark):
    far, point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [999, 0]}}, {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [9, 0]}}
    found = inspection.inspect(frame(spark, [far, point, far, far, {"type": "x", "id": 3}]), most_coordinates=4)
    assert tuple(found.summary.first()) == (False, 5, 4, 1, 3)
    assert [(r.feature_seq, r.code) for r in inspection.first_issues(found.issues, 2)] == [(0, "mercator-range"), (4, "feature")]
    assert [(r.feature_seq, r.fid, r.code) for r in inspection.first_issues(found.issues)] == [(0, None, "mercator-range"), (2, None, "mercator-range"), (3, None, "mercator-range"), (4, "3", "feature")]
    assert inspection.inspect(frame(spark, [point, far]), most_coordinates=1).issues.filter("code = 'coordinate-limit'").count() == 1
    none = inspection.inspect(frame(spark, [point]).limit(0))
    assert tuple(none.summary.first()) == (True, 0, 0, 0, 0) and none.issues.count() == 0


def test_small_rings_are_tested_at_once(monkeypatch):
    """rings of one size share a call; each gives what it gives alone."""
    rng = np.random.default_rng(2)
    rings = [np.vstack([p, p[:1]]) for p in (rng.integers(0, 9, (rng.integers(1, 9), 2)).astype(float) for _ in range(500))]
    rings += [np.vstack([p, p[:1]]) for p in (rng.random((70, 2)) for _ in range(3))] + [np.array([(0, 0), (np.nan, 2), (2, 0), (0, 2), (0, 0)]), np.empty((0, 2))]
    want = [len(r) > 1 and validate.crosses(r) for r in rings]
    assert 0 < sum(want) < len(want)
    assert validate.which_cross(rings).tolist() == validate.which_cross(rings, 1).tolist() == want
    monkeypatch.setattr(validate, "crosses", lambda ring: pytest.fail("one by one"))
    assert validate.which_cross(rings[:500]).tolist() == want[:500] and validate.which_cross([]).tolist() == []


@pytest.mark.parametrize("text", ["[1,2]", "[1,2.5]", "[1e400,2]", '["1",2]', '["x",2]', "[null,true]", "[null,5]", "[5,null]", "[1]", "[]", "7", '{"a":1}', "[1,2,3]", "[[1],2]", "[0.1,123456789012345678901234567890]", '["NaN",1]', '["Infinity",1]', '["1d",1]'])
def test_places_of_numbers_equal_those_one_by_one(spark, text):
    p = F.try_parse_json(F.lit(text))
    slow = [F.when(F.size(inspection.items_of(p)) >= 2, inspection.number_of(F.try_variant_get(p, f"$[{k}]", "variant"))) for k in (0, 1)]
    row = spark.range(1).select(*(inspection.place_of(p, k) for k in (0, 1)), *slow).first()
    assert row[:2] == row[2:]
