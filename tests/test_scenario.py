"""Scenarios, spatial joins of all kinds, and streams in any order of arrival, against plain loops."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mapfold.operators import changes, scenario, spatial
from mapfold.sources import geojson
from mapfold.streaming import entities, updates

PROPS = "map<string,string>"
FRAME = f"entity_id long, time_ms long, lon double, lat double, status string, props {PROPS}"
PATCH = f"entity_id long, time_ms long, seq long, lon double, lat double, status string, props {PROPS}"


def seen(track, t):
    """An entity at a time: position, status and properties, or None before its first frame."""
    track = sorted(track)
    if not track or t < track[0][0]:
        return None
    i = max(k for k, f in enumerate(track) if f[0] <= t)
    (t0, x, y, status, props), after = track[i], track[i + 1 : i + 2]
    if after and t < after[0][0]:
        share, step = (t - t0) / (after[0][0] - t0), after[0][1] - x
        step += -360 if step > 180 else 360 if step < -180 else 0
        x, y = (x + step * share + 540) % 360 - 180, y + (after[0][2] - y) * share
    return x, y, status, props


def plain_tracks(frames, patches):
    tracks, errors = {}, []
    for e, *f in frames:
        tracks.setdefault(e, []).append(tuple(f))
    for e, t, seq, lon, lat, status, props in sorted(patches, key=lambda p: (p[1], p[2])):
        if e not in tracks:
            errors.append((e, t, seq, "unknown"))
            continue
        now = seen(tracks[e], t)
        if lon is None and now is None:
            errors.append((e, t, seq, "position"))
            continue
        x, y, s, p = now or (None, None, None, {})
        row = (t, x if lon is None else lon, y if lat is None else lat, s if status is None else status, {**p, **props})
        tracks[e] = [f for f in tracks[e] if f[0] != t] + [row]
    return [(e, *f) for e, track in tracks.items() for f in track], errors


def shown(rows):
    return sorted((e, t, round((x + 180) % 360, 6), round(y, 6), s or "", tuple(sorted(p.items()))) for e, t, x, y, s, p in rows)


def scenario_rows(seed):
    rng = random.Random(seed)
    frames = [(e, t, rng.uniform(-180, 180), rng.uniform(-80, 80), rng.choice([None, "a", "b"]), {k: str(t) for k in rng.sample("xyz", rng.randint(0, 2))}) for e in range(6) for t in rng.sample(range(100), 1 if e == 5 else 9)]
    patches = []
    for seq in range(150):
        there = rng.random() < 0.4
        patches.append((rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 77]), rng.randrange(0, 110), seq, rng.uniform(-180, 180) if there else None, rng.uniform(-80, 80) if there else None, rng.choice([None, "p", "q"]), {k: f"p{seq}" for k in rng.sample("xyzw", rng.randint(0, 2))}))
    return frames, patches


@pytest.mark.parametrize("seed, blocks", [(1, 1024), (2, 3), (3, 20)])
def test_patches_see_those_before_them(spark, seed, blocks):
    frames, patches = scenario_rows(seed)
    track, errors = scenario.entity_frames(spark.createDataFrame(frames, FRAME), spark.createDataFrame(patches, PATCH), blocks)
    want, refused = plain_tracks(frames, patches)
    assert shown(tuple(r) for r in track.collect()) == shown(want)
    assert sorted(map(tuple, errors.collect())) == sorted(refused)
    assert {r[3] for r in refused} == {"unknown", "position"}


def test_a_patch_without_a_position_is_on_the_way(spark):
    frames = spark.createDataFrame([(1, 0, 0.0, 0.0, "s", None), (1, 100, 10.0, 20.0, "s", {})], FRAME)
    patches = spark.createDataFrame([(1, 50, 1, None, None, "halt", None)], PATCH)
    rows = {r.time_ms: (r.lon, r.lat, r.status) for r in scenario.entity_frames(frames, patches)[0].collect()}
    assert rows == {0: (0.0, 0.0, "s"), 50: (5.0, 10.0, "halt"), 100: (10.0, 20.0, "s")}
    none = scenario.entity_frames(frames.limit(0), patches.limit(0))
    assert none[0].collect() == [] and none[1].collect() == []


def test_streamed_tracks_equal_the_batch_in_any_order(spark, tmp_path):
    frames, patches = scenario_rows(4)
    rows = [(e, t, 0, 0, *rest) for e, t, *rest in frames] + [(e, t, 1, seq, *rest) for e, t, seq, *rest in patches]
    random.Random(9).shuffle(rows)
    schema = f"entity_id long, time_ms long, patch int, seq long, lon double, lat double, status string, props {PROPS}"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows.parquet"))
    stream = updates.read_table_stream(spark, str(tmp_path), "rows", files_per_batch=1)
    got = entities.tracks(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert shown(tuple(r) for r in got.collect()) == shown(plain_tracks(frames, patches)[0])


def test_entities_are_added_and_removed_in_order(spark):
    rng = random.Random(3)
    frames = [(e, t, 1.0, 2.0, "s", {}) for e in range(8) for t in (0, 5)]
    ops = [(rng.randrange(12), seq, rng.choice(["add", "remove"])) for seq in range(120)]
    added = [(seq, seq + k * rng.choice([1, 1, 500]), 3.0, 4.0, "n", {}) for _, seq, op in ops if op == "add" and seq % 13 for k in range(2)]
    tracks, errors = {}, []
    for e, *f in frames:
        tracks.setdefault(e, []).append(f[0])
    for e, seq, op in ops:
        times = [a[1] for a in added if a[0] == seq]
        if op == "remove":
            tracks.pop(e, None)
        elif not times or max(times) > 400:
            errors.append((e, seq, "duration" if times else "track"))
        elif e in tracks:
            errors.append((e, seq, "duplicate"))
        else:
            tracks[e] = times
    kinds = "seq long, time_ms long, lon double, lat double, status string, props map<string,string>"
    got, refused = scenario.entity_set(spark.createDataFrame(frames, FRAME), spark.createDataFrame(ops, "entity_id long, seq long, op string"), spark.createDataFrame(added, kinds), 400)
    assert sorted((r.entity_id, r.time_ms) for r in got.collect()) == sorted((e, t) for e, times in tracks.items() for t in times)
    assert sorted(map(tuple, refused.collect())) == sorted(errors) and {r[2] for r in errors} == {"duration", "track", "duplicate"}


def test_injected_events_have_default_times_and_ids(spark):
    rng = random.Random(6)
    events = [("a", 1), ("injected-4", 2)]
    asked = [(seq, rng.choice([None, None, "a", "b", "injected-9"]), rng.choice([None, rng.randrange(120)]), rng.randrange(100)) for seq in range(60)]
    ids, timeline, errors, n = {e for e, _ in events}, list(events), [], 1
    for seq, event, t, clock in asked:
        t = clock if t is None else t
        if event is None:
            event, n = f"injected-{n}", n + 1
        n += 1
        if t > 100 or event in ids:
            errors.append((seq, event, "duration" if t > 100 else "duplicate"))
            continue
        ids.add(event)
        timeline.append((event, t))
    got, refused = scenario.inject(spark.createDataFrame(events, "event_id string, time_ms long"), spark.createDataFrame(asked, "seq long, event_id string, time_ms long, clock_ms long"), 100, cell=7)
    assert sorted(map(tuple, got.collect())) == sorted(timeline) and sorted(map(tuple, refused.collect())) == sorted(errors)


def far(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def city(seed):
    rng = random.Random(seed)
    at = lambda: {"x": rng.uniform(0, 100), "y": rng.uniform(0, 100)}
    near = lambda p, r: {"x": p["x"] + rng.uniform(-r, r), "y": p["y"] + rng.uniform(-r, r)}
    features = []
    for i in range(60):
        start, kind = at(), rng.choice(["line", "circle", "symbol", "fill", "line"])
        size = rng.choice([0.5, 5, 60])
        if kind == "fill":
            w, h = size, rng.choice([0.5, 5, 60])
            corners = [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
            parts = [[{"x": start["x"] + a, "y": start["y"] + b} for a, b in corners]]
        else:
            parts = [[start, *(near(start, size) for _ in range(rng.randint(0, 3)))] for _ in range(rng.randint(1, 2))]
        features.append((i, kind, parts, rng.choice([0.0, 1.0, 3.0]), rng.choice([0.0, 0.4, 2.0]), rng.choice([None, 1.0]), rng.choice([None, 2.0, 20.0])))
    return features, [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(250)], rng


FEATURE = "feature_id long, kind string, parts array<array<struct<x:double,y:double>>>, width double, radius double, stroke double, size double"


@pytest.mark.parametrize("seed, tolerance", [(1, 0.0), (2, 0.7)])
def test_points_hit_features_of_each_kind(spark, seed, tolerance):
    features, points, _ = city(seed)
    want = set()
    for f, kind, parts, width, radius, stroke, size in features:
        reach = tolerance + {"line": width / 2, "circle": radius + (stroke or 0) / 2, "symbol": max(6, (size or 0) / 2), "fill": 0}[kind]
        for i, x, y in points:
            p = [(q["x"], q["y"]) for part in parts for q in part]
            if kind == "fill":
                hit = min(q[0] for q in p) <= x <= max(q[0] for q in p) and min(q[1] for q in p) <= y <= max(q[1] for q in p)
            elif kind == "line":
                hit = reach > 0 and any(far(x, y, a["x"], a["y"], b["x"], b["y"]) <= reach for part in parts for a, b in zip(part, part[1:]))
            else:
                hit = reach > 0 and any(far(x, y, *q, *q) <= reach for q in p)
            if hit:
                want.add((i, f))
    got = spatial.features_at(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(features, FEATURE), tolerance)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {features[f][1] for _, f in want} == {"line", "circle", "symbol", "fill"}


def crosses(a, b, w, s, e, n):
    low, high = 0.0, 1.0
    for p, d, lo, hi in ((a["x"], b["x"] - a["x"], w, e), (a["y"], b["y"] - a["y"], s, n)):
        if d == 0:
            if not lo <= p <= hi:
                return False
            continue
        u, v = sorted(((lo - p) / d, (hi - p) / d))
        low, high = max(low, u), min(high, v)
    return low <= high


@pytest.mark.parametrize("seed, tolerance", [(3, 0.0), (4, 0.6)])
def test_boxes_meet_features_of_each_kind(spark, seed, tolerance):
    features, _, rng = city(seed)
    boxes = []
    for i in range(120):
        x, y = rng.uniform(-5, 105), rng.uniform(-5, 105)
        boxes.append((i, x, y, x + rng.choice([0.1, 2, 70]), y + rng.choice([0.1, 2, 70])))
    want = set()
    for f, kind, parts, width, radius, stroke, _ in features:
        reach = tolerance + {"line": width / 2, "circle": radius + (stroke or 0) / 2}.get(kind, 0)
        for i, w, s, e, n in boxes:
            grown = (w - reach, s - reach, e + reach, n + reach)
            p = [q for part in parts for q in part]
            if kind in ("circle", "symbol"):
                hit = any(crosses(q, q, *grown) for q in p)
            else:
                hit = any(crosses(a, b, *grown) for part in parts for a, b in zip(part, part[1:]))
            if kind == "fill":
                x, y = (w + e) / 2, (s + n) / 2
                hit = hit or min(q["x"] for q in p) <= x <= max(q["x"] for q in p) and min(q["y"] for q in p) <= y <= max(q["y"] for q in p)
            if hit:
                want.add((i, f))
    got = spatial.features_in_boxes(spark.createDataFrame(features, FEATURE), spark.createDataFrame(boxes, "box_id long, w double, s double, e double, n double"), tolerance)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_segment_around_the_world_is_four_rows(spark):
    lines = spark.createDataFrame([(1, -180.0, -85.0, 180.0, 85.0), (2, 0.0, 0.0, 0.0, 0.0), (3, 0.001, 0.0, 0.002, 0.0)], "line_id long, ax double, ay double, bx double, by double")
    grown = spatial.with_reach(lines, 0.0001).withColumn("box", spatial.box_of(F.col("reach")))
    dealt = spatial.in_cells(grown.withColumn("level", spatial.level_of(spatial.size_of(F.col("box")))), F.col("box"))
    assert max(r["count"] for r in dealt.groupBy("line_id").count().collect()) <= 4
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 42.5), (3, 90.0, 42.6), (4, 0.0015, 0.0)], "point_id long, x double, y double")
    assert sorted((r.point_id, r.line_id) for r in spatial.points_near_segments(points, lines, 0.0001).collect()) == [(1, 1), (1, 2), (2, 1), (4, 3)]


def test_streamed_state_is_the_same_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for seq in range(200):
        op = rng.choice(["set", "set", "set", "remove"])
        fid = None if op == "remove" and rng.random() < 0.1 else rng.randrange(4)
        key = None if fid is None or (op == "remove" and rng.random() < 0.3) else rng.choice("kl")
        rows.append((rng.choice("ab"), fid, key, seq if op == "set" else None, op, seq))
    schema = "source string, fid long, key string, value long, op string, seq long"
    want = sorted(map(tuple, changes.feature_state(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes.parquet"))
    stream = updates.read_table_stream(spark, str(tmp_path), "changes", files_per_batch=1)
    got = updates.feature_state(stream, str(tmp_path / "state"), str(tmp_path / "progress"), every=2)
    assert sorted(map(tuple, got.collect())) == want
    assert len(updates.versions(spark, str(tmp_path / "state/base"))) == 1


def test_removals_stay_removed_when_older_changes_arrive(spark, tmp_path):
    schema = "source string, fid long, key string, value long, op string, seq long"
    for row in (("a", 1, "k", None, "remove", 100), ("a", 1, "k", 20, "set", 50)):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes.parquet"))
    stream = updates.read_table_stream(spark, str(tmp_path), "changes", files_per_batch=1)
    assert updates.feature_state(stream, str(tmp_path / "state"), str(tmp_path / "progress")).collect() == []


def test_feature_seq_is_unique_over_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text('{"type":"FeatureCollection","features":[' + ",".join('{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}' for _ in range(3)) + "]}")
    rows, errors = geojson.read_geojson(spark, str(tmp_path))
    assert len({r.feature_seq for r in rows.collect()}) == 6 and errors.count() == 0


class Held:
    """A list or a value of an entity's state that counts its calls."""

    def __init__(self):
        self.kept, self.calls = [], 0

    def exists(self):
        return bool(self.kept)

    def get(self):
        self.calls += 1
        return iter(list(self.kept)) if self.kept and len(self.kept[0]) > 1 else self.kept[0]

    def put(self, rows):
        self.calls, self.kept = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls, self.kept = self.calls + 1, self.kept + list(rows)

    def update(self, row):
        self.calls, self.kept = self.calls + 1, [row]


def test_tracks_ask_the_state_once_a_batch_not_once_a_row():
    """what an entity's batch costs in calls to the state doesn't grow with its rows."""
    rows, version = Held(), Held()
    handle = type("Handle", (), {"getListState": lambda self, *_: rows, "getValueState": lambda self, *_: version})()
    tracks = entities.Tracks()
    tracks.init(handle)
    columns = ["time_ms", "patch", "seq", "lon", "lat", "status", "props"]
    frame = lambda times, lon: pd.DataFrame([(t, 0, 0, lon, 1.0, "a", {"k": str(t)}) for t in times] + [(times[0], 1, 7, None, None, None, {"p": "q"})], columns=columns)
    first = pd.concat(tracks.handleInputRows((5,), iter([frame(range(500), 1.0), frame(range(500, 900), 1.0)]), None))
    assert rows.calls + version.calls <= 4 and len(first) == 900 and len(rows.kept) == 902
    assert first["props"].tolist()[0] == {"k": "0", "p": "q"} and set(first["version"]) == {1}
    again = pd.concat(tracks.handleInputRows((5,), iter([frame(range(899, 902), 2.0)]), None))
    assert [tuple(r) for r in again[["time_ms", "lon", "version"]].values.tolist()] == [(899, 2.0, 2), (900, 2.0, 2), (901, 2.0, 2)] and len(rows.kept) == 905
