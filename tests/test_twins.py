"""Whole queries without SQL against plain loops over their whole tables."""

import math

import numpy as np
import pytest

from mapfold.jobs import registry
from mapfold.jobs.inputs import view
from mapfold.jobs.scenes import city_items

from .test_operators import twin_merge


def rows_of(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).collect()


def scaled(v, factor=1000):
    return math.floor(v * factor + 0.5)


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    """item_id, seq, x, y, value of all events, in input order."""
    return sorted((r.item_id, r.seq, r.x, r.y, r.value) for r in city_items(spark, sf_dir).collect())


def twin(items, high, low, radius=50, reach=None):
    """(z, id, seq, x, y, n, value, leaves, children) of each level, by a scan of all items for each."""
    now = [(i, s, x, y, 1, v, [i], []) for i, s, x, y, v in items]
    out = []
    for z in range(high, low - 1, -1):
        far = (reach or radius / (512 * 2.0**z)) ** 2
        x, y = np.array([p[2] for p in now]), np.array([p[3] for p in now])
        free, level = np.ones(len(now), bool), []
        for k, p in enumerate(now):
            if not free[k]:
                continue
            free[k] = False
            near = np.flatnonzero(free & ((x - x[k]) ** 2 + (y - y[k]) ** 2 <= far)).tolist()
            if not near:
                level.append((*p[:7], []))
                continue
            free[near] = False
            group = [p, *(now[m] for m in near)]
            n = sum(q[4] for q in group)
            level.append((-(p[1] + 1) * 32 - z, p[1], sum(q[2] * q[4] for q in group) / n, sum(q[3] * q[4] for q in group) / n, n, sum(q[5] for q in group), [i for q in group for i in q[6]], [q[0] for q in group]))
        now = level
        out += [(z, *p) for p in level]
    return out


def test_agg_cluster(spark, sf_dir, items):
    want = {(z, i): (n, x, y, v) for z, i, s, x, y, n, v, *_ in twin(items, 14, 0)}
    got = {(r.z, r.item_id): r for r in rows_of(spark, sf_dir, "agg_cluster")}
    assert got.keys() == want.keys()
    for k, (n, x, y, v) in want.items():
        r = got[k]
        assert r.n == n and abs(r.x - x * 1e9) < 1 and abs(r.y - y * 1e9) < 1 and abs(r.value - v * 1000) < 1


def test_agg_cluster_tile(spark, sf_dir, items):
    tiles = {}
    for i, s, x, y, v in items:
        fx, fy = x * 4096, y * 4096
        tiles.setdefault((math.floor(fx), math.floor(fy)), []).append((i, s, (fx - math.floor(fx)) * 4096, (fy - math.floor(fy)) * 4096, v))
    want = sorted((12, *t, p[2], p[5], p[3], p[4]) for t, mine in tiles.items() for p in twin(mine, 0, 0, reach=50 * 4096 / 512))
    got = sorted((r.z, r.x, r.y, r.seq, r.n, r.px, r.py) for r in rows_of(spark, sf_dir, "agg_cluster_tile"))
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert all(abs(w[5] * 100 - g[5]) < 1 and abs(w[6] * 100 - g[6]) < 1 for w, g in zip(want, got))


def in_child_order(items, high, low, radius=50):
    """Children of each cluster in the order of a search through the nine squares around its taker, column by column, and x, y, n of every item."""
    now = [(i, s, x, y, 1) for i, s, x, y, v in items]
    of, at = {}, {p[0]: p[2:] for p in now}
    for z in range(high, low - 1, -1):
        reach, squares, level, free = radius / (512 * 2.0**z), {}, [], [True] * len(now)
        for k, p in enumerate(now):
            squares.setdefault((math.floor(p[2] / reach), math.floor(p[3] / reach)), []).append(k)
        for k, (i, s, x, y, n) in enumerate(now):
            if not free[k]:
                continue
            free[k] = False
            cx, cy = math.floor(x / reach), math.floor(y / reach)
            met = [m for c in range(cx - 1, cx + 2) for r in range(cy - 1, cy + 2) for m in squares.get((c, r), [])]
            near = [m for m in met if free[m] and (now[m][2] - x) ** 2 + (now[m][3] - y) ** 2 <= reach**2]
            if not near:
                level.append((i, s, x, y, n))
                continue
            for m in near:
                free[m] = False
            group, own = [now[k], *(now[m] for m in near)], -(s + 1) * 32 - z
            total = sum(q[4] for q in group)
            of[own] = [q[0] for q in group]
            level.append((own, s, sum(q[2] * q[4] for q in group) / total, sum(q[3] * q[4] for q in group) / total, total))
            at[own] = level[-1][2:]
        now = level
    return of, at


def depth_first(of, i):
    return [leaf for c in of[i] for leaf in depth_first(of, c)] if i in of else [i]


def test_leaves(spark, sf_dir, items):
    for name, high, low, first, last in (("agg_cluster_leaves", 12, 8, 1, 10), ("top_leaves", 11, 10, 11, 20)):
        of, _ = in_child_order(items, high, low)
        want = {(c, i, k) for c in of for k, i in enumerate(depth_first(of, c), 1) if first <= k <= last}
        assert {tuple(r) for r in rows_of(spark, sf_dir, name)} == want and want


def test_agg_cluster_children(spark, sf_dir, items):
    of, at = in_child_order(items, 12, 8)
    want = {(c, k): (i, at[i]) for c, mine in of.items() for k, i in enumerate(mine, 1)}
    got = {(r.cluster_id, r.rank): r for r in rows_of(spark, sf_dir, "agg_cluster_children")}
    assert got.keys() == want.keys() and want
    for key, (i, (x, y, n)) in want.items():
        r = got[key]
        assert (r.item_id, r.n, r.cluster) == (i, n, i in of) and abs(r.x - x * 1e9) < 1 and abs(r.y - y * 1e9) < 1


def test_win_cluster_ids(spark, sf_dir, items):
    made = [(-z, s, i) for z, i, s, *_, children in twin(items, 12, 8) if children]
    assert {r.item_id: r.cluster_id for r in rows_of(spark, sf_dir, "win_cluster_ids")} == {i: k for k, (_, _, i) in enumerate(sorted(made), 1)}


def test_join_query_source(spark, sf_dir, items):
    want = {(i, "cluster", n) for z, i, s, x, y, n, *_ in twin(items, 10, 9) if z == 9 and n >= 20} | {(r.zone_id, "polygon", 1) for r in view(spark, sf_dir, "zones").collect()}
    assert {tuple(r) for r in rows_of(spark, sf_dir, "join_query_source")} == want


def test_udaf_reducer(spark, sf_dir, items):
    kinds = {r.event_id: r.event_type for r in view(spark, sf_dir, "pts_city").collect()}
    value = {i: v for i, *_, v in items}
    got = {r.cluster_id: r for r in rows_of(spark, sf_dir, "udaf_reducer")}
    want = {i: below for z, i, s, x, y, n, v, below, _ in twin(items, 11, 9) if z == 9 and n > 1}
    assert got.keys() == want.keys() and want
    for c, below in want.items():
        r, v = got[c], [value[i] for i in below]
        assert abs(r.sum - sum(v) * 10) < 1 and (r.max, r.min) == (scaled(max(v)), scaled(min(v)))
        assert abs(r.product - math.prod(1 + (i % 3) / 1000 for i in below) * 1000) < 1
        assert (r.all, r.any) == (all(kinds[i] == "view" for i in below), any(kinds[i] == "view" for i in below))


@pytest.fixture(scope="module")
def city(spark, sf_dir):
    """The points of each user in order of time."""
    users = {}
    for r in sorted(view(spark, sf_dir, "pts_city").collect(), key=lambda r: (r.time_ms, r.event_id)):
        users.setdefault(r.user_id, []).append(r)
    return users


def test_agg_merge_lines(spark, sf_dir, city):
    want = set()
    for user, way in city.items():
        parts = sorted((a.event_id, [(a.lon, a.lat), (b.lon, b.lat)]) for a, b in zip(way, way[1:]))
        merged = sorted(twin_merge([line for _, line in parts]), key=lambda m: -m[0])
        want |= {(user, k, len(line)) for k, (_, line) in enumerate(merged)}
    assert {tuple(r) for r in rows_of(spark, sf_dir, "agg_merge_lines")} == want


def test_sc_simplify(spark, sf_dir, city):
    def kept(p, tolerance):
        """Places that a recursive pass keeps between the first and the last."""
        if len(p) < 3:
            return 0
        (ax, ay), (bx, by) = p[0], p[-1]
        length, far = (bx - ax) ** 2 + (by - ay) ** 2, []
        for x, y in p[1:-1]:
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else 0
            far.append((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2)
        k = max(range(len(far)), key=far.__getitem__)
        return 1 + kept(p[: k + 2], tolerance) + kept(p[k + 1 :], tolerance) if far[k] > tolerance**2 else 0

    want = {(u, len(way) if len(way) <= 2 else 2 + kept([(r.lon, r.lat) for r in way], 0.001)) for u, way in city.items()}
    assert {tuple(r) for r in rows_of(spark, sf_dir, "sc_simplify")} == want


def test_agg_label_thin(spark, sf_dir, items):
    weight = {r.event_id: r.weight for r in view(spark, sf_dir, "pts_city").collect()}
    tiles = {}
    for i, s, x, y, v in items:
        w, n = (x * 4096 - math.floor(x * 4096)) * 512, (y * 4096 - math.floor(y * 4096)) * 512
        tiles.setdefault((math.floor(x * 4096), math.floor(y * 4096)), []).append((-(i % 3), weight[i], i, w, n))
    want = set()
    for tile, labels in tiles.items():
        shown = []
        for _, _, i, w, s in sorted(labels):
            if all(w >= a + 40 or w + 40 <= a or s >= b + 12 or s + 12 <= b for a, b in shown):
                shown.append((w, s))
                want.add((*tile, i))
    assert {tuple(r) for r in rows_of(spark, sf_dir, "agg_label_thin")} == want


def test_st_edit_log(spark, sf_dir):
    """Each state of a document by its place in a list, of which undo and redo move the end."""
    logs = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: r.event_id):
        k = r.event_id % 7
        op = "add" if k <= 2 else {3: "update", 4: "remove", 5: "undo"}.get(k, "clear" if r.event_id % 101 == 6 else "redo")
        logs.setdefault(r.user_id, []).append((op, str(r.event_id % 13), r.event_type))
    want = set()
    for user, steps in logs.items():
        states, at = [{}], 0
        for op, fid, value in steps:
            if op == "undo":
                at = max(0, at - 1)
            elif op == "redo":
                at = min(len(states) - 1, at + 1)
            else:
                now = states[at]
                if op in ("update", "remove") and fid not in now:
                    continue
                after = {} if op == "clear" else {k: v for k, v in now.items() if (op, k) != ("remove", fid)}
                if op in ("add", "update"):
                    after[fid] = value
                states, at = [*states[: at + 1], after][-21:], min(at + 1, 20)
        want.add((user, ",".join(sorted(states[at])), at, len(states) - 1 - at))
    assert {tuple(r) for r in rows_of(spark, sf_dir, "st_edit_log")} == want


def test_dem_relief(spark, sf_dir):
    stops = [(0.0, (0, 0, 0, 1.0)), (100.0, (0, 255, 0, 1.0)), (250.0, (255, 0, 0, 0.5))]
    for r in rows_of(spark, sf_dir, "dem_relief"):
        want = b""
        for i in range(64):
            h = (r.tile_id * 7 + i * 3) % 256 + (r.tile_id + i) % 256 / 256
            if i % 11 == 5:
                want += bytes(4)
                continue
            (a, low), (b, high) = next(((s, t) for s, t in zip(stops, stops[1:]) if h <= t[0]), (stops[-1], stops[-1]))
            t = (h - a) / (b - a) if b > a else 0
            alpha = low[3] + (high[3] - low[3]) * t
            want += bytes(round((low[c] * low[3] + (high[c] * high[3] - low[c] * low[3]) * t) / alpha) for c in range(3)) + bytes([round(alpha * 255)])
        assert r.rgba == want.hex().upper(), r.tile_id
