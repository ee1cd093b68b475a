"""Labels that are placed by rounds of joins against a plain scan."""

import random

import pytest

from mapfold.operators import shapes

SCHEMA = "tile long, label_id long, priority double, sort_key double, w double, s double, e double, n double, allow_overlap boolean, ignore_placement boolean"


def scan(rows):
    """(tile, label_id) of what a scan in order shows."""
    out, taken = [], {}
    for tile, i, p, k, w, s, e, n, overlap, ignore in sorted(rows, key=lambda r: (-(r[2] or 0), r[3] or 0, r[1])):
        if None in (w, s, e, n):
            continue
        held = taken.setdefault(tile, [])
        if overlap or not any(a < e and c > w and b < n and d > s for a, b, c, d in held):
            out.append((tile, i))
            if not ignore:
                held.append((w, s, e, n))
    return sorted(out, key=str)


def boxes(rng, count, side, sizes, flags):
    rows = []
    for i in range(count):
        x, y, width = rng.uniform(-side, side), rng.uniform(-side, side), rng.choice(sizes)
        tile = rng.choice([1, 1, 1, 2, None])
        rows.append((tile, i, rng.choice([0.0, 1.0, None]), rng.choice([0.0, 2.5, None]), x, y, x + width, y + width / 3, flags and rng.random() < 0.1, (flags and rng.random() < 0.1) or None))
    return rows


@pytest.mark.parametrize("sizes, flags", [((10.0,), False), ((0.0, 1.0, 9.0, 40.0), True)])
def test_rounds_show_what_a_scan_shows(spark, sizes, flags):
    rows = boxes(random.Random(len(sizes)), 300, 60, sizes, flags) + [(1, 900, 5.0, 0.0, None, 0.0, 1.0, 1.0, False, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = scan(rows)
    for few in (5, 10_000):
        got = sorted((tuple(r) for r in shapes.thin_labels(df, ["tile"], few=few).collect()), key=str)
        assert got == want and len(want) < len(rows)


def test_labels_of_one_place_and_limits(spark):
    same = [(1, i, 0.0, 0.0, 0.0, 0.0, 5.0, 5.0, False, False) for i in range(200)] + [(1, 7, 0.0, 0.0, 0.0, 0.0, 5.0, 5.0, False, False)]
    df = spark.createDataFrame(same, SCHEMA)
    assert [tuple(r) for r in shapes.thin_labels(df, ["tile"], few=3).collect()] == [(1, 0)]
    apart = spark.createDataFrame([(1, i, float(-i), 0.0, 10.0 * i, 0.0, 10.0 * i + 5, 5.0, False, False) for i in range(30)], SCHEMA)
    assert sorted(r.label_id for r in shapes.thin_labels(apart, ["tile"], most=7, few=3).collect()) == list(range(7))
    assert shapes.thin_labels(df.limit(0), ["tile"]).count() == 0


def test_crowded_groups_shrink_by_what_comes_first(spark, monkeypatch):
    """labels that cover each other are placed without rounds over all of them."""
    rows = boxes(random.Random(5), 3000, 15, (3.0, 9.0, 40.0), True)
    df = spark.createDataFrame([(*r[:8], False, r[9]) for r in rows], SCHEMA)
    want = scan([(*r[:8], False, r[9]) for r in rows])
    monkeypatch.setattr(shapes, "by_rounds", lambda labels: pytest.fail("rounds"))
    for sent in (50_000, 0):
        monkeypatch.setattr(shapes, "SENT_BOXES", sent)
        got = sorted((tuple(r) for r in shapes.thin_labels(df, ["tile"], few=400).collect()), key=str)
        assert got == want and len(want) < len(rows) / 2
