"""Rings put in order by rounds of joins against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from mapfold.operators import rings
from mapfold.sources import osm

SCHEMA = "id string, seq long, line array<struct<x:double,y:double>>"


def cut(rng, ring):
    """A closed ring as lines in any order and direction."""
    n = len(ring) - 1
    cuts = sorted(rng.sample(range(n), rng.randint(1, min(n, 6))))
    if len(cuts) == 1:
        return [ring[cuts[0] : -1] + ring[: cuts[0] + 1]]
    out = [ring[a : b + 1] for a, b in zip(cuts, cuts[1:])] + [ring[cuts[-1] : -1] + ring[: cuts[0] + 1]]
    return [p if rng.random() < 0.5 else p[::-1] for p in out]


def walked(spark, table):
    rows = [(k, i, line) for k, lines in table.items() for i, line in enumerate(lines)]
    random.Random(1).shuffle(rows)
    found, broken = rings.ring_positions(spark.createDataFrame(rows, SCHEMA), "id")
    out = {}
    for r in found.orderBy("id", "ring", "place").collect():
        got = out.setdefault(r["id"], {}).setdefault(r["ring"], [])
        assert r["place"] == len(got)
        got.append((r["x"], r["y"]))
    return out, {r["id"] for r in broken.collect()}


def test_rings_equal_the_walk(spark):
    rng, table = random.Random(3), {}
    for k in range(60):
        lines = []
        for j in range(rng.randint(1, 4)):
            n = rng.randint(3, 12)
            ring = [(100.0 * j + i, float(i * i)) for i in range(n)]
            lines += cut(rng, ring + ring[:1])
        rng.shuffle(lines)
        if k % 6 == 0:
            lines.pop()
        if k % 10 == 1:
            lines.append(list(lines[0]))  # a repeated line: three ends or a closed one twice
        table[f"k{k}"] = lines
    got, broken = walked(spark, table)
    for k, lines in table.items():
        want = osm.stitch(lines) if lines else None
        assert (k in broken) == (want is None and bool(lines)), k
        assert sorted(got.get(k, {}).values()) == sorted(want or []), k


@pytest.mark.parametrize("lines", [[[(0.0, 0.0)]], [[]], [[(0.0, 0.0), (1.0, 0.0)]], [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (0.0, 0.0)]], [[(0.0, 0.0), None]], [[(0.0, 0.0), (None, 1.0), (0.0, 0.0), (0.0, 0.0)]]])
def test_what_makes_no_ring(spark, lines):
    assert walked(spark, {"a": lines}) == ({}, {"a"})


def test_null_key_and_seq_and_no_lines(spark):
    found, broken = rings.ring_positions(spark.createDataFrame([], SCHEMA), "id")
    assert found.isEmpty() and broken.isEmpty()
    line = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    found, broken = rings.ring_positions(spark.createDataFrame([("a", None, line), ("b", 0, line)], SCHEMA), "id")
    assert [r["id"] for r in broken.collect()] == ["a"] and found.filter("id = 'b'").count() == found.count() == 4


def test_one_ring_of_many_segments(spark):
    """No collect_list: a ring of 20,000 segments, each second one turned around, in any order."""
    n = 20_000
    at = lambda i: F.struct((i % n).cast("double").alias("x"), F.lit(0.0).alias("y"))
    i = F.pmod(F.col("id") * 7919 + 3, F.lit(n))
    line = F.when(i % 2 == 0, F.array(at(i), at(i + 1))).otherwise(F.array(at(i + 1), at(i)))
    lines = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("seq"), line.alias("line"))
    found, broken = rings.ring_positions(lines, "id")
    assert broken.isEmpty()
    # the first line goes from 3 + 1 down to 3
    wrong = found.filter(F.col("x") != F.pmod(F.lit(4) - F.col("place"), F.lit(n)))
    assert found.count() == n + 1 and found.select("ring").distinct().count() == 1 and wrong.isEmpty()


def test_relations_equal_those_of_one_task(spark):
    rng, rows = random.Random(9), []
    for k in range(50):
        lines = []
        for role in ("outer", "inner")[: rng.randint(1, 2)]:
            for j in range(rng.randint(1, 3)):
                ring = [(100.0 * j + i, float(i * i)) for i in range(rng.randint(3, 9))]
                lines += [(role, p) for p in cut(rng, ring + ring[:1])]
        rng.shuffle(lines)
        if k % 5 == 0:
            lines.pop()
        rows += [(k, i, role, line, rng.choice(["role", "missing-way"]) if k % 7 == 0 and i % 2 else None) for i, (role, line) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "relation_id long, pos int, role string, line array<struct<x:double,y:double>>, code string")
    want = osm.relation_rings(lines).collect()
    found, errors = osm.relation_positions(lines)
    assert {(r["relation_id"], r["code"]) for r in errors.collect()} == {(r["relation_id"], r["code"]) for r in want if r["code"]}
    got = {}
    for r in found.orderBy("relation_id", "role", "ring", "place").collect():
        got.setdefault((r["relation_id"], r["role"], r["ring"]), []).append((r["x"], r["y"]))
    rings_of = [(r["relation_id"], r["role"], [(p["x"], p["y"]) for p in r["ring"]]) for r in want if not r["code"]]
    assert sorted((k, role, line) for (k, role, _), line in got.items()) == sorted(rings_of)


def test_short_rings_need_no_rounds(spark, monkeypatch):
    """only keys of more segments than a task may hold are put in order by rounds, and both ways give the same."""
    rng, rows = random.Random(4), []
    for k in range(40):
        for j in range(rng.randint(1, 3)):
            ring = [(100.0 * j + i, float(i * i)) for i in range(rng.randint(3, 30))]
            rows += [(f"k{k}", line[0], line[-1], len(line) - 1) for line in cut(rng, ring + ring[:1]) if line[0] != line[-1]]
    rng.shuffle(rows)
    schema = "id string, seq long, a struct<x:double,y:double>, b struct<x:double,y:double>, steps int"
    segments = spark.createDataFrame([(r[0], i - 50, *r[1:]) for i, r in enumerate(rows)], schema)
    by_joins = sorted(rings.ring_order(segments, "id", few=2)[0].collect())
    monkeypatch.setattr(rings, "by_rounds", lambda *_: pytest.fail("rounds"))
    for held in (1 << 16, 5):
        monkeypatch.setattr(rings, "FEW_SEGMENTS", held)
        assert sorted(rings.ring_order(segments, "id", few=1 << 16)[0].collect()) == by_joins
    assert len(by_joins) == len(rows)
