"""Simplifying, clipping, offsetting, anchors, labels and grid lines: numpy kernels in Arrow batches, or Columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import parse_color

LINE = "array<struct<x:double,y:double>>"


def simplified(points: np.ndarray, tolerance: float, closed: bool) -> np.ndarray:
    """The points (n, 2) that a Douglas-Peucker pass keeps; a ring that would keep fewer than three is left as it is."""
    n = len(points)
    if tolerance <= 0 or n <= (3 if closed else 2):
        return points
    keep, todo = np.zeros(n, bool), [(0, n - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        step, inner = points[b] - points[a], points[a + 1 : b]
        length = step @ step
        t = np.clip((inner - points[a]) @ step / length, 0, 1)[:, None] if length else np.zeros((len(inner), 1))
        far = ((inner - points[a] - t * step) ** 2).sum(1)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points if closed and keep.sum() < 3 else points[keep]


def clipped(ring: np.ndarray, low: float, high: float) -> np.ndarray:
    """The ring (n, 2) within the square low..high, edges included, one side after another."""
    for axis, bound, sign in ((0, low, 1), (1, low, 1), (0, high, -1), (1, high, -1)):
        if not len(ring):
            return ring
        after = np.roll(ring, -1, axis=0)
        here, there = sign * (ring[:, axis] - bound) >= 0, sign * (after[:, axis] - bound) >= 0
        out = []
        for p, q, a, b in zip(ring, after, here, there):
            if a:
                out.append(p)
            if a != b:
                out.append(p + (q - p) * (bound - p[axis]) / (q[axis] - p[axis]))
        ring = np.array(out).reshape(-1, 2)
    return ring


def offset(points: np.ndarray, distance: float) -> np.ndarray:
    """The line (n, 2) moved to its right, with mitres that reach four times the distance at most."""
    steps = np.diff(points, axis=0)
    length = np.hypot(*steps.T)[:, None]
    normals = np.column_stack([-steps[:, 1], steps[:, 0]]) / np.where(length > 0, length, 1)
    before, after = np.vstack([normals[:1], normals]), np.vstack([normals, normals[-1:]])
    middle = before + after
    size = np.hypot(*middle.T)[:, None]
    middle = np.where(size > 1e-12, middle / np.where(size > 0, size, 1), after)
    half = np.abs((middle * after).sum(1))[:, None]
    return points + middle * distance / np.maximum(0.25, half)


#: Positions that a task holds in Python at once, beyond those of one line or group.
POSITIONS = 1 << 16


def runs(sizes: Iterable[int], most: int = POSITIONS) -> Iterator[tuple[int, int]]:
    """start and length of the runs of rows whose sizes add up to `most` at most, or that are one row."""
    start, total, k = 0, 0, -1
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k - start
            start, total = k, 0
        total += n
    if k >= start:
        yield start, k + 1 - start


def each_line(lines: DataFrame, change: Callable[[np.ndarray], np.ndarray], column: str = "line") -> DataFrame:
    """lines with `column`, an array of x, y, changed row by row, in runs of POSITIONS positions; null lines stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            sizes = batch.column(at).value_lengths().fill_null(0).to_pylist()
            for start, n in runs(sizes):
                part = batch.slice(start, n)
                held = part.column(at)
                x, y = (held.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                points, out = np.column_stack([x, y]).astype(float), []
                ends = np.cumsum(sizes[start : start + n])
                for row, end in enumerate(ends.tolist()):
                    out.append(change(points[end - sizes[start + row] : end]) if held[row].is_valid else np.empty((0, 2)))
                flat = np.concatenate(out)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
                offsets = pa.array([0, *np.cumsum([len(o) for o in out]).tolist()], pa.int32())
                made = pa.ListArray.from_arrays(offsets, pairs, mask=held.is_null())
                yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(part.columns)], part.schema.names)

    return lines.mapInArrow(work, lines.schema)


def simplify(lines: DataFrame, tolerance: float, closed: bool = False) -> DataFrame:
    return each_line(lines, lambda p: simplified(p, tolerance, closed))


def clip(rings: DataFrame, low: float, high: float) -> DataFrame:
    return each_line(rings, lambda p: clipped(p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p, low, high))


def offset_lines(lines: DataFrame, distance: float) -> DataFrame:
    return each_line(lines, lambda p: offset(p, distance) if len(p) > 1 else p)


def line_anchors(lines: DataFrame, spacing: float) -> DataFrame:
    """line_id, place, x, y of anchors along lines(line_id, line): 1 to 32, each in the middle of its share."""
    n = F.size("line")
    steps = F.zip_with(F.slice("line", 1, n - 1), F.slice("line", 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("d")))
    rows = lines.filter(n >= 2).select("line_id", steps.alias("steps")).withColumn("total", F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["d"])).filter("total > 0")
    count = F.greatest(F.lit(1), F.least(F.lit(32), F.floor(F.col("total") / spacing))) if spacing > 0 else F.lit(1)
    rows = rows.withColumn("n", count.cast("int")).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("at", (F.col("place") + 0.5) * F.col("total") / F.col("n"))
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(acc: Column, s: Column) -> Column:
        t = (F.col("at") - acc["gone"]) / F.when(s["d"] > 0, s["d"])
        here = acc["x"].isNull() & (s["d"] > 0) & (acc["gone"] + s["d"] >= F.col("at"))
        return F.struct((acc["gone"] + s["d"]).alias("gone"), F.when(here, s["ax"] + (s["bx"] - s["ax"]) * t).otherwise(acc["x"]).alias("x"), F.when(here, s["ay"] + (s["by"] - s["ay"]) * t).otherwise(acc["y"]).alias("y"))

    found = rows.withColumn("p", F.aggregate("steps", start, walk))
    return found.select("line_id", "place", F.coalesce("p.x", F.element_at("steps", -1)["bx"]).alias("x"), F.coalesce("p.y", F.element_at("steps", -1)["by"]).alias("y"))


def merge_lines(lines: list[list[tuple]]) -> list[list[tuple]]:
    """Lines joined end to start, without turning any around."""
    return [line for _, line in merge_steps(lines)]


def merge_steps(lines: list[list[tuple]]) -> list[tuple[int, list[tuple]]]:
    """The same, each with the place of the line that was taken for it."""
    ordered = merge_order([(line[0], line[-1]) for line in lines])
    return [(i, [p for k, j in enumerate(order) for p in lines[j][k > 0 :]]) for i, order in ordered]


def merge_order(ends: list[tuple]) -> list[tuple[int, list[int]]]:
    """For each merged line the place of the line that was taken for it, and the places of its lines in their order, of lines' first and last positions.

    Lines are taken from the end of the list. One that was taken is extended, at
    either end, by what is left, the last of the list first, until nothing
    fits; after each addition what comes earlier in the list is tried before the
    list is gone through again.
    """
    left = dict(enumerate(ends))
    by_start: dict[tuple, list[int]] = {}
    by_end: dict[tuple, list[int]] = {}
    for i, (start, end) in left.items():
        by_start.setdefault(start, []).append(i)
        by_end.setdefault(end, []).append(i)

    def last_below(places: list[int], bound: float) -> int:
        while places and places[-1] not in left:
            places.pop()
        return next((i for i in reversed(places) if i < bound and i in left), -1)

    out = []
    while left:
        i, (first, last) = left.popitem()
        before, after, bound = [], [], float("inf")
        while True:
            following, leading = last_below(by_start.get(last, []), bound), last_below(by_end.get(first, []), bound)
            k = max(following, leading)
            if k < 0:
                if bound == float("inf"):
                    break
                bound = float("inf")
                continue
            other, bound = left.pop(k), k
            if k == following:
                after.append(k)
                last = other[1]
            else:
                before.append(k)
                first = other[0]
        out.append((i, [*reversed(before), i, *after]))
    return out


def merged_lines(lines: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """by, line_no, line of lines(by, seq, line): the lines of a group joined, in the order of seq; lines without positions are left out.

    Groups of more than `most` lines stay as they are, if it is given: 256 is
    what browsers draw. Lines that don't meet, over any others, are groups of
    their own: the task that orders a group holds the ends of what is connected
    alone, no positions between them.
    """
    kind, lines = lines.schema[by].dataType.simpleString(), lines.filter(F.size("line") > 0)
    ends = lines.select(by, "seq", F.explode(F.array(F.get("line", F.lit(0)), F.element_at("line", -1))).alias("at"))
    if most is not None:
        small = lines.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(by)
        ends = ends.join(small, by, "left_semi")
    labels = connected(ends, by)

    labelled = lines.join(labels, [by, "seq"], "left").withColumn("label", F.coalesce("label", "seq"))
    numbered = labelled.withColumn("k", F.row_number().over(Window.partitionBy(by, "label").orderBy("seq", "line")))
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    ends = numbered.select(by, "label", "k", "seq", first["x"].alias("_ax"), first["y"].alias("_ay"), last["x"].alias("_bx"), last["y"].alias("_by"))
    found = ends.mapInArrow(orders, f"{by} {kind}, label {ends.schema['label'].dataType.simpleString()}, k int, taken long, place int")
    parts = numbered.join(found, [by, "label", "k"]).groupBy(by, "taken").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("parts"))
    # a position where two lines meet is there once
    line = F.flatten(F.transform("parts", lambda p: F.when(p["place"] == 0, p["line"]).otherwise(F.slice(p["line"], F.lit(2), F.size(p["line"])))))
    number = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("taken"))) - 1
    return parts.select(by, number.alias("line_no"), line.alias("line"))


def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first three columns, taken and place of the ends of lines, which come by group and are numbered by k from 1; one group is held at a time."""

    def ordered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ax, ay, bx, by, seqs = (table.column(c).to_pylist() for c in ("_ax", "_ay", "_bx", "_by", "seq"))
        merged = merge_order(list(zip(zip(ax, ay), zip(bx, by))))
        rows = [j for _, order in merged for j in order]
        taken, place = [seqs[i] for i, order in merged for _ in order], [k for _, order in merged for k in range(len(order))]
        found = table.select([0, 1, 2]).take(pa.array(rows))
        yield from found.append_column("taken", pa.array(taken, pa.int64())).append_column("place", pa.array(place, pa.int32())).combine_chunks().to_batches(POSITIONS)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("k").to_numpy() == 1).tolist()
        for i, (a, b) in enumerate(zip([0, *starts], [*starts, len(batch)])):
            if i and held:
                yield from ordered(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from ordered(held)


def connected(ends: DataFrame, by: str) -> DataFrame:
    """by, seq, label of ends(by, seq, at): the least seq of those that share positions, over any others."""
    nodes = ends.select(by, "seq", F.col("seq").alias("label")).distinct().checkpoint()
    ends = ends.distinct().checkpoint()
    while True:
        at = ends.join(nodes, [by, "seq"]).groupBy(by, "at").agg(F.min("label").alias("near"))
        near = ends.join(at, [by, "at"]).groupBy(by, "seq").agg(F.min("near").alias("near"))
        hooked = nodes.join(near, [by, "seq"]).select(by, "seq", F.least("label", "near").alias("label"))
        up = hooked.select(by, F.col("seq").alias("label"), F.col("label").alias("up"))
        after = hooked.join(up, [by, "label"]).select(by, "seq", F.least("label", "up").alias("label")).checkpoint()
        changed = not after.join(nodes.withColumnRenamed("label", "old"), [by, "seq"]).filter("label <> old").isEmpty()
        nodes = after
        if not changed:
            return nodes


def place_labels(boxes: list[tuple], most: int | None = None) -> list[bool]:
    """Which of (priority, sort key, w, s, e, n, allow overlap, ignore placement) are shown; higher priority first, then lower sort key, of `most` at most if it is given."""
    order = sorted(range(len(boxes)), key=lambda i: (-boxes[i][0], boxes[i][1], i))[:most]
    taken, n_taken, shown = np.empty((16, 4)), 0, [False] * len(boxes)
    for i in order:
        _, _, w, s, e, n, overlap, ignore = boxes[i]
        held = taken[:n_taken]
        free = not ((held[:, 0] < e) & (held[:, 2] > w) & (held[:, 1] < n) & (held[:, 3] > s)).any()
        shown[i] = bool(overlap or free)
        if shown[i] and not ignore:
            if n_taken == len(taken):
                taken = np.vstack([taken, np.empty_like(taken)])
            taken[n_taken] = (w, s, e, n)
            n_taken += 1
    return shown


#: So many labels of a group may be placed in one task.
FEW_LABELS = 50_000


def thin_labels(labels: DataFrame, by: list[str], most: int | None = None, few: int = FEW_LABELS) -> DataFrame:
    """by, label_id of the labels(by, label_id, priority, sort_key, w, s, e, n) that fit, each group of `by` for itself.

    Of a group's labels the first `most` in order are candidates, if it is
    given: 2000 is what browsers take. Columns allow_overlap and
    ignore_placement may be there: such labels are shown whatever they overlap,
    or leave their place to others. Nulls in priority and sort_key count as 0,
    in the two flags as false; labels without a whole box are left out. Groups
    of up to `few` labels are placed one by one, others by their first labels
    and what these leave, or by rounds of joins.
    """
    columns = ["priority", "sort_key", "w", "s", "e", "n", "allow_overlap", "ignore_placement"]
    for name in columns[6:]:
        if name not in labels.columns:
            labels = labels.withColumn(name, F.lit(False))
    filled = [F.coalesce(name, F.lit(0)).alias(name) for name in columns[:2]] + columns[2:6] + [F.coalesce(name, F.lit(False)).alias(name) for name in columns[6:]]
    labels = labels.dropna(subset=columns[2:6]).select(*by, "label_id", *filled)
    if most is not None:
        order = Window.partitionBy(*by).orderBy(F.desc("priority"), "sort_key", "label_id")
        labels = labels.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")

    shown = [*by, "label_id", "w", "s", "e", "n", "holds"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                items = sorted(row.items, key=lambda r: r["label_id"])
                placed = place_labels([tuple(r[c] for c in columns) for r in items])
                yield pd.DataFrame([(*(getattr(row, b) for b in by), *(r[c] for c in ("label_id", "w", "s", "e", "n")), not r["ignore_placement"]) for r, ok in zip(items, placed) if ok], columns=shown)

    def placed(some: DataFrame) -> DataFrame:
        """What is shown of labels whose groups are small."""
        packed = some.groupBy(*by).agg(F.collect_list(F.struct("label_id", *columns)).alias("items"))
        return packed.mapInPandas(work, ", ".join(f"{b} {labels.schema[b].dataType.simpleString()}" for b in by) + ", label_id long, w double, s double, e double, n double, holds boolean")

    group = F.struct(*by)  # null is equal to null in a struct
    full = labels.groupBy(*by).agg(F.count("*").alias("size")).filter(F.col("size") > few).select(group.alias("_group"), "size").checkpoint()
    if full.isEmpty():
        return placed(labels).select(*by, "label_id")
    keyed, crowd = labels.withColumn("_group", group), F.broadcast(full.select("_group"))  # a row for each `few` labels at most
    small = placed(keyed.join(crowd, "_group", "left_anti")).select(*by, "label_id")
    crowded = by_prefixes(keyed.join(crowd, "_group", "left_semi").checkpoint(), by, few, full.agg(F.sum("size")).first()[0], placed)
    return small.unionByName(crowded)


#: So many boxes are sent to all tasks at once; more are joined by a shuffle.
SENT_BOXES = 50_000


def by_prefixes(labels: DataFrame, by: list[str], few: int, total: int, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """by, label_id of the labels(by, _group, ...) that are shown, `total` labels of groups of over `few`.

    The first labels of each group, about a quarter of `few` by a sample of the
    order, are placed in one task: none of what comes after counts for them.
    One pass then drops all that they cover, which is most of a crowded group,
    and what is left goes on. Labels that don't shrink so are placed by rounds.
    """
    order = F.struct((-F.col("priority")).alias("p"), "sort_key", "label_id", "w", "s", "e", "n", "allow_overlap", "ignore_placement")
    first, step = max(1, min(64, few // 4)), max(1, few // 256)
    left, shown = labels, []
    while True:
        sample = left.filter(F.pmod(F.xxhash64("label_id", "w", "s"), F.lit(step)) == 0).select("_group", order.alias("ord"))
        sample = sample.withColumn("_k", F.row_number().over(Window.partitionBy("_group").orderBy("ord"))).filter(F.col("_k") <= first)
        until = sample.groupBy("_group").agg(F.max("ord").alias("until"))
        met = left.join(F.broadcast(until), "_group", "left").withColumn("early", F.coalesce(order <= F.col("until"), F.lit(False))).drop("until")
        now = placed(met.filter("early")).checkpoint()
        shown.append(now)
        left = uncovered(met.filter("not early").drop("early"), now.filter("holds").withColumn("_group", F.struct(*by))).checkpoint()
        full = left.groupBy("_group").agg(F.count("*").alias("size")).filter(F.col("size") > few).checkpoint()
        crowd, before = F.broadcast(full.select("_group")), total
        shown.append(placed(left.join(crowd, "_group", "left_anti")))
        total = full.agg(F.sum("size")).first()[0]
        if not total:
            break
        left = left.join(crowd, "_group", "left_semi")
        if total > before / 2:
            shown.append(by_rounds(left).select(*(F.col("_group")[b].alias(b) for b in by), "label_id"))
            break
    return reduce(DataFrame.unionByName, (s.select(*by, "label_id") for s in shown))


def uncovered(labels: DataFrame, held: DataFrame) -> DataFrame:
    """The labels(_group, w, s, e, n, allow_overlap, ...) that overlap none of held(_group, w, s, e, n), or may.

    Two boxes meet in squares of the larger one's size: a label is in that of
    its corner, and what is held in all from which a label could reach it.
    """
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(2.0**-20)) * (1 + 2.0**-30)
    level = F.ceil(F.log2(size)).cast("int")
    labels, held = labels.withColumn("_own", level), held.select(F.col("_group").alias("b_group"), *(F.col(c).alias(f"b_{c}") for c in "wsen"), level.alias("b_own"))
    levels = sorted({r[0] for some, own in ((labels, "_own"), (held, "b_own")) for r in some.select(own).distinct().collect()})  # some dozens at most
    sent = held.count() <= SENT_BOXES
    for v in levels:
        side = 2.0**v
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side) - 1, F.floor(F.col(b) / side)))
        boxes = held.filter(F.col("b_own") <= v).withColumn("b_x", cells("b_w", "b_e")).withColumn("b_y", cells("b_s", "b_n"))
        at = lambda c: F.when((F.col("_own") <= v) & ~F.col("allow_overlap"), F.floor(F.col(c) / side))
        over = (F.col("b_w") < F.col("e")) & (F.col("b_e") > F.col("w")) & (F.col("b_s") < F.col("n")) & (F.col("b_n") > F.col("s"))
        met = (F.col("_group") == F.col("b_group")) & (at("w") == F.col("b_x")) & (at("s") == F.col("b_y")) & ((F.col("_own") == v) | (F.col("b_own") == v)) & over
        labels = labels.join(F.broadcast(boxes) if sent else boxes, met, "left_anti")
    return labels.drop("_own")


def by_rounds(labels: DataFrame) -> DataFrame:
    """_group, label_id of the labels that are shown, by rounds of joins: no task holds a group.

    A label is dealt to squares of its own size, four at most, and of the larger
    sizes in use. In a square, those of its size wait for whatever is earlier,
    smaller ones for earlier ones of its size. What waits for nothing is shown,
    what it overlaps is not, and the rest goes on. A round shows one blocker of
    its size at most in a square, so a crowded square isn't all pairs; only
    labels that are shown anyway meet all others of their squares.
    """
    box, square = ["w", "s", "e", "n"], ["_group", "level", "cx", "cy"]
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(2.0**-20))
    order = F.struct((-F.col("priority")).alias("p"), "sort_key", "label_id", "_row").alias("ord")
    rows = labels.withColumn("_row", F.monotonically_increasing_id()).select("_group", "label_id", "_row", order, *box, "allow_overlap", (~F.col("ignore_placement")).alias("holds"), F.ceil(F.log2(size)).cast("int").alias("own")).checkpoint()
    levels = sorted(r.own for r in rows.select("own").distinct().collect())  # some dozens at most: sizes from 2**-20 by powers of two

    def dealt(some: DataFrame) -> DataFrame:
        at = some.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("own"))))
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.pow(F.lit(2.0), "level")), F.floor(F.col(b) / F.pow(F.lit(2.0), "level"))))
        return at.withColumn("cx", cells("w", "e")).withColumn("cy", cells("s", "n")).withColumn("is_own", F.col("level") == F.col("own"))

    def covered(waiting: DataFrame, taken: DataFrame) -> DataFrame:
        """_row of the waiting that what is taken overlaps and precedes."""
        other = taken.select(*square, F.col("is_own").alias("b_own"), F.col("ord").alias("b_ord"), *(F.col(c).alias(f"b_{c}") for c in box))
        over = (F.col("b_w") < F.col("e")) & (F.col("b_e") > F.col("w")) & (F.col("b_s") < F.col("n")) & (F.col("b_n") > F.col("s"))
        met = waiting.join(other, square).filter((F.col("is_own") | F.col("b_own")) & over & (F.col("b_ord") < F.col("ord")))
        return met.select("_row").distinct()

    free = rows.filter("allow_overlap")
    left = rows.filter("not allow_overlap")
    shown = free.select("_group", "label_id")
    if not free.filter("holds").isEmpty():
        left = left.join(covered(dealt(left), dealt(free.filter("holds"))), "_row", "left_anti").checkpoint()
    while not left.isEmpty():
        at = dealt(left)
        first = at.filter("holds").groupBy(*square).agg(F.min("ord").alias("any"), F.min(F.when(F.col("is_own"), F.col("ord"))).alias("large"))
        waits = at.join(first, square).filter(F.when(F.col("is_own"), F.col("any")).otherwise(F.col("large")) < F.col("ord")).select("_row").distinct()
        now = left.join(waits, "_row", "left_anti").checkpoint()
        shown = shown.unionByName(now.select("_group", "label_id"))
        rest = left.join(now.select("_row"), "_row", "left_anti")
        left = rest.join(covered(dealt(rest), dealt(now.filter("holds"))), "_row", "left_anti").checkpoint()
    return shown


# Distances of grid lines in degrees.
INTERVALS = (90, 45, 30, 15, 10, 5, 2, 1, 0.5, 0.25, 0.1, 0.05, 0.01)


def grid_interval(zoom: float, latitude: float = 0.0) -> float:
    """The interval whose lines are closest to 100 pixels apart, the larger of equally close ones."""
    pixels = 256 * 2**zoom / 360 * max(0.01, math.cos(math.radians(latitude)))
    return min(INTERVALS, key=lambda i: abs(math.log(max(1.0, pixels * i) / 100)))


def graticule(views: DataFrame, interval: float, most: int | None = None) -> DataFrame:
    """views(view_id, w, s, e, n): a row for each grid line: kind (meridian or parallel) and value; `most` at most of a kind, if it is given."""
    few = lambda lines: lines if most is None else F.slice(lines, 1, most)
    span = lambda a, b: F.filter(F.sequence(F.ceil(a / interval), F.greatest(F.ceil(a / interval), F.floor(b / interval))), lambda k: k * interval <= b)
    south, north = F.greatest(F.col("s"), F.lit(-85.0)), F.least(F.col("n"), F.lit(85.0))
    lines = F.concat(
        F.transform(few(span(F.col("w"), F.col("e"))), lambda k: F.struct(F.lit("meridian").alias("kind"), (k * interval).alias("value"))),
        F.transform(few(span(south, north)), lambda k: F.struct(F.lit("parallel").alias("kind"), (k * interval).alias("value"))),
    )
    return views.select("view_id", F.explode(lines).alias("l")).select("view_id", "l.kind", "l.value")


def color_table(stops: list[tuple[float, str]], size: int = 256) -> list[tuple[int, int, int, int]]:
    """`size` RGBA entries of a ramp of (0..1, colour) stops."""
    at = np.linspace(0, 1, size)
    colors = np.array([parse_color(c) for _, c in stops], float) * (1, 1, 1, 255)
    return [tuple(int(v) for v in row) for row in np.floor(np.column_stack([np.interp(at, [s for s, _ in stops], colors[:, k]) for k in range(4)]) + 0.5)]


def tile_to_lonlat(features: DataFrame) -> DataFrame:
    """features(z, x, y, extent, parts of tile units) with parts in degrees."""
    from ..functions import mercator as M

    n = F.pow(F.lit(2.0), F.col("z"))
    turn = lambda p: F.struct(M.lon_of_world((F.col("x") + p["x"] / F.col("extent")) / n, False).alias("x"), M.lat_of_world((F.col("y") + p["y"] / F.col("extent")) / n).alias("y"))
    return features.withColumn("parts", F.transform("parts", lambda part: F.transform(part, turn)))


def holes_to_outers(rings: DataFrame) -> DataFrame:
    """relation_id, hole_id, outer_id of rings(relation_id, ring_id, role, ring): the smallest outer that holds the hole's first vertex; null if none.

    The test runs within relations: an equi-join, then even-odd crossings of a
    horizontal ray, as Columns.
    """
    from ..functions.geometry import signed_area

    outers = rings.filter("role = 'outer'").select("relation_id", F.col("ring_id").alias("outer_id"), F.col("ring").alias("outer"), F.abs(signed_area(F.col("ring"))).alias("area"))
    holes = rings.filter("role = 'inner'").select("relation_id", F.col("ring_id").alias("hole_id"), F.get("ring", F.lit(0)).alias("p"))
    px, py = F.col("p.x"), F.col("p.y")
    n = F.size("outer")
    edges = F.zip_with(F.slice("outer", 1, n - 1), F.slice("outer", 2, n - 1), lambda a, b: F.when(((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    inside = F.aggregate(edges, F.lit(0), lambda acc, v: acc + v) % 2 == 1
    met = holes.join(outers, "relation_id").filter(inside).groupBy("relation_id", "hole_id").agg(F.min(F.struct("area", "outer_id"))["outer_id"].alias("outer_id"))
    return holes.select("relation_id", "hole_id").join(met, ["relation_id", "hole_id"], "left")
