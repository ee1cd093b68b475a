"""Point clusters per zoom: greedy in input order, exact and without a task that holds all points.

At a level, whatever is free in input order takes the free items within reach,
and stays alone if there are none. So what takes is the first of all items
within its reach, or within reach of earlier takers only through others: rounds
find takers that no open item with an earlier place can take, and leave out what
they reach. A square that is narrower than the reach has one taker at most, so
a round looks at the first open item of each square alone, and a crowded square
costs no more than others. Every item then belongs to the first taker within
its reach. Links between levels are rows, so no row grows with a cluster.

When few items are left, one task does the remaining levels. Clusters of three
and more items at least (min_points) don't follow that rule, as an item that
finds too few takes none; for those, connected components of filled squares are
scanned one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: So many items may be scanned as one group: 4 MB.
FEW = 50_000
#: Rounds of joins before components are scanned.
ROUNDS = 12
#: Side of the squares that have one taker at most, in reaches: their diagonal is shorter than the reach.
SIDE = 0.7
#: How properties of a cluster's items become one: sums, products, extremes, all true, any true; nulls are left out.
#: log* is the logarithm of the product of the positive ones, which doesn't pass the greatest double.
REDUCERS = ("+", "*", "log*", "max", "min", "all", "any")
ITEM = ["item_id", "seq", "x", "y", "n"]


class Clusters(NamedTuple):
    """levels: z, item_id, seq, x, y, n, made and the properties; made is true at the level where a cluster is made.

    links: z, cluster_id, child_id, place, child_seq: the items that a cluster
    of a level was made of; they are in the order of place and child_seq.
    """

    levels: DataFrame
    links: DataFrame


def cluster_id(seq, z):
    """A cluster's id: below zero, of its taker's place and the zoom."""
    return -(seq + 1) * 32 - z


def scan(x: np.ndarray, y: np.ndarray, n: np.ndarray, reach: float, least: int) -> list[list[int]]:
    """Groups of places, takers first, in the order of takers; the arrays are in input order."""
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy = np.floor(x / reach).astype(np.int64).tolist(), np.floor(y / reach).astype(np.int64).tolist()
    for i, key in enumerate(zip(cx, cy)):
        cells.setdefault(key, []).append(i)
    free, out, far = np.ones(len(x), bool), [], reach * reach
    for i in range(len(x)):
        if not free[i]:
            continue
        free[i] = False
        around = np.array([k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in cells.get((cx[i] + dx, cy[i] + dy), ())], np.int64)
        near = around[free[around] & ((x[around] - x[i]) ** 2 + (y[around] - y[i]) ** 2 <= far)]
        if not len(near) or n[i] + n[near].sum() < least:
            out.append([i])
        else:
            free[near] = False
            out.append([i, *near.tolist()])
    return out


def reduced(values: np.ndarray, kind: str) -> float:
    values = values[~np.isnan(values)]
    if not len(values):
        return float("nan")
    return float({"+": np.sum, "*": np.prod, "log*": np.sum, "max": np.max, "min": np.min, "all": np.min, "any": np.max}[kind](values))


def merge(frame: pd.DataFrame, z: int, reach: float, least: int, props: dict[str, str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The level z of items in frame, and its links. A cluster keeps its taker's place."""
    frame = frame.sort_values("seq", kind="stable").reset_index(drop=True)
    x, y, n = (frame[c].to_numpy() for c in ("x", "y", "n"))
    ids, seqs = frame["item_id"].to_numpy(), frame["seq"].to_numpy()
    values = {name: frame[name].to_numpy(float) for name in props}
    cx, cy = np.floor(x / reach), np.floor(y / reach)
    rows, links = [], []
    for group in scan(x, y, n, reach, least):
        taker = group[0]
        if len(group) == 1:
            rows.append((z, ids[taker], seqs[taker], x[taker], y[taker], n[taker], False, *(v[taker] for v in values.values())))
            continue
        total, own = n[group].sum(), cluster_id(seqs[taker], z)
        rows.append((z, own, seqs[taker], (x[group] * n[group]).sum() / total, (y[group] * n[group]).sum() / total, total, True, *(reduced(values[p][group], kind) for p, kind in props.items())))
        places = np.where(np.arange(len(group)) == 0, 0, 3 * (cx[group] - cx[taker]) + cy[group] - cy[taker] + 5)
        links += [(z, own, c, int(p), s) for c, p, s in zip(ids[group].tolist(), places, seqs[group].tolist())]
    return pd.DataFrame(rows, columns=["z", *ITEM, "made", *props]), pd.DataFrame(links, columns=["z", "item_id", "child_id", "place", "seq"])


def grouped(items: DataFrame, key: str | None, levels: list[int], reach_of, least: int, props: dict[str, str]) -> Clusters:
    """The levels of items, each group of key for itself."""
    columns = [*ITEM, *props]
    names = ["z", *ITEM, "made", *props, "child_id", "place"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in frame["items"]:
                now = pd.DataFrame([tuple(r[c] for c in columns) for r in rows], columns=columns)
                for z in levels:
                    now, links = merge(now, z, reach_of(z), least, props)
                    yield (pd.concat([now, links]) if len(links) else now).reindex(columns=names).astype({"n": "Int64", "made": "boolean", "child_id": "Int64", "place": "Int32"})

    schema = "z int, item_id long, seq long, x double, y double, n long, made boolean, " + "".join(f"{p} double, " for p in props) + "child_id long, place int"
    packed = (items.groupBy(key) if key else items.groupBy()).agg(F.collect_list(F.struct(*columns)).alias("items"))
    both = packed.select("items").mapInPandas(work, schema).checkpoint()
    level = both.filter("child_id is null").select("z", *ITEM, "made", *(F.nanvl(p, F.lit(None).cast("double")).alias(p) for p in props))
    return Clusters(level, both.filter("child_id is not null").select("z", F.col("item_id").alias("cluster_id"), "child_id", "place", F.col("seq").alias("child_seq")))


def squares(x: Column, y: Column, side: float) -> list[Column]:
    return [F.floor(x / side).alias("cx"), F.floor(y / side).alias("cy")]


def around(rows: DataFrame, steps: int) -> DataFrame:
    """rows once for each square within `steps` of their own."""
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-steps, steps + 1) for dy in range(-steps, steps + 1)))
    return rows.withColumn("move", F.explode(moves)).withColumn("cx", F.col("cx") + F.col("move.dx")).withColumn("cy", F.col("cy") + F.col("move.dy")).drop("move")


def takers(items: DataFrame, reach: float, by: list[str], rounds: int = ROUNDS) -> tuple[DataFrame | None, DataFrame]:
    """The takers that `rounds` find among items(by, seq, x, y, cx, cy), and the items that are still open; groups of `by` are apart."""
    cell, far = [*by, "cx", "cy"], reach * reach
    still = items.select(*cell, "seq", "x", "y").checkpoint()
    found = None
    for _ in range(rounds):
        firsts = still.groupBy(*cell).agg(F.min(F.struct("seq", "x", "y")).alias("f")).select(*cell, F.col("f.seq").alias("tseq"), F.col("f.x").alias("tx"), F.col("f.y").alias("ty")).checkpoint()
        if firsts.isEmpty():
            break
        asked = around(firsts, 2)
        near = (F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) <= far
        late = still.join(asked, cell).filter(near & (F.col("seq") < F.col("tseq"))).select(*by, "tseq").distinct()
        new = firsts.join(late, [*by, "tseq"], "left_anti").checkpoint()
        found = new if found is None else found.unionByName(new)
        gone = still.join(around(new, 2), cell).filter(near).select(*by, "seq").distinct()
        still = still.join(gone, [*by, "seq"], "left_anti").select(*cell, "seq", "x", "y").checkpoint()
    return found, still


def level_by_joins(items: DataFrame, reach: float, z: Column, props: dict[str, str], by: list[str]) -> Clusters:
    """The level of items, for clusters of two items and more; z may be a column of by."""
    at = items.withColumns({"cx": F.floor(F.col("x") / (SIDE * reach)), "cy": F.floor(F.col("y") / (SIDE * reach))})
    first, still = takers(at, reach, by)
    if not still.isEmpty():
        # chains of items, each of which waits for the one before: their components are apart from all else
        rest = chained(still, reach, by)
        first = rest if first is None else first.unionByName(rest)
    cell = [*by, "cx", "cy"]
    near = (F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) <= reach * reach
    taken = at.join(around(first, 2), cell).filter(near).groupBy(*by, "seq").agg(F.min(F.struct("tseq", "tx", "ty")).alias("t"))
    met = items.join(taken, [*by, "seq"]).withColumn("tseq", F.col("t.tseq"))
    sums = {"+": F.sum, "*": F.product, "log*": F.sum, "max": F.max, "min": F.min, "all": F.min, "any": F.max}
    only = F.min(F.when(F.col("seq") == F.col("tseq"), F.struct("item_id", "x", "y"))).alias("only")
    rows = met.groupBy(*by, "tseq").agg(F.count("*").alias("size"), only, F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"), F.sum("n").alias("n"), *(sums[kind](p).alias(p) for p, kind in props.items()))
    made = F.col("size") > 1
    pick = lambda total, own: F.when(made, F.col(total) / F.col("n")).otherwise(F.col(f"only.{own}"))
    level = rows.select(*by, z.cast("int").alias("z"), F.when(made, cluster_id(F.col("tseq"), z)).otherwise(F.col("only.item_id")).alias("item_id"), F.col("tseq").alias("seq"), pick("sx", "x").alias("x"), pick("sy", "y").alias("y"), "n", made.alias("made"), *props).checkpoint()
    clusters = level.filter("made").select(*by, F.col("seq").alias("tseq"), F.col("item_id").alias("cluster_id"))
    step = lambda c: F.floor(F.col(c) / reach) - F.floor(F.col(f"t.t{c}") / reach)
    place = F.when(F.col("seq") == F.col("tseq"), 0).otherwise(3 * step("x") + step("y") + 5).cast("int")
    links = met.join(clusters, [*by, "tseq"]).select(*by, z.cast("int").alias("z"), "cluster_id", F.col("item_id").alias("child_id"), place.alias("place"), F.col("seq").alias("child_seq"))
    return Clusters(level, links)


def chained(still: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """The takers among what rounds left open, each component of squares for itself."""
    cell = [*by, "cx", "cy"]
    labels = cell_components(still.select(*cell).distinct(), by, 2)
    packed = still.join(labels, cell).groupBy(*by, "label").agg(F.collect_list(F.struct("seq", "x", "y", "cx", "cy")).alias("items"))
    columns = ["seq", "x", "y", "cx", "cy"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, rows in enumerate(frame["items"]):
                now = pd.DataFrame([tuple(r[c] for c in columns) for r in rows], columns=columns).sort_values("seq", kind="stable").reset_index(drop=True)
                first = [g[0] for g in scan(now["x"].to_numpy(), now["y"].to_numpy(), np.ones(len(now), int), reach, 2)]
                out = now.iloc[first].rename(columns={"seq": "tseq", "x": "tx", "y": "ty"})
                yield out.assign(**{b: frame[b].iloc[k] for b in by})[[*by, "cx", "cy", "tseq", "tx", "ty"]]

    schema = ", ".join(f"{b} {still.schema[b].dataType.simpleString()}" for b in by) + ", " * bool(by) + "cx long, cy long, tseq long, tx double, ty double"
    return packed.select(*by, "items").mapInPandas(work, schema).checkpoint()


def cell_components(cells: DataFrame, by: list[str] = [], steps: int = 1) -> DataFrame:  # noqa: B006
    """by, cx, cy, label of filled cells(by, cx, cy): the least cell of those connected by at most `steps` sides or corners."""
    key, cell = F.struct("cx", "cy"), [*by, "cx", "cy"]
    nodes = cells.select(*cell, key.alias("label")).checkpoint()
    while True:
        least = around(nodes, steps).groupBy(*cell).agg(F.min("label").alias("near"))
        hooked = nodes.join(least, cell).select(*cell, F.least("label", "near").alias("label"))
        # jump: the label of the label
        of_label = hooked.select(*by, key.alias("label"), F.col("label").alias("up"))
        after = hooked.join(of_label, [*by, "label"]).select(*cell, F.least("label", "up").alias("label")).checkpoint()
        changed = after.join(nodes.withColumnRenamed("label", "old"), cell).filter("label <> old").limit(1).count()
        nodes = after
        if not changed:
            return nodes


def with_properties(points: DataFrame, props: dict[str, str]) -> DataFrame:
    unknown = set(props.values()).difference(REDUCERS)
    if unknown:
        raise ValueError(f"unknown reducers: {sorted(unknown)}")
    return points.select("item_id", "seq", "x", "y", F.lit(1).cast("long").alias("n"), *((F.log(F.col(p)) if kind == "log*" else F.col(p).cast("double")).alias(p) for p, kind in props.items()))


def cluster_points(points: DataFrame, radius: float = 50, max_zoom: int = 14, min_points: int = 2, min_zoom: int = 0, few: int = FEW, reducers: dict[str, str] | None = None) -> Clusters:
    """Clusters of points(item_id, seq, x, y, properties), x and y in world units, for the zooms max_zoom to min_zoom.

    Items pass through a level unchanged if nothing is near them. `seq` is the
    input order and must be unique. reducers names the properties that clusters
    have, with one of REDUCERS each: by default the sum of `value`. True is 1.
    """
    props = {"value": "+"} if reducers is None else reducers
    items = with_properties(points, props)
    reach_of = lambda z: radius / (512 * 2.0**z)
    done: list[Clusters] = []
    for z in range(max_zoom, min_zoom - 1, -1):
        if items.limit(few + 1).count() <= few:
            done.append(grouped(items, None, list(range(z, min_zoom - 1, -1)), reach_of, min_points, props))
            break
        if min_points <= 2:
            level = level_by_joins(items, reach_of(z), F.lit(z), props, [])
        else:
            at = items.select("*", *squares(F.col("x"), F.col("y"), reach_of(z)))
            labels = cell_components(at.select("cx", "cy").distinct())
            level = grouped(at.join(labels, ["cx", "cy"]), "label", [z], reach_of, min_points, props)
        done.append(level)
        items = level.levels.select(*ITEM, *props)
    levels, links = done[0]
    for more in done[1:]:
        levels, links = levels.unionByName(more.levels), links.unionByName(more.links)
    return Clusters(levels, links)


def cluster_tiles(tile_points: DataFrame, radius: float = 50, min_points: int = 2, extent: int = 4096, few: int = FEW) -> DataFrame:
    """The same within each tile(z, x, y) of tile_points(z, x, y, item_id, seq, px, py, value), px and py in tile units: z, x, y, seq, px, py, n, value.

    Tiles of up to `few` points are scanned one by one, others by joins; clusters
    of three and more items at least are scanned in all.
    """
    reach = radius * extent / 512
    tile = ["tile_z", "tile_x", "tile_y"]
    items = tile_points.select(F.col("z").alias("tile_z"), F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "item_id", "seq", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(1).cast("long").alias("n"), F.col("value").cast("double").alias("value"))
    full = items.groupBy(*tile).agg(F.count("*").alias("size")).filter((F.col("size") > few) & F.lit(min_points <= 2)).select(*tile).checkpoint()
    props, columns = {"value": "+"}, [*ITEM, "value"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for z, x, y, rows in zip(frame["tile_z"], frame["tile_x"], frame["tile_y"], frame["items"]):
                level = merge(pd.DataFrame([tuple(r[c] for c in columns) for r in rows], columns=columns), 0, reach, min_points, props)[0]
                out.append(level.assign(z=z, tile_x=x, tile_y=y))
            if out:
                yield pd.concat(out)[["z", "tile_x", "tile_y", "seq", "x", "y", "n", "value"]]

    packed = items.join(full, tile, "left_anti").groupBy(*tile).agg(F.collect_list(F.struct(*columns)).alias("items"))
    found = packed.mapInPandas(work, "z int, tile_x long, tile_y long, seq long, x double, y double, n long, value double")
    if not full.isEmpty():
        crowded = level_by_joins(items.join(full, tile, "left_semi"), reach, F.col("tile_z"), props, tile).levels
        found = found.unionByName(crowded.select(*found.columns))
    return found.select("z", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), "seq", F.col("x").alias("px"), F.col("y").alias("py"), "n", "value")


def leaves(links: DataFrame) -> DataFrame:
    """cluster_id, item_id of all points below each cluster: one join a level, from the clusters down."""
    made = links.select("cluster_id", F.col("child_id").alias("item_id")).checkpoint()
    down, out = made, made.filter("item_id >= 0")
    while not (inner := down.filter("item_id < 0")).isEmpty():
        down = inner.join(made.select(F.col("cluster_id").alias("item_id"), F.col("item_id").alias("below")), "item_id").select("cluster_id", F.col("below").alias("item_id")).checkpoint()
        out = out.unionByName(down.filter("item_id >= 0"))
    return out


def expansion_zoom(levels: DataFrame, max_zoom: int) -> DataFrame:
    """cluster_id and the zoom at which it comes apart: one above that at which it was made, at most max_zoom + 1."""
    made = levels.filter("made").select(F.col("item_id").alias("cluster_id"), "z")
    return made.select("cluster_id", F.least(F.col("z") + 1, F.lit(max_zoom + 1)).alias("zoom"))


def before(rows: DataFrame, by: list[str], order: list[str], value: Column, most_cells: int = 1 << 18) -> DataFrame:
    """rows with `_before`: the sum of value over the rows of the same `by` that come earlier in the order of whole-number columns.

    Ranges of the last column are summed first and the sums added up, so a group
    of any size is many windows; the order within a group must be without ties.
    """
    *lead, last = order
    low, high = rows.agg(F.min(last), F.max(last)).first()
    size = max(4096, ((high or 0) - (low or 0)) // most_cells + 1)
    cell = [*by, *lead, "_cell"]
    at = rows.withColumns({"_value": value, "_cell": F.floor((F.col(last) - F.lit(low or 0)) / size)})
    sums = at.groupBy(*cell).agg(F.sum("_value").alias("_sum"))

    def gone(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    starts = sums.select(*cell, gone("_sum", Window.partitionBy(*by).orderBy(*lead, "_cell")).alias("_start"))
    total = F.col("_start") + gone("_value", Window.partitionBy(*cell).orderBy(last))
    return at.join(starts, cell).withColumn("_before", total).drop("_value", "_cell", "_start")


class Tour(NamedTuple):
    """A walk through all clusters, children in order, each leaf counted once.

    spans: cluster_id, start, n: the cluster's leaves are those of places start
    to start + n - 1. places: item_id, at: the place of each leaf.
    """

    spans: DataFrame
    places: DataFrame


def tour(found: Clusters) -> Tour:
    """The walk through found: sizes give each child its offset in its cluster; starts go down from zoom to zoom, a join for each."""
    made = found.levels.filter("made").select(F.col("item_id").alias("cluster_id"), "seq", "n", F.pmod(-F.col("item_id"), F.lit(32)).cast("int").alias("z"))
    sizes = made.select(F.col("cluster_id").alias("child_id"), F.col("n").alias("size"))
    links = found.links.join(sizes, "child_id", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    children = before(links, ["cluster_id"], ["place", "child_seq"], F.col("size")).select("z", "cluster_id", "child_id", F.col("size").alias("n"), "_before").checkpoint()
    roots = made.join(children.select(F.col("child_id").alias("cluster_id")), "cluster_id", "left_anti")
    starts = before(roots, [], ["seq"], F.col("n")).select("cluster_id", F.col("_before").alias("start"), "n").checkpoint()
    spans, places = starts, None
    for z in sorted(r.z for r in children.select("z").distinct().collect()):  # a row a zoom
        here = children.filter(F.col("z") == z).join(spans.select("cluster_id", "start"), "cluster_id")
        rows = here.select("child_id", (F.col("start") + F.col("_before")).alias("at"), "n").checkpoint()
        spans = spans.unionByName(rows.filter("child_id < 0").select(F.col("child_id").alias("cluster_id"), F.col("at").alias("start"), "n"))
        leaf = rows.filter("child_id >= 0").select(F.col("child_id").alias("item_id"), "at")
        places = leaf if places is None else places.unionByName(leaf)
    if places is None:
        places = children.select(F.col("child_id").alias("item_id"), F.col("_before").alias("at"))
    return Tour(spans, places)


def leaves_in_order(found: Clusters, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """cluster_id, item_id, rank (from 1) of each cluster's leaves offset + 1 to offset + limit, depth first and children in order; all from offset on if limit is None.

    Leaves that aren't asked for are never made: a cluster asks for places, each of which one leaf has.
    """
    spans, places = tour(found)
    last = F.col("n") if limit is None else F.least("n", F.lit(offset + limit))
    asked = spans.withColumn("last", last).filter(F.col("last") > offset)
    step = 1 << 16  # so that no array grows with a cluster
    asked = asked.withColumn("first", F.explode(F.sequence(F.lit(offset).cast("long"), F.col("last") - 1, F.lit(step).cast("long"))))
    asked = asked.select("cluster_id", "start", F.explode(F.sequence("first", F.least(F.col("first") + step, "last") - 1)).alias("k"))
    return asked.select("cluster_id", (F.col("start") + F.col("k")).alias("at"), (F.col("k") + 1).alias("rank")).join(places, "at").select("cluster_id", "item_id", "rank")


def children(found: Clusters, points: DataFrame) -> DataFrame:
    """cluster_id, rank (from 1), item_id, x, y, n, cluster: the children of each cluster in order, as features; points as they were given."""
    ranked = before(found.links, ["cluster_id"], ["place", "child_seq"], F.lit(1).cast("long"))
    own = points.select("item_id", "x", "y", F.lit(1).cast("long").alias("n"), F.lit(False).alias("cluster"))
    features = own.unionByName(found.levels.filter("made").select("item_id", "x", "y", "n", F.lit(True).alias("cluster")))
    return ranked.select("cluster_id", (F.col("_before") + 1).alias("rank"), F.col("child_id").alias("item_id")).join(features, "item_id").select("cluster_id", "rank", "item_id", "x", "y", "n", "cluster")
