"""Costs, reachability and routes on weighted graphs.

Routes without a greatest cost are searched from both ends (`Growth`), so that
a search costs about twice the root of what one from the origin alone would.

Two engines give the same rows. Up to MOST_EDGES edges the adjacency is
broadcast as arrays and each origin is searched by a heap within a task. A
larger graph is searched by rounds of joins: the frontier, all improved nodes
of all origins, is joined with the edges on their start until nothing improves.
All of it is dealt out by node, so only what a round tries is shuffled and only
what it improves is written. Edges that alone cost too much are left out first.

Both give a tree for each origin: of the cheapest ways to a node that with the
fewest edges, and of those that whose last edge has the least id. So a route is
one and the same, whichever engine found it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2M edges in both directions are 4M arcs of 24 bytes.
MOST_EDGES = 2_000_000
#: The same for routes without a greatest cost: 20M arcs of 28 bytes. Rounds of joins would find the ways from each origin to all nodes.
MOST_EDGES_BETWEEN = 10_000_000
#: So many rounds are kept apart before what they found is written as one.
LAYERS = 8
#: What is known of a node: prev and edge_id are the step that leads to it, null at the origin.
TREE = ["origin", "node", "cost", "hops", "edge_id", "prev"]


def edge_cost(kind: str = "cost", mode: str | None = None, default_speed: float = 30.0) -> Column:
    """The cost of an edge, null where it can't be used: closed, or of other modes only."""
    distance, speed = F.col("distance"), F.coalesce(F.col("speed_kph"), F.lit(default_speed))
    value = {
        "distance": distance,
        "time": F.coalesce(F.col("time"), distance / (speed / 3.6)),
        "cost": F.coalesce(F.col("cost"), distance),
    }[kind]
    usable = ~F.coalesce(F.col("closed"), F.lit(False))
    if mode is not None:
        usable = usable & (F.col("modes").isNull() | F.array_contains("modes", mode))
    return F.when(usable & (value >= 0), value)


def arcs(edges: DataFrame) -> DataFrame:
    """Directed src, dst, cost, edge_id of edges(edge_id, from_id, to_id, cost, one_way); null costs are left out."""
    there = edges.filter("cost is not null").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "cost", "edge_id", "one_way")
    back = there.filter(~F.coalesce(F.col("one_way"), F.lit(False))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "edge_id", "one_way")
    return there.unionByName(back).drop("one_way")


class Adjacency:
    """Arcs by start; nodes by number. The arrays are made once, on the driver, and broadcast."""

    def __init__(self, frame: pd.DataFrame):
        src, dst, edge = (frame[c].to_numpy() for c in ("src", "dst", "edge_id"))
        self.nodes = np.unique(np.concatenate([src, dst]))
        src, dst = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.lexsort((edge, src))
        self.starts = np.searchsorted(src[order], np.arange(len(self.nodes) + 1))
        self.ends, self.costs, self.edges = dst[order].astype(np.int32), frame["cost"].to_numpy()[order], edge[order]

    @cached_property
    def backward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs by end: starts, the nodes that they come from, and their places."""
        order = np.argsort(self.ends, kind="stable").astype(np.int32)
        starts = np.searchsorted(self.ends[order], np.arange(len(self.nodes) + 1))
        return starts, np.repeat(np.arange(len(self.nodes), dtype=np.int32), np.diff(self.starts))[order], order

    def out(self, at: int) -> Iterator[tuple[int, int, int]]:
        """Node, cost and edge of the arcs from a node."""
        a, b = self.starts[at], self.starts[at + 1]
        return zip(self.ends[a:b].tolist(), self.costs[a:b].tolist(), self.edges[a:b].tolist())

    def into(self, at: int) -> Iterator[tuple[int, int, int]]:
        """Node, cost and edge of the arcs to a node."""
        starts, nodes, places = self.backward
        a, b = starts[at], starts[at + 1]
        k = places[a:b]
        return zip(nodes[a:b].tolist(), self.costs[k].tolist(), self.edges[k].tolist())

    def number(self, node: int) -> int:
        """The number of a node, -1 if no arc has it."""
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else -1

    def search(self, origin: int, max_cost: float, targets: set[int] | None = None) -> dict[int, tuple]:
        """(cost, hops, edge, number of the node before) by number of the nodes within max_cost; if targets are given, of those needed for them."""
        start = self.number(origin)
        if start < 0:
            return {}
        left = None if targets is None else {self.number(t) for t in targets} - {-1}
        found, done, heap = {start: (0, 0, None, None)}, {}, [(0, 0, start)]
        while heap and (left is None or left):
            cost, hops, at = heapq.heappop(heap)
            if at in done:
                continue
            done[at] = found[at]
            if left is not None:
                left.discard(at)
            a, b = self.starts[at], self.starts[at + 1]
            for to, step, edge in zip(self.ends[a:b].tolist(), self.costs[a:b].tolist(), self.edges[a:b].tolist()):
                after = cost + step
                if after > max_cost:
                    continue
                known = found.get(to)
                if known is None or (after, hops + 1) < known[:2]:
                    found[to] = (after, hops + 1, edge, at)
                    heapq.heappush(heap, (after, hops + 1, to))
                elif (after, hops + 1) == known[:2] and (edge, self.nodes[at]) < (known[2], self.nodes[known[3]]):
                    found[to] = (after, hops + 1, edge, at)
        return done


    def between(self, fore: Growth, target: int) -> tuple[int, list[int], list[int]] | None:
        """Cost, nodes (numbers) and edges of the way from where fore began to target, as `search` has it; None if there is none. Costs are integers."""
        back = Growth(self, target, self.into, fore.done)
        best = fore.found[target][:2] if target in fore.found else None
        while (a := fore.nearest()) is not None and (b := back.nearest()) is not None and (best is None or (a[0] + b[0], a[1] + b[1]) <= best):
            grown, other = (fore, back) if a[:2] <= b[:2] else (back, fore)
            # what is farther back than this, from nodes that fore hasn't settled, is of no shorter way
            for node, cost, hops in grown.settle(best[0] - a[0] if best and grown is back else math.inf):
                met = other.found.get(node)
                if met is not None and (best is None or (cost + met[0], hops + met[1]) < best):
                    best = cost + met[0], hops + met[1]
        if best is None:
            return None

        def before(at: int, cost: int, hops: int) -> list[tuple]:
            """Steps to a node that is this far from the start, from nodes that may be on a way as short: edge, node's name, node, cost and hops there. All of a way is settled from one end."""
            rows = []
            for node, step, edge in self.into(at):
                c, h = cost - step, hops - 1
                far = (*fore.done[node][:2],) if node in fore.done else tuple(b - d for b, d in zip(best, back.done[node])) if node in back.done else None
                if far == (c, h):
                    rows.append((edge, self.nodes[node], node, c, h))
            return rows

        def begins(step: tuple) -> bool:
            """Whether a node that is near enough to the target is as near to the start."""
            left, seen = [step[2:]], set()
            while left:
                node, cost, hops = left.pop()
                if node in fore.done:
                    return True
                if node not in seen:
                    seen.add(node)
                    left += [s[2:] for s in before(node, cost, hops)]
            return False

        nodes, steps, cost, hops = [target], [], *best
        while nodes[-1] not in fore.done:
            ways = before(nodes[-1], cost, hops)
            edge, _, node, cost, hops = min(ways if len(ways) == 1 else filter(begins, ways))
            nodes.append(node)
            steps.append(edge)
        while (step := fore.done[nodes[-1]])[3] is not None:
            steps.append(step[2])
            nodes.append(step[3])
        return best[0], nodes[::-1], steps[::-1]


class Growth:
    """A search from a node along arcs(node) of an Adjacency that settles one node at a time: found and done as in `Adjacency.search`. Nodes of `ends` are met, but not passed."""

    def __init__(self, graph: Adjacency, start: int, arcs, ends=frozenset()):
        self.names, self.arcs, self.ends = graph.nodes, arcs, ends
        self.found, self.done, self.heap = {start: (0, 0, None, None)}, {}, [(0, 0, start)]

    def nearest(self) -> tuple | None:
        """(cost, hops, node) of what is settled next."""
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None

    def settle(self, most: float) -> list[tuple[int, int, int]]:
        """Settles the nearest node; (node, cost, hops) of those that are nearer now, up to a cost."""
        cost, hops, at = heapq.heappop(self.heap)
        self.done[at] = self.found[at]
        hops, found, nearer = hops + 1, self.found, []
        for to, step, edge in self.arcs(at):
            after = cost + step
            if to in self.ends:
                nearer.append((to, after, hops))
                continue
            if after > most:
                continue
            known = found.get(to)
            if known is None or after < known[0] or (after == known[0] and hops < known[1]):
                found[to] = (after, hops, edge, at)
                heapq.heappush(self.heap, (after, hops, to))
                nearer.append((to, after, hops))
            elif after == known[0] and hops == known[1] and (edge, self.names[at]) < (known[2], self.names[known[3]]):
                found[to] = (after, hops, edge, at)
        return nearer


def broadcast_adjacency(edges: DataFrame, max_cost: float, most_edges: int):
    """The broadcast Adjacency of edges within max_cost, or None if there are more than most_edges."""
    ways = arcs(edges).filter(F.col("cost") <= max_cost).select("src", "dst", "cost", "edge_id")
    if ways.limit(2 * most_edges + 1).count() > 2 * most_edges:
        return None
    return edges.sparkSession.sparkContext.broadcast(Adjacency(ways.toArrow().to_pandas()))


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept(rows: DataFrame) -> DataFrame:
    """rows as a checkpoint that still tells how they are dealt out, which one of an adaptive plan doesn't."""
    conf = rows.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return rows.checkpoint()
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def cheapest(origins: DataFrame, edges: DataFrame, max_cost: float, most_edges: int = MOST_EDGES) -> DataFrame:
    """TREE rows of all nodes within max_cost (included) of origins(origin)."""
    kind = edges.schema["cost"].dataType.simpleString()
    starts = origins.select(F.col("origin").cast("long")).distinct()
    shared = broadcast_adjacency(edges, max_cost, most_edges)
    if shared is None:
        return cheapest_by_joins(starts, edges, max_cost)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        names = graph.nodes.tolist()
        kinds = [pa.int64(), pa.int64(), number, pa.int32(), pa.int64(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], TREE)

        for batch in batches:
            rows: list[tuple] = []
            for origin in batch.column(0).to_pylist():
                found = graph.search(origin, max_cost)
                rows += [(origin, names[n], c, h, e, None if p is None else names[p]) for n, (c, h, e, p) in found.items()] or [(origin, origin, 0, 0, None, None)]
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    number = pa.int64() if kind == "bigint" else pa.float64()
    schema = f"origin long, node long, cost {'long' if kind == 'bigint' else 'double'}, hops int, edge_id long, prev long"
    # origins are few bytes and much work
    return starts.repartition(parts_of(starts), "origin").mapInArrow(work, schema)


def cheapest_by_joins(origins: DataFrame, edges: DataFrame, max_cost: float, layers: int = LAYERS) -> DataFrame:
    """The same by rounds of joins. Edges, the frontier and what is known are dealt out by node once; a round shuffles what it tries and writes what it improves."""
    n = parts_of(origins)
    ways = arcs(edges).filter(F.col("cost") <= max_cost).select(F.col("src").alias("node"), "dst", F.col("cost").alias("step"), F.col("edge_id").alias("by"))
    ways = kept(ways.repartition(n, "node").sortWithinPartitions("node"))
    kind = edges.schema["cost"].dataType
    start = [F.lit(0).cast(kind).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("long").alias("prev")]
    found = kept(origins.select("origin", F.col("origin").alias("node"), F.struct(*start).alias("label"), F.lit(True).alias("better")).repartition(n, "node"))
    known = [found]

    def rows_of(new: bool, rows: DataFrame) -> DataFrame:
        return rows.select("origin", "node", "label", F.lit(new).alias("new"))

    def together() -> DataFrame:
        return reduce(DataFrame.union, (rows_of(False, k) for k in known))

    while not (frontier := found.filter("better")).isEmpty():
        label = F.struct((F.col("label.cost") + F.col("step")).alias("cost"), (F.col("label.hops") + 1).alias("hops"), F.col("by").alias("edge_id"), F.col("node").alias("prev"))
        tried = frontier.join(ways.hint("merge"), "node").select("origin", F.col("dst").alias("node"), label.alias("label")).filter(F.col("label.cost") <= max_cost)
        both = together().union(rows_of(True, tried.repartition(n, "node"))).groupBy("origin", "node").agg(F.min(F.when(F.col("new"), F.col("label"))).alias("label"), F.min(F.when(~F.col("new"), F.col("label"))).alias("old"))
        # a better last edge alone changes nothing beyond the node
        nearer = F.col("old").isNull() | (F.struct("label.cost", "label.hops") < F.struct("old.cost", "old.hops"))
        found = kept(both.filter("label is not null and (old is null or label < old)").select("origin", "node", "label", nearer.alias("better")))
        known.append(found)
        if len(known) > layers:
            known = [kept(together().groupBy("origin", "node").agg(F.min("label").alias("label")))]
    return together().groupBy("origin", "node").agg(F.min("label").alias("label")).select("origin", "node", "label.*")


def reachable(origins: DataFrame, edges: DataFrame, max_cost: float, most_edges: int = MOST_EDGES) -> DataFrame:
    """origin, node, cost of all nodes within max_cost (included) of origins(origin)."""
    return cheapest(origins, edges, max_cost, most_edges).select("origin", "node", "cost")


def reachable_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """origin, edge_id of edges whose both ends are reached and that can be used in some direction."""
    usable = edges.filter("cost is not null").select("edge_id", "from_id", "to_id")
    # read twice, searched once; the side of the starts stays where it is
    reached = kept(reached.select("origin", "node").repartition(parts_of(reached), "node"))
    a = reached.select("origin", F.col("node").alias("from_id"))
    b = reached.select("origin", F.col("node").alias("to_id"))
    return usable.hint("merge").join(a, "from_id").join(b.hint("merge"), ["origin", "to_id"], "left_semi").select("origin", "edge_id")


ROUTE = "origin long, target long, cost double, node_ids array<long>, edge_ids array<long>"


def routes(pairs: DataFrame, edges: DataFrame, max_cost: float = math.inf, most_edges: int | None = None) -> DataFrame:
    """origin, target, cost, node_ids, edge_ids of pairs(origin, target); nulls where there is no route within max_cost.

    A node's route to itself has cost 0, one node and no edge. Without a
    max_cost, routes of integer costs are searched from both ends.
    """
    asked = pairs.select(F.col("origin").cast("long"), F.col("target").cast("long"))
    both_ends = math.isinf(max_cost) and edges.schema["cost"].dataType.simpleString() in ("int", "bigint")
    most = (MOST_EDGES_BETWEEN if both_ends else MOST_EDGES) if most_edges is None else most_edges
    shared = broadcast_adjacency(edges, max_cost, most)
    if shared is None:
        return routes_by_joins(asked, edges, max_cost)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value

        def found_by(origin: int, targets: list[int]) -> Iterator[tuple]:
            if both_ends:
                start = graph.number(origin)
                fore = Growth(graph, start, graph.out)
                for target in targets:
                    at = graph.number(target)
                    way = graph.between(fore, at) if start >= 0 and at >= 0 and target != origin else None
                    yield way and (float(way[0]), graph.nodes[way[1]].tolist(), way[2])
                return
            found = graph.search(origin, max_cost, set(targets))
            for target in targets:
                at = graph.number(target)
                if at not in found:
                    yield None
                    continue
                nodes, steps = [at], []
                while found[nodes[-1]][3] is not None:
                    steps.append(found[nodes[-1]][2])
                    nodes.append(found[nodes[-1]][3])
                yield float(found[at][0]), graph.nodes[nodes[::-1]].tolist(), steps[::-1]

        def out(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["origin", "target", "cost", "node_ids", "edge_ids"])

        for frame in frames:
            rows, steps = [], 0
            for origin, targets in frame.groupby("origin")["target"]:
                for target, way in zip(targets.tolist(), found_by(origin, targets.tolist())):
                    way = (0.0, [origin], []) if target == origin else way or (None, None, None)
                    rows.append((origin, target, *way))
                    steps += len(way[1] or ())
                    if steps > 100_000:
                        yield out(rows)
                        rows, steps = [], 0
            yield out(rows)

    # a search serves all targets of an origin in the batch; pairs are few bytes and much work: dealt out by a hash of their own, which isn't merged with how they came
    return asked.repartition(parts_of(asked), F.xxhash64("origin")).sortWithinPartitions("origin").mapInPandas(work, ROUTE)


def routes_by_joins(pairs: DataFrame, edges: DataFrame, max_cost: float) -> DataFrame:
    """The same from the trees of cheapest_by_joins: each round takes all open routes one edge back."""
    tree = cheapest_by_joins(pairs.select("origin").distinct(), edges, max_cost)
    # dealt out once: the rounds shuffle the open routes alone
    tree = kept(tree.repartition(parts_of(tree), "origin", "node").sortWithinPartitions("origin", "node"))
    steps = tree.select("origin", F.col("node").alias("at"), "edge_id", "prev")
    ends = tree.select("origin", F.col("node").alias("target"), F.col("cost").cast("double").alias("cost"))
    found = pairs.distinct().join(ends.hint("merge"), ["origin", "target"])
    walks = found.select("origin", "target", "cost", F.col("target").alias("at"), F.array("target").alias("node_ids"), F.array().cast("array<long>").alias("edge_ids")).checkpoint()
    done = walks.filter("at = origin")
    while not (walks := walks.filter("at <> origin")).isEmpty():
        met = walks.join(steps.hint("merge"), ["origin", "at"])
        walks = met.select("origin", "target", "cost", F.col("prev").alias("at"), F.concat(F.array("prev"), "node_ids").alias("node_ids"), F.concat(F.array("edge_id"), "edge_ids").alias("edge_ids")).checkpoint()
        done = done.unionByName(walks.filter("at = origin"))
    return pairs.join(done.drop("at"), ["origin", "target"], "left").select("origin", "target", "cost", "node_ids", "edge_ids")


def route_shapes(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """found(origin, target, node_ids, edge_ids, ...) with `distance` and `line`, an array of x, y; null without a route.

    The line is the shapes(edge_id, from_id, distance, line) of the edges, read
    backwards where an edge is walked from its end. Where a shape begins with
    the position that the one before ended with, it is there once; gaps stay. A
    route without edges is the place of its node(node_id, lon, lat).
    """
    key = ["origin", "target"]
    steps = found.select(*key, "node_ids", F.posexplode("edge_ids").alias("k", "edge_id"))
    shapes = edges.select("edge_id", "from_id", "distance", "line")
    turned = F.when(F.col("from_id") == F.get("node_ids", F.col("k")), F.col("line")).otherwise(F.reverse("line"))
    parts = steps.hint("merge").join(shapes, "edge_id").select(*key, F.struct("k", turned.alias("line"), "distance").alias("part"))
    # a route is one row: no longer than its edges
    whole = parts.groupBy(*key).agg(F.sum("part.distance").alias("distance"), F.array_sort(F.collect_list("part")).alias("parts"))
    before = lambda i: F.element_at(F.get(F.col("parts"), i - 1)["line"], -1)
    joined = F.transform("parts", lambda p, i: F.when((i > 0) & (before(i) == F.get(p["line"], F.lit(0))), F.slice(p["line"], 2, F.greatest(F.size(p["line"]) - 1, F.lit(0)))).otherwise(p["line"]))
    whole = whole.select(*key, "distance", F.flatten(joined).alias("line"))
    at = nodes.select(F.col("node_id").alias("origin"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("place"))
    rows = found.join(whole.hint("merge"), key, "left").join(at, "origin", "left")
    stays = F.size("edge_ids") == 0
    line, metres = F.when(stays, F.col("place")).otherwise(F.col("line")), F.when(stays, F.lit(0.0)).otherwise(F.col("distance"))
    return rows.select(*found.columns, metres.alias("distance"), line.alias("line"))


def snapped(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests(request_id, node_id, lon, lat) as request_id, node_id, start_distance: the node that is asked for if there is one, else the nearest to lon and lat."""
    from .spatial import nearest_node

    known = requests.join(nodes.select("node_id"), "node_id", "left_semi").select("request_id", "node_id", F.lit(0.0).alias("start_distance"))
    others = requests.join(nodes.select("node_id"), "node_id", "left_anti").select(F.col("request_id").alias("point_id"), "lon", "lat")
    return known.unionByName(nearest_node(others, nodes).select(F.col("point_id").alias("request_id"), "node_id", F.col("metres").alias("start_distance")))


def patch_edges(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """edges(edge_id, cost, closed, ...) after patches(edge_id, seq, cost, closed): the last value of each column counts."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"].alias(f"_{c}")
    latest = patches.groupBy("edge_id").agg(last("cost"), last("closed"))
    return edges.join(latest, "edge_id", "left").withColumn("cost", F.coalesce("_cost", "cost")).withColumn("closed", F.coalesce("_closed", "closed")).drop("_cost", "_closed")


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id and code of edges that can't be part of a graph: loop, from, to, negative."""
    ids = nodes.select(F.col("node_id").alias("from_id"))
    missing_from = edges.join(ids, "from_id", "left_anti").select("edge_id", F.lit("from").alias("code"))
    missing_to = edges.join(ids.withColumnRenamed("from_id", "to_id"), "to_id", "left_anti").select("edge_id", F.lit("to").alias("code"))
    own = edges.select("edge_id", F.when(F.col("from_id") == F.col("to_id"), "loop").when(F.col("cost") < 0, "negative").alias("code")).filter("code is not null")
    return missing_from.unionByName(missing_to).unionByName(own)


def with_distance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with `distance`: their own, or where it is null or 0 the straight line between their nodes."""
    from ..functions.geodesy import haversine_m

    a = nodes.select(F.col("node_id").alias("from_id"), F.col("lon").alias("_ax"), F.col("lat").alias("_ay"))
    b = nodes.select(F.col("node_id").alias("to_id"), F.col("lon").alias("_bx"), F.col("lat").alias("_by"))
    straight = haversine_m(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))
    joined = edges.join(a, "from_id").join(b, "to_id")
    return joined.withColumn("distance", F.when(F.coalesce("distance", F.lit(0.0)) == 0, straight).otherwise(F.col("distance"))).drop("_ax", "_ay", "_bx", "_by")
