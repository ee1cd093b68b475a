"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are sorted by their rank in Gray order, which puts those that share
bits next to each other. Each run of LEAF neighbours becomes a node with the
bits that all of them share (a mask and a pattern), each run of FAN nodes a node
above with the bits that its nodes share, less than those below. A search goes
down with the number of differences so far, adds those in the bits that a node
fixes and its parent does not, and leaves the node's whole group as soon as they
exceed the radius.

One index of all fingerprints would grow with the corpus, so it is grown as many
trees, one for each masked pattern: fingerprints that differ in at most RADIUS
of 64 bits are equal in one of RADIUS + 1 blocks of bits, and each value of a
block is a group with a tree of its own. A value that more than PART
fingerprints share is dealt out again, by RADIUS + 1 blocks of the bits that are
left, so groups stay small however many fingerprints there are, and the copies
of one grow with the logarithm of their number. After LEVELS rounds, groups that
are still larger are cut into parts by a hash, and each two parts are a group.

Copies are one fingerprint. Groups return links of a spanning forest, never all
pairs. Components are then found by rounds of joins over these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, text_key, without, written

RADIUS, WORDS = 4, 4
PART, LEAF, FAN, LEVELS = 4096, 8, 8, 3
#: Pairs that a search may hold at once, and rows of groups that are searched together.
FRONTIER, TOGETHER = 1 << 20, 1 << 17
#: What a group is: the mask's number, the masked bits, and two parts.
GROUP = ["mask", "bits", "low", "high"]


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of the text's word shingles; no words: 0."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        shingles = [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp: the fingerprint as a signed 64-bit number. Null counts as empty: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "") for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_key long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: its prefix parities."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree for each group of codes (uint64); groups are numbered from 0, and each has a code at least."""

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(codes), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, of_node = codes[self.order], group[self.order]
        self.sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        #: from the leaves up: patterns and masks of the nodes of a level, where their children begin and end, and the last code below
        self.levels: list[tuple[np.ndarray, ...]] = []
        patterns, masks, last, fan = self.codes, np.full(len(codes), ~np.uint64(0)), np.arange(len(codes)), LEAF
        while len(codes) and (not self.levels or len(of_node) > len(self.sizes)):
            first = np.searchsorted(of_node, np.arange(len(self.sizes)))
            starts = np.flatnonzero((np.arange(len(of_node)) - first[of_node]) % fan == 0)
            ends = np.append(starts[1:], len(of_node))
            shared = np.bitwise_and.reduceat(patterns, starts) | ~np.bitwise_or.reduceat(patterns, starts)
            shared &= np.bitwise_and.reduceat(masks, starts)
            patterns, masks, last, of_node, fan = patterns[starts] & shared, shared, last[ends - 1], of_node[starts], FAN
            self.levels.append((patterns, masks, starts, ends, last))

    def search(self, queries: np.ndarray, radius: int, group: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in queries and in codes of all pairs with at most `radius` different bits, within the queries' groups.

        `after` leaves out, for each query, the codes up to this one in the order of the index.
        """
        if not self.levels:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        after = np.full(len(queries), -1) if after is None else after
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64) if group is None else group
        acc, above = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint64)
        for patterns, masks, starts, ends, last in reversed(self.levels):
            acc = acc + np.bitwise_count((queries[q] ^ patterns[node]) & masks[node] & ~above)
            near = (acc <= radius) & (last[node] > after[q])
            q, node, acc = q[near], node[near], acc[near]
            fan = ends[node] - starts[node]
            child = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(starts[node], fan)
            q, acc, above, node = np.repeat(q, fan), np.repeat(acc, fan), np.repeat(masks[node], fan), child
        near = (acc + np.bitwise_count((queries[q] ^ self.codes[node]) & ~above) <= radius) & (node > after[q])
        return q[near], self.order[node[near]]


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Joins the trees of root (a place's least known relative) along the links a, b, in place."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def group_links(codes: np.ndarray, groups: np.ndarray, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups (numbered from 0, in order) of different codes.

    Codes of part 0 are searched among those of part 1 of their group, and those
    of part -1 among themselves.
    """
    root = np.arange(len(codes))
    for whole in (True, False):
        theirs = np.flatnonzero(parts < 0 if whole else parts == 1)
        numbers, of_theirs = np.unique(groups[theirs], return_inverse=True)
        # a group may have codes of its first part alone
        ours = theirs if whole else np.flatnonzero((parts == 0) & np.isin(groups, numbers))
        if not len(ours):
            continue
        of_ours = np.searchsorted(numbers, groups[ours])
        index = GrayIndex(codes[theirs], of_theirs)
        place = np.empty(len(theirs), np.int64)
        place[index.order] = np.arange(len(theirs))
        # as many queries at once as may meet FRONTIER codes
        bound = np.cumsum(index.sizes[of_ours]) // FRONTIER
        cuts = np.append(np.append(0, np.flatnonzero(np.diff(bound)) + 1), len(ours)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            q, c = index.search(codes[ours[a:b]], radius, of_ours[a:b], place[a:b] if whole else None)
            forest(len(codes), ours[a + q], theirs[c], root)
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return codes[moved], codes[root[moved]]


def block_masks(levels: int, radius: int) -> list[list[int]]:
    """For each level the masks of its blocks, (radius + 1) ** level of them: mask k of a level is in masks k * (radius + 1) + j of the next."""
    found = [[0]]
    for _ in range(levels):
        after = []
        for mask in found[-1]:
            left = [b for b in range(63, -1, -1) if not mask >> b & 1]
            cuts = [len(left) * i // (radius + 1) for i in range(radius + 2)]
            after += [mask | sum(1 << b for b in left[a:z]) for a, z in zip(cuts, cuts[1:])]
        found.append(after)
    return found[1:]


def dealt_groups(fps: DataFrame, radius: int, part: int) -> DataFrame:
    """GROUP, side, fp of all groups of two fingerprints or more; side is -1, or in groups of two parts 0 or 1."""
    fan, found = radius + 1, None
    rows = fps.select("fp", F.lit(0).alias("mask"))
    for level, masks in enumerate(block_masks(LEVELS, radius)):
        signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))
        rows = rows.select("fp", F.explode(F.expr(f"sequence(mask * {fan}, mask * {fan} + {radius})")).alias("mask"))
        rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.get(signed, F.col("mask"))))
        counts = written(rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
        # the first blocks have fan * 2 ** (64 / fan) values
        rows = rows.join(F.broadcast(counts) if level == 0 and radius >= 4 else counts, ["mask", "bits"])
        # masks of all levels have numbers of their own
        small = rows.filter(F.col("n") <= part).select((F.col("mask") + F.lit(level << 16)).alias("mask"), "bits", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(-1).alias("side"), "fp")
        found = small if found is None else found.unionByName(small)
        rows = rows.filter(F.col("n") > part)
        if counts.filter(F.col("n") > part).isEmpty():
            return found
    # part i meets part j in group (min, max), and itself in (i, i)
    split = rows.withColumn("k", F.expr(f"int((n + {part - 1}) div {part})")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return found.unionByName(split.select((F.col("mask") + F.lit(LEVELS << 16)).alias("mask"), "bits", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), side.alias("side"), "fp"))


def links(fps: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """fps: different fingerprints, column fp. Links a, b that connect whatever is within the radius."""
    keyed = dealt_groups(fps, radius, part).repartition(*GROUP).sortWithinPartitions(*GROUP)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            groups = np.append(0, np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(0)))
            a, b = group_links(rows[5].view(np.uint64), groups, rows[4], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= TOGETHER:
                rows = np.concatenate(held, axis=1)
                # all but the last group is whole
                last = int((rows[:4] == rows[:4, -1:]).all(0).argmax())
                held = [rows[:, last:]]
                if last:
                    yield done(rows[:, :last])
        if held:
            yield done(np.concatenate(held, axis=1))

    return keyed.select(*GROUP, "side", "fp").mapInArrow(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of links a, b; root is the least node that can be reached.

    Rounds of large-star and small-star steps: each links the neighbours of a
    node to the least of them. Every round is a table in the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = written(pairs, "links")
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours to the least
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node, to the least
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        after = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        after = written(after, "links")
        # done when every node has one link, to a node that has none downwards
        tops = after.select(F.col("v").alias("u")).distinct()
        open_links = after.join(tops, "u", "left_semi").limit(1).count()
        several = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        forget(pairs)
        pairs = after
        if not open_links and not several:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes_of(docs: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, fp, component_id of each row of docs."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    codes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    codes = written(codes, "codes")
    found = components(links(codes.select("fp"), radius))
    classes = codes.join(found, codes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = classes.join(ids, "root").select("fp", "component_id")
    return prints.join(of_code, "fp").select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least id of a document that can be reached by links.
    Null and blank texts have fingerprint zero and are linked like any other.
    Rows that repeat an id are rows of one document. Null ids are never the
    least unless a component has no other. An empty table gives an empty table.
    Other columns play no part, whatever their names.
    """
    return classes_of(docs, radius, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document has the least id of its component, with all their columns. A row goes by its id and text: others of its id stay."""
    gone = classes_of(docs, radius, id_col, text_col).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text"))
    return without(docs, gone, {"_gone": docs[id_col], "_gone_text": text_key(docs[text_col])})
