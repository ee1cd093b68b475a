"""N-gram Jaccard join by PartEnum signatures.

Sizes of sets are cut into overlapping bands, so that any two sets that may link
are of one band, and there differ in at most k shingles. For each band the
domain of shingles is cut into k / 2 + 1 partitions, one of which has at most one
of k differences, and each of those into three parts. A set has a signature for
each two of the three parts of each partition: what it holds of them. Two linked
sets share one, as one difference is in one part.

Sets that share a signature are a bucket. Buckets with the same members are one.
In a bucket, parity sketches bound the differences from below, and only a
spanning forest of the nearest pairs is verified; then what the sketches
couldn't rule out between sets that are still apart. So a bucket is never
expanded into its pairs, and no link between different sets is lost.

Shingles, and whole sets, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, forget, slices, written
from .simhash import components

#: Linked are sets whose intersection is LINK / OF of their union at least.
LINK, OF, WORDS = 85, 100, 4
#: The largest size of a band over its smallest, and the parts of a partition.
GROWTH, PARTS = 1.6, 3
#: Members of a bucket that meet in one group; one in DELEGATES goes on to meet those of other groups.
PART, DELEGATES = 1024, 512
#: Bits of parity sketches: four for each shingle up to MEDIUM, then as many as leave the bound useful, up to SKETCH.
MEDIUM, SKETCH = 1 << 12, 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, letters by their lower case, and for each of the first places in a word; and which bytes are of words.
OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
OF_PLACE = mixed(np.arange(1001, 1001 + (1 << 12), dtype=np.uint64)) | np.uint64(1)
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def word_hashes(text: bytes) -> np.ndarray:
    """The hash (uint64) of each word, whatever the case of its ASCII letters."""
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    sizes = edges[1::2] - edges[::2]
    if not len(sizes):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    of_place = OF_PLACE if sizes.max() <= len(OF_PLACE) else mixed(np.arange(1001, 1001 + sizes.max(), dtype=np.uint64)) | np.uint64(1)
    return mixed(np.add.reduceat(OF_BYTE[data[inside[1:-1]]] * of_place[place], starts) + sizes.astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes (uint64, ascending) of the text's different shingles; fewer words are one shingle, none are none.

    A shingle's hash is made of its words' hashes and their number.
    """
    each = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(each):
        return each
    n = min(words, len(each))
    out = np.full(len(each) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out + each[k : k + len(out)])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def digest(values: np.ndarray) -> int:
    """A set's own hash, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).view(np.int64))


def bands(largest: int) -> list[tuple[int, int]]:
    """The smallest and largest sizes of the bands, up to the first that holds `largest`."""
    found = [(1, 1)]
    while found[-1][1] < largest:
        # the smallest set that may link to one beyond the band
        low = -(-LINK * (found[-1][1] + 1) // OF)
        found.append((low, max(low, int(GROWTH * low))))
    return found


def differences(sizes: int) -> int:
    """The most shingles that two linked sets, of so many together, may differ in."""
    return sizes * (OF - LINK) // (OF + LINK)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (int64) of sets that aren't empty, and whose each is."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    found, owners = [], []
    for number, (low, high) in enumerate(bands(int(sizes.max(initial=1)))):
        mine = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(mine):
            continue
        k = differences(2 * high)
        partitions, parts = (k // 2 + 1, PARTS) if k else (1, 1)
        values = np.concatenate([sets[i] for i in mine])
        cells = np.repeat(np.arange(len(mine)), sizes[mine]) * (partitions * parts)
        # values ascend in each set, and so do their parts
        cells += ((values >> np.uint64(32)) * np.uint64(partitions * parts) >> np.uint64(32)).astype(np.int64)
        starts = np.append(0, np.flatnonzero(np.diff(cells)) + 1)
        held = np.zeros(len(mine) * partitions * parts, np.uint64)
        held[cells[starts]] = mixed(np.add.reduceat(mixed(values), starts))
        held, there = held.reshape(len(mine), partitions, parts), np.zeros(len(held), bool)
        there[cells[starts]] = True
        there = there.reshape(held.shape)
        # a partition serves if no two of its parts are empty; with enough of them, what is empty needs no signature
        serves = there.sum(2) >= max(1, parts - 1)
        enough = (2 if k else 1) * serves.sum(1) > k
        for left_out in range(parts):
            chosen = [p for p in range(parts) if p != left_out or parts == 1]
            place = np.uint64(number << 48 | left_out << 40) + np.arange(partitions, dtype=np.uint64)
            signature = mixed(place)[None, :]
            for p in chosen:
                signature = mixed(signature + held[:, :, p])
            keep = there[:, :, chosen].any(2) | ~enough[:, None]
            found.append(signature[keep])
            owners.append(np.broadcast_to(mine[:, None], keep.shape)[keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).view(np.int64), np.concatenate(owners)


def sketch(values: np.ndarray) -> bytes:
    """The parities of the numbers of values whose last bits are 0, 1, ..."""
    power = lambda n: 1 << (n - 1).bit_length()
    bits = min(SKETCH, max(64, min(MEDIUM, power(4 * len(values))), power(-(-len(values) // 2))))
    return np.packbits(np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """A row of words for each sketch, all as short as the shortest."""
    short = min(map(len, sketches))
    return np.array([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, short // 8), axis=0) for s in sketches])


def near(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At least how many shingles sets differ in from one, and which of them may be linked to it."""
    least = np.bitwise_count(many ^ one).sum(1, dtype=np.int64)
    return least, least <= differences(sizes + size)


def nearest_pairs(sketches: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may be linked, of the least differences."""
    n, far = len(sizes), np.iinfo(np.int64).max
    least, origin, out, pairs = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        i = int(np.where(out, least, far).argmin())
        if not out[i]:
            i = int(out.argmax())
        if least[i] < far:
            pairs.append((int(origin[i]), i))
        out[i] = False
        rest = np.flatnonzero(out)
        d, linked = near(sketches[i], sketches[rest], sizes[i], sizes[rest])
        nearer = rest[linked & (d < least[rest])]
        least[nearer], origin[nearer] = d[linked & (d < least[rest])], i
    return pairs


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of sorted batches, by their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        by = np.array([table.column(k).to_numpy() for k in range(keys)])
        cuts = np.flatnonzero((by[:, 1:] != by[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
            yield table.slice(a, b - a)
        held = table.slice(int(cuts[-1]) if len(cuts) else 0).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


def forest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members by group (sig, part, h, n, sketch): pairs to verify that connect whatever may be linked."""
    for group in whole_groups(batches, 2):
        h = group.column(2).to_numpy()
        if len(h) > 1:
            yield pairs_of([(int(h[i]), int(h[j])) for i, j in nearest_pairs(folded(group.column(4).to_pylist()), group.column(3).to_numpy())])


def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members by group (sig, part, other, inner, h, n, root, sketch): pairs of an inner set and any that may be linked and aren't of one root."""
    for group in whole_groups(batches, 3):
        inner, h, n, root = (group.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7))
        sketches = folded(group.column(7).to_pylist())
        for i in np.flatnonzero(inner).tolist():
            apart = np.flatnonzero(~inner & (root != root[i]))
            partners = h[apart[near(sketches[i], sketches[apart], n[i], n[apart])[1]]] if len(apart) else apart
            if len(partners):
                yield pairs_of([(int(h[i]), int(p)) for p in partners])


def of_texts(docs: DataFrame, kind: str, words: int) -> DataFrame:
    """From docs (doc_id, text) by kind: heads (doc_id, n, h; null h without words), signatures (sig, h), sketches (h, n, sketch), or sets (h, n, s)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column(1)).to_pylist()):
                sets = [shingles(t.as_py(), words) for t in batch.column(1)[a:b]]
                if kind == "heads":
                    hashes = pa.array([digest(s) if len(s) else None for s in sets], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(map(len, sets), pa.int64()), hashes], ["doc_id", "n", "h"])
                    continue
                different = {digest(s): s for s in sets if len(s)}
                hashes, sets = np.array(list(different), np.int64), list(different.values())
                if kind == "signatures":
                    found, owners = signatures(sets)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(hashes[owners])], ["sig", "h"])
                    continue
                columns = [pa.array(hashes), pa.array(map(len, sets), pa.int64())]
                if kind == "sketches":
                    columns.append(pa.array(map(sketch, sets), pa.binary()))
                else:
                    ends = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["h", "n", "sketch" if kind == "sketches" else "s"])

    schemas = {"heads": "doc_id long, n long, h long", "signatures": "sig long, h long", "sketches": "h long, n long, sketch binary", "sets": "h long, n long, s array<long>"}
    return docs.mapInArrow(work, schemas[kind])


def of_them(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose column `name` is in keys, a table; up to BROADCAST_IDS keys are broadcast."""
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(keys) if few else keys, rows[name].eqNullSafe(keys[name]), "left_semi")


def of_sets(texts: DataFrame, heads: DataFrame, wanted: DataFrame, kind: str, words: int) -> DataFrame:
    """The sketches or sets of the h in wanted, each from one text; a table."""
    ids = written(heads.join(wanted, "h").groupBy("h").agg(F.min("doc_id").alias("doc_id")), "wanted")
    rows = of_them(of_texts(of_them(texts, ids.select("doc_id").distinct(), "doc_id"), kind, words), ids.select("h"), "h")
    found = written(rows.groupBy("h").agg(*(F.first(c).alias(c) for c in rows.columns[1:])), kind)
    forget(ids)
    return found


def both_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, and the other columns of the rows of h = a and h = b."""
    a, b = (rows.select(*(F.col(c).alias(name if c == "h" else f"{c}_{name}") for c in rows.columns)) for name in "ab")
    return pairs.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * LINK)


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs a, b that the sketches don't rule out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, y = folded([x, y])
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= differences(n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both_of(pairs, sketches).select("a", "b", F.col("n_a") + F.col("n_b"), "sketch_a", "sketch_b").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """The pairs a, b of a table that are linked; a table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * shared >= LINK * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sets = of_sets(texts, heads, pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "sets", words)
    found = written(both_of(pairs, sets).select("a", "b", "s_a", "s_b").mapInArrow(work, "a long, b long"), "set-links")
    forget(sets)
    return found


def set_links(texts: DataFrame, heads: DataFrame, words: int = WORDS, part: int = PART) -> DataFrame:
    """a, b: links between sets (by h) of texts that connect whatever is linked; a table."""
    # sets that share a signature, at least two different ones; sums of 40 bits tell who they are
    shared = of_texts(texts, "signatures", words).groupBy("sig").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.try_sum(F.shiftright("h", 24)).alias("who"))
    same = ["low", "high", "who", F.when(F.col("who").isNull(), F.col("sig"))]
    buckets = written(shared.filter("low < high").groupBy(*same).agg(F.min("sig").alias("sig")).select("sig", "low", "high", "who"), "buckets")
    two = F.coalesce(F.col("who") == F.shiftright("low", 24) + F.shiftright("high", 24), F.lit(False))
    twos = buckets.filter(two).select(F.col("low").alias("a"), F.col("high").alias("b"))
    members = of_them(of_texts(texts, "signatures", words), buckets.filter(~two).select("sig"), "sig")
    members = written(members.distinct(), "members")
    sketches = of_sets(texts, heads, members.select("h").union(twos.select("a")).union(twos.select("b")).distinct(), "sketches", words)

    many = members.groupBy("sig").agg(F.expr(f"(count(*) + {part - 1}) div {part}").alias("parts"))
    dealt = members.join(many, "sig").withColumn("part", F.pmod(F.xxhash64("h"), "parts"))
    # a few of each part of a crowded bucket meet in a group of their own
    delegates = dealt.filter((F.col("parts") > 1) & (F.pmod(F.xxhash64("h", F.lit(1)), F.lit(DELEGATES)) == 0))
    delegates = delegates.withColumn("part", -1 - F.pmod(F.xxhash64("h"), F.expr(f"parts div {DELEGATES} + 1")))
    # sketches come last, and go through one exchange
    columns = ["sig", "part", "h"]
    rows = dealt.select(*columns).union(delegates.select(*columns)).join(sketches, "h").select(*columns, "n", "sketch").repartition("sig", "part").sortWithinPartitions("sig", "part", "h")
    first = written(rows.mapInArrow(forest_pairs, "a long, b long").union(possible(twos.distinct(), sketches)).distinct(), "pairs")
    links = verified(first, texts, heads, words)

    # buckets whose sets aren't all of one root: those of other roots than most meet all the rest
    roots = components(links).withColumnRenamed("node", "h")
    rooted = written(members.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "rooted")
    of_root = rooted.groupBy("sig", "root").agg(F.count("*").alias("m")).groupBy("sig").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("of_main"), F.sum("m").alias("m"))
    of_root = of_root.filter("of_main < m").select("sig", "main", F.expr(f"(m + {part - 1}) div {part}").alias("parts"), F.expr(f"(m - of_main + {part - 1}) div {part}").alias("others"))
    apart = rooted.join(of_root, "sig")
    outer = apart.withColumns({"part": F.pmod(F.xxhash64("h"), "parts"), "other": F.explode(F.expr("sequence(0L, others - 1)")), "inner": F.lit(False)})
    inner = apart.filter("root <> main").withColumns({"part": F.explode(F.expr("sequence(0L, parts - 1)")), "other": F.pmod(F.xxhash64("h"), "others"), "inner": F.lit(True)})
    columns = ["sig", "part", "other", "inner", "h"]
    rows = outer.select(*columns, "root").union(inner.select(*columns, "root")).join(sketches, "h").select(*columns, "n", "root", "sketch").repartition("sig", "part", "other").sortWithinPartitions("sig", "part", "other", "h")
    second = written(rows.mapInArrow(open_pairs, "a long, b long").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = verified(second, texts, heads, words)
    found = written(links.union(more), "set-links")
    for table in (buckets, members, sketches, first, second, links, more, rooted):
        forget(table)
    return found


def jaccard_classes(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    n_shingles is the number of different shingles of the whole text, one if it
    has fewer words. component_id is the least id that links lead to. Null and
    blank texts have no shingle and are linked with nothing: their component is
    their own id. Rows that repeat an id stand for themselves. Null ids are the
    least only where a component has no other. An empty table gives an empty
    table. Other columns play no part, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    heads = written(of_texts(texts, "heads", words), "heads")
    roots = components(set_links(texts, heads, words))
    sets = heads.filter("n > 0").groupBy("h").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    sets = written(sets, "classes")
    classes = sets.join(sets.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h", "component_id")
    found = heads.filter("n > 0").join(classes, "h").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(heads.filter("n = 0").select("doc_id", "n", "doc_id"))
