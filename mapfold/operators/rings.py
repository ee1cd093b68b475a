"""Rings of segments that meet at their ends, put in order by rounds of joins: no ring is held in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of up to so many segments are put in order in one task each, longer ones by rounds of joins.
FEW_SEGMENTS = 1 << 16


def ring_order(segments: DataFrame, key: str, few: int = FEW_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """Where segments(key, seq, a, b, steps) are on their rings, and the keys whose segments aren't all on rings.

    A segment goes from a to b, which are any comparable values and differ, in
    `steps` steps; seq is its own within the key. Two ends meet at each place,
    else the key is in the second frame (key) and has no rows in the first:
    key, seq, ring, back, start, total. A ring is named by its least seq, which
    is walked from a to b and starts at step 0; `back` is true where a segment
    is walked from b to a. Nulls in seq or an end make the key a broken one.

    Each segment is two arrows, one each way. An arrow's successor is known
    from the place where it ends. Keys of up to `few` segments are walked with
    one shuffle by key, for the others see by_rounds.
    """
    ends = F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("back")), F.struct(F.col("b").alias("at"), F.lit(1).alias("back")))
    # arrow 2 * seq goes from a to b, 2 * seq + 1 from b to a: each leaves one end
    leaving = segments.select(key, "seq", "steps", F.explode(ends).alias("e")).select(key, "e.at", "steps", (F.col("seq") * 2 + F.col("e.back")).alias("arrow"))
    places = leaving.groupBy(key, "at").agg(F.count("*").alias("n"), F.min("arrow").alias("lo"), F.min_by("steps", "arrow").alias("lo_steps"), F.max("arrow").alias("hi"), F.max_by("steps", "arrow").alias("hi_steps")).checkpoint()
    whole = (F.col("n") == 2) & F.col("at").isNotNull() & F.col("lo").isNotNull() & (F.col("lo") < F.col("hi"))
    # a place of a whole key is an end of one segment and an end of another: as many places as segments
    sizes = places.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole"))
    told = sizes.filter((F.col("n") > few) | ~F.col("whole")).checkpoint()
    broken = told.filter("not whole").select(key)
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
    # who arrives over the one leaves over the other
    pairs = F.array(*(F.struct(turned(x).alias("arrow"), F.col(f"{x}_steps").cast("long").alias("steps"), F.col(y).alias("ahead")) for x, y in (("lo", "hi"), ("hi", "lo"))))
    arrows = lambda some: some.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    kept = in_tasks(arrows(places.join(told, key, "left_anti")), key)
    long = told.filter("whole").select(key)
    if not long.isEmpty():
        kept = kept.unionByName(by_rounds(arrows(places.join(long, key, "left_semi")), key))
    start = F.when(F.col("off") == 0, F.lit(0).cast("long")).otherwise(F.col("total") - F.col("off"))
    return kept.select(key, F.floor(F.col("arrow") / 2).alias("seq"), F.floor(F.col("least") / 2).alias("ring"), (F.col("arrow") % 2 == 1).alias("back"), start.alias("start"), "total"), broken


def walked(key: np.ndarray, arrow: np.ndarray, ahead: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows, least arrow, steps to it and length of the rings, of arrows in order of (key, arrow): those whose ring's least arrow is even."""
    names, rank = np.unique(arrow, return_inverse=True)
    wide = key * len(names)
    follower = np.searchsorted(wide + rank, wide + np.searchsorted(names, ahead))
    least, off, span = arrow, np.zeros(len(arrow), np.int64), steps
    while True:
        closer = least[follower] < least
        if not closer.any():
            break
        off = np.where(closer, span + off[follower], off)
        least, span, follower = np.where(closer, least[follower], least), span + span[follower], follower[follower]
    rows = np.flatnonzero(least % 2 == 0)
    _, ring = np.unique(wide[rows] + np.searchsorted(names, least[rows]), return_inverse=True)
    total = np.zeros(len(rows), np.int64)
    np.add.at(total, ring, steps[rows])
    return rows, least[rows], off[rows], total[ring]


def in_tasks(arrows: DataFrame, key: str) -> DataFrame:
    """key, arrow, least, off, total of arrows(key, arrow, steps, ahead) that go the way of their ring's least segment.

    A task holds as many whole keys as fill FEW_SEGMENTS arrows, one at least.
    """
    numbered = arrows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("arrow")))

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, arrow, ahead, steps = (table.column(c).to_numpy() for c in ("k", "arrow", "ahead", "steps"))
        rows, *found = walked(np.cumsum(k == 1), arrow, ahead, steps)
        columns = [table.column(key).take(pa.array(rows)).combine_chunks(), pa.array(arrow[rows]), *map(pa.array, found)]
        yield from pa.table(columns, names=[key, "arrow", "least", "off", "total"]).to_batches(1 << 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            begins = np.flatnonzero(batch.column("k").to_numpy() == 1)
            held, n = [*held, batch], n + len(batch)
            if n >= FEW_SEGMENTS and len(begins):
                yield from told(pa.Table.from_batches([*held[:-1], batch.slice(0, begins[-1])]))
                held = [batch.slice(begins[-1])]
                n = len(held[0])
        if n:
            yield from told(pa.Table.from_batches(held))

    return numbered.mapInArrow(work, f"{key} {arrows.schema[key].dataType.simpleString()}, arrow long, least long, off long, total long")


def by_rounds(arrows: DataFrame, key: str) -> DataFrame:
    """The same for keys of any length, none of which is held in one task.

    Each round joins arrows with those twice as far ahead and keeps the least
    arrow seen and the steps to it, so a ring of n segments takes log2(n)
    rounds, and a round shuffles each arrow twice, by key and arrow.
    """
    state = arrows.select(key, "arrow", "steps", "ahead", F.col("arrow").alias("least"), F.lit(0).cast("long").alias("off"), F.col("steps").alias("span")).checkpoint()
    while True:
        there = state.select(key, F.col("arrow").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("least").alias("_least"), F.col("off").alias("_off"), F.col("span").alias("_span"))
        closer = F.col("_least") < F.col("least")
        state = state.join(there, [key, "ahead"]).select(
            key, "arrow", "steps", F.col("_ahead").alias("ahead"), F.least("least", "_least").alias("least"),
            F.when(closer, F.col("span") + F.col("_off")).otherwise(F.col("off")).alias("off"), (F.col("span") + F.col("_span")).alias("span"), closer.alias("moved"),
        ).checkpoint()
        if state.filter("moved").isEmpty():
            break
    # of a ring's two ways around, the one that its least segment goes
    kept = state.filter("least % 2 = 0")
    totals = kept.groupBy(key, "least").agg(F.sum("steps").alias("total"))
    return kept.join(totals, [key, "least"]).select(key, "arrow", "least", "off", "total")


def ring_positions(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """key, ring, place, x, y of the rings of lines(key, seq, line), and the keys whose lines don't make rings.

    Lines that are closed are rings of their own. Places count from 0, the
    last position is the first again. A key is broken, and has no positions, if
    a line has fewer than two positions or a null, if other than two ends meet
    anywhere, or if a ring has fewer than four positions. Lines without a key
    are left out.
    """
    lines = lines.filter(F.col(key).isNotNull())
    n, first, last = F.size("line"), F.get("line", F.lit(0)), F.element_at("line", -1)
    known = F.coalesce((n >= 2) & F.col("seq").isNotNull() & ~F.exists("line", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()), F.lit(False))
    lines = lines.select(key, "seq", "line", known.alias("known"), F.when(known, first == last).alias("closed"), n.alias("n")).checkpoint()  # read four times
    bad = lines.filter(~F.col("known") | (F.col("closed") & (F.col("n") < 4))).select(key)
    segments = lines.filter("known and not closed").select(key, "seq", first.alias("a"), last.alias("b"), (n - 1).cast("long").alias("steps"))
    order, open_ = ring_order(segments, key)
    zero = F.lit(0).cast("long")
    own = lines.filter("known and closed").select(key, "seq", F.col("seq").alias("ring"), F.lit(False).alias("back"), zero.alias("start"), (n - 1).cast("long").alias("total"))
    order = order.unionByName(own)
    broken = bad.unionByName(open_).unionByName(order.filter("total < 3").select(key)).distinct().checkpoint()
    walked = order.join(broken, key, "left_anti").join(lines.select(key, "seq", "line"), [key, "seq"])
    line = F.when(F.col("back"), F.reverse("line")).otherwise(F.col("line"))
    # a line's last position is the next one's first; the ring's last line keeps it
    upto = F.when(F.col("start") + F.size("line") - 1 == F.col("total"), F.size("line")).otherwise(F.size("line") - 1)
    rows = walked.select(key, "ring", "start", F.posexplode(F.slice(line, F.lit(1), upto)).alias("i", "p"))
    return rows.select(key, "ring", (F.col("start") + F.col("i")).alias("place"), "p.x", "p.y"), broken
