"""Moving entities that are patched, added and removed, and injected events.

A track is a table of frames(entity_id, time_ms, lon, lat, status, props), at
most one for each entity and time; props are map<string,string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import with_next

EMPTY = "map<string,string>"


def between(at: Column, t0: Column, lon: Column, lat: Column, t1: Column, lon1: Column, lat1: Column) -> tuple[Column, Column]:
    """The position at a time on the way to the next frame, the shorter way around the world; where there is none, the one before."""
    share = (at - t0) / F.when(t1 > t0, t1 - t0)
    step = lon1 - lon
    step = F.when(step > 180, step - 360).when(step < -180, step + 360).otherwise(step)
    return F.coalesce(F.pmod(lon + step * share + 540.0, F.lit(360.0)) - 180.0, lon), F.coalesce(lat + (lat1 - lat) * share, lat)


def block_width(rows: DataFrame, blocks: int) -> int:
    span = rows.agg(F.min("time_ms").alias("low"), F.max("time_ms").alias("high")).first()
    return max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // blocks))


def in_segments(rows: DataFrame, frames: DataFrame, width: int) -> DataFrame:
    """rows(entity_id, time_ms, ...) with `t0`, the time of the frame at or before them, or null.

    Time is cut in blocks, and the last frame of a block is carried into those
    that follow, so the rows of an entity may be in any number of tasks.
    """
    block = F.floor(F.col("time_ms") / width)
    marks = frames.select("entity_id", "time_ms").withColumn("_block", block)
    both = rows.withColumn("_row", F.lit(1)).withColumn("_block", block).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    seen = F.last(F.when(F.col("_row") == 0, F.col("time_ms")), ignorenulls=True).over(Window.partitionBy("entity_id", "_block").orderBy("time_ms", "_row").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("entity_id", "_block").agg(F.max(F.when(F.col("_row") == 0, F.col("time_ms"))).alias("_end"))
    carried = ends.select("entity_id", "_block", F.max("_end").over(Window.partitionBy("entity_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    placed = both.withColumn("_seen", seen).filter("_row = 1").join(carried, ["entity_id", "_block"])
    return placed.select(*rows.columns, F.coalesce("_seen", "_before").alias("t0"))


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """The join on columns of these names, in which nulls equal nulls; the left ones stay."""
    theirs = {c: f"_their_{c}" for c in names}
    return left.join(right.withColumnsRenamed(theirs), [F.col(c).eqNullSafe(F.col(t)) for c, t in theirs.items()], how).drop(*theirs.values())


def merged_props(rows: DataFrame, line: list[str]) -> DataFrame:
    """rows with `props` of the frame that begins their segment (`line`), overlaid by those of each patch up to their own.

    Keys are rows, so a segment may have any number of patches.
    """
    place = Window.partitionBy(*line).orderBy("time_ms", "patch", "seq")
    numbered = rows.withColumn("_n", F.row_number().over(place))
    given = numbered.filter(F.size("props") > 0).select(*line, "_n", F.explode("props").alias("_k", "_v"))
    keys = given.select(*line, "_k").distinct()
    known = null_safe(null_safe(numbered.select(*line, "_n"), keys, line), given, [*line, "_n", "_k"], "left")
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(*line, "_k").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    maps = known.withColumn("_v", last).filter("_v is not null").groupBy(*line, "_n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("_props"))
    return null_safe(numbered, maps, [*line, "_n"], "left").select(*(c for c in rows.columns if c != "props"), F.coalesce("_props", F.create_map().cast(EMPTY)).alias("props"))


def entity_frames(frames: DataFrame, patches: DataFrame, blocks: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The track after patches(entity_id, time_ms, seq, lon, lat, status, props), and the errors: entity_id, time_ms, seq, code.

    Patches are applied in the order of their times, those of one time by seq,
    and each sees those before it. A patch replaces the frame at exactly its
    time. What it doesn't have (null) is as it is then: the position between
    the last one that was given and the next frame, the status, and the
    properties, which those of the patch are laid over. A frame sets all three
    anew, null or not. Errors: `unknown` where an entity has no frame,
    `position` where a patch without one is before any.
    """
    plain = [F.col(c) for c in ("entity_id", "time_ms", "lon", "lat", "status")] + [F.coalesce("props", F.create_map().cast(EMPTY)).alias("props")]
    asked = patches.select(*plain, "seq")
    firsts = frames.groupBy("entity_id").agg(F.min("time_ms").alias("_first"))
    given = asked.filter("lon is not null").groupBy("entity_id").agg(F.min(F.struct("time_ms", "seq")).alias("_given"))
    judged = asked.join(firsts, "entity_id", "left").join(given, "entity_id", "left")
    early = (F.col("time_ms") < F.col("_first")) & (F.col("_given").isNull() | (F.struct("time_ms", "seq") < F.col("_given")))
    judged = judged.withColumn("code", F.when(F.col("_first").isNull(), "unknown").when(early, "position"))
    errors = judged.filter("code is not null").select("entity_id", "time_ms", "seq", "code")
    good = judged.filter("code is null").drop("_first", "_given", "code").withColumn("patch", F.lit(1))

    width = block_width(frames, blocks)
    own = frames.select(*plain, F.lit(None).cast(patches.schema["seq"].dataType).alias("seq"), F.lit(0).alias("patch"))
    rows = own.withColumn("t0", F.col("time_ms")).unionByName(in_segments(good, frames, width))
    rows = merged_props(rows, ["entity_id", "t0"])
    follow = with_next(frames.select("entity_id", "time_ms", "lon", "lat"), "entity_id", "time_ms", ["lon", "lat"], width).select("entity_id", F.col("time_ms").alias("t0"), "next")
    # before an entity's first frame, that one is the next
    opening = firsts.join(frames.select("entity_id", F.col("time_ms").alias("_first"), "lon", "lat"), ["entity_id", "_first"])
    follow = follow.union(opening.select("entity_id", F.lit(None).cast("long"), F.struct(F.col("_first").alias("time_ms"), "lon", "lat")))
    rows = null_safe(rows, follow, ["entity_id", "t0"])

    upto = Window.partitionBy("entity_id", "t0").orderBy("time_ms", "patch", "seq").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("lon").isNotNull(), F.struct("time_ms", "lon", "lat")), ignorenulls=True).over(upto)
    status = F.last(F.when((F.col("patch") == 0) | F.col("status").isNotNull(), F.struct("status")), ignorenulls=True).over(upto)
    known = rows.withColumns({"_at": at, "_status": status})
    lon, lat = between(*(F.col(c) for c in ("time_ms", "_at.time_ms", "_at.lon", "_at.lat", "next.time_ms", "next.lon", "next.lat")))
    fresh = F.col("lon").isNotNull()
    known = known.select("entity_id", "time_ms", F.when(fresh, F.col("lon")).otherwise(lon).alias("lon"), F.when(fresh, F.col("lat")).otherwise(lat).alias("lat"), F.col("_status.status").alias("status"), "props", "patch", "seq", "t0")
    last = Window.partitionBy("entity_id", "t0", "time_ms").orderBy(F.desc("patch"), F.desc("seq"))
    return known.withColumn("_k", F.row_number().over(last)).filter("_k = 1").select("entity_id", "time_ms", "lon", "lat", "status", "props"), errors


def entity_set(frames: DataFrame, ops: DataFrame, added: DataFrame, duration: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The tracks after ops(entity_id, seq, op) that add and remove entities, in the order of seq, and the errors: entity_id, seq, code.

    added(seq, time_ms, lon, lat, status, props) has the frames of what is
    added. Errors, which have no effect: `track` where there are none,
    `duration` where one is later than the scenario, `duplicate` where the
    entity is there. To remove what isn't there does nothing.
    """
    tracks = added.groupBy("seq").agg(F.max("time_ms").alias("_last"))
    adds = F.col("op") == "add"
    late = F.col("_last") > duration if duration is not None else F.lit(False)
    judged = ops.select("entity_id", "seq", "op").join(tracks, "seq", "left").withColumn("code", F.when(adds & F.col("_last").isNull(), "track").when(adds & late, "duration"))
    bad = judged.filter("code is not null").select("entity_id", "seq", "code")
    good = judged.filter("code is null").select("entity_id", "seq", "op")
    there = frames.select("entity_id").distinct().withColumn("_there", F.lit(True))
    # an entity is there if the operation before added it, whether or not it was there before
    span = good.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    chained = with_next(good, "entity_id", "seq", ["op"], max(1, ((span["high"] or 0) - (span["low"] or 0)) // 1024))
    again = chained.filter("op = 'add' and next.op = 'add'").select("entity_id", F.col("next.seq").alias("seq"))
    ends = good.groupBy("entity_id").agg(F.min(F.struct("seq", "op")).alias("_first"), F.max(F.struct("seq", "op")).alias("_end"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("_gone"))
    first = ends.join(there, "entity_id").filter("_first.op = 'add'").select("entity_id", F.col("_first.seq").alias("seq"))
    twice = again.union(first)
    errors = bad.unionByName(twice.withColumn("code", F.lit("duplicate")))

    columns = ["entity_id", "time_ms", "lon", "lat", "status", "props"]
    kept = frames.select(*columns).join(ends.filter("_gone is not null").select("entity_id"), "entity_id", "left_anti")
    made = good.filter("op = 'add'").join(twice, ["entity_id", "seq"], "left_anti").join(ends.filter("_end.op = 'add'").select("entity_id", "_gone"), "entity_id")
    made = made.filter("_gone is null or seq > _gone").select("entity_id", "seq").join(added, "seq").select(*columns)
    return kept.unionByName(made), errors


def inject(events: DataFrame, injected: DataFrame, duration: int, cell: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The timeline (event_id, time_ms) after injected(seq, event_id, time_ms, clock_ms), and the errors: seq, event_id, code.

    Without a time an event is at the clock. Without an id it is `injected-n`,
    n being one more than the events before it (in the order of seq, numbers
    from 1) and the ids given to them so far. Errors, which have no effect but
    count: `duration` where it is later than the scenario, `duplicate` where
    the id is there or a good injection before has it.
    """
    # prefix sums by ranges of seq
    used = injected.withColumns({"_cell": F.floor(F.col("seq") / cell), "_uses": F.when(F.col("event_id").isNull(), 2).otherwise(1)})
    sums = used.groupBy("_cell").agg(F.sum("_uses").alias("_sum"))
    before = sums.select("_cell", F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_uses").over(Window.partitionBy("_cell").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = used.withColumn("_inside", inside).join(before, "_cell")
    name = F.coalesce(F.col("event_id"), F.concat(F.lit("injected-"), (F.col("_before") + F.col("_inside") + 1).cast("string")))
    named = named.select("seq", name.alias("event_id"), F.coalesce("time_ms", "clock_ms").alias("time_ms"))
    late = named.filter(F.col("time_ms") > duration).select("seq", "event_id", F.lit("duration").alias("code"))
    good = named.filter(F.col("time_ms") <= duration)
    there = events.select("event_id", F.lit(True).alias("_there")).distinct()
    first = good.groupBy("event_id").agg(F.min("seq").alias("_first"))
    judged = good.join(first, "event_id").join(there, "event_id", "left").withColumn("_new", F.col("_there").isNull() & (F.col("seq") == F.col("_first")))
    errors = late.unionByName(judged.filter("not _new").select("seq", "event_id", F.lit("duplicate").alias("code")))
    return events.select("event_id", "time_ms").unionByName(judged.filter("_new").select("event_id", "time_ms")), errors
