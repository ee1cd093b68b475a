"""Diffs, keyed state, edit logs and replayed events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import RADIUS
from ..functions.mercator import world_x, world_y


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order, at its own place."""
    line = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_k", F.row_number().over(line)).filter("_k = 1").drop("_k")


def keep_last(rows: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    """The last `most` rows of each key (0 to 100)."""
    if not 0 <= most <= 100:
        raise ValueError("a history keeps 0 to 100 steps")
    line = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(line)).filter(F.col("_k") <= most).drop("_k")


def repair_ids(features: DataFrame, prefix: str, order: str = "feature_seq") -> DataFrame:
    """features with `fid` unique: null and repeated ids become the next free `prefix-n`, in order.

    The first row of an id keeps it. Numbers are given by counting within
    ranges of the order, so no task numbers all rows; numbers whose name is
    taken are left out.
    """
    # null ids need no place among each other: they are spread, as most features may have none
    spread = F.when(F.col("fid").isNull(), F.pmod(F.xxhash64(order), F.lit(4096)))
    line = Window.partitionBy(F.col("fid").cast("string"), spread).orderBy(order)
    marked = features.withColumn("_again", F.col("fid").isNull() | (F.row_number().over(line) > 1))
    fresh = marked.filter("_again").select(order)
    n = fresh.count()
    taken = marked.filter(~F.col("_again")).select(F.regexp_extract(F.col("fid").cast("string"), rf"^{prefix}-([1-9][0-9]*)$", 1).try_cast("long").alias("n")).filter(F.col("n").isNotNull())
    # the n smallest free numbers are among the first n + (taken ones)
    most = n + taken.count()
    free = features.sparkSession.range(1, most + 1).withColumnRenamed("id", "n").join(taken, "n", "left_anti")
    numbered = ranked(free, "n").filter(F.col("_rank") <= n).select("_rank", "n")
    names = ranked(fresh, order).join(numbered, "_rank").select(F.col(order).alias("_at"), F.concat(F.lit(f"{prefix}-"), F.col("n").cast("string")).alias("_name"))
    out = marked.join(names, marked[order] == names["_at"], "left")
    return out.withColumn("fid", F.when(F.col("_again"), F.col("_name")).otherwise(F.col("fid").cast("string"))).drop("_again", "_at", "_name")


def ranked(rows: DataFrame, order: str, cell: int = 4096, most_cells: int = 1 << 18) -> DataFrame:
    """rows with `_rank` from 1 in the order of a whole-number column of different values.

    Ranges of the column, at most most_cells, are counted, the counts added up,
    and rows ranked within their range.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    size = max(cell, ((high or 0) - (low or 0)) // most_cells + 1)
    at = rows.withColumn("_cell", F.floor((F.col(order) - F.lit(low or 0)) / size))
    counts = at.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_cell", before.alias("_before"))
    return at.join(starts, "_cell").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_cell").orderBy(order))).drop("_cell", "_before")


def apply_diff(features: DataFrame, diff: DataFrame) -> DataFrame:
    """features(fid, geometry, props) after diff(op, fid, geometry, clear, unset, props).

    props are map<string,string>, unset an array of names. The order is
    remove_all, remove, add, update, whatever the rows' order. Added ids must
    be new; an update of an unknown id does nothing. An update replaces the
    geometry if it has one, then clears, unsets and sets properties.
    """
    everything = diff.filter("op = 'remove_all'").limit(1).select(F.lit(True).alias("_all"))
    kept = features.join(everything, how="left_anti")
    kept = kept.join(diff.filter("op = 'remove'").select("fid").distinct(), "fid", "left_anti")
    both = kept.select("fid", "geometry", "props").unionByName(diff.filter("op = 'add'").select("fid", "geometry", "props"))
    update = diff.filter("op = 'update'").select("fid", F.col("geometry").alias("_geometry"), F.coalesce("clear", F.lit(False)).alias("_clear"), F.coalesce("unset", F.array().cast("array<string>")).alias("_unset"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("_set"))
    joined = both.join(update, "fid", "left")
    held = F.when(F.col("_clear"), F.create_map().cast("map<string,string>")).otherwise(F.coalesce("props", F.create_map().cast("map<string,string>")))
    held = F.map_filter(held, lambda k, v: ~F.array_contains(F.col("_unset"), k) & ~F.map_contains_key(F.col("_set"), k))
    props = F.when(F.col("_set").isNull(), F.col("props")).otherwise(F.map_concat(held, F.col("_set")))
    return joined.select("fid", F.coalesce("_geometry", "geometry").alias("geometry"), props.alias("props"))


def unknown_or_repeated(features: DataFrame, diff: DataFrame) -> DataFrame:
    """fid and code of diff rows that apply_diff must not get: null_id, repeated_id, existing_id."""
    added = diff.filter("op = 'add'")
    null = added.filter("fid is null").select("fid", F.lit("null_id").alias("code"))
    again = added.groupBy("fid").count().filter("count > 1 and fid is not null").select("fid", F.lit("repeated_id").alias("code"))
    gone = diff.filter("op = 'remove'").select("fid")
    there = features.join(gone, "fid", "left_anti").select("fid").join(added.select("fid"), "fid", "left_semi").select("fid", F.lit("existing_id").alias("code"))
    return null.unionByName(again).unionByName(there)


def feature_state(changes: DataFrame) -> DataFrame:
    """source, fid, key, value after changes(source, fid, key, value, op, seq).

    op set writes a key; remove deletes the key, or the whole feature if key is
    null, or the whole source if fid is null too. The last of them counts.
    """
    removed = F.col("op") == "remove"
    of_feature = changes.filter(removed & F.col("key").isNull() & F.col("fid").isNotNull()).groupBy("source", "fid").agg(F.max("seq").alias("_f"))
    of_source = changes.filter(removed & F.col("fid").isNull()).groupBy("source").agg(F.max("seq").alias("_s"))
    last = changes.filter(F.col("key").isNotNull()).groupBy("source", "fid", "key").agg(F.max(F.struct("seq", "op", "value")).alias("last"))
    rows = last.join(of_feature, ["source", "fid"], "left").join(of_source, "source", "left")
    live = (F.col("last.op") == "set") & (F.col("last.seq") > F.greatest(F.coalesce("_f", F.lit(-1)), F.coalesce("_s", F.lit(-1))))
    return rows.filter(live).select("source", "fid", "key", F.col("last.value").alias("value"))


def with_feature_state(features: DataFrame, state: DataFrame) -> DataFrame:
    """features(source, fid, ...) with `state`, a map of the state of the feature, or null."""
    maps = state.groupBy("source", "fid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("state"))
    return features.join(maps, ["source", "fid"], "left")


#: Ticks of a scenario in a block of time, and events, on average.
BLOCK_TICKS, BLOCK_EVENTS = 64, 65_536


def tick_blocks(events: DataFrame, ticks: DataFrame, most: int = 1024) -> int:
    """In how many blocks the time of ticks is cut: as many as the scenario with the most ticks or events needs, `most` at most."""
    counts = events.select("scenario_id", F.lit(0).alias("tick")).unionByName(ticks.select("scenario_id", F.lit(1).alias("tick"))).groupBy("scenario_id").agg(F.count_if(F.col("tick") == 1).alias("ticks"), F.count_if(F.col("tick") == 0).alias("events"))
    need = counts.agg(F.max(F.greatest(F.col("ticks") / BLOCK_TICKS, F.col("events") / BLOCK_EVENTS))).first()[0]
    return min(most, max(1, math.ceil(need or 0)))


def dispatch(events: DataFrame, ticks: DataFrame, blocks: int | None = None) -> DataFrame:
    """tick_ms with the events(scenario_id, event_id, time_ms) that a tick of ticks(scenario_id, time_ms) emits: those after the tick before, up to it.

    The first tick emits from the beginning. The time of the ticks is cut in
    `blocks` (see tick_blocks): an event's tick is the first of its block that
    isn't before it, or else the first of the scenario's next block, so a
    scenario's events may be in any number of tasks.
    """
    span = ticks.agg(F.min("time_ms").alias("low"), F.max("time_ms").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    width = max(1, -(-(high - low + 1) // (blocks or tick_blocks(events, ticks))))
    block = F.floor((F.greatest("time_ms", F.lit(low)) - low) / width).alias("block")
    asked = events.filter(F.col("time_ms") <= high).select("scenario_id", "event_id", "time_ms", block)
    held = ticks.select("scenario_id", "time_ms", block).groupBy("scenario_id", "block").agg(F.sort_array(F.collect_set("time_ms")).alias("here"))
    # the first tick of the blocks after: `blocks` rows a scenario at most; sizes aren't known before ticks are made, so nothing is broadcast
    every = held.unionByName(asked.select("scenario_id", "block").distinct(), allowMissingColumns=True).groupBy("scenario_id", "block").agg(F.first("here", ignorenulls=True).alias("here"))
    later = F.first(F.get("here", F.lit(0)), ignorenulls=True).over(Window.partitionBy("scenario_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing))
    known = every.select("scenario_id", "block", "here", later.alias("later"))
    at = F.coalesce(F.get(F.filter("here", lambda t: t >= F.col("time_ms")), F.lit(0)), F.col("later"))
    return asked.join(known.hint("merge"), ["scenario_id", "block"]).select("scenario_id", "event_id", at.alias("tick_ms")).filter("tick_ms is not null")


def replay(steps: list[tuple[str, str | None, str | None]], history: int = 20) -> tuple[dict[str, str], int, int]:
    """The features after (op, fid, value) steps, and the sizes of the undo and redo stacks."""
    now: dict[str, str] = {}
    undo: list[dict[str, str]] = []
    redo: list[dict[str, str]] = []
    for op, fid, value in steps:
        if op in ("undo", "redo"):
            source, target = (undo, redo) if op == "undo" else (redo, undo)
            if source:
                target.append(now)
                now = source.pop()
            continue
        after = dict(now)
        if op == "clear":
            after = {}
        elif op == "remove":
            if fid not in after:
                continue
            del after[fid]
        elif op == "add" or fid in after:
            after[fid] = value
        else:
            continue
        undo.append(now)
        del undo[: max(0, len(undo) - history)]
        redo.clear()
        now = after
    return now, len(undo), len(redo)


def edit_log(steps: DataFrame, history: int = 20) -> DataFrame:
    """doc_id, fids (sorted, comma-joined), undo, redo after replaying steps(doc_id, seq, op, fid, value).

    A document's log is one group: it is what a user edits.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [replay([(s["op"], s["fid"], s["value"]) for s in steps], history) for steps in frame["steps"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fids": [",".join(sorted(now)) for now, _, _ in done], "undo": [u for _, u, _ in done], "redo": [r for _, _, r in done]})

    logs = steps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "fid", "value"))).alias("steps"))
    return logs.mapInPandas(work, "doc_id long, fids string, undo long, redo long")


def tiles_ahead(speed: Column, seconds: Column, lat: Column, z: Column) -> Column:
    """How many tiles of zoom z a speed in metres a second covers in so many seconds: 0 to 16, null with any null."""
    metres = 2 * math.pi * RADIUS * F.greatest(F.lit(0.01), F.cos(F.radians(lat))) / F.pow(F.lit(2.0), z)
    tiles = speed * seconds / metres
    return F.when(tiles.isNotNull(), F.least(F.lit(16.0), F.greatest(F.lit(0.0), tiles)))


def corridor_ahead(moving: DataFrame, distance: float = 0.0, width: int = 1) -> DataFrame:
    """The rows of moving(z, lon, lat, heading, speed, seconds) with each tile x, y that lies ahead.

    Ahead are the tiles from one step on to as many as the speed covers in the
    given seconds, `distance` at least, and `width` to each side; the heading is
    in degrees from north. Rows without a heading or position, and those that
    reach no tile, have none; a null speed or time covers nothing. Columns wrap
    around the world, rows beyond its edges are left out.
    """
    covered = F.coalesce(tiles_ahead(F.col("speed"), F.col("seconds"), F.col("lat"), F.col("z")), F.lit(0.0))
    steps = F.ceil(F.greatest(F.lit(float(distance)), covered)).cast("int")
    rows = moving.dropna(subset=["z", "lon", "lat", "heading"]).withColumn("_steps", steps).filter("_steps > 0")
    rows = rows.withColumn("_step", F.explode(F.sequence(F.lit(1), F.col("_steps")))).withColumn("_side", F.explode(F.sequence(F.lit(-width), F.lit(width))))
    n, turn = F.pow(F.lit(2.0), F.col("z")), F.radians("heading")
    x = F.floor(world_x(F.col("lon")) * n + F.sin(turn) * F.col("_step") + F.cos(turn) * F.col("_side") + 0.5)
    y = F.floor(world_y(F.col("lat")) * n - F.cos(turn) * F.col("_step") + F.sin(turn) * F.col("_side") + 0.5)
    rows = rows.withColumn("x", F.pmod(x, n.cast("long"))).withColumn("y", y).filter((F.col("y") >= 0) & (F.col("y") < n))
    return rows.drop("_steps", "_step", "_side").distinct()


def corridor(positions: DataFrame, distance: Column, width: int = 1, most: int = 16) -> DataFrame:
    """Tiles x, y at zoom z ahead of positions(z, x, y, bearing): up to `distance` tiles on, `width` to each side."""
    reach = F.least(F.lit(most), F.ceil(distance)).cast("int")
    rows = positions.withColumn("step", F.explode(F.sequence(F.lit(0), reach))).withColumn("side", F.explode(F.sequence(F.lit(-width), F.lit(width))))
    n = F.pow(F.lit(2.0), F.col("z")).cast("long")
    x = F.floor(F.col("x") + 0.5 + F.sin("bearing") * F.col("step") + F.cos("bearing") * F.col("side"))
    y = F.floor(F.col("y") + 0.5 - F.cos("bearing") * F.col("step") + F.sin("bearing") * F.col("side"))
    rows = rows.withColumn("tx", F.pmod(x, n)).withColumn("ty", y).filter((F.col("ty") >= 0) & (F.col("ty") < n))
    return rows.drop("x", "y", "step", "side").withColumnsRenamed({"tx": "x", "ty": "y"}).distinct()
