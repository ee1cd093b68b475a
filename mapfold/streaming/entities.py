"""Tracks that are kept by entity while frames and patches stream in, in any order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: What is kept of a frame or a patch.
VALUE = "lon double, lat double, status string, props map<string,string>"
OUT = f"entity_id long, time_ms long, {VALUE}, version long"
Frame = tuple[float | None, float | None, str | None, dict[str, str]]


def at_time(t: int, before: tuple[int, float, float], after: tuple[int, float, float] | None) -> tuple[float, float]:
    """The position on the way from one to the next, the shorter way around the world."""
    t0, lon, lat = before
    if after is None or after[0] <= t0:
        return lon, lat
    share, step = (t - t0) / (after[0] - t0), after[1] - lon
    step += 360 if step < -180 else -360 if step > 180 else 0
    return (lon + step * share + 540) % 360 - 180, lat + (after[2] - lat) * share


def folded(frames: dict[int, Frame], patches: dict[tuple[int, int], Frame]) -> dict[int, Frame]:
    """An entity's track after its patches; the rules are those of operators.scenario.entity_frames."""
    track: dict[int, Frame] = {}
    if not frames:
        return track
    times = sorted(frames)
    rows = sorted([(t, 0, 0, f) for t, f in frames.items()] + [(t, 1, seq, p) for (t, seq), p in patches.items()], key=lambda r: r[:3])
    ahead, last, status, props = 0, None, None, {}
    for t, patch, _, (lon, lat, own, extra) in rows:
        while ahead < len(times) and times[ahead] <= t:
            ahead += 1
        if not patch:
            last, status, props = (t, lon, lat), own, dict(extra)
        else:
            after = None if ahead == len(times) else (times[ahead], *frames[times[ahead]][:2])
            if lon is not None:
                last = (t, lon, lat)
            elif last is None:
                continue
            else:
                lon, lat = at_time(t, last, after)
            status, props = own if own is not None else status, props | extra
        track[t] = (lon, lat, status, props)
    return track


def split(rows: dict[tuple[int, int, int], Frame]) -> tuple[dict[int, Frame], dict[tuple[int, int], Frame]]:
    """Frames by time, and patches by time and seq, of rows by time, patch and seq."""
    return {t: f for (t, patch, _), f in rows.items() if not patch}, {(t, seq): f for (t, patch, seq), f in rows.items() if patch}


class Tracks(StatefulProcessor):
    """Keeps an entity's frames and patches, and gives the rows of its track that new ones change.

    What is new is added to the state at once, as every call to it costs about
    as much as a hundred rows; only where it replaces a row the state is written anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", f"time_ms long, patch int, seq long, {VALUE}")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        kept = {tuple(r[:3]): (*r[3:6], dict(r[6] or {})) for r in self.rows.get()} if version > 1 else {}
        new = {}
        for frame in rows:
            given = frame[["lon", "lat"]].notna().all(axis=1)
            columns = (frame[c].tolist() for c in ("time_ms", "patch", "seq", "lon", "lat", "status", "props"))
            for here, t, patch, seq, lon, lat, status, props in zip(given.tolist(), *columns):
                new[t, patch, seq] = (lon if here else None, lat if here else None, None if pd.isna(status) else status, dict(props if props is not None else {}))
        after = kept | new
        if len(after) == len(kept) + len(new):
            self.rows.appendList([(*k, *v) for k, v in new.items()])
        else:
            self.rows.put([(*k, *v) for k, v in after.items()])
        self.version.update((version,))
        before = folded(*split(kept))
        changed = [(key[0], t, *f, version) for t, f in folded(*split(after)).items() if before.get(t) != f]
        yield pd.DataFrame(changed, columns=["entity_id", "time_ms", "lon", "lat", "status", "props", "version"])

    def close(self) -> None:
        pass


def track_changes(rows: DataFrame) -> DataFrame:
    """Rows of tracks as they change, by a stream of rows(entity_id, time_ms, patch, seq, lon, lat, status, props).

    patch is 0 for frames, whose seq is 0, and 1 for patches. `version` counts
    the batches that an entity was in: of rows of one entity and time the last
    version counts. State is kept by key in RocksDB, so an entity costs a batch
    its own track and nothing else is rewritten.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("entity_id").transformWithStateInPandas(Tracks(), StructType.fromDDL(OUT), "Update", "None")


def tracks(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The tracks after all that is there now of a stream of rows (see track_changes); changes are appended to `path`."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    track_changes(rows).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    changes = rows.sparkSession.read.schema(OUT).parquet(path)
    last = changes.groupBy("entity_id", "time_ms").agg(F.max_by(F.struct("lon", "lat", "status", "props"), "version").alias("r"))
    return last.select("entity_id", "time_ms", "r.*")
