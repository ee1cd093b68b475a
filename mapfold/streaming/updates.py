"""Structured Streaming forms: the batch operators applied to micro-batches and to keyed streams.

State tables are versions in a folder: a micro-batch writes the version of its
own id from the one before, so a batch that is run again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet table `name` of a folder, one file or a folder of files, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    kind = spark.read.parquet(path).schema  # fails where there is no such table
    reader = spark.readStream.schema(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions in a folder, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in system.listStatus(at)]
    whole = [int(n.partition("=")[2]) for n, p in names if n.startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(whole)


def keep_versions(stream: DataFrame, first: DataFrame, path: str, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """step(state, batch) for each micro-batch of all that is there now; the last version of the state.

    A restart goes on from the versions that are there: `first` is written only
    where there are none. The version before that of a batch stays, so the
    batch can be run again; older ones are deleted.
    """
    spark = first.sparkSession
    if not versions(spark, path):
        first.write.mode("overwrite").parquet(f"{path}/version=0")

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = spark.read.schema(first.schema).parquet(f"{path}/version={batch_id}")
        step(state, batch).write.mode("overwrite").parquet(f"{path}/version={batch_id + 1}")
        for old in versions(spark, path):
            if old < batch_id:
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{path}/version={versions(spark, path)[-1]}")


def source_updates(features: DataFrame, diffs: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """features after a stream of diffs (see changes.apply_diff)."""
    return keep_versions(diffs, features.select("fid", "geometry", "props"), path, changes.apply_diff, checkpoint)


def keep_log(stream: DataFrame, empty: DataFrame, path: str, merge: Callable[[DataFrame], DataFrame], checkpoint: str, every: int = 16) -> DataFrame:
    """merge(rows) of all rows that a stream has now and had before.

    merge must give the same for merged rows as for the rows themselves, in any
    order. A micro-batch writes its own merged rows, so what is written follows
    the batch; after `every` batches the deltas and the base are merged into a
    new base, and what it was made of is deleted. Batches that run again write
    the same.
    """
    spark = empty.sparkSession
    read = lambda *folders: spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def parts() -> tuple[list[str], list[int]]:
        base, deltas = versions(spark, f"{path}/base")[-1:], versions(spark, f"{path}/delta")
        return [f"{path}/base/version={b}" for b in base], [d for d in deltas if not base or d > base[0]]

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge(batch.select(*empty.columns)).write.mode("overwrite").parquet(f"{path}/delta/version={batch_id}")
        base, deltas = parts()
        if len(deltas) >= every:
            merge(read(*base, *(f"{path}/delta/version={d}" for d in deltas))).write.mode("overwrite").parquet(f"{path}/base/version={batch_id}")
            for old in [*base, *(f"{path}/delta/version={d}" for d in deltas)]:
                at = spark._jvm.org.apache.hadoop.fs.Path(old)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    base, deltas = parts()
    return merge(read(*base, *(f"{path}/delta/version={d}" for d in deltas)))


def last_changes(rows: DataFrame) -> DataFrame:
    """Of state changes those that still count, removals too: the last of each key, and the last that removed a feature or a source whole."""
    same = ["source", "fid", "key", ((F.col("op") == "remove") & F.col("key").isNull()).alias("whole")]
    last = rows.groupBy(*same).agg(F.max(F.struct("seq", "op", "value")).alias("r"))
    return last.select("source", "fid", "key", "r.value", "r.op", "r.seq")


def feature_state(updates: DataFrame, path: str, checkpoint: str, every: int = 16) -> DataFrame:
    """source, fid, key, value after a stream of state changes in any order of arrival (see changes.feature_state)."""
    empty = updates.sparkSession.createDataFrame([], "source string, fid long, key string, value long, op string, seq long")
    return changes.feature_state(keep_log(updates, empty, path, last_changes, checkpoint, every))


def injected(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of events(event_id, ts, ...) without repeated ids; ids are remembered for as long as events may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tile_windows(events: DataFrame, z: int, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, x, y, n, weight of a stream of events(ts, lon, lat, weight)."""
    from ..functions import mercator as M

    at = events.withWatermark("ts", late).select(F.window("ts", width).alias("w"), M.tile_x(F.col("lon"), z).alias("x"), M.tile_y(F.col("lat"), z).alias("y"), "weight")
    return at.groupBy("w", "x", "y").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select(F.col("w.start").alias("start"), "x", "y", "n", "weight")
