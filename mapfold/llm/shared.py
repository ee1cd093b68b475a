"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker turns into Python strings at once.
SLICE_BYTES = 1 << 20
#: Ids of 8 bytes that may be broadcast at most.
BROADCAST_IDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a
    temporary folder takes its place if driver and executors are one process on
    one machine, as in tests; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mapfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mapfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes the files of a table that written() made and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {uri.rpartition("/")[0] for uri in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reading_tasks(spark: SparkSession, pieces: int, most: int = 32) -> int:
    """The number of tasks for pieces of files: one each at first, then up to `most` pieces a task beyond what the cluster runs at once."""
    return max(1, min(pieces, max(4 * spark.sparkContext.defaultParallelism, -(-pieces // most))))


def text_key(text: Column) -> Column:
    """Tells texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose keys aren't a row of gone, with all their columns; nulls equal nulls.

    keys has, by gone's columns, what they are in docs. Up to `most` rows are
    broadcast, so that the texts needn't be shuffled; more are joined.
    """
    rows = written(gone.select(*keys).distinct(), "gone")
    if rows.count() <= most:
        rows = F.broadcast(rows)
    return docs.join(rows, [of_docs.eqNullSafe(rows[name]) for name, of_docs in keys.items()], "left_anti")


def worker_state(name: str, build: Callable[[], object]) -> object:
    """What build() returns, made once in each Python worker process.

    A worker keeps one such state, the last that was asked for, so stages of
    different operators don't add up in its memory.
    """
    box = sys.modules.get("_mapfold_worker_state")
    if box is None:
        box = sys.modules["_mapfold_worker_state"] = types.ModuleType("_mapfold_worker_state")
        box.name = box.state = None
    if box.name != name:
        box.state = None
        if box.name is not None:
            # what the last operator held goes back to the system
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
            if trim is not None:
                trim(0)
        box.name, box.state = name, build()
    return box.state


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(col: Column) -> Column:
    return F.encode(col, "UTF-8")


def unsigned_hex_bits(key: Column, bits: int) -> Column:
    """The first `bits` bits of a 64-bit key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
