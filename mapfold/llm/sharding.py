"""Shards whose source mixture equals the corpus mixture.

Rows get a seeded random rank within their source, the rank becomes a fraction
of the source's size, and all rows are put in the order of that fraction. Any
contiguous run of this order holds each source in proportion, so cutting it in
equal runs gives shards that match the mixture. Sizes follow the law ``rows``:
row counts of shards differ by one at most.

Both rankings are exact and none sorts a source, or the corpus, in one task: a
row's rank is the count of all rows in earlier cells plus its rank in its own
cell. Cells of the first ranking are ranges of the shuffle hash, cells of the
second are ranges of the fraction; either holds about ROWS_PER_CELL rows
however large a source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import utf8, written

ROWS_PER_CELL = 512
#: The tables of cell counts have at most this many rows for a source.
MOST_CELLS = 1 << 18


def cell_bits(rows: int) -> int:
    cells = min(MOST_CELLS, max(1, rows // ROWS_PER_CELL))
    return max(0, (cells - 1).bit_length())


def stratified_shards(docs: DataFrame, n_shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, source, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 and text_crc32 the unsigned CRC-32 of
    them; a null text counts as empty. A null source is a source of its own.
    Rows that repeat an id are placed one by one. Slots of a shard run from 0
    without gaps. An empty table gives an empty table. Other columns of docs
    play no part, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(utf8(text)).alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("shuffle_key"),
    )
    total = docs.count()
    bits = cell_bits(total)
    # 20 bits of the hexadecimal shuffle key are enough for MOST_CELLS cells
    first = F.conv(F.substring("shuffle_key", 1, 5), 16, 10).cast("long")
    rows = rows.withColumn("cell", F.shiftright(first, 20 - bits))

    counts = rows.groupBy("source", "cell").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.select(
        F.col("source").alias("s"),
        F.col("cell").alias("c"),
        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("of_source"),
    )
    placed = rows.join(cells, rows.source.eqNullSafe(cells.s) & (rows.cell == cells.c))
    in_cell = Window.partitionBy("source", "cell").orderBy("shuffle_key", "doc_id", "size", "text_crc32")
    rank = F.col("before") + F.row_number().over(in_cell)
    ranked = placed.select("doc_id", "size", "text_crc32", "source", "shuffle_key", ((rank - F.lit(0.5)) / F.col("of_source")).alias("fraction"))
    ranked = written(ranked, "shard-ranks").withColumn("cell", F.floor(F.col("fraction") * F.lit(1 << bits)))

    steps = ranked.groupBy("cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # MOST_CELLS rows of two numbers at most
    starts = F.broadcast(steps.select("cell", before.alias("before")))
    order = Window.partitionBy("cell").orderBy("fraction", "source", "shuffle_key", "doc_id", "size", "text_crc32")
    place = F.col("before") + F.row_number().over(order) - 1
    shard = F.expr(f"(place * {n_shards}) div {max(total, 1)}")
    return (
        ranked.join(starts, "cell")
        .withColumn("place", place)
        .withColumn("shard", shard.cast("int"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"place - (shard * {total}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "source",
        )
    )
