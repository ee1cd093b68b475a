"""Exact dedup with an extendible-hash index that lies in shared files.

Keys are 64-bit hashes of the normalised text. The directory starts as one
bucket; a bucket that holds more than its capacity of distinct text bytes is
split on the next bit of the key, which doubles the directory where that needs
a bit more than before. A text counts as half a bucket at most, as no split
makes it smaller. The capacity is BUCKET_BYTES, or more where 2**MOST_BITS cells
would hold more than that on average, so the directory may be broadcast.

Each text goes to the bucket that the directory gives for its key. An owner
task holds a range of buckets, so a range of keys: it sorts their texts by
bucket, key and bytes, which chains those whose keys collide, and texts are
copies where all bytes are equal. Its pages, a row for each text, are written
to the shared folder, and documents are read from them.

Keys that very many documents share would make an owner's page hot. They are
few, as each has more than a 2**-HOT_BITS share of the rows: their texts are
combined before the shuffle and are one row of a page, and their documents find
that row by bucket, key, SHA-256 and length. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unsigned_hex_bits, utf8, without, written

#: The directory has at most 2**MOST_BITS cells.
MOST_BITS = 17
#: Bytes of distinct text that a bucket holds before it is split, and that an owner task holds.
BUCKET_BYTES, OWNED_BYTES = 256 << 10, 64 << 20
#: A key is hot if more rows than this have it, and more than their number >> HOT_BITS.
HOT_ROWS, HOT_BITS = 64, 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """The directory for keys(key, n_bytes), a row for each cell that has keys: cell, depth, bucket.

    A bucket is the keys whose first `depth` bits are the same: those of its
    first cell, by which it is named. It is the shortest such prefix that fits
    the capacity, or a whole cell.
    """
    distinct = keys.groupBy("key", "n_bytes").agg(F.lit(1).alias("one"))
    counted = F.least(F.col("n_bytes"), F.lit(max(1, bucket_bytes // 2)))
    cells = distinct.groupBy(unsigned_hex_bits(F.col("key"), most_bits).alias("cell")).agg(F.sum(counted).alias("held"))
    levels = cells.select("cell", "held", F.explode(F.sequence(F.lit(0), F.lit(most_bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {most_bits} - depth)"))
    held = levels.groupBy("depth", "prefix").agg(F.sum("held").alias("held"))
    fits = held.filter((F.col("held") <= bucket_bytes) | (F.col("depth") == most_bits)).select("depth", "prefix")
    fits = F.broadcast(fits)  # fewer than 2**(most_bits + 1) rows
    found = levels.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
    shortest = found.groupBy("cell").agg(F.min("depth").alias("depth"))
    return shortest.select("cell", "depth", F.expr(f"shiftleft(shiftright(cell, {most_bits} - depth), {most_bits} - depth)").alias("bucket"))


def shortened(cells: DataFrame, most_bits: int) -> tuple[DataFrame, int]:
    """The directory with cells of as many bits as its deepest bucket has, and their number."""
    bits = cells.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    return cells.select(F.shiftright("cell", most_bits - bits).alias("cell"), "depth", "bucket").distinct(), bits


def in_buckets(rows: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """rows(key, ...) with the depth and bucket that the directory, whose cells have so many bits, gives for their key."""
    named = cells.withColumnRenamed("cell", "_cell")
    return rows.join(F.broadcast(named), unsigned_hex_bits(F.col("key"), bits) == named["_cell"]).drop("_cell")  # 2**bits rows at most


def pages(texts: DataFrame, cells: DataFrame, bits: int, owners: int, most_bits: int) -> DataFrame:
    """The written index of texts(doc_id, key, body, n, hot): depth, bucket, key, chain, doc_id, sha, n_bytes, keep_id, group_size, hot.

    A row stands for n documents, of which doc_id is the least. chain numbers,
    from 0, the different texts whose keys are equal.
    """
    placed = in_buckets(texts, cells, bits).withColumn("owner", F.expr(f"int((bucket * {owners}L) div {1 << most_bits})"))
    owned = placed.repartitionById(owners, F.col("owner"))
    same = Window.partitionBy("owner", "bucket", "key", "body")
    collided = Window.partitionBy("owner", "bucket", "key").orderBy("body")
    compared = owned.withColumn("keep_id", F.min("doc_id").over(same)).withColumn("group_size", F.sum("n").over(same)).withColumn("chain", F.dense_rank().over(collided) - 1)
    digest = F.unhex(F.sha2(utf8(F.col("body")), 256)).alias("sha")
    return written(compared.select("depth", "bucket", "key", "chain", "doc_id", digest, F.octet_length("body").alias("n_bytes"), "keep_id", "group_size", "hot"), "dedup-pages")


def grouped(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, most_bits: int, hot_rows: int) -> DataFrame:
    """doc_id, key, sha, n_bytes, keep_id, group_size of each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body")).withColumn("key", F.xxhash64("body"))
    keys = texts.select("doc_id", "key", F.unhex(F.sha2(utf8(F.col("body")), 256)).alias("sha"), F.octet_length("body").alias("n_bytes"))
    keys = written(keys, "dedup-keys")
    counts = written(keys.groupBy("key", "n_bytes").agg(F.count("*").alias("n")), "dedup-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    capacity = max(bucket_bytes, 2 * total["bytes"] >> most_bits)
    whole = written(directory(counts, capacity, most_bits), "dedup-directory")
    cells, bits = shortened(whole, most_bits)
    owners = min(1 << most_bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["bytes"] // OWNED_BYTES))

    many = counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > max(hot_rows, total["rows"] >> HOT_BITS)).select("key")
    many = F.broadcast(written(many, "dedup-hot"))  # fewer than 2**HOT_BITS keys
    cold = texts.join(many, "key", "left_anti").select("doc_id", "key", "body", F.lit(1).cast("long").alias("n"), F.lit(False).alias("hot"))
    # a task's copies are one row before the shuffle
    hot = texts.join(many, "key", "left_semi").groupBy("key", "body").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    index = pages(cold.unionByName(hot.withColumn("hot", F.lit(True))), cells, bits, owners, most_bits)

    columns = ["doc_id", "key", "sha", "n_bytes", "keep_id", "group_size"]
    place = ["bucket", "key", "sha", "n_bytes"]
    # a row for each text of a hot key, which are fewer than 2**HOT_BITS but for collisions
    entries = F.broadcast(index.filter("hot").select(*place, "keep_id", "group_size"))
    asked = in_buckets(keys.join(many, "key", "left_semi"), cells, bits)
    return index.filter("not hot").select(*columns).unionByName(asked.join(entries, place).select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_bits: int = MOST_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when their normalised bytes are. Null counts as empty, and
    empty texts are one group. group_size counts rows. Rows that repeat the
    smallest id of their group are one document and all stay. A null id is
    never the smallest unless the group has no other. An empty table gives an
    empty table. Other columns of docs play no part, whatever their names.
    """
    found = grouped(docs, id_col, text_col, bucket_bytes, most_bits, hot_rows)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"), F.col("n_bytes").cast("long").alias("n_bytes"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. A row goes by its id and text: others of its id stay."""
    found = grouped(docs, id_col, text_col, BUCKET_BYTES, MOST_BITS, HOT_ROWS)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_text"))
    return without(docs, gone, {"_gone": docs[id_col], "_gone_text": F.xxhash64(normalised(docs[text_col]))})
