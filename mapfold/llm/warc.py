"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The reader's tasks get byte ranges. A task scans its range for the gzip magic
number, takes a candidate for a member if it decodes and what it decodes to
begins with WARC headers, and from there on goes from member to member. It owns
the records that start in its range, the last of which it reads beyond the
range's end. After a damaged member it scans for the next one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import NewFile, OldFile
from .shared import reading_tasks, shared_path, utf8, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split, of one read, and of an archive file before the next is begun.
SPLIT, READ, FILE = 8 << 20, 1 << 20, 128 << 20
#: Digests of 64 letters that may be broadcast at most.
BROADCAST_DIGESTS = 1 << 18
#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "uri string, offset long, record_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_length long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if refers_to is given, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> dict[str, object]:
    """The fields of RECORD, but for uri and offset, of a decoded member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    sizes = [int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    kind = fields.get("warc-type")
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": fields.get("warc-payload-digest"),
        "payload_length": sizes[0] if kind == "revisit" and sizes else len(payload),
        "payload": None if kind == "revisit" else payload,
    }


class Window:
    """A file's bytes from some place on, read as they are asked for."""

    def __init__(self, file: OldFile, start: int):
        # the bytes before `at` in data are done with
        self.file, self.base, self.at, self.data, self.size = file, start, 0, b"", file.size

    @property
    def start(self) -> int:
        return self.base + self.at

    def more(self) -> bool:
        end = self.base + len(self.data)
        if end >= self.size:
            return False
        # what is done with is left out once for each read, not for each record
        self.data, self.base, self.at = self.data[self.at :] + self.file.read(end, READ), self.start, 0
        return True

    def move(self, start: int) -> None:
        self.at = start - self.base

    def find(self, what: bytes) -> int:
        """Where what is next in the bytes that were read, or -1."""
        found = self.data.find(what, self.at)
        return found if found < 0 else self.base + found

    def member(self) -> tuple[bytes, int] | None:
        """The member at the window's start, decoded, and where it ends; None if there is none."""
        unpack, out, fed = zlib.decompressobj(31), [], 0
        while True:
            if self.at + fed >= len(self.data) and not self.more():
                return None
            part = self.data[self.at + fed : self.at + fed + (READ if fed else 4096)]
            try:
                out.append(unpack.decompress(part))
            except zlib.error:
                return None
            fed += len(part)
            got = out[0] if len(out) == 1 else b"".join(out[:2])
            if len(got) >= 7 and not got.startswith(b"WARC/1."):
                return None
            if unpack.eof:
                data = b"".join(out)
                return (data, self.start + fed - len(unpack.unused_data)) if data.startswith(b"WARC/1.") and b"\r\n\r\n" in data else None


def members(file: OldFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of the records that start in a range."""
    window = Window(file, start)
    while window.start < end:
        found = window.find(MAGIC)
        if found < 0:
            # keep what may be the beginning of a magic number
            window.move(max(window.start, window.base + len(window.data) - 2))
            if window.start >= end or not window.more():
                return
            continue
        window.move(found)
        if window.start >= end:
            return
        whole = window.member()
        if whole is None:
            window.move(window.start + 1)
            continue
        yield window.start, whole[0]
        window.move(whole[1])


def classed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: null for what is stored, else the page that is."""
    payload = utf8(F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # digests that several pages have; a task's copies are one row before the shuffle
    several = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    several = written(several.select(F.col("digest").alias("_digest"), "first"), "warc-copies")
    if several.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(several), F.col("digest") == F.col("_digest"), "left")
    else:
        # payloads that can't be a revisit have no key; adaptive joins split what is left of a hot one
        key = F.when(F.octet_length("payload") >= least, F.col("digest"))
        joined = rows.withColumn("_key", key).join(several, F.col("_key") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(rows: DataFrame) -> DataFrame:
    """Writes what classed() gives; the archives: uri, size."""
    folder = shared_path(rows.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out = out or NewFile(folder, ".warc.gz")
                out.write(record(page_id, url, payload, digest, refers_to))
                if out.size >= FILE:
                    done.append((out.close(), out.size))
                    out = None
        if out:
            done.append((out.close(), out.size))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["uri", "size"])

    return written(rows.mapInArrow(write, "uri string, size long"), "warc-files")


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """RECORD of all records of archives(uri, size), read by ranges of `split` bytes."""
    full = archives.filter("size > 0")
    n = full.agg(F.coalesce(F.sum(F.expr(f"(size - 1) div {split} + 1")), F.lit(0))).first()[0]
    ranges = full.select("uri", F.explode(F.expr(f"sequence(0L, (size - 1) div {split})")).alias("k")).repartition(reading_tasks(archives.sparkSession, n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for uri, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, rows, held = OldFile(uri), [], 0
                for offset, data in members(file, k * split, (k + 1) * split):
                    rows.append({"uri": uri, "offset": offset} | parse(data))
                    held += len(data)
                    if held >= 4 * READ:
                        yield out(rows)
                        rows, held = [], 0
                yield out(rows)
                file.close()

    return ranges.mapInArrow(read, RECORD)


def page_id_of(record_id) -> F.Column:
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, split: int = SPLIT) -> DataFrame:
    """Writes a record for each row of pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least `least` bytes, those with the
    smallest page_id are responses and the others revisit it. A null html is an
    empty payload; a null page_id stays null, and is a response if no other of
    its payload has an id. Rows that repeat a page_id are a record each. An
    empty table gives an empty table. Other columns play no part.
    """
    records = read_warc(write_warc(classed(pages, id_col, url_col, html_col, least)), split)
    stored = F.col("record_type") == "response"
    return records.select(
        page_id_of(F.col("record_id")).alias("page_id"),
        "payload_length",
        F.when(stored, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        page_id_of(F.col("refers_to_id")).alias("refers_to"),
    ).withColumnRenamed("payload_length", "payload_bytes")


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def find_archives(spark: SparkSession, path: str) -> DataFrame:
    """uri, size of the archives in a folder, as read_warc takes them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("uri"), F.col("length").alias("size"))
