"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a range of documents, one after another, in blocks of
BLOCK ids. A block stores its least id, a width, the low `width` bits of each
id's distance from the least, and a list of exceptions: the places and high
bits of the ids that need more. The width is the least that holds PERCENT of
the block's ids. The file ends with the starts of all blocks, the documents
(id and number of tokens) and where these begin, so a reader may open a file
at any block.

    block:   u32 least | u8 width | u8 0 | u16 exceptions | packed low bits, lowest first
             | u16 places | u32 high bits
    footer:  u64 block starts | i64 doc ids | u8 id is null | u64 token counts
    trailer: u64 footer start | u64 blocks | u64 documents | u64 ids | magic
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .files import NewFile, OldFile
from .shared import reading_tasks, shared_path, slices, worker_state, written
from .token_counts import load_tokenizer
from .units import Cache

BLOCK = 4096
PERCENT = 90
MAGIC = b"MFPFOR02"
TRAILER = 32 + len(MAGIC)
#: Ids that a reader's task decodes at once.
SEGMENT = 1 << 20
#: First letters of a text that decide its file among the texts of one id.
HEAD = 64
#: Bytes of text that a file takes, on average, where there are more than a file for each reducer.
FILE_BYTES = 64 << 20


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each row's values, one after another, the lowest first; a row has a multiple of eight."""
    # eight values fill `width` whole bytes, and each has the same place in them
    lanes = values.astype(np.uint64).reshape(-1, 8).T.copy()
    out = np.zeros((width + 8, lanes.shape[1]), np.uint8)
    for j in range(8 if width else 0):
        byte, shift = divmod(j * width, 8)
        moved = lanes[j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[byte + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out[:width].T.reshape(len(values), -1)


def unpack(data: np.ndarray, width: int) -> np.ndarray:
    """The values (uint64) that pack() put in the rows of data."""
    rows = data.reshape(-1, width).T.astype(np.uint64)
    out = np.zeros((8, rows.shape[1]), np.uint64)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        for k in range((shift + width + 7) // 8):
            out[j] |= rows[byte + k] << np.uint64(8 * k)
        out[j] >>= np.uint64(shift)
    return (out & np.uint64((1 << width) - 1)).T.reshape(len(data), -1)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids, which are a whole number of blocks or the end of a file."""
    n = -(-len(ids) // BLOCK)
    # the end of a file is filled up with its last id
    values = np.pad(ids.astype(np.int64), (0, n * BLOCK - len(ids)), "edge").reshape(n, BLOCK)
    least = values.min(1)
    rest = values - least[:, None]
    sizes = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(n))
    widths = [int(np.partition(r[:size], k := (size * PERCENT - 1) // 100)[k]).bit_length() for r, size in zip(rest, sizes.tolist())]
    low: list = [None] * n
    for width in set(widths):
        where = [i for i, w in enumerate(widths) if w == width]
        for i, row in zip(where, pack(rest[where] & ((1 << width) - 1), width)):
            low[i] = row.tobytes()[: (int(sizes[i]) * width + 7) // 8]
    out = []
    for i, (width, size) in enumerate(zip(widths, sizes.tolist())):
        places = np.flatnonzero(rest[i, :size] >> width)
        head = least[i : i + 1].astype("<u4").tobytes() + bytes([width, 0]) + np.array([len(places)], "<u2").tobytes()
        out.append(head + low[i] + places.astype("<u2").tobytes() + (rest[i, places] >> width).astype("<u4").tobytes())
    return out


def unpack_blocks(blocks: list[bytes], total: int) -> np.ndarray:
    """The ids of blocks, `total` together; all but the last are full."""
    n = len(blocks)
    out = np.zeros((n, BLOCK), np.uint64)
    widths = [block[4] for block in blocks]
    sizes = [BLOCK] * (n - 1) + [total - BLOCK * (n - 1)]
    for width in set(widths) - {0}:
        where = [i for i, w in enumerate(widths) if w == width]
        packed = b"".join(blocks[i][8 : 8 + (sizes[i] * width + 7) // 8].ljust(BLOCK // 8 * width, b"\0") for i in where)
        out[where] = unpack(np.frombuffer(packed, np.uint8).reshape(len(where), -1), width)
    for i, (block, width, size) in enumerate(zip(blocks, widths, sizes)):
        least, exceptions = int(np.frombuffer(block, "<u4", 1)[0]), int(np.frombuffer(block, "<u2", 1, 6)[0])
        end = 8 + (size * width + 7) // 8
        if exceptions:
            places = np.frombuffer(block, "<u2", exceptions, end)
            out[i, places] |= np.frombuffer(block, "<u4", exceptions, end + 2 * exceptions).astype(np.uint64) << np.uint64(width)
        out[i] += np.uint64(least)
    return out.ravel()[:total].astype(np.uint32)


def unpack_block(block: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    return unpack_blocks([block], n)


class IdFile:
    """A file being written."""

    def __init__(self, folder: str):
        self.file = NewFile(folder, ".ids")
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document, with its ids as little-endian 32-bit numbers."""
        self.docs.append((doc_id, len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= 64 * BLOCK:
            self.flush(self.held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        self.starts += [self.file.write(block) for block in pack_blocks(ids[:n])]
        self.waiting, self.held = [ids[n:].tobytes()], self.held - n

    def close(self) -> tuple[str, int]:
        self.flush(self.held)
        parts = [np.array(self.starts, "<u8"), np.array([d or 0 for d, _ in self.docs], "<i8"), np.array([d is None for d, _ in self.docs], "u1"), np.array([n for _, n in self.docs], "<u8")]
        footer = self.file.write(b"".join(p.tobytes() for p in parts))
        self.file.write(np.array([footer, len(self.starts), len(self.docs), self.total], "<u8").tobytes() + MAGIC)
        return self.file.close(), self.total


def read_footer(file: OldFile) -> tuple[np.ndarray, list[int | None], np.ndarray, int]:
    """Starts of the blocks and of the footer, document ids, their numbers of tokens, the number of ids."""
    trailer = file.read(file.size - TRAILER, TRAILER)
    if trailer[32:] != MAGIC:
        raise ValueError("not a file of token ids")
    footer, blocks, docs, total = np.frombuffer(trailer, "<u8", 4).tolist()
    data = file.read(footer, file.size - TRAILER - footer)
    at = 8 * blocks
    doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
    absent = np.frombuffer(data, "u1", docs, at + 8 * docs).tolist()
    starts = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(footer)).astype(np.int64)
    return starts, [None if no else d for d, no in zip(doc_ids, absent)], np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64), total


def read_ids(file: OldFile, starts: np.ndarray, total: int, first: int, end: int) -> np.ndarray:
    """Ids number first to end of the file, from the blocks that hold them only."""
    if first == end:
        return np.empty(0, np.uint32)
    a, b = first // BLOCK, -(-end // BLOCK)
    data, base = file.read(int(starts[a]), int(starts[b] - starts[a])), int(starts[a])
    blocks = [data[int(starts[i]) - base : int(starts[i + 1]) - base] for i in range(a, b)]
    return unpack_blocks(blocks, min(total, b * BLOCK) - a * BLOCK)[first - a * BLOCK : end - a * BLOCK]


#: Beyond these letters, lower case and composition may depend on each other.
UNUSUAL = re.compile("[^\\x00-\u024f]|\u0130")
SPACES = "\n\t\r\x0b\x0c"


def stretches(text: str) -> list[str]:
    """Stretches of text that the tokenizer encodes as it would the whole text.

    It drops white space and never joins what is before it with what is after.
    """
    for space in SPACES:
        if space in text:
            text = text.replace(space, " ")
    return text.split(" ")


class WordEncoder:
    """Encodes texts by the tokenizers library, and remembers the ids of their stretches.

    The vocabulary makes letters small, never joins letters with punctuation,
    and its tokens tell where words end. A stretch that is letters, with or
    without ASCII punctuation after them, is the ids of its word and its
    signs; words that are not known are given to the library many at once, and
    the ends tell their ids apart. All else is encoded stretch by stretch, and
    texts that hold special strings are encoded whole.
    """

    def __init__(self, vocabulary: str):
        self.tok = load_tokenizer(vocabulary)
        self.tok.no_padding(), self.tok.no_truncation()
        self.special = sorted({t.content for t in self.tok.get_added_tokens_decoder().values()})
        model = json.loads(self.tok.to_str())["model"]
        suffix, size = model.get("end_of_word_suffix") or "", self.tok.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        # letters that are small already: nothing but white space parts them
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache = Cache(self.encode, len)

    def apart(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate(4 * len(x) for x in ids))
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def words(self, words: list[str]) -> list[bytes]:
        """The same for words of small, usual letters."""
        if not words:
            return []
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.apart(words)
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, missing: list[str]) -> list[bytes]:
        known = self.cache.known
        words = [m for m in missing if m.isalpha()]
        rest = {m: m.rstrip(punctuation) for m in missing if not m.isalpha()}
        signed = [m for m, w in rest.items() if w.isalpha()]
        odd = [m for m, w in rest.items() if not w.isalpha()]
        if UNUSUAL.search(" ".join(words + signed)):
            odd += [m for m in words + signed if UNUSUAL.search(m)]
            words, signed = ([m for m in part if not UNUSUAL.search(m)] for part in (words, signed))
        of_word = dict(zip(words, map(str.lower, words)))
        of_signed = {m: rest[m].lower() for m in signed}
        wanted = {*of_word.values(), *of_signed.values()}
        ids = {w: known[w] for w in wanted if w in known}
        new = list(wanted.difference(ids))
        ids.update(zip(new, self.words(new)))
        out = dict(zip(odd, self.apart(odd)))
        out.update((m, ids[w]) for m, w in of_word.items())
        signs = {m: m[len(w) :] for m, w in of_signed.items()}
        runs = list(set(signs.values()))
        of_run = dict(zip(runs, self.apart(runs)))
        out.update((m, ids[w] + of_run[signs[m]]) for m, w in of_signed.items())
        return list(map(out.__getitem__, missing))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        cut = [None if any(s in t for s in self.special) else stretches(t) for t in texts]
        known = self.cache.get(set(chain.from_iterable(c for c in cut if c is not None)))
        for text, c in zip(texts, cut):
            yield b"".join(map(known.__getitem__, c)) if c is not None else self.apart([text])[0]


def write_id_files(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs to files in ascending order of their ids; the files: first_id, first_text, first_hash, uri, n_docs, n_ids.

    The vocabulary must drop white space between words, as those with word ends
    do. end_id is appended to each document. Rows that repeat an id are in the
    order of the first letters of their texts, then of a hash; null ids come
    first. Files are ranges in this order, so an id may fill several, whatever
    its texts begin with; only rows of one id and text are of one file.
    """
    folder = shared_path(docs.sparkSession, "token-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
    order = ["doc_id", F.substring("text", 1, HEAD), F.xxhash64("text")]
    ordered = texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").withColumn("hash", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"id_files_{vocabulary}", lambda: WordEncoder(vocabulary))
        out, end, first = None, np.array([end_id], "<u4").tobytes(), None
        for batch in batches:
            doc_ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if out is None and doc_ids:
                out, first = IdFile(folder), (doc_ids[0], found[0][:HEAD], batch.column(2)[0].as_py())
            for a, b in slices(pa.compute.binary_length(batch.column(1)).to_pylist()):
                for doc_id, ids in zip(doc_ids[a:b], encoder.texts(found[a:b])):
                    out.add(doc_id, ids + end)
        if out is not None:
            n_docs = len(out.docs)
            uri, n_ids = out.close()
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*first, uri, n_docs, n_ids), kinds)], ["first_id", "first_text", "first_hash", "uri", "n_docs", "n_ids"])

    return written(ordered.mapInArrow(write, "first_id long, first_text string, first_hash long, uri string, n_docs long, n_ids long"), "token-id-files")


def read_id_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the files that write_id_files returned: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start is the number of ids of all documents before. Files are read by
    segments of about SEGMENT ids, any of which may be in a task of its own.
    """
    # one row for each file, and a file for each task that wrote: none of them for a document
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_text", "first_hash", "uri").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    segments = placed.select("uri", "base", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {SEGMENT})")).alias("segment"))
    n = files.agg(F.coalesce(F.sum(F.expr(f"(n_ids - 1) div {SEGMENT} + 1")), F.lit(0))).first()[0]
    segments = segments.repartition(reading_tasks(files.sparkSession, n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        footers: dict = {}  # of the last file alone
        for batch in batches:
            for uri, base, segment in zip(*(c.to_pylist() for c in batch.columns)):
                file = OldFile(uri)
                if uri not in footers:
                    footers = {uri: read_footer(file)}
                starts, doc_ids, counts, total = footers[uri]
                ends = np.cumsum(counts)
                firsts = ends - counts
                # a document is of the segment in which it begins
                mine = range(*np.searchsorted(firsts, [segment * SEGMENT, (segment + 1) * SEGMENT]).tolist())
                if len(mine):
                    low, high = int(firsts[mine[0]]), int(ends[mine[-1]])
                    ids = read_ids(file, starts, total, low, high).astype("<u4", copy=False)
                    own = [ids[firsts[i] - low : ends[i] - low] for i in mine]
                    columns = [pa.array([doc_ids[i] for i in mine], pa.int64()), pa.array([base + int(firsts[i]) for i in mine], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)
                file.close()

    return segments.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes the ids of docs to files and reads them back: one row for each row of docs, see read_id_files.

    Null counts as empty and has the end id alone. An empty table writes no
    file and gives an empty table. Texts are encoded whole by the tokenizers
    library for the file `vocabulary` (its path on every node). Other columns
    play no part, whatever their names.
    """
    return read_id_files(write_id_files(docs, vocabulary, end_id, id_col, text_col), with_ids)
