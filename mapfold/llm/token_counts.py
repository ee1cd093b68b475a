"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

First tier: the token counts of the corpus's most frequent stretches (see
units.py), found over all documents: each task counts its own, keeps its TOP
most frequent, and packs them in one row, which it writes to the shared folder;
tasks merge what FAN_IN others wrote, until one table of TOP entries is left,
which is broadcast. Nothing is shuffled: merging tasks read files. Second tier: what
is not in the table is encoded by the tokenizers library once for each worker
and kept in the worker's bounded cache. Both tiers hold what the library gives,
so neither changes a count.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, slices, worker_state, written
from .units import Cache, unit_text, units

#: Entries of the broadcast table, and longest stretch in it: 16384 * (64 * 4 + 5) bytes at most.
TOP = 16_384
LONGEST = 64
#: Stretches that a task counts at once before rare ones are forgotten.
COUNTED = 300_000
#: Packed rows that one task merges.
FAN_IN = 32
#: How byte-level vocabularies write a space.
SPACE = "\u0120"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pack(counts: list[tuple[str, int]]) -> bytes:
    """(stretch, number) pairs in one block: the number of entries, all numbers, all lengths, all bytes."""
    data = [s.encode("utf-8", "surrogatepass") for s, _ in counts]
    head = np.array([len(data)], "<u4").tobytes()
    return head + np.array([n for _, n in counts], "<u8").tobytes() + np.array([len(d) for d in data], "<u2").tobytes() + b"".join(data)


def unpack(block: bytes) -> list[tuple[str, int]]:
    n = int(np.frombuffer(block, "<u4", 1)[0])
    numbers = np.frombuffer(block, "<u8", n, 4).tolist()
    ends = (np.cumsum(np.frombuffer(block, "<u2", n, 4 + 8 * n)) + 4 + 10 * n).tolist()
    return [(block[a:b].decode("utf-8", "surrogatepass"), k) for a, b, k in zip([4 + 10 * n, *ends], ends, numbers)]


def frequent_units(docs: DataFrame, top: int = TOP) -> bytes:
    """The packed table of the most frequent stretches of all texts, with how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for text in texts:
                seen.update(units(text)[1:])
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        best = [(s, n) for s, n in seen.most_common(2 * top) if n > 1 and len(s) <= LONGEST][:top]
        yield pa.RecordBatch.from_arrays([pa.array([pack(best)], pa.binary())], ["packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for block in batch.column(0).to_pylist():
                for s, n in unpack(block):
                    seen[s] += n
        yield pa.RecordBatch.from_arrays([pa.array([pack(seen.most_common(top))], pa.binary())], ["packed"])

    packed = written(docs.mapInArrow(count, "packed binary"), "frequent")
    tasks = packed.count()  # a row for each task that counted
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        # coalesce: a task reads the files of several; no exchange
        merged = written(packed.coalesce(tasks).mapInArrow(merge, "packed binary"), "frequent")
        forget(packed)
        packed = merged
    row = packed.first()  # one row of bounded size
    forget(packed)
    return row[0] if row else pack([])


class UnitCounter:
    """Token counts of stretches by the tokenizers library, many at once.

    The first token of a stretch that has no other space than its first, and no
    other token of it, begins with that space; so the counts of many such
    stretches in one text are the distances between tokens that do.
    """

    def __init__(self, vocabulary: str):
        self.tok = load_tokenizer(vocabulary)
        self.tok.no_padding(), self.tok.no_truncation()
        self.special = sorted({t.content for t in self.tok.get_added_tokens_decoder().values()})
        self.begins = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.begins[i] = token.startswith(SPACE)
        self.cache = Cache(self.count)

    def alone(self, texts: list[str]) -> list[int]:
        return list(map(len, self.tok.encode_batch_fast(texts, add_special_tokens=False)))

    def count(self, missing: list) -> list[int]:
        plain = [u for u in missing if type(u) is str and u and " " not in u]
        sizes = {}
        if plain:
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(plain):
                sizes = dict(zip(plain, np.diff(starts, append=len(ids)).tolist()))
        rest = [u for u in missing if u not in sizes]
        sizes.update(zip(rest, self.alone(list(map(unit_text, rest)))))
        return list(map(sizes.__getitem__, missing))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the file `vocabulary` (its
    path on every node), for the whole text, without added tokens; a text that
    has one of the vocabulary's special strings goes to the library whole. Null
    counts as empty, with no tokens. Repeated rows give repeated rows, an empty
    table an empty one. Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counter = UnitCounter(vocabulary)
    table = [s for s, _ in unpack(frequent_units(texts.select("text"), top))]
    shared = spark.sparkContext.broadcast(pack(list(zip(table, counter.count(table)))))
    special = counter.special

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"token_counts_{vocabulary}", lambda: UnitCounter(vocabulary))
        frequent = dict(unpack(shared.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = pa.compute.binary_length(batch.column(1)).to_pylist()
            n_tokens: list[int] = []
            for a, b in slices(n_bytes):
                cut = [None if any(s in t for s in special) else units(t) for t in texts[a:b]]
                wanted = set(chain.from_iterable(c for c in cut if c is not None))
                rare = wanted.difference(frequent)
                known = counter.cache.get(rare)
                sizes = {u: known[u] if u in rare else frequent[u] for u in wanted}
                for text, c in zip(texts[a:b], cut):
                    n_tokens.append(counter.alone([text])[0] if c is None else sum(map(sizes.__getitem__, c)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
