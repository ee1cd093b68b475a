"""Byte-level BPE encoding and decoding with a segment tree for each pre-token.

A tree over the byte positions of a pre-token holds, at the leaf of each live
part, the rank of the pair that it makes with the part after it, together with
its position; the root is the leftmost pair of the least rank. A merge changes
the leaves of the merged part, of the one it swallowed and of the live part
before it, and the nodes above them, so it takes logarithmic time. Many
pre-tokens of about one length go through the same steps as rows of arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, worker_state
from .units import Cache, Unit, unit_text, units

NONE = np.int64(1) << 40
#: Pre-tokens longer than this, or few of one length, take a tree of their own.
WIDEST, FEWEST = 128, 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that together are a token: left << 32 | right, sorted, and its rank."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


class Encoder:
    """Ranks are the ids, as in the vocabulary's file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keys: np.ndarray, merged: np.ndarray):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.keys, self.merged = keys, merged
        self.of_pair = dict(zip(keys.tolist(), merged.tolist()))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: b"%d " % rank for rank in ranks.values()}
        size = lambda v: 130 + len(v[0]) + len(v[1])
        self.cache, self.words = Cache(self.encode_units, size, 48 << 20), Cache(self.packed_words, size, 32 << 20)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """The ids of one pre-token, by a tree in plain lists."""
        n, none, of_pair = len(word), int(NONE), self.of_pair
        width = 1 << max(1, (n - 1).bit_length())
        token = [int(self.of_byte[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = of_pair.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            token[i], after[i], token[j] = rank, k, -1
            if k < n:
                before[k] = i
            changed = [(j, None), (i, of_pair.get(rank << 32 | token[k]) if k < n else None)]
            if before[i] >= 0:
                changed.append((before[i], of_pair.get(token[before[i]] << 32 | rank)))
            for at, new in changed:
                node = width + at
                tree[node] = none if new is None else new * width + at
                node >>= 1
                while node:
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
                    node >>= 1
        return [t for t in token if t >= 0]

    def together(self, words: list[bytes], width: int) -> list[list[int]]:
        """The ids of pre-tokens of up to `width` bytes, a power of two, as rows of arrays."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        token = np.full((n, width + 1), -1, np.int64)
        token[:, :width] = self.of_byte[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)]
        place = np.arange(width)
        live = place < lengths[:, None]
        token[:, :width][~live] = -1
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), lengths - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.pair_ranks(token[:, :-1], token[:, 1:])
        tree[:, width:] = np.where(rank < NONE, rank * width + place, NONE)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray | None) -> None:
            node = width + at
            tree[rows, node] = NONE if rank is None else np.where(rank < NONE, rank * width + at, NONE)
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            rank, i = root // width, root % width
            j = after[rows, i]
            k = after[rows, j]
            token[rows, i], after[rows, i], before[rows, k], live[rows, j] = rank, k, i, False
            put(rows, j, None)
            put(rows, i, self.pair_ranks(rank, token[rows, k]))
            p = before[rows, i]
            some = p >= 0
            put(rows[some], p[some], self.pair_ranks(token[rows[some], p[some]], rank[some]))
        flat = token[:, :width][live].tolist()
        ends = np.cumsum(live.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[at] = [rank]
            else:
                groups.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(at)
        for width, where in groups.items():
            if width > WIDEST or len(where) < FEWEST:
                for at in where:
                    out[at] = self.alone(words[at])
            else:
                for a in range(0, len(where), 4096):
                    part = where[a : a + 4096]
                    for at, ids in zip(part, self.together([words[at] for at in part], width)):
                        out[at] = ids
        return out

    def words_of(self, unit: Unit) -> list[bytes]:
        """The pre-tokens of a stretch."""
        if type(unit) is str and unit.isascii():
            # a space and letters are one, and so are signs after them
            word = unit.rstrip(punctuation)
            if word.isalpha():
                return [b" " + word.encode(), unit[len(word) :].encode()] if len(word) < len(unit) else [b" " + word.encode()]
        return [w.encode("utf-8") for w in self.find(unit_text(unit))]

    def packed_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each pre-token its ids as little-endian 32-bit numbers, and in decimal with a space after each."""
        flat, ends = [], [0]
        for ids in self.encode_words(words):
            flat += ids
            ends.append(len(flat))
        numbers, decimals = np.array(flat, "<u4").tobytes(), list(map(self.decimal.__getitem__, flat))
        return [(numbers[4 * a : 4 * b], b"".join(decimals[a:b])) for a, b in zip(ends, ends[1:])]

    def encode_units(self, missing: list) -> list[tuple[bytes, bytes]]:
        """The same for stretches; their pre-tokens are remembered too, as words stand with several signs."""
        cut = list(map(self.words_of, missing))
        known = self.words.get(set(chain.from_iterable(cut)))
        return [known[ws[0]] if len(ws) == 1 else (b"".join([known[w][0] for w in ws]), b"".join([known[w][1] for w in ws])) for ws in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_encoder(vocabulary: str, pattern: str) -> Encoder:
    ranks = read_ranks(vocabulary)
    return Encoder(ranks, pattern, *pair_table(ranks))


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    Every match of pattern is encoded separately by the ranks of the file
    `vocabulary` (its path on every node); then the ids are decoded again, by
    the tokens' bytes. ids_sha256 is of the decimal ids with a space between,
    decoded_sha256 of the decoded bytes. Null counts as empty: no ids. Repeated
    rows give repeated rows, an empty table an empty one. Texts are read whole.
    Other columns play no part, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(f"bpe_{vocabulary}_{pattern}", lambda: load_encoder(vocabulary, pattern))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for batch in batches:
            # a slice of the texts at a time, so that no batch of ids is larger
            for a, b in slices(pa.compute.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(a, b - a)
                cut = [units(t) for t in part.column(1).to_pylist()]
                known = bpe.cache.get(set(chain.from_iterable(cut)))
                n_tokens, shas, backs, kept = [], [], [], []
                for c in cut:
                    got = [known[u] for u in c]
                    ids = np.frombuffer(b"".join([x for x, _ in got]), "<u4")
                    n_tokens.append(len(ids))
                    shas.append(hashlib.sha256(b"".join([x for _, x in got])[:-1]).hexdigest())
                    backs.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                columns = [part.column(0), pa.array(n_tokens, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int32()))] * with_ids], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts.mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`, the bytes of its ids; null for null ids."""

    @F.pandas_udf("binary")
    def decode(ids):
        bytes_of = worker_state(f"bpe_bytes_{vocabulary}", lambda: {r: t for t, r in read_ranks(vocabulary).items()})
        return ids.map(lambda x: None if x is None else b"".join(bytes_of[i] for i in x.tolist()))

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
