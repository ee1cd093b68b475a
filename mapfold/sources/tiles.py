"""Vector tiles and tile archives: codecs for batches of binary rows."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "z int, x long, y long, layer string, extent int, feature_seq int, fid long, fid_text string, fid_type string, kind int, parts array<array<struct<x:int,y:int>>>, props string, error string"


class Wire:
    """Fields of a protobuf message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise ValueError("truncated number")
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("truncated message")
        self.at += n
        return self.data[self.at - n : self.at]

    def fields(self) -> Iterator[tuple[int, int, object]]:
        while self.at < len(self.data):
            tag = self.varint()
            number, wire = tag >> 3, tag & 7
            if wire == 0:
                yield number, wire, self.varint()
            elif wire in (1, 5):
                yield number, wire, self.take(8 if wire == 1 else 4)
            elif wire == 2:
                yield number, wire, self.take(self.varint())
            else:
                raise ValueError(f"unsupported wire type {wire}")


def packed(data: bytes) -> list[int]:
    wire, out = Wire(data), []
    while wire.at < len(data):
        out.append(wire.varint())
    return out


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def value_of(data: bytes) -> object:
    """string, float, double, int, uint, sint or bool."""
    out: object = None
    for number, _, v in Wire(data).fields():
        out = {1: lambda: v.decode(), 2: lambda: struct.unpack("<f", v)[0], 3: lambda: struct.unpack("<d", v)[0], 4: lambda: v - (1 << 64) if v >> 63 else v, 5: lambda: v, 6: lambda: unzigzag(v), 7: lambda: bool(v)}.get(number, lambda: out)()
    return out


def geometry_of(commands: list[int], kind: int) -> list[list[tuple[int, int]]]:
    """Parts: each MoveTo opens one."""
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        op, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if not count or op not in (1, 2, 7):
            raise ValueError("bad geometry command")
        if op == 7:
            if kind != 3 or not parts:
                raise ValueError("unexpected ClosePath")
            continue
        if op == 2 and (not parts or kind == 1):
            raise ValueError("LineTo before MoveTo")
        if at + 2 * count > len(commands):
            raise ValueError("truncated geometry")
        for dx, dy in zip(commands[at : at + 2 * count : 2], commands[at + 1 : at + 2 * count : 2]):
            x, y = x + unzigzag(dx), y + unzigzag(dy)
            if op == 1:
                parts.append([])
            parts[-1].append((x, y))
        at += 2 * count
    return parts


def decode_tile(data: bytes) -> list[tuple[str, int, int, int | None, int, list, str]]:
    """layer, extent, place, id, kind, parts, properties (JSON) of a version 2 tile."""
    out = []
    for number, wire, body in Wire(data).fields():
        if number != 3 or wire != 2:
            continue
        name, extent, version, keys, values, features = None, 4096, None, [], [], []
        for field, _, v in Wire(body).fields():
            if field == 1:
                name = v.decode()
            elif field == 2:
                features.append(v)
            elif field == 3:
                keys.append(v.decode())
            elif field == 4:
                values.append(value_of(v))
            elif field == 5:
                extent = v
            elif field == 15:
                version = v
        if not name or version != 2 or extent < 1:
            raise ValueError("a layer needs a name, version 2 and an extent")
        for place, feature in enumerate(features):
            fid, tags, kind, commands = None, [], 0, []
            for field, _, v in Wire(feature).fields():
                if field == 1:
                    fid = v
                elif field == 2:
                    tags += packed(v)
                elif field == 3:
                    kind = v
                elif field == 4:
                    commands += packed(v)
            if kind not in (1, 2, 3) or len(tags) % 2:
                raise ValueError("bad feature")
            if any(k >= len(keys) for k in tags[::2]) or any(v >= len(values) for v in tags[1::2]):
                raise ValueError("tag out of range")
            props = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
            out.append((name, extent, place, fid, kind, geometry_of(commands, kind), json.dumps(props, ensure_ascii=False, separators=(",", ":"))))
    return out


def id_columns(fid: int | float | str | None) -> tuple[int | None, str | None, str | None]:
    """fid, fid_text and fid_type of an id."""
    if fid is None:
        return None, None, None
    if isinstance(fid, str):
        return None, fid, "str"
    whole = int(fid) if fid == int(fid) else None
    return whole if whole is not None and -(1 << 63) <= whole < 1 << 63 else None, str(fid if whole is None else whole), "num"


#: Features that a task holds in Python at once, beyond those of one tile.
MOST_ROWS = 4096


def decode_mvt(tiles: DataFrame, decode=decode_tile) -> DataFrame:
    """FEATURES of tiles(z, x, y, data); a tile that can't be decoded gives one row with its error.

    fid_text has every id, and fid_type is num or str; fid has whole numbers below 2^63.

    `decode` may be any function from bytes to rows like decode_tile's.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in ("z", "x", "y", "layer", "extent", "feature_seq", "fid", "fid_text", "fid_type", "kind", "parts", "props", "error")]
        part = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), part, pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            rows: list[tuple] = []
            # tile by tile, and features are handed on as they come: a batch may hold thousands of tiles
            for z, x, y, data in zip(*(batch.column(c) for c in ("z", "x", "y", "data"))):
                z, x, y = z.as_py(), x.as_py(), y.as_py()
                try:
                    # all of a tile's features, or its error alone
                    found = decode(data.as_py())
                    rows += [(z, x, y, name, extent, place, *id_columns(fid), kind, [[{"x": a, "y": b} for a, b in p] for p in parts], props, None) for name, extent, place, fid, kind, parts, props in found]
                except (ValueError, IndexError, UnicodeDecodeError, struct.error) as error:
                    rows.append((z, x, y, *[None] * 9, str(error)))
                if len(rows) >= MOST_ROWS:
                    yield out(rows)
                    rows = []
            yield out(rows)

    return tiles.select("z", "x", "y", "data").mapInArrow(work, FEATURES)


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """tile id, run, offset, length of an archive's directory: columns of varints, ids as differences, offset 0 for what follows on."""
    wire = Wire(data)
    n = wire.varint()
    ids, last = [], 0
    for i in range(n):
        step = wire.varint()
        if i and not step:
            raise ValueError("ids must ascend")
        last += step
        ids.append(last)
    runs, lengths = [wire.varint() for _ in range(n)], [wire.varint() for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        v = wire.varint()
        if not v and not i:
            raise ValueError("the first offset is missing")
        offsets.append(v - 1 if v else offsets[-1] + lengths[i - 1])
    if wire.at != len(data) or 0 in lengths:
        raise ValueError("bad directory")
    return list(zip(ids, runs, offsets, lengths))


def archive_root(head: bytes) -> tuple[int, int, int, int, bool]:
    """Start and size of an archive's root directory, where leaf directories and tiles begin, and whether directories are compressed."""
    if head[:7] != b"PMTiles" or head[7] != 3:
        raise ValueError("not a version 3 archive")
    root, root_size, _, _, leaf, _, tiles, _ = struct.unpack_from("<8Q", head, 8)
    if head[101] > 26 or head[97] not in (1, 2):
        raise ValueError("unsupported zoom or compression")
    return root, root_size, leaf, tiles, head[97] == 2


def archive_index(data: bytes, depth: int = 4) -> list[tuple[int, int, int, int]]:
    """All entries of an archive, those of leaf directories in their places."""
    root, root_size, leaf, tiles, packed = archive_root(data)

    def walk(start: int, size: int, left: int) -> Iterator[tuple[int, int, int, int]]:
        if left < 0:
            raise ValueError("directories are too deep")
        found = data[start : start + size]
        for tile_id, run, offset, length in directory(gzip.decompress(found) if packed else found):
            if run:
                yield tile_id, run, tiles + offset, length
            else:
                yield from walk(leaf + offset, length, left - 1)

    return list(walk(root, root_size, depth))


#: What a task knows of a directory, and of an entry: entries have a run above zero, directories have none.
RANGES = "source string, tile_id long, run long, offset long, length long, leaf long, tiles long, packed boolean, error string"


def read_archives(archives: DataFrame, depth: int = 4) -> DataFrame:
    """source, tile_id, run, offset, length, error of archives(source), their URIs, of which the header and the directories alone are read.

    The directories of a level are a row each and are read by any number of
    tasks, so an archive may be of any size. An archive or directory that can't
    be read gives a row with its error.
    """
    names = [f.split(" ")[0] for f in RANGES.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows: list[tuple] = []
            for source, _, _, start, size, leaf, tiles, packed, _ in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    system, path = fs.FileSystem.from_uri(source)
                    with system.open_input_file(path) as file:
                        if leaf is None:
                            start, size, leaf, tiles, packed = archive_root(file.read_at(127, 0))
                        found = file.read_at(size, start)
                    for tile_id, run, offset, length in directory(gzip.decompress(found) if packed else found):
                        rows.append((source, tile_id, run, (tiles if run else leaf) + offset, length, leaf, tiles, packed, None))
                except (ValueError, IndexError, struct.error, OSError) as error:
                    rows.append((source, *[None] * 7, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names)

    nothing = {c: F.lit(None).cast("long") for c in ("tile_id", "run", "offset", "length", "leaf", "tiles")}
    open_ones = archives.select("source").withColumns(nothing | {"packed": F.lit(None).cast("boolean"), "error": F.lit(None).cast("string")})
    found = None
    for level in range(depth + 1):
        read = open_ones.repartition("source", "offset").mapInArrow(work, RANGES).checkpoint()
        entries = read.filter("run > 0 or error is not null")
        found = entries if found is None else found.unionByName(entries)
        open_ones = read.filter("run = 0")
        if open_ones.isEmpty():
            break
    else:
        deep = open_ones.select("source").distinct().withColumns(nothing | {"packed": F.lit(None).cast("boolean"), "error": F.lit("directories are too deep")})
        found = found.unionByName(deep)
    return found.select("source", "tile_id", "run", "offset", "length", "error")


def read_archive_index(files: DataFrame) -> DataFrame:
    """source, tile_id, run, offset, length, error of files(path, content), as the binaryFile source gives them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *entry, None) for entry in archive_index(content)]
                except (ValueError, IndexError, struct.error, OSError) as error:
                    rows.append((path, None, None, None, None, str(error)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "tile_id", "run", "offset", "length", "error"])

    return files.select("path", "content").mapInArrow(work, "source string, tile_id long, run long, offset long, length long, error string")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def message(*fields: tuple[int, int | bytes]) -> bytes:
    return b"".join(varint(k << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for k, v in fields)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def encode_points(layer: str, rows: list[tuple[int, int, int, str]], extent: int = 4096) -> bytes:
    """A tile with one layer of points (id, x, y, value of the property `kind`)."""
    values = sorted({r[3] for r in rows})
    place = {v: i for i, v in enumerate(values)}
    features = [(2, message((1, fid), (2, varint(0) + varint(place[kind])), (3, 1), (4, varint(9) + varint(zigzag(x)) + varint(zigzag(y))))) for fid, x, y, kind in rows]
    return message((3, message((15, 2), (1, layer.encode()), *features, (3, b"kind"), *((4, message((1, v.encode()))) for v in values), (5, extent))))


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """The inverse of directory(): entries in ascending order of tile ids."""
    ids = [e[0] for e in entries]
    steps = [b - a for a, b in zip([0, *ids], ids)]
    offsets = [0 if i and e[2] == entries[i - 1][2] + entries[i - 1][3] else e[2] + 1 for i, e in enumerate(entries)]
    return b"".join(map(varint, [len(entries), *steps, *(e[1] for e in entries), *(e[3] for e in entries), *offsets]))


SIGNATURE = b"MMT\x01"


class Columns(Wire):
    """Columnar tiles: texts with their length, null bitmaps, zig-zag numbers of up to 53 bits."""

    def text(self) -> str:
        return self.take(self.varint()).decode()

    def signed(self) -> int:
        n = unzigzag(self.varint())
        if abs(n) > 4503599627370495:
            raise ValueError("number out of range")
        return n

    def double(self) -> float:
        v = struct.unpack("<d", self.take(8))[0]
        if v != v or v in (float("inf"), float("-inf")):
            raise ValueError("number isn't finite")
        return v

    def flag(self) -> bool:
        byte = self.take(1)[0]
        if byte > 1:
            raise ValueError("bad boolean")
        return byte == 1

    def column(self, n: int, kind: str) -> list:
        """n values of a kind: bool, int, float or text, null where the bitmap says so."""
        bits = self.take((n + 7) // 8)
        words = [self.text() for _ in range(self.varint())] if kind == "text" else []
        read = {"bool": self.flag, "int": self.signed, "float": self.double, "text": lambda: words[self.varint()]}[kind]
        return [read() if bits[i >> 3] >> (i & 7) & 1 else None for i in range(n)]


def decode_columnar(data: bytes) -> list[tuple[str, int, int, int | None, int, list, str]]:
    """The rows of a columnar tile, as decode_tile gives them; ids that aren't whole numbers are null."""
    wire, out = Columns(data), []
    if wire.take(4) != SIGNATURE:
        raise ValueError("not a columnar tile")
    for _ in range(wire.varint()):
        layer = Columns(wire.take(wire.varint()))
        name, extent, n, id_kind = layer.text(), layer.varint(), layer.varint(), layer.take(1)[0]
        if not name or extent < 1 or id_kind > 3:
            raise ValueError("bad layer")
        ids = layer.column(n, ("int", "float", "text")[id_kind - 1]) if id_kind else [None] * n
        props: dict[str, list] = {}
        for _ in range(layer.varint()):
            key, kind = layer.text(), layer.take(1)[0]
            if not key or key in props or kind not in (1, 2, 3, 4):
                raise ValueError("bad property column")
            props[key] = layer.column(n, ("bool", "int", "float", "text")[kind - 1])
        for i, kind in enumerate(layer.take(n)):
            if kind not in (1, 2, 3):
                raise ValueError("bad geometry type")
            x = y = 0
            parts = []
            for _ in range(layer.varint()):
                part = []
                for _ in range(layer.varint()):
                    x, y = x + layer.signed(), y + layer.signed()
                    part.append((x, y))
                if len(part) < kind:
                    raise ValueError("a part is too short")
                parts.append(part)
            if not parts:
                raise ValueError("a feature has no parts")
            held = {k: v[i] for k, v in props.items() if v[i] is not None}
            out.append((name, extent, i, ids[i], kind, parts, json.dumps(held, ensure_ascii=False, separators=(",", ":"))))
        if layer.at != len(layer.data):
            raise ValueError("bytes after a layer")
    if wire.at != len(data):
        raise ValueError("bytes after the tile")
    return out


def encode_columnar_points(layer: str, rows: list[tuple[int, int, int, str]], extent: int = 4096) -> bytes:
    """A columnar tile with one layer of points (id, x, y, value of the property `kind`)."""
    text = lambda s: varint(len(s.encode())) + s.encode()
    n, words = len(rows), sorted({r[3] for r in rows})
    every = bytes(255 if 8 * k + 8 <= n else (1 << n - 8 * k) - 1 for k in range((n + 7) // 8))
    ids = every + b"".join(varint(zigzag(r[0])) for r in rows)
    kinds = every + varint(len(words)) + b"".join(map(text, words)) + b"".join(varint(words.index(r[3])) for r in rows)
    shapes = b"".join(varint(1) + varint(1) + varint(zigzag(r[1])) + varint(zigzag(r[2])) for r in rows)
    body = text(layer) + varint(extent) + varint(n) + b"\x01" + ids + varint(1) + text("kind") + b"\x04" + kinds + b"\x01" * n + shapes
    return SIGNATURE + varint(1) + varint(len(body)) + body
