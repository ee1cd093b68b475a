"""Exact dedup, SimHash, sharding and WARC against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from mapfold.llm import exact_dedup, queries, sharding, simhash, warc
from mapfold.llm.files import OldFile


def key(row):
    return tuple((v is not None, v) for v in row)


def want_copies(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    out = []
    for d, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids, default=None)
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest(), len(t.encode())))
    return out


@pytest.mark.parametrize("bucket_bytes", [exact_dedup.BUCKET_BYTES, 1])
@pytest.mark.parametrize("hot_rows", [exact_dedup.HOT_ROWS, 1])
def test_op10_odd_rows(odd, none, bucket_bytes, hot_rows):
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd, bucket_bytes=bucket_bytes, most_bits=6, hot_rows=hot_rows).collect()]
    want = want_copies([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_directory_doubles_only_where_buckets_are_full(spark):
    keys = spark.createDataFrame([(i << 40, 100) for i in range(64)] + [(-1, 100)] * 500, "key long, n_bytes int")
    rows = exact_dedup.directory(keys, bucket_bytes=1000, most_bits=30).collect()
    assert {r.depth for r in rows} >= {1} and max(r.depth for r in rows) > 10
    # copies are one entry: the crowded key alone doesn't fill its bucket
    assert next(r.depth for r in rows if r.cell == (1 << 30) - 1) == 1


def many_texts(spark):
    """Texts of 400 groups, one of them with a third of all rows."""
    return spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' ELSE concat('text ', id % 400, repeat(' x', id % 7)) END AS text")


@pytest.mark.parametrize("bucket_bytes", [20, 2000])
def test_op10_many_buckets(spark, bucket_bytes):
    docs = many_texts(spark)
    want = want_copies([(r.doc_id, r.text) for r in docs.collect()])
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, bucket_bytes=bucket_bytes, most_bits=12).collect()]
    assert sorted(got) == sorted(want)


def test_op10_documents_are_found_by_the_directory(spark, monkeypatch):
    """Without a part of the directory the documents of its buckets are lost: nothing else leads to them."""
    docs, whole = many_texts(spark), exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: whole(*a).filter("cell < 2048"))
    rows = exact_dedup.exact_dedup(docs, bucket_bytes=20, most_bits=12).collect()
    lost = docs.withColumn("key", exact_dedup.F.xxhash64(exact_dedup.normalised(docs.text))).filter("shiftrightunsigned(key, 52) >= 2048").count()
    assert lost and len(rows) == 3000 - lost


def test_op10_owners_compare_bytes(spark):
    """Texts whose keys collide are chained in their bucket."""
    texts = spark.createDataFrame([(i, 7, f"text {i % 3}", 1, False) for i in range(9)], "doc_id long, key long, body string, n long, hot boolean")
    cells = spark.createDataFrame([(0, 0, 0)], "cell long, depth int, bucket long")
    rows = exact_dedup.pages(texts, cells, 0, 2, 12).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.chain) for r in rows} == {(i, i % 3, 3, i % 3) for i in range(9)}


def test_op10_directory_is_no_deeper_than_its_buckets(spark):
    """Long texts alone don't deepen it."""
    keys = spark.range(1000).selectExpr("xxhash64(id) AS key", "CASE WHEN id % 100 = 0 THEN 1000000 ELSE 100 END AS n_bytes")
    cells, bits = exact_dedup.shortened(exact_dedup.directory(keys, 10_000, 17), 17)
    assert 3 <= bits <= 8 and cells.count() <= 1 << bits


def rows_of_one_id(spark):
    return spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "unique text that is quite another")], "doc_id long, text string")


def test_drops_are_by_row(spark):
    """A text of its own stays though a copy has its id."""
    docs = rows_of_one_id(spark)
    for kept in (exact_dedup.drop_copies(docs), simhash.keep_one(docs)):
        assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f"), (5, "unique text that is quite another")]


def test_drop_copies_keeps_columns(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 3, 4, 6, 7, 8, 9, None}


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_op4_whole_table(spark, sf_dir, sf):
    sf_dir = sf_dir.replace("0.001", sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op4_simhash_near_dedup(spark, sf_dir).collect()) == sorted(brute_components(rows))


def test_op4_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(none).collect() == []


def planted_codes(n, seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    near = codes[: n // 3].copy()
    for i in range(len(near)):
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    return np.unique(np.concatenate([codes, near]))


def test_gray_index_searches_groups_of_their_own():
    codes = planted_codes(4000, 5)
    group = np.sort(np.random.default_rng(1).integers(0, 300, len(codes)))
    group = np.unique(group, return_inverse=True)[1]
    a, b = simhash.group_links(codes, group, np.full(len(codes), -1), 14)
    root = np.arange(len(codes))
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 14) & (group[:, None] == group[None, :])
    simhash.forest(len(codes), *np.nonzero(np.triu(near, 1)), root)
    moved = np.flatnonzero(root != np.arange(len(codes)))
    assert len(moved) and set(zip(codes[moved], codes[root[moved]])) == set(zip(a, b))


def test_masks_of_blocks():
    levels = simhash.block_masks(3, 4)
    assert [len(m) for m in levels] == [5, 25, 125]
    # the blocks of a level are apart, and each child has its parent's bits
    for masks, children in zip(levels, levels[1:]):
        assert all(c & masks[k // 5] == masks[k // 5] for k, c in enumerate(children))


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_gray_index_finds_all_pairs(n):
    codes = planted_codes(n, n)
    q, c = simhash.GrayIndex(codes).search(codes, 4)
    want = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    assert set(zip(q.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in want)))


@pytest.mark.parametrize("part", [simhash.PART, 50, 7])
def test_links_join_a_crowded_block(spark, part):
    """Thousands of codes about one centre, split over parts or not, and strays."""
    rng = np.random.default_rng(3)
    centre = np.full(400, 0x0123456789ABCDEF, np.uint64)
    for _ in range(2):
        centre ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    codes = np.unique(np.concatenate([centre, planted_codes(300, 8)]))
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, part=part)).collect()}
    root = np.arange(len(codes))
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1))
    simhash.forest(len(codes), a, b, root)
    classes = {}
    for code, r in zip(codes.view(np.int64).tolist(), root.tolist()):
        classes.setdefault(r, []).append(code)
    assert {m: min(v) for v in classes.values() for m in v if m != min(v)} == got


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100}


def test_keep_one_keeps_columns(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {0, 1, 4, 8} <= {r.doc_id for r in kept.collect()}


def test_op7_odd_rows(odd, none):
    rows = sharding.stratified_shards(odd, 5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    text = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" for r in rows)
    assert sharding.stratified_shards(none).collect() == []


def test_op7_shards_match_the_mixture(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 8) END AS source")
    rows = sharding.stratified_shards(docs, 16).groupBy("shard", "source").count().collect()
    total = Counter()
    for r in rows:
        total[r.source] += r["count"]
    assert all(abs(r["count"] - total[r.source] / 16) <= 2 for r in rows)


@pytest.fixture(scope="module")
def pages(spark):
    html = "<p>" + "same " * 40 + "</p>"
    rows = [(1, "http://a/ä b", html, 9), (2, None, html, 9), (3, "http://c", None, 9), (4, "http://d", "", 9), (5, "http://e", "short", 9), (6, "http://f", "short", 9), (7, "u", "é" * 90_000, 9), (None, "x", "<b>no id</b>" * 20, 9), (2, "again", html, 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest long")


def want_pages(rows):
    least = {}
    for p, h in rows:
        if len(h.encode()) >= 100 and p is not None:
            least[h] = min(least.get(h, p), p)
    out = []
    for p, h in rows:
        first = least.get(h)
        again = first is not None and p is not None and p != first
        out.append((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_op1_reads_in_many_tasks(spark, pages):
    archives = warc.write_warc(warc.classed(pages))
    assert warc.read_warc(archives, 64).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("split", [warc.SPLIT, 64])
def test_op1_odd_rows(pages, split):
    got = [tuple(r) for r in warc.archive_pages(pages, split=split).collect()]
    assert sorted(got, key=key) == sorted(want_pages([(r.page_id, r.html or "") for r in pages.collect()]), key=key)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_op1_reader_skips_damage_and_false_magic(tmp_path):
    good = [warc.record(i, f"http://x/{i}", bytes([i]) * 50, "d", None) for i in range(4)]
    path = tmp_path / "x.warc.gz"
    damaged = bytearray(good[1])
    damaged[12:20] = b"\xff" * 8
    path.write_bytes(good[0] + bytes(damaged) + b"\x1f\x8b\x08junk" + good[2] + good[3][:-5])
    found = [warc.parse(data)["record_id"] for _, data in warc.members(OldFile(f"file://{path}"), 0, path.stat().st_size)]
    assert found == ["urn:page:0", "urn:page:2"]


def test_op1_a_page_without_an_id_revisits_one_that_has_one(spark):
    html = "x" * 200
    pages = spark.createDataFrame([(None, "u", html), (5, "u", html), (6, "u", html), (None, "v", "y" * 200), (None, "w", "y" * 200), (7, "w", None)], "page_id long, url string, html string")
    rows = warc.archive_pages(pages).collect()
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in rows)
    assert found == [(0, 200, "response", 0), (0, 200, "response", 0), (0, 200, "revisit", 5), (5, 200, "response", 0), (6, 200, "revisit", 5), (7, 0, "response", 0)]
