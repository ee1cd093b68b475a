"""Token files, token counts and byte-level BPE against the tokenizer libraries."""

import functools
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from mapfold.llm import bpe, queries, token_blocks, token_counts, units

WORDS, BYTES, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@functools.cache
def word_tokenizer():
    return Tokenizer.from_file(WORDS)


def word_ids(text):
    return [*word_tokenizer().encode(text, add_special_tokens=False).ids, 2]


def want_files(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = word_ids(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def test_op3_whole_table(spark, sf_dir):
    got = [tuple(r) for r in queries.op3_token_files(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want_files(texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def test_op3_odd_rows(odd, none):
    got = [tuple(r) for r in token_blocks.token_files(odd, WORDS).collect()]
    assert sorted(got, key=key) == sorted(want_files(texts(odd)), key=key)
    assert token_blocks.token_files(none, WORDS).collect() == []


@pytest.mark.parametrize("n", [1, 7, 4096, 4097, 12_000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint32)
    ids[:: max(1, n // 5)] = 4_000_000_000
    blocks = token_blocks.pack_blocks(ids)
    assert np.array_equal(np.concatenate([token_blocks.unpack_block(b, min(token_blocks.BLOCK, n - i * token_blocks.BLOCK)) for i, b in enumerate(blocks)]), ids)


def test_op3_reads_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_blocks, "SEGMENT", 50)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of text number ', id) AS text")
    files = token_blocks.write_id_files(docs, WORDS, 2)
    read = token_blocks.read_id_files(files)
    assert read.rdd.getNumPartitions() > 4
    assert sorted(tuple(r) for r in read.collect()) == want_files(texts(docs))


def test_op3_one_id_fills_several_files(spark):
    docs = spark.range(300).selectExpr("CASE WHEN id % 3 > 0 THEN 7 END AS doc_id", "concat(id, ' text') AS text")
    files = token_blocks.write_id_files(docs, WORDS, 2)
    assert files.count() > 2
    assert sorted(map(tuple, token_blocks.read_id_files(files).collect()), key=key) == sorted(want_files(texts(docs)), key=key)


def test_op3_one_id_and_beginning_fill_several_files(spark):
    docs = spark.range(300).selectExpr("7 AS doc_id", "concat(repeat('the same words ', 20), id) AS text")
    files = token_blocks.write_id_files(docs, WORDS, 2)
    assert files.count() > 2
    rows = token_blocks.read_id_files(files).collect()
    assert Counter(r.ids_crc32 for r in rows) == Counter(r[3] for r in want_files(texts(docs)))
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


@pytest.mark.parametrize("words", ["Word,\nWORD... ¡hola! été*** x'y it's 12a a1, --- ÅNGSTRÖM İx ǅ ﬁ", "a,b ,, . 'tis rock'n'roll don't!!! naïve\u0301 e\u0301 ª º"])
def test_stretches_are_encoded_as_the_whole(words):
    encoder = token_blocks.WordEncoder(WORDS)
    for text in (words, " ".join(f"{w}{s}" for w in words.split() for s in ("", ",", ".", "!?", "'"))):
        assert np.frombuffer(next(encoder.texts([text])), "<u4").tolist() == word_ids(text)[:-1]


def test_caches_are_bounded_by_bytes():
    cache = units.Cache(lambda missing: [b"x" * 10] * len(missing), len, most=20_000)
    for a in range(0, 3000, 50):
        wanted = {f"word{i}" for i in range(a, a + 50)} | {"y" * 5000}
        got = cache.get(wanted)
        assert all(got[w] == b"x" * 10 for w in wanted) and cache.held <= 20_000 and "y" * 5000 not in cache.known


def test_megabytes_without_a_space(spark):
    docs = spark.createDataFrame([(1, "日本語" * 100_000), (2, "ab1+/" * 60_000)], "doc_id long, text string")
    assert sorted(map(tuple, token_blocks.token_files(docs, WORDS).collect())) == want_files(texts(docs))
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTES).collect())) == want_counts(texts(docs))


def test_ids_come_back(odd):
    got = {r.doc_id: list(r.ids) for r in token_blocks.token_files(odd.filter("doc_id < 8"), WORDS, with_ids=True).collect()}
    assert got == {d: word_ids(t) for d, t in texts(odd) if d is not None and d < 8}


def want_counts(rows):
    tok = Tokenizer.from_file(BYTES)
    return [(d, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for d, t in rows]


def test_op6_whole_table(spark, sf_dir):
    got = [tuple(r) for r in queries.op6_token_counts(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want_counts(texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


@pytest.mark.parametrize("top", [token_counts.TOP, 2])
def test_op6_odd_rows(odd, none, top):
    got = [tuple(r) for r in token_counts.count_tokens(odd, BYTES, top=top).collect()]
    assert sorted(got, key=key) == sorted(want_counts(texts(odd)), key=key)
    assert token_counts.count_tokens(none, BYTES).collect() == []


def test_frequent_units_cover_all_documents(spark):
    docs = spark.createDataFrame([(f"first {'common ' * 5}word{i} seldom",) for i in range(400)], "text string").repartition(40)
    assert token_counts.unpack(token_counts.frequent_units(docs, top=2))[:2] == [("common", 2000), ("seldom", 400)]


def want_bpe(rows):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(d, len(ids := enc.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for d, t in rows]


def test_op8_whole_table(spark, sf_dir):
    got = [tuple(r) for r in queries.op8_byte_bpe(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want_bpe(texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def test_op8_odd_rows(odd, none):
    got = [tuple(r) for r in bpe.encode_texts(odd, RANKS, P.PATTERN).collect()]
    assert sorted(got, key=key) == sorted(want_bpe(texts(odd)), key=key)
    assert bpe.encode_texts(none, RANKS, P.PATTERN).collect() == []


def test_op8_decodes(odd):
    rows = bpe.decode_ids(bpe.encode_texts(odd.filter("doc_id < 8"), RANKS, P.PATTERN, with_ids=True), RANKS).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in rows} == {d: t for d, t in texts(odd) if d is not None and d < 8}


def test_tree_alone_and_together_agree():
    enc = bpe.load_encoder(RANKS, P.PATTERN)
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdehilnorst"), n)) for n in rng.integers(1, 200, 400)]
    data = [w.encode() for w in words]
    assert enc.encode_words(data) == [tik._encode_single_piece(w) if hasattr(tik, "_encode_single_piece") else tik.encode_ordinary(w) for w in words]
    assert [enc.alone(d) for d in data if d not in enc.ranks] == [tik.encode_ordinary(d.decode()) for d in data if d not in enc.ranks]
    assert enc.alone(b"ab" * 4000) == tik.encode_ordinary("ab" * 4000)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a  b", "a \n b", "a\n\n b ", "  lead", "x  \t y", "a b  "])
def test_units_rejoin(text):
    assert "".join(map(units.unit_text, units.units(text))) == text
