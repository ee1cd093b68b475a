import pytest

LONG = "word " * 30_000

#: Null, empty, blank, long, repeated, accented and punctuated texts; columns with clashing names.
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, LONG),
    (5, "The quick  brown fox jumps over\nthe lazy dog near the river bank today."),
    (6, "ÄÖÜ ß İstanbul naïve café ΣΑΣ 日本語 😀 don't e.g., 3.5km <|endoftext|> x"),
    (7, "J̌ combining, marks.  nbsp  em a\x1cb"),
    (8, "a b c"),
    (8, "a b c"),
    (9, "A B C"),
    (None, "no id at all, but text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "en", "s", i, "k", 1, 2, 3, "b", "c") for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, shard int, hash long, fp long, cell string, place string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


