"""Source divergence, centroid clusters and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mapfold.llm import centroids, divergence, jaccard

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def want_divergence(rows, min_docs, top):
    counts, of_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
        counts[lang or "", source or ""].update(found)
        of_docs[lang or ""].update(set(found))
    out = []
    for lang, kept in of_docs.items():
        kept = [t for t, n in kept.items() if n >= min_docs]
        columns = {s: c for (x, s), c in counts.items() if x == lang}

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        shares = {s: share(c) for s, c in columns.items()}
        whole = share(sum(columns.values(), Counter()))
        for s, p in shares.items():
            pairs = [("pair", o, sum(abs(p[t] - q[t]) for t in kept)) for o, q in shares.items() if o != s]
            terms = [("term", t, p[t] - whole[t]) for t in kept if columns[s][t] and p[t] > whole[t]]
            for part in (pairs, terms):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i) for i, r in enumerate(part, 1) if r[0] == "pair" or i <= top]
    return out


def odd_sources():
    """Two languages and a null one, sources of many and of no terms, ties, repeated rows."""
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "abcdefghé" for b in "xyzÄ日"]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "S3", "", None, "é"]), " ".join(rng.choices(names, range(1, len(names) + 1), k=rng.randint(0, 60)))) for _ in range(300)]
    return [*rows, *rows[:40], ("xx", "only", "so few"), ("yy", "a", None), ("yy", "b", ""), ("en", "blank", " 12 \t"), ("de", "s2", "ax, AX-ax_ax1ax\x00ÄX " * 9000)]


@pytest.mark.parametrize("block, tile", [(divergence.BLOCK, divergence.TILE), (3, 2)])
def test_op11_odd_rows(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = odd_sources()
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "lang string, source string, text string, n long, term string, total int")
    got = [tuple(r) for r in divergence.source_divergence(docs, min_docs=4, top=7).collect()]
    assert sorted(got) == sorted(want_divergence(rows, 4, 7))
    assert {r[2] for r in got} == {"pair", "term"} and max(r[5] for r in got if r[2] == "term") == 7


def test_op11_empty_table(none):
    assert divergence.source_divergence(none).collect() == []


def test_op11_counts_are_the_same_when_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = odd_sources()
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.source_divergence(docs, 4, 7).collect())) == sorted(want_divergence(rows, 4, 7))


def test_op11_runs_meet_at_the_bounds_of_both():
    rng = np.random.default_rng(1)
    for _ in range(50):
        columns = rng.integers(0, 4, (3, 40)) * 10
        coded = [(s := divergence.runs(c), c[s]) for c in divergence.clustered(columns)]
        for i in range(3):
            assert divergence.divergence(coded[0], coded[i], 40) == np.abs(columns[0] - columns[i]).sum()
        assert sum(len(s) for s, _ in coded) < sum(len(divergence.runs(c)) for c in columns)


def test_op11_shares_are_exact_beyond_64_bits(spark):
    n = 2**62
    row = spark.range(1).select(divergence.share(*(divergence.F.lit(v) for v in (n, 2**62 + 12345, 7))).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (2**62 + 12345 + 35)


def want_clusters(rows, dims, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < centroids.LIMIT for x in v):
            kept.append((i, [int(np.floor(64.0 * x)) for x in v]))
    c = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, u)), j) for j, u in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, m) in zip(kept, found) if m == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    sums = Counter()
    for d, j in found:
        sums[j] += d
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)]


def odd_vectors(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dims) + 3 * (i % 5)).tolist()) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + n // 3)]  # a third of all rows is one vector
    nan, inf = float("nan"), float("inf")
    return rows + [(None, rows[1][1]), (7, rows[2][1]), (7, rows[2][1]), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1)), (904, [None] + [1.0] * (dims - 1)), (905, [nan] * dims), (906, [inf] * dims), (907, [1e30] * dims), (908, [0.0] * dims), (909, [-1048575.0] * dims)]


@pytest.mark.parametrize("n, k", [(120, 16), (120, 3), (5, 16)])
def test_op12_odd_rows(spark, n, k):
    rows = odd_vectors(n, 12)
    table = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, x long, cluster int, rest double")
    got = [tuple(r) for r in centroids.cluster_vectors(table, dims=12, clusters=k, leading=3).collect()]
    key = lambda t: tuple((v is not None, v) for v in t)
    assert sorted(got, key=key) == sorted(want_clusters(rows, 12, k, 3), key=key)
    assert centroids.cluster_vectors(table.limit(0), dims=12).collect() == []


def test_op12_the_rotation_changes_work_alone(spark):
    rows = odd_vectors(60, 8)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(str, centroids.cluster_vectors(table, dims=8, leading=m, fit_rows=f).collect())) for m, f in ((1, 10), (8, 8192), (4, 0))]
    assert found[0] == found[1] == found[2]


def test_op12_few_centroids_are_verified():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(16, 64)) * np.geomspace(8, 0.2, 64)
    x = np.floor(64 * (middles[np.arange(2000) % 16] + 0.3 * rng.normal(size=(2000, 64)))).astype(np.int64)
    rotation = centroids.Rotation(x.astype(float), 8)
    c = x[:16]
    cluster, distance, looked = centroids.nearest(x, *rotation.stored(x.astype(float)), c, *rotation.stored(c.astype(float)))
    every = ((x[:, None] - c) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert looked < every.size / 4


def want_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def classes(docs, **options):
    return sorted(map(tuple, jaccard.jaccard_classes(docs, **options).collect()), key=lambda t: tuple((v is not None, v) for v in t))


def sorted_classes(rows):
    return sorted(want_classes(rows), key=lambda t: tuple((v is not None, v) for v in t))


def test_op13_odd_rows(odd, none):
    assert classes(odd) == sorted_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard.jaccard_classes(none).collect() == []


def families(seed, n, lengths, edits):
    """Texts and copies of them with some words changed, a third of them of one text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    starts = [[word() for _ in range(rng.randint(*lengths))] for _ in range(max(2, n // 8))]
    rows = []
    for i in range(n):
        words = list(starts[0] if i % 3 == 0 else rng.choice(starts))
        for _ in range(rng.randint(0, edits)):
            place = rng.randrange(len(words))
            words[place : place + 1] = rng.choice([[word()], [], [words[place], word()]]) if len(words) > 1 else [word()]
        rows.append((i * 7 % 1000, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, lengths, edits, part", [(1, (1, 12), 1, 1024), (2, (15, 60), 3, 1024), (3, (40, 200), 8, 1024), (4, (60, 90), 5, 4), (5, (400, 900), 20, 1024)])
def test_op13_links_of_families(spark, monkeypatch, seed, lengths, edits, part):
    """All links of near copies at and around the bound; small parts cut buckets into several groups."""
    rows = families(seed, 240, lengths, edits)
    monkeypatch.setattr(jaccard, "DELEGATES", 3)
    whole = jaccard.set_links
    monkeypatch.setattr(jaccard, "set_links", lambda texts, heads, words: whole(texts, heads, words, part))
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == sorted_classes(rows)


def test_op13_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    checked = 0
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(12):
            pool = rng.choice(1 << 62, 2 * size + 4, replace=False).astype(np.uint64) << np.uint64(2)
            a, drop, more = pool[:size], rng.integers(0, size // 8 + 1), rng.integers(0, size // 8 + 1)
            b = np.append(a[drop:], pool[size : size + more])
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                found, owners = jaccard.signatures([np.sort(a), np.sort(b)])
                assert set(found[owners == 0]) & set(found[owners == 1])
                checked += 1
    assert checked > 300


def test_op13_sketches_bound_differences():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (20, 100, 300, 9000)]
    words = jaccard.folded([jaccard.sketch(s) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(words[i] ^ words[j]).sum() <= len(np.setxor1d(a, b))


def test_op13_bands_hold_every_linked_pair_of_sizes():
    found = jaccard.bands(3000)
    for r in range(1, 2500):
        for s in range(r, 100 * r // 85 + 1):
            assert any(low <= r and s <= high for low, high in found)
