"""Licenses, decontamination, toxicity and the pipeline."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from mapfold.llm import decontaminate, licenses, queries, toxicity


def key(row):
    return tuple((v is not None, v) for v in row)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_op9_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op9_license_notices(spark, sf_dir.replace("0.001", "0.01")).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert any(r.n_base for r in rows.values())


def test_op9_odd_rows(spark, odd, none):
    got = [tuple(r)[1:6] for r in licenses.scan_licenses(odd).collect()]
    assert sorted(got, key=key) == sorted((brute_base(r.text) for r in odd.collect()), key=key)
    assert licenses.scan_licenses(none).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("relased undr the MIT licence", "mit"),
        ("under the MIT-License; Apache License, Version 2.0", "apache-2,mit"),
        ("Apache Lisence Version 2", "apache-2"),
        ("Apache License Version 1", ""),
        ("under the BSD license", ""),
        ("CC-BY-NC and cc b nc", "cc-by-nc"),
        ("CC BY ND", ""),
        ("xcc by ncx", ""),
        ("apache license version2", "apache-2"),
        ("apache license version 22", ""),
        ("cc bync", "cc-by-nc"),
        ("under the mlt license", "mit"),
        ("under the MPL license", ""),
    ],
)
def test_op9_misspelled(text, labels):
    assert licenses.Finder(licenses.NOTICES).row(text)[5] == labels


def test_op9_finds_all_misspellings_within_the_bound():
    """Random edits against the edit distance: what keeps the telling word is found, and nothing beyond the bound."""
    import random

    rng, finder, found, missed = random.Random(4), licenses.Finder(licenses.NOTICES), 0, 0
    for phrase, label, sure, most in licenses.NOTICES:
        for _ in range(300):
            text = list(phrase)
            for _ in range(rng.randint(1, most + 2)):
                at = rng.randrange(len(text))
                text[at : at + rng.choice((0, 1, 1))] = rng.choice(("", "e", "x", "q"))
            text = "".join(text)
            distance = brute_distance(text, phrase)
            got = label in finder.row(f"word {text} word")[5].split(",")
            if got and text != phrase:
                # a match may take in a part of the words about it, within the bound
                assert min(brute_distance(x, phrase) for x in (text, f"word {text}", f"{text} word", text.strip())) <= most, text
            if 0 < distance <= most and f" {sure} " in f" {text} " and not text.startswith(" ") and not text.endswith(" "):
                found, missed = found + got, missed + (not got)
    assert found > 200 and missed == 0


ITEM = "If a train leaves Paris at 9 and runs 120 km per hour toward Berlin, how long until it meets the 85 km per hour train from Berlin to Paris tonight?"
CHANGED = "if a train leaves Madrid at 7 and runs 95 km per hour toward Lisbon, how long until it meets the 60 km per hour train from Lisbon to Madrid tonight?"
MIXED = CHANGED.replace("from Lisbon to Madrid", "from Rome to Oslo").replace("and runs 95", "and runs 7")


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 0])
def test_op5_planted(spark, most):
    docs = spark.createDataFrame([(1, "Some words first. " + ITEM + " And more."), (2, ITEM.upper()), (3, "intro here. " + CHANGED), (4, MIXED), (5, "A clean text about trains that leave Paris at 9 or so."), (6, None), (7, ""), (8, "one two"), (1, "same id")], "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (None, "an item that has no id at all")], "item_id long, text string")
    rows = decontaminate.decontamination(docs, items, most_windows=most).collect()
    assert len(rows) == 9
    found = {r.doc_id: (r.contaminated, list(r.item_ids), r.reparameterised) for r in rows}
    assert found[1] == (True, [10], False) and found[2] == (True, [10], False)
    assert found[3] == (True, [10], True)
    assert not any(found[i][0] for i in (4, 5, 6, 7, 8))
    assert not any(r.contaminated for r in decontaminate.decontamination(docs, items.limit(0)).collect())
    assert decontaminate.decontamination(docs.limit(0), items).collect() == []


def test_op5_each_copy_has_its_own_values(spark):
    """Copies with other values, a stray piece of a copy, and copies in texts of one id: each is judged on its own."""
    second = CHANGED.replace("Madrid", "Oslo").replace("Lisbon", "Rome").replace("at 7", "at 6").replace("95", "70").replace("60", "40")
    stray = "a train leaves Bonn at 5 and runs 3 km per hour toward Ulm"
    docs = [(1, f"{CHANGED} {second}"), (2, f"{second} Then {CHANGED}"), (3, f"So {stray}. {CHANGED}"), (4, CHANGED), (4, second), (5, f"{MIXED} {MIXED}"), (6, f"{stray} {stray}")]
    rows = decontaminate.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.contaminated, r.reparameterised) for r in rows} == {1: (True, True), 2: (True, True), 3: (True, True), 4: (True, True), 5: (False, False), 6: (False, False)}


def test_op5_short_sentences_and_loose_windows(spark):
    """Names that begin sentences, and windows of few literal words."""
    clips = "Natalia sold 48 clips in April. Mary then sold 24 clips in May. How many clips did they sell?"
    other = "Weng sold 30 clips in June. Tom then sold 15 clips in July. How many clips did they sell?"
    mixed = "Weng sold 30 clips in June. Tom then sold 30 tins in July. How many tins did they sell?"
    loose, again = "Tom gave Mary 3 kg and Ann 4 kg but Bob 5 kg", "Jim gave Sue 7 lb and Eva 8 lb but Max 9 lb"
    docs = [(1, other), (2, "So it goes. " + other), (3, mixed), (4, again), (5, again.replace("8 lb", "8 kg")), (6, clips), (7, "Weng sold 30 clips in June.")]
    items = spark.createDataFrame([(10, clips), (11, loose)], "item_id long, text string")
    rows = decontaminate.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {r.doc_id: (list(r.item_ids), r.reparameterised) for r in rows} == {1: ([10], True), 2: ([10], True), 3: ([], False), 4: ([11], True), 5: ([], False), 6: ([10], False), 7: ([], False)}


def test_op5_whole_table(spark, sf_dir):
    """Against the share of five-word windows, as they stand, by brute force."""
    sf_dir = sf_dir.replace("0.001", "0.01")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [[m.lower() for m in decontaminate.PIECE.findall(t or "")]] for i in range(len(w) - 4)}
    items = [(r.item_id, grams(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        have = grams(d.text)
        want[d.doc_id] = sorted(i for i, g in items if g and len(g & have) / len(g) >= 0.8)
    got = {r.doc_id: list(r.item_ids) for r in queries.op5_benchmark_templates(spark, sf_dir).collect()}
    assert got == want and any(want.values())


def test_op2_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op2_toxicity(spark, sf_dir).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert wins > 0.93
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.96


def test_drop_toxic_is_by_row(spark, sf_dir):
    """A clean text stays though a toxic one has its id; what goes is what the query predicts."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert toxic and {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == {r.doc_id for r in docs.collect()} - toxic
    twice = docs.unionByName(docs.filter(docs.doc_id.isin(list(toxic))).withColumn("text", toxicity.F.lit("A kind and clean text.")))
    assert toxicity.drop_toxic(twice, labels).filter("text = 'A kind and clean text.'").count() == len(toxic)


def test_op2_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 0, 1), (4, 1, 0), (5, None, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(none, labels).collect() == []
    assert len(toxicity.toxicity(odd, labels.limit(0)).collect()) == odd.count()


@pytest.mark.parametrize(("word", "edits"), [("idiot", 0), ("idoit", -1), ("idiiot", 1), ("idio", 1), ("adiot", 1), ("worthles", 1), ("wrothless", 2), ("scun", -1), ("scum", 0), ("clean", -1), ("loweischaft", 0), ("", -1)])
def test_automaton(word, edits):
    assert toxicity.Automaton(["idiot$", "worthless$", "scum$", "lowei"]).match(word) == edits


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_exact():
    import itertools

    terms = ["abcab", "bbbccc", "abcabcabc"]
    automaton = toxicity.Automaton([t + "$" for t in terms])
    words = ["".join(w) for n in (4, 5, 6) for w in itertools.product("abc", repeat=n)] + ["abcabcab", "abccabcc", "abcabcabcab", "cabcabcabc"]
    for w in words:
        near = [d for t in terms if (d := brute_distance(w, t)) <= toxicity.allowed(t + "$")]
        assert automaton.match(w) == min(near, default=-1), w


def test_quotation_is_not_abuse():
    scanner = toxicity.Scanner(["idiot$"], [])
    texts = ['They said "you idiot" to me', "you idiot go away", "the word idiot is Greek", "“an idiot” he wrote", 'he "left" and you idiot "stayed" there']
    parts = [t.split() for t in texts]
    known = scanner.codes(parts)
    got = [scanner.features(p, known)[:2] for p in parts]
    assert [g[0] > 0 for g in got] == [False, True, False, False, True]
    assert [g[1] > 0 for g in got] == [True, False, True, True, False]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, sf_dir).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    left = docs.filter(~docs.doc_id.isin(list(toxic)))
    # by brute force: equal texts, then linked fingerprints, then held items
    from .test_dedup import brute_components, want_copies

    kept = {d for d, keep, *_ in want_copies([(r.doc_id, r.text) for r in left.collect()]) if d == keep}
    apart = [(r.doc_id, r.text) for r in left.collect() if r.doc_id in kept]
    single = {d for d, _, c in brute_components(apart) if d == c}
    held = {r.doc_id for r in decontaminate.decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").collect()}
    assert set(rows) == single - held
    from .test_tokens import want_bpe

    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.values()} == set(want_bpe([(d, t) for d, t in apart if d in rows]))


def test_stages_keep_columns(spark, odd, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, sf_dir)
        assert kept.columns == odd.columns
        assert stage(spark, odd.limit(0), sf_dir).collect() == []
        kept.collect()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
