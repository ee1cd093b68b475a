"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon is learned from labelled rows: words, and beginnings of words for
languages that inflect, that stand in toxic texts far more often than chance
allows. Near copies of a text count once. The terms form a trie; its product
with the terms' Levenshtein automata is made deterministic as texts ask for it,
so a word costs a few table steps, most words one or two before the automaton
dies. Words that labelled clean texts use are no misspellings.

Hits are weighed by their context: inside quotation marks, or a few words after
a word of saying or naming, a term counts as quotation and not as abuse. A
logistic model of both sums and of the density gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_key, without, worker_state
from .units import Cache

#: Labelled rows that the model is fitted on, taken by hash: at most this many.
FIT_ROWS = 8000
#: Letters of the shortest and longest beginning of a word that is a term.
SHORT, LONG = 4, 8
#: What a misspelled hit counts, words of context, and words that a word of saying reaches.
MISSPELLED, CONTEXT, SAYING = 0.45, 12, 4
END = "$"

# Words of saying and naming, and quotation marks, by language.
SAYINGS = set(
    """
    said says saying called calls word words term terms quote quoted quotes wrote writes slur insult
    sagte sagt nannte wort wörter begriff zitat schrieb beleidigung
    dit disait appelé mot mots terme citation écrit insulte
    dijo dice llamó palabra palabras término cita escribió insulto
    """.split()
)
OPENING, CLOSING, EITHER = "“„«‹‘", "”»›’", '"'
STRIP = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[^\W\d_]+")
HIT, NEAR, OPEN, CLOSE, SAID = 1, 2, 4, 8, 16


def allowed(term: str) -> int:
    """Edits that a term may have: whole words of 5 letters one, of 9 two; beginnings of 7 letters one."""
    n = len(term.rstrip(END))
    return (n >= 5) + (n >= 9) if term.endswith(END) else int(n >= 7)


class Automaton:
    """The product of the lexicon's trie with Levenshtein automata, made deterministic lazily."""

    def __init__(self, terms: list[str], most_states: int = 50_000):
        self.children: list[dict[str, int]] = [{}]
        self.whole, self.begin, self.most = {}, {}, [0]
        for term in terms:
            node, k = 0, allowed(term)
            self.most[0] = max(self.most[0], k)
            for letter in term.rstrip(END):
                node = self.children[node].setdefault(letter, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.most.append(0)
                self.most[node] = max(self.most[node], k)
            (self.whole if term.endswith(END) else self.begin)[node] = k
        self.most_states = most_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.ended: list[int] = []
        self.begun: list[int] = []
        self.start = self.state({0: 0})

    def state(self, places: dict[int, int]) -> int:
        """The number of a set of trie nodes with their least edits; -1 if it is empty."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            if e > places.get(node, 99):
                continue
            for child in self.children[node].values():  # a letter of the term is missing
                if e < self.most[child] and e + 1 < places.get(child, 99):
                    places[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(places.items()))
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.ended.append(min((e for n, e in key if n in self.whole and e <= self.whole[n]), default=-1))
            self.begun.append(min((e for n, e in key if n in self.begin and e <= self.begin[n]), default=-1))
        return self.ids[key]

    def step(self, state: int, letter: str) -> int:
        places: dict[int, int] = {}
        for node, e in self.states[state]:
            for sign, child in self.children[node].items():
                cost = e + (sign != letter)
                if cost <= self.most[child] and cost < places.get(child, 99):
                    places[child] = cost
            if e < self.most[node] and e + 1 < places.get(node, 99):  # a letter too many
                places[node] = e + 1
        found = self.steps[state][letter] = self.state(places)
        return found

    def match(self, word: str) -> int:
        """The least edits between the word and a term, or -1."""
        if len(self.states) > self.most_states:
            self.reset()
        at, best, steps = self.start, -1, self.steps
        for letter in word:
            after = steps[at].get(letter)
            at = self.step(at, letter) if after is None else after
            if at < 0:
                return best
            e = self.begun[at]
            if e >= 0 and (best < 0 or e < best):
                best = e
        e = self.ended[at]
        return e if e >= 0 and (best < 0 or e < best) else best


def word_of(part: str) -> str:
    return STRIP.sub("", part).lower()


class Scanner:
    """What the stretches between spaces of a text are: codes of HIT, NEAR, OPEN, CLOSE and SAID."""

    def __init__(self, terms: list[str], clean: list[str]):
        self.automaton, self.clean = Automaton(terms), set(clean)
        self.cache = Cache(lambda missing: list(map(self.code, missing)), most=32 << 20)

    def code(self, part: str) -> int:
        word = word_of(part)
        words = [word] if word.isalpha() else [word, *(w.lower() for w in INNER.findall(part))]
        best = -1
        for w in words:
            e = self.automaton.match(w) if w else -1
            if e > 0 and w in self.clean:
                e = -1
            if e >= 0 and (best < 0 or e < best):
                best = e
        code = (HIT if best == 0 else NEAR if best > 0 else 0) | SAID * (word in SAYINGS)
        if part[0] in OPENING + EITHER or (len(part) > 1 and part[0] in "([" and part[1] in OPENING + EITHER):
            code |= OPEN
        if any(sign in CLOSING + EITHER for sign in part[-3:].lstrip(OPENING)) and (len(part) > 1 or part in CLOSING):
            code |= CLOSE
        return code

    def codes(self, texts: list[list[str]]) -> dict[str, int]:
        return self.cache.get(set(chain.from_iterable(texts)))

    def features(self, parts: list[str], known: dict[str, int]) -> tuple[float, float, int]:
        """Sums of the hits that are abuse and that are quotation, and the number of words."""
        codes = bytes(map(known.__getitem__, parts))
        abuse = quoted = 0.0
        hits = np.flatnonzero(np.frombuffer(codes, np.uint8) & (HIT | NEAR)).tolist()
        for at in hits:
            weight = 1.0 if codes[at] & HIT else MISSPELLED
            low, high = max(0, at - CONTEXT), at + CONTEXT + 1
            opened = next((i for i in range(at, low - 1, -1) if codes[i] & (OPEN | CLOSE * (i < at))), None)
            inside = opened is not None and codes[opened] & OPEN > 0 and (opened == at or not codes[opened] & CLOSE)
            closed = inside and any(c & CLOSE for c in codes[at:high])
            if closed or any(c & SAID for c in codes[max(0, at - SAYING) : at]):
                quoted += weight
            else:
                abuse += weight
        return abuse, quoted, len(parts)

    def measure(self, texts: pa.Array) -> list[tuple[float, float, int]]:
        """features() of each text."""
        rows: list[tuple[float, float, int]] = []
        for a, b in slices(pa.compute.binary_length(texts).to_pylist()):
            parts = [t.split() for t in texts.slice(a, b - a).to_pylist()]
            known = self.codes(parts)
            rows += [self.features(p, known) for p in parts]
        return rows


def inputs(rows: np.ndarray) -> np.ndarray:
    """rows: abuse, quotation, words. The model's inputs."""
    abuse, quoted, words = rows.T
    return np.column_stack([np.ones(len(rows)), np.log1p(abuse), np.log1p(quoted), np.log1p(1000 * abuse / np.maximum(words, 20))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights by Newton's method; the ridge keeps them finite where classes are apart."""
    w = np.zeros(x.shape[1])
    hold = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def terms_of(parts: list[str]) -> list[str]:
    """The words of a text with an end sign, and the beginnings of its words."""
    words = {w for w in map(word_of, set(parts)) if w.isalpha() and len(w) >= SHORT}
    return [*(w + END for w in words), *{w[:n] for w in words for n in range(SHORT, min(LONG, len(w) - 1) + 1)}]


def sketch(parts: list[str]) -> int:
    """The least hash of the three-word sequences: near copies mostly have the same."""
    runs = {" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))}
    return min(int.from_bytes(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for r in runs)


def choose(found: list[tuple[str, int, int]], base: float, candidates: int) -> list[str]:
    """Of (term, toxic texts, clean texts) those beyond chance, and of nested ones the most telling."""
    hold = math.log(max(2, candidates)) + 3
    good: dict[str, int] = {}
    score: dict[str, float] = {}
    for term, toxic, clean in found:
        share = toxic / (toxic + clean)
        value = toxic * math.log(share / base) if share >= 0.8 and share > base else 0
        if value > hold:
            good[term], score[term] = toxic, value
    kept = {}
    for term in sorted(good, key=len, reverse=True):
        above = [term[:n] for n in range(SHORT, len(term)) if term[:n] in good]
        if any(good[a] >= 1.2 * good[term] for a in above):
            continue  # a beginning says more
        if any(k.startswith(term) and good[term] < 1.2 * good[k] for k in kept):
            continue  # as many texts have the longer term
        kept[term] = score[term]
    return sorted(kept)


def held_out(id_col: str):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[list[str], list[str], list[float]]:
    """Terms, clean words near terms, and weights, from at most fit_rows labelled rows that are not held out."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("y"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    # the sample is read several times; lost blocks are computed anew
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "_id").select("text", F.col("y").cast("int").alias("y")).persist()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [t.as_py().split() for t in batch.column(0)]
            keep = [i for i, p in enumerate(parts) if p]
            for at in range(0, len(keep), 100):
                some = keep[at : at + 100]
                yield pa.RecordBatch.from_arrays([pa.array([sketch(parts[i]) for i in some], pa.int64()), batch.column(1).take(pa.array(some, pa.int64())), pa.array([terms_of(parts[i]) for i in some], pa.list_(pa.string()))], ["sketch", "y", "terms"])

    counted = rows.mapInArrow(terms, "sketch long, y int, terms array<string>").select("sketch", "y", F.explode("terms").alias("term")).groupBy("term", "y", "sketch").agg(F.lit(1).alias("one"))
    counted = counted.groupBy("term").agg(F.count(F.when(F.col("y") == 1, 1)).alias("toxic"), F.count(F.when(F.col("y") == 0, 1)).alias("clean")).filter("toxic + clean >= 2").persist()
    totals = rows.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    base = max(totals["toxic"], 0.5) / max(totals["n"], 1)
    candidates = counted.filter("toxic + clean >= 3").count()
    # terms and words of the sample, so of fit_rows texts
    found = counted.filter("toxic >= 3 and toxic >= 4 * clean").collect()
    lexicon = choose([tuple(r) for r in found], base, candidates)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([automaton.match(t.rstrip(END)) > 0 for t in batch.column(0).to_pylist()], pa.bool_()))

    words = counted.filter("clean > 0 and 4 * clean > toxic").filter(F.col("term").endswith(END)).select("term")
    clean = [r[0].rstrip(END) for r in words.mapInArrow(near, "term string").collect()]
    clean.sort()
    # where rows repeat an id, fit_rows of them at most
    got = measured(rows.select(F.col("y").cast("long").alias("_id"), "text"), lexicon, clean).orderBy(F.xxhash64("abuse", "quoted", "n_words", "_id")).limit(fit_rows).collect()
    counted.unpersist(), rows.unpersist()
    if not got:
        return lexicon, clean, [-4.0, 0.0, 0.0, 0.0]
    table = np.array([[r["abuse"], r["quoted"], r["n_words"]] for r in got], float)
    return lexicon, clean, logistic(inputs(table), np.array([r["_id"] for r in got], float)).tolist()


def measured(texts: DataFrame, lexicon: list[str], clean: list[str]) -> DataFrame:
    """texts(_id, text) as _id, text_key, abuse, quoted, n_words."""
    shared = texts.sparkSession.sparkContext.broadcast((lexicon, clean))
    key = hashlib.sha256(repr((lexicon, clean)).encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_state(f"toxicity_{key}", lambda: Scanner(*shared.value))
        for batch in batches:
            rows = scanner.measure(batch.column(2))
            abuse, quoted, words = (list(c) for c in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(abuse, pa.float64()), pa.array(quoted, pa.float64()), pa.array(words, pa.int64())], ["_id", "text_key", "abuse", "quoted", "n_words"])

    return texts.select("_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(work, "_id long, text_key long, abuse double, quoted double, n_words long")


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """_id, text_key, abuse, quoted, score of each row of docs."""
    lexicon, clean, weights = fit(docs, labels, id_col, text_col, label_col, fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = measured(texts, lexicon, clean)
    x = [F.lit(1.0), F.log1p("abuse"), F.log1p("quoted"), F.log1p(1000 * F.col("abuse") / F.greatest(F.col("n_words"), F.lit(20)))]
    z = sum((F.lit(w) * c for w, c in zip(weights[1:], x[1:])), F.lit(weights[0]))
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, abuse, quoted.

    Only the text is an input of the score. Null counts as empty, and empty
    texts get the score of texts without a hit. Rows without an id are not held
    out and teach nothing; of several labels of a document the highest counts.
    Without labels the score is that of the prior weights. Repeated rows give
    repeated rows, an empty table an empty one. Texts are read whole. Other
    columns play no part, whatever their names.
    """
    rows = scored(docs, labels, id_col, text_col, label_col, fit_rows)
    return rows.select(F.col("_id").alias("doc_id"), F.coalesce(held_out("_id"), F.lit(False)).alias("held_out"), "score", "abuse", "quoted").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns. A row goes by its id and text: others of its id stay."""
    gone = scored(docs, labels, id_col, text_col, "toxic", FIT_ROWS).filter("score >= 0.5").select(F.col("_id").alias("_gone"), F.col("text_key").alias("_gone_text"))
    return without(docs, gone, {"_gone": docs[id_col], "_gone_text": text_key(docs[text_col])})
