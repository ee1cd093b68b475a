"""Benchmark items in documents, re-parameterised ones too.

Texts become word sequences in which numbers, names (capitalised words inside a
sentence) and units (after a number) have typed placeholders. Windows of WORDS
words are hashed as they stand, with placeholders, and where a sentence begins
with a capitalised word also with that word as a name; documents' windows are hash-joined with the items'. What the placeholders stand for must
be consistent: within an occurrence of an item, one value of the item stands for
one value in the document. A document is contaminated by an item if an
occurrence, with the windows that the document has as they stand, holds at least
SHARE of the item's windows.

A first join counts the windows of an item that a document has at all, without
the loose ones of few literal words, which many texts have; only pairs that
could reach SHARE with those are matched again, with all windows and values, and
judged. Items that could reach it by loose windows alone have all theirs in the
first join.

Before the join, documents' windows are tested against a bit table of the
items' hashes; it has a fixed size and is broadcast. It is left out if the items
have more than MOST_WINDOWS windows, as then it would let most windows pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, slices, without, worker_state, written
from .units import Cache

WORDS, SHARE = 5, 0.8
#: Windows with fewer words that are no placeholders are loose.
LITERAL = 3
#: Places of an occurrence may be shifted against the item's by this much from one to the next.
SHIFT = WORDS - 1
MOST_WINDOWS, TABLE_BITS = 1 << 21, 24
NUMBER, NAME, UNIT = 1, 2, 3
#: Forms of a window: as it stands, with placeholders, and with the first words of sentences as names too.
LITERALLY, TYPED, FIRSTS = 0, 1, 2

# Units of measure, as they are written after a number.
UNITS = """
mm cm m km in inch inches ft feet yd yards mile miles mg g kg lb lbs oz t ton tons tonne tonnes ml cl l liter liters
litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months
year years percent usd eur gbp dollar dollars euro euros pound pounds cent cents degree degrees celsius fahrenheit
w kw kwh v volt volts watt watts hz khz mhz ghz kb mb gb tb byte bytes mph kmh kph
""".split()

PIECE = regex.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
TITLE, ENDS, DIGITS, MEASURE = 1, 2, 4, 8
MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WORDS)]


def hash64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ (hashes >> np.uint64(32))
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


class Canon:
    """Words of texts as rows of numbers: hash, flags. Stretches between spaces are remembered."""

    def __init__(self):
        self.units, self.cache = set(UNITS), Cache(lambda missing: list(map(self.stretch, missing)), len, 48 << 20)
        self.holders = np.array([0, *(hash64(b"\0<%d>" % k) for k in (NUMBER, NAME, UNIT))], np.uint64)

    def word(self, word: str) -> tuple[int, int]:
        low = word.lower()
        flags = DIGITS if word[0].isdigit() else TITLE * (word[0].isupper() and word[1:] == low[1:]) | MEASURE * (low in self.units)
        return hash64(low.encode()), flags

    def stretch(self, text: str) -> bytes:
        if text.isalpha():
            return struct.pack("=QQ", *self.word(text))
        if text[-1] in ".,!?:;" and text[:-1].isalpha():
            found, flags = self.word(text[:-1])
            return struct.pack("=QQ", found, flags | ENDS * (text[-1] in ".!?:"))
        out, found = [], list(PIECE.finditer(text))
        for m in found:
            word, flags = self.word(m[0])
            out.append(struct.pack("=QQ", word, flags | ENDS * (m is found[-1] and any(c in ".!?:" for c in text[m.end() :]))))
        return b"".join(out)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of words of each text, and for all words the hash and the kind of placeholder, or 0, in the forms TYPED and FIRSTS."""
        parts = [t.split() for t in texts]
        known = self.cache.get(set(chain.from_iterable(parts)))
        data = [b"".join(map(known.__getitem__, p)) for p in parts]
        counts = np.array([len(x) // 16 for x in data], np.int64)
        rows = np.frombuffer(b"".join(data), np.uint64).reshape(-1, 2)
        flags = rows[:, 1].astype(np.uint8)
        before = np.empty_like(flags)
        before[1:] = flags[:-1]
        firsts = np.cumsum(counts) - counts
        before[firsts[counts > 0]] = ENDS
        kind = np.zeros(len(flags), np.int8)
        kind[(flags & TITLE > 0) & (before & ENDS == 0)] = NAME
        kind[(flags & MEASURE > 0) & (before & DIGITS > 0)] = UNIT
        kind[flags & DIGITS > 0] = NUMBER
        return counts, rows[:, 0], kind, np.where((kind == 0) & (flags & TITLE > 0), np.int8(NAME), kind)

    def windows(self, texts: list[str], least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, place, hash and form of all windows of all texts, with `least` literal words at least."""
        counts, words, *kinds = self.words(texts)
        n = max(0, len(words) - WORDS + 1)
        of_text = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        place = np.arange(len(words), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
        inside = np.flatnonzero(of_text[:n] == of_text[WORDS - 1 :]) if n else np.empty(0, np.int64)
        literal = np.zeros(n, np.uint64)
        for k, multiplier in enumerate(MULTIPLIERS):
            literal += words[k : n + k] * np.uint64(multiplier)
        where, hashes, before = [inside], [literal[inside]], np.zeros(n, np.int64)
        for kind in kinds:
            sums = np.append(0, np.cumsum(kind > 0))
            slots = sums[WORDS : n + WORDS] - sums[:n]
            typed = inside[(slots[inside] > before[inside]) & (WORDS - slots[inside] >= least)]
            template = np.ones(len(typed), np.uint64)
            for k, multiplier in enumerate(MULTIPLIERS):
                at = typed + k
                template += np.where(kind[at] > 0, self.holders[kind[at]], words[at]) * np.uint64(multiplier)
            before = slots
            where.append(typed)
            hashes.append(template)
        form = np.repeat(np.array([LITERALLY, TYPED, FIRSTS], np.int8), [len(w) for w in where])
        all_of = np.concatenate(where)
        return of_text[all_of], place[all_of], mixed(np.concatenate(hashes)), form

    def slots(self, text: str, places: list[int], forms: list[int]) -> list[list[str]]:
        """What the placeholders of the windows at these places stand for, with their kinds."""
        words = [m.lower() for m in PIECE.findall(" ".join(text.split()))]
        kinds = [None, *(k.tolist() for k in self.words([text])[2:])]
        return [[f"{kinds[form][i]}:{words[i]}" for i in range(at, at + WORDS) if kinds[form][i]] for at, form in zip(places, forms)]


#: part tells texts of one id apart.
WINDOWS = "id long, part long, place int, hash long, form byte, slots array<string>"


def text_windows(texts: DataFrame, id_col: str, text_col: str, table=None, values: bool = True, least: int = 0) -> DataFrame:
    """WINDOWS of all texts; with a broadcast bit table, only of those that may be in it; without values, slots are empty. Those with placeholders have `least` literal words at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = worker_state("decontaminate", Canon)
        bits = table.value if table is not None else None
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            ids, found = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in found]):
                of_text, places, hashes, form = canon.windows(found[a:b], least)
                if bits is not None:
                    near = np.flatnonzero(bits[hashes >> np.uint64(64 - TABLE_BITS)])
                    of_text, places, hashes, form = of_text[near], places[near], hashes[near], form[near]
                slots: list[list[str]] = [[] for _ in places]
                for t in np.unique(of_text[form > 0]).tolist() if values else ():
                    mine = np.flatnonzero((form > 0) & (of_text == t))
                    for at, stand in zip(mine.tolist(), canon.slots(found[a + t], places[mine].tolist(), form[mine].tolist())):
                        slots[at] = stand
                parts = {t: hash64(found[a + t].encode("utf-8", "surrogatepass")) - (1 << 63) for t in set(of_text.tolist())}
                columns[0] += [ids[a + t] for t in of_text.tolist()]
                columns[1] += [parts[t] for t in of_text.tolist()]
                columns[2] += places.tolist()
                columns[3] += hashes.view(np.int64).tolist()
                columns[4] += form.tolist()
                columns[5] += slots
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int8(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "part", "place", "hash", "form", "slots"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, WINDOWS)


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, containment, reparameterised.

    containment is the share of the item's windows that the document holds;
    reparameterised is true if some of them are there with other values only.
    """
    spark = docs.sparkSession
    ours = written(text_windows(items, item_col, item_text_col).drop("part").filter("id is not null").distinct(), "benchmark-windows")
    ours = ours.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "hash", (F.col("form") > 0).alias("typed"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots"))
    ours = ours.withColumn("loose", F.col("typed") & (WORDS - F.size("item_slots") < LITERAL))
    places = ours.groupBy("item_id", "item_place").agg(F.max("loose").alias("late"))
    totals = places.groupBy("item_id").agg(F.count("*").alias("total"), F.count_if("late").alias("n_late"))
    totals = totals.withColumn("all_first", F.col("n_late") / F.col("total") >= share)
    # places whose loose windows aren't in the first join
    late = F.col("late") & ~F.col("all_first")
    early = ours.join(places, ["item_id", "item_place"]).join(totals, "item_id").filter(~F.col("loose") | F.col("all_first"))
    early = written(early.select("item_id", "item_place", "hash", "typed", "loose", late.alias("late")), "benchmark-first")
    n, tables = ours.count(), [None, None]
    if n <= most_windows:
        for k, df in enumerate((early, ours)):
            bits = np.zeros(1 << TABLE_BITS, bool)
            rows = df.select("hash").toArrow()["hash"].to_numpy()  # most_windows numbers at most
            bits[rows.view(np.uint64) >> np.uint64(64 - TABLE_BITS)] = True
            tables[k] = spark.sparkContext.broadcast(bits)
    small = F.broadcast if n <= 1 << 16 else lambda df: df  # 65536 rows at most
    # one row for each document and window of an item, however often the document repeats it
    theirs = text_windows(docs, id_col, text_col, tables[0], False, LITERAL if early.filter("loose").isEmpty() else 0)
    theirs = theirs.filter("id is not null").select(F.col("id").alias("doc_id"), "hash", (F.col("form") > 0).alias("typed"))
    hits = theirs.join(small(early.drop("loose")), ["hash", "typed"]).select("doc_id", "item_id", "item_place", "late").distinct()
    hopes = hits.groupBy("doc_id", "item_id").agg(F.count_if(~F.col("late")).alias("hits")).join(totals, "item_id")
    most = F.col("hits") + F.when(F.col("all_first"), 0).otherwise(F.col("n_late"))
    hopes = written(hopes.filter(most / F.col("total") >= share).select("doc_id", "item_id", "total"), "benchmark-hopes")
    ids = hopes.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    theirs = text_windows(texts, "id", "text", tables[1]).withColumnRenamed("id", "doc_id").withColumn("typed", F.col("form") > 0).join(hopes.drop("total"), "doc_id")
    values = F.when(F.col("typed"), F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))))
    met = theirs.join(small(ours), ["item_id", "hash", "typed"]).select("doc_id", "item_id", "item_place", "part", (F.col("place") - F.col("item_place")).alias("shift"), "typed", (F.col("loose") | (F.col("form") == FIRSTS) | (F.col("item_form") == FIRSTS)).alias("wide"), values.alias("slots"))
    held = held_windows(written(met.distinct(), "benchmark-matches"))
    found = hopes.join(held, ["doc_id", "item_id"]).withColumn("containment", (F.col("as_they_stand") + F.col("changed")) / F.col("total"))
    return found.filter(F.col("containment") >= share).select("doc_id", "item_id", "containment", (F.col("changed") > 0).alias("reparameterised"))


def held_windows(met: DataFrame) -> DataFrame:
    """doc_id, item_id, as_they_stand, changed: windows of an item that a document has as they stand, and the most others that one occurrence has.

    Occurrences are the matches of equal shift in a text, and those of shifts that
    follow each other by SHIFT at most. All matches of the document are taken
    for one too, for copies that are in pieces. Values that stand for
    several values in an occurrence: their windows don't count in it. Each is
    judged without the wide windows, those that are loose or take the first
    words of sentences as names, and with them.
    """
    pair = ["doc_id", "item_id"]
    as_is = met.filter("not typed").select(*pair, "item_place").distinct()
    typed = met.filter("typed").join(as_is, [*pair, "item_place"], "left_anti")
    typed = typed.filter("not wide").unionByName(typed.withColumn("wide", F.lit(True)))
    text = Window.partitionBy(*pair, "wide", "part").orderBy("shift")
    typed = typed.withColumn("new", (F.col("shift") - F.lag("shift").over(text) > SHIFT).cast("int")).withColumn("chain", F.coalesce(F.sum("new").over(text), F.lit(0)))
    typed = typed.withColumn("n", F.count("*").over(Window.partitionBy(*pair, "wide", "part", "shift")))
    named = lambda kind, part, at: F.struct("wide", F.lit(kind).alias("kind"), part.cast("long").alias("part"), at.cast("long").alias("at"))
    kinds = F.array(named("shift", F.col("part"), F.col("shift")), named("chain", F.col("part"), F.col("chain")), named("whole", F.lit(0), F.lit(0)), named("least", F.lit(0), F.lit(0)))
    # of several matches of a window, that of the shift with the most matches counts
    first = F.max(F.struct("n", (-F.size("slots")).alias("few"), "shift", "part", "slots"))["slots"]
    dealt = typed.withColumn("place", F.explode(kinds)).groupBy(*pair, "place", "item_place").agg(first.alias("first"), F.min("slots").alias("least"))
    dealt = dealt.select(*pair, "place", "item_place", F.when(F.col("place.kind") == "least", F.col("least")).otherwise(F.col("first")).alias("slots"))
    stands = dealt.select(*pair, "place", F.explode("slots").alias("slot")).groupBy(*pair, "place", "slot.item").agg(F.countDistinct("slot.doc").alias("n"))
    broken = stands.filter("n > 1").groupBy(*pair, "place").agg(F.collect_set("item").alias("values"))
    kept = dealt.join(broken, [*pair, "place"], "left").filter(F.col("values").isNull() | ~F.exists("slots", lambda s: F.array_contains("values", s["item"])))
    changed = kept.groupBy(*pair, "place").agg(F.count("*").alias("n")).groupBy(*pair).agg(F.max("n").alias("changed"))
    stand = as_is.groupBy(*pair).agg(F.count("*").alias("as_they_stand"))
    return stand.join(changed, pair, "full").select(*pair, F.coalesce("as_they_stand", F.lit(0)).alias("as_they_stand"), F.coalesce("changed", F.lit(0)).alias("changed"))


def decontamination(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, item_ids (ascending), containment (the largest, or 0), reparameterised.

    Null and short texts, of fewer than WORDS words, hold no window and are
    clean; items as short are never found; items without an id are left out.
    Rows that repeat a document's id are judged together. Empty tables: no
    documents, no rows; no items, all clean. Texts are read whole. Other columns
    play no part, whatever their names.
    """
    found = contamination(docs, items, share, id_col, text_col, item_col, item_text_col, most_windows)
    # an item is in the list once, so the list is no longer than the benchmark
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("containment").alias("containment"), F.max("reparameterised").alias("reparameterised"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(by_doc, "doc_id", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows of one id are judged together, those without one stay."""
    gone = contamination(docs, items, share, id_col, text_col).select(F.col("doc_id").alias("_gone"))
    return without(docs, gone, {"_gone": docs[id_col]})
