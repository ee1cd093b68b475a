"""License notices in texts: exact phrases, and misspelled ones with bounded edits.

The fuzzy search is for short notices. A phrase that may have k edits is split
into k + 1 pieces; whatever text matches it has one piece unchanged, so the
pieces, searched as plain strings, locate every candidate. The regex library
then matches the phrase with at most k edits in a window about each candidate
and gives the span and the number of edits. One word of each phrase tells it
from sister licenses (the 2 of a version, the nc of its terms): the span must
hold it, with one edit if it is long enough, and no word of a sister in its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import worker_state

# Phrase, label, word that tells it from its sisters, edits that are allowed.
NOTICES = [
    ("under the mit license", "mit", "mit", 2),
    ("apache license version 2", "apache-2", "2", 2),
    ("cc by nc", "cc-by-nc", "nc", 1),
]

# Words that stand in that word's place in the notices of sister licenses.
SISTERS = set("bsd gpl lgpl agpl mpl epl isc cc0 ms nd sa".split())

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"

#: ASCII bytes that are not of [0-9a-z] part words; capitals become small.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase in edits + 1 pieces of about equal length, with their offsets."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def telling(sure: str):
    """A test of a span: whether it holds the word, and no other of its kind."""
    near = regex.compile(rf"(?:{regex.escape(sure)}){{e<={int(len(sure) > 2)}}}")

    def test(span: str) -> bool:
        words = span.split()
        if any(w in SISTERS or (sure.isdigit() and w.isdigit() and w != sure) for w in words):
            return False
        return near.search(span) is not None

    return test


class Finder:
    def __init__(self, notices: list[tuple[str, str, str, int]]):
        self.base = [(f" {p} ", len(p), label) for p, label, _, _ in notices]
        self.fuzzy = [
            (p, label, k, pieces(p, k), regex.compile(rf"(?e)(?<= )(?:{regex.escape(p)}){{e<={k}}}(?= )"), telling(sure))
            for p, label, sure, k in notices
        ]

    def words(self, text: str) -> tuple[str, int]:
        """The words of text, a space before, between and after them, and their number."""
        found = text.encode("utf-8", "replace").translate(WORD_BYTES).split()
        return " " + (b" ".join(found) + b" " if found else b"").decode("utf-8"), len(found)

    def exact(self, joined: str) -> list[tuple[int, str]]:
        """(offset, label) of all places, overlapping ones too."""
        out = []
        for phrase, _, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = joined.find(phrase, at + 1)
        return out

    def near(self, joined: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the misspelled places."""
        out = set()
        for phrase, label, k, seeds, pattern, tells in self.fuzzy:
            starts = set()
            for offset, seed in seeds:
                at = joined.find(seed)
                while at >= 0:
                    starts.add(at - offset)
                    at = joined.find(seed, at + 1)
            for start in sorted(starts):
                # words before and after, so that the match begins and ends at words
                low = joined.rfind(" ", 0, max(1, start - k))
                high = joined.find(" ", start + len(phrase) + k)
                window = joined[max(low, 0) : high + 1 if high >= 0 else len(joined)]
                for m in pattern.finditer(window, overlapped=True):
                    edits = sum(m.fuzzy_counts)
                    if edits and tells(m[0]):
                        out.add((max(low, 0) + m.start(), max(low, 0) + m.end(), label, edits))
        best: dict[tuple[str, int], tuple[int, int, str, int]] = {}
        for hit in sorted(out):
            at = (hit[2], hit[0])
            if at not in best or (hit[3], hit[1]) < (best[at][3], best[at][1]):
                best[at] = hit
        return sorted(best.values())

    def row(self, text: str | None) -> tuple:
        joined, n_words = self.words(text or "")
        exact = self.exact(joined)
        near = self.near(joined)
        word = lambda at: joined.count(" ", 0, at + 1) - 1
        spans = [(label, word(at), word(at) + {x[2]: x[0].count(" ") - 1 for x in self.base}[label] - 1, 0) for at, label in exact]
        spans += [(label, word(a - 1), word(b) - 1, edits) for a, b, label, edits in near if (label, a - 1) not in {(x, y) for y, x in exact}]
        firsts = [s[1] for s in spans[: len(exact)]]
        base_labels = sorted({label for _, label in exact})
        lengths = {label: n for _, n, label in self.base}
        score = max((1 - edits / lengths[label] for label, _, _, edits in spans), default=0.0)
        return n_words, len(exact), min(firsts, default=None), max(firsts, default=None), ",".join(base_labels), ",".join(sorted({s[0] for s in spans})), score, [dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in sorted(spans, key=lambda s: (s[1], s))]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str, str, int]] = NOTICES) -> DataFrame:
    """One row for each row of docs: SCHEMA.

    n_base, first_word, last_word and base_labels are of the exact places,
    labels and spans of the misspelled ones too; score is 1 for an exact place,
    1 - edits / length for the best misspelled one, 0 without any. Null counts
    as empty. Repeated rows give repeated rows, an empty table an empty one.
    Texts are read whole. Other columns play no part, whatever their names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_state(f"licenses_{hash(tuple(notices))}", lambda: Finder(notices))
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [finder.row(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
