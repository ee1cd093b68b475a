"""How far the sources of a language diverge, by run-length columns.

The kept terms of a language are cut into blocks of terms with totals of the
same size. In each block the terms are put in an order that brings equal counts
together, and each source's column is run-length encoded. The divergence of two
sources is the sum over the pieces between the run boundaries of both: the
difference of the two values, times the length of the piece. Blocks are groups
of their own, so a vocabulary of any size is many tasks, and the sums of blocks
are combined before they are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a block on average, and sources whose columns meet in one group.
BLOCK, TILE = 256, 64
#: Different terms that a task counts before it passes them on.
HELD = 1 << 18
#: Letters become lower case, other ASCII becomes blank, and what is not ASCII stays.
LETTERS = bytes(b if b > 127 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and of what is not ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs of docs (lang, source, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in held.items():
                found = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), found]
                columns += [pa.array(n.values(), pa.int64()), pa.array(map(n_docs.__getitem__, n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = terms(text.as_py())
                n, n_docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                n_docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from passed()
        yield from passed()

    rows = docs.mapInArrow(work, "lang string, source string, term string, n long, n_docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * vocabulary)), exact; null without a vocabulary."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    of = F.when(vocabulary > 0, total + SMOOTHING * vocabulary)
    return F.call_function("div", whole, of.cast("decimal(20,0)")) + 1


def runs(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1)


def clustered(columns: np.ndarray) -> np.ndarray:
    """The columns (a row each) with their terms reordered so that equal values meet: sorted by the column of fewest values first."""
    values = [len(np.unique(c)) for c in columns]
    return columns[:, np.lexsort(columns[np.argsort(values, kind="stable")[::-1]])]


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> int:
    """The sum of differences of two run-length columns (where runs begin, their values) of n terms."""
    bounds = np.union1d(a[0], b[0])
    here, there = (values[np.searchsorted(starts, bounds, "right") - 1] for starts, values in (a, b))
    return int((np.abs(here - there) * np.diff(np.append(bounds, n))).sum())


def block_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """a, b, value of the pairs of sources in a block.

    A source has a row with a null term, whose p holds for terms that it lacks
    and which tells the block's terms, and a row for each term that it has. In
    groups of two tiles only pairs across them are wanted.
    """
    lang, low, high = key[0].as_py(), key[3].as_py(), key[4].as_py()
    number, p = table.column("number").to_numpy(), table.column("p").to_numpy(zero_copy_only=False)
    coded = table.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    mark = code < 0
    sources, at = np.unique(number[mark], return_index=True)
    n = int(table.column("n_terms").filter(pa.array(mark))[0].as_py())
    value = np.zeros(0, np.int64)
    pairs = [(i, j) for i, j in combinations(range(len(sources)), 2) if low == high or (sources[i] // TILE == low) != (sources[j] // TILE == low)]
    if n:
        absent = p[mark][at].astype(np.int64)
        # what no source here has is one more column of lacking terms, as long as need be
        known = len(coded.dictionary)
        columns = np.repeat(absent[:, None], known + (known < n), 1)
        columns[np.searchsorted(sources, number[~mark]), code[~mark]] = p[~mark]
        columns = np.concatenate([clustered(columns[:, :known]), columns[:, known:]], axis=1)
        starts = [runs(c) for c in columns]
        encoded = [(s, c[s]) for s, c in zip(starts, columns)]
        value = np.array([divergence(encoded[i], encoded[j], n) for i, j in pairs], np.int64)
    else:
        value = np.zeros(len(pairs), np.int64)
    firsts, seconds = (pa.array([int(sources[pair[k]]) for pair in pairs], pa.int64()) for k in (0, 1))
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "a": firsts, "b": seconds, "value": pa.array(value, pa.int64())})


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value of all pairs of a language's sources, by their numbers, a < b."""
    # terms of the same number of bits in their total are spread over blocks
    kept = kept.withColumn("bits", F.length(F.bin("total")))
    sizes = kept.filter("first").groupBy("lang", "bits").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("pieces"))
    placed = kept.join(sizes, ["lang", "bits"]).withColumn("piece", F.pmod(F.xxhash64("term"), "pieces"))
    blocks = placed.filter("first").groupBy("lang", "bits", "piece").agg(F.count("*").alias("n_terms"))
    # languages without kept terms have a block of none
    blocks = blocks.union(groups.select("lang", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")).distinct())
    columns = ["lang", "bits", "piece", "number", "tiles"]
    marks = groups.join(blocks, "lang").select(*columns, F.lit(None).cast("string").alias("term"), F.col("p_none").alias("p"), "n_terms")
    there = placed.join(groups, ["lang", "source"]).select(*columns, "term", share(F.col("n"), F.col("n_all"), F.col("vocabulary")).alias("p"), F.lit(None).cast("long").alias("n_terms"))
    rows = marks.union(there).withColumn("tile", F.expr(f"number div {TILE}")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "bits", "piece", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "number", "term", "p", "n_terms")
    found = rows.groupBy("lang", "bits", "piece", "low", "high").applyInArrow(block_pairs, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame) -> DataFrame:
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(place))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) group of docs.

    Part `pair` has a row for each other source of the language, with the summed
    differences of the shares of all kept terms (0 if none is kept). Part `term`
    has the `top` terms that the source has and whose share exceeds the
    language's most. Kept are the terms in at least min_docs rows of the
    language. Null texts, languages and sources are empty; a language of one
    source has no pair, a group without terms has pairs alone. Repeated rows
    count each. An empty table gives an empty table. Other columns play no part,
    whatever their names. Texts are counted whole.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    of_term = Window.partitionBy("lang", "term")
    counts = counted(texts).withColumns({"docs": F.sum("n_docs").over(of_term), "total": F.sum("n").over(of_term), "first": F.col("source") == F.min("source").over(of_term)})
    kept = written(counts.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"), "kept-terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("vocabulary"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["n_all", "n_lang", "vocabulary"])
    groups = groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("tiles", F.expr(f"(count(*) OVER (PARTITION BY lang) + {TILE - 1}) div {TILE}"))
    groups = written(groups.withColumn("p_none", share(F.lit(0).cast("long"), F.col("n_all"), F.col("vocabulary"))), "groups")

    sums = pair_sums(kept, groups)
    both = sums.union(sums.select("lang", F.col("b"), F.col("a"), "value"))
    a, b = (groups.select("lang", F.col("number").alias(n), F.col("source").alias(name)) for n, name in (("a", "source"), ("b", "item")))
    pairs = both.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("n_all"), F.col("vocabulary")), "q": share(F.col("total"), F.col("n_lang"), F.col("vocabulary"))})
    found = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(pairs).unionByName(ranked(found).filter(F.col("rank") <= top))
