"""The registered queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, divergence, exact_dedup, jaccard, licenses, sharding, simhash, token_blocks, token_counts, toxicity, warc
from .shared import table


def op7_proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)


def op1_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_warc_pages, op2_toxicity, op3_token_files, op4_simhash_near_dedup, op5_benchmark_templates, op6_token_counts, op7_proportional_shards),
        *(op8_byte_bpe, op9_license_notices, op10_exact_dedup, op11_source_divergence, op12_centroid_clusters, op13_ngram_jaccard),
    )
}

#: A round of clustering in SQL: what is nearest to the centroids before, and the floors of its means.
NEAREST = """
near{i} AS (
  SELECT r, vec_id, v, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
      SELECT r, vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, here.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM kept, centroids{i} AS here)) WHERE place = 1
)"""
MEANS = """
centroids{j} AS (
  SELECT old.c, coalesce(new.v, old.v) AS v FROM centroids{i} AS old LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v
    FROM (SELECT c, k, CAST(sum(v[k]) AS BIGINT) AS s, count(*) AS n FROM near{i}, range(1, 65) AS ks(k) GROUP BY c, k) GROUP BY c
  ) AS new ON old.c = new.c
)"""

SQL: dict[str, str] = {
    "op1_warc_pages": r"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
""",
    "op7_proportional_shards": r"""
WITH RECURSIVE crc_step AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_step WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8),
rows_in AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle_key
  FROM documents
),
sized AS (
  SELECT doc_id, source, shuffle_key, CAST(strlen(text) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
             lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM rows_in, crc_table
),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffle_key, doc_id, size, text_crc32) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS fraction
  FROM sized
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, shuffle_key, doc_id, size, text_crc32) - 1 AS place,
         count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard,
       CAST(place - ((place * 16 // total) * total + 15) // 16 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
""",
    "op10_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256,
       CAST(strlen(body) AS BIGINT) AS n_bytes
FROM texts WINDOW same AS (PARTITION BY body)
""",
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
terms AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
sums AS (SELECT lang, source, sum(n) AS n_all FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n_all, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n_lang + 5 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
  LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
rows_out AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_out)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op12_centroid_clusters": r"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 1048576)) = 0
),
centroids0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 16)),
"""
    + ",".join(NEAREST.format(i=i) + "," + MEANS.format(i=i, j=i + 1) for i in range(3))
    + ","
    + NEAREST.format(i=3)
    + """
SELECT vec_id, CAST(near3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY near3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near3 JOIN (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM centroids3) AS names ON near3.c = names.c
""",
    "op13_ngram_jaccard": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM docs
),
postings AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM postings a JOIN postings b ON a.g = b.g AND a.r <> b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT r, r AS other FROM docs UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN docs ON reach.other = docs.r GROUP BY reach.r) c ON s.r = c.r
""",
}
