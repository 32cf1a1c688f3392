"""The queries of this subpackage: one per operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import centroids, decontaminate, language_id, line_dedup, lm_scoring, media, mixing, near_dedup, ngram_jaccard, periodic_runs, sharding, token_store, toxicity
from threadloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_decisions(table(spark, sf_dir, "documents"))
    return found.withColumn("deleted", F.array_join(F.transform("deleted", lambda i: i.cast("string")), ","))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_held_out(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_line_dedup, op4_mix_sources, op5_media_columns, op6_ngram_jaccard, op7_lm_scoring, op8_token_store, op9_toxicity, op10_sharding, op11_near_dedup, op12_periodic_runs, op13_centroids)}


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS digest,
         coalesce(greatest(0.5, 1.0 - len(regexp_extract_all(text, '[0-9#$%&*|<>{}@=_~^\\/+]'))::DOUBLE / greatest(length(text), 1)), 1.0)::DOUBLE AS q
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), digest)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / q AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), r AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w
), v AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (
  SELECT (SELECT level FROM v WHERE ratio > level ORDER BY ratio, level LIMIT 1) AS free_level
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(free_level * weight, 3.0::DOUBLE * source_size)) AS target FROM v, f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), c AS (
  SELECT k.doc_id, k.source, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(k.size) OVER (PARTITION BY k.source, k.key, k.doc_id, k.digest) AS own
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
       (size * (epochs + CASE WHEN upto <= rest OR (upto - own < rest AND upto - rest <= rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


#: A run of at least three words is made of windows of one to three lines, as each line has a word.
OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), s AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM w
), n AS (
  SELECT *, lead(line) OVER d AS line1, lead(words) OVER d AS words1, lead(line, 2) OVER d AS line2, lead(words, 2) OVER d AS words2 FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, pos, 1 AS m, line AS txt FROM n WHERE words >= 3
  UNION ALL SELECT doc_id, pos, 2, line || chr(10) || line1 FROM n WHERE words + words1 >= 3 AND (words < 3 OR words1 < 3)
  UNION ALL SELECT doc_id, pos, 3, line || chr(10) || line1 || chr(10) || line2 FROM n WHERE words + words1 + words2 >= 3 AND (words + words1 < 3 OR words1 + words2 < 3)
), later AS (
  SELECT pos, m FROM (SELECT *, min(pos) OVER (PARTITION BY m, txt) AS first_pos FROM windows) WHERE pos > first_pos
), gone AS (
  SELECT DISTINCT pos + k AS pos FROM later, range(3) r(k) WHERE k < m
)
SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(CASE WHEN g.pos IS NOT NULL THEN line_no::VARCHAR END, ',' ORDER BY line_no), '') AS deleted
FROM s LEFT JOIN gone g ON s.pos = g.pos GROUP BY doc_id
"""

#: The least capacity by bisection, a greedy cut of eight runs for each trial; crc32 byte by byte.
OP10_SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(k))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS digest FROM documents
), c AS (
  SELECT DISTINCT text, hex(encode(text)) AS h FROM d
), crc AS (
  SELECT text, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i+1])::UBIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255)::INT + 1], a >> 8))) AS text_crc32 FROM c, table_of
), u AS (
  SELECT *, (('0x' || substr(digest, 1, 8))::BIGINT >> 16) AS unit FROM d
), e AS (
  SELECT unit, sum(s) OVER (ORDER BY unit)::BIGINT AS upto, s FROM (SELECT unit, sum(size)::BIGINT AS s FROM u GROUP BY unit)
), ends AS (
  SELECT list(upto ORDER BY unit) AS l, max(s) AS largest, max(upto) AS total FROM e
), b AS (
  SELECT greatest(largest, (total + 7) // 8)::BIGINT AS lo, total::BIGINT AS hi FROM ends
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END FROM (
    SELECT lo, hi, mid, list_reduce(list_prepend(0::BIGINT, range(8)), lambda a, k: list_max(list_filter(l, lambda x: x <= a + mid))) = total AS fits
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM b WHERE lo < hi), ends)
), cap AS (
  SELECT min(hi) AS capacity FROM b WHERE lo = hi
), cuts AS (
  SELECT k, list_reduce(list_prepend(0::BIGINT, range(k)), lambda a, j: list_max(list_filter(l, lambda x: x <= a + capacity))) AS cut FROM range(1, 8) r(k), ends, cap
), placed AS (
  SELECT u.*, (SELECT count(DISTINCT cut) FROM cuts WHERE e.upto > cut) AS shard, (('0x' || substr(md5(concat_ws('|', coalesce(u.doc_id::VARCHAR, ''), digest)), 1, 8))::BIGINT
    % greatest(1, (SELECT (count(*) + 39999) // 40000 FROM d))) AS bucket FROM u JOIN e USING (unit)
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, digest) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed JOIN crc USING (text)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op10_sharding": OP10_SQL, "op13_centroids": centroids.oracle()}
