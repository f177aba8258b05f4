"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, fingerprints, language_id, licenses, media, mixing, packing, simhash, substring_index, toxicity, warc, whitening
from .common import id_crc, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc("doc_id") % 4 == 2)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc("doc_id") % 5 == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (id_crc("doc_id") % 5 != 0))
    labelled = toxicity.labelled_sample(docs.select("doc_id", "text"), labels)
    model = toxicity.fit(labelled)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_index.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (op1_language_id, op2_document_fingerprints, op3_toxicity, op4_substring_dedup, op5_license_scan, op6_mixing, op7_media, op8_packing, op9_simhash, op10_warc, op11_whitening, op12_alignment, op13_decontamination, pipeline)
    return {f.__name__: f for f in own}


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (
  SELECT s, min(doc_id) AS first_id FROM starts GROUP BY s
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM starts JOIN firsts USING (s) WHERE first_id < doc_id
), gone AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, k: NOT list_contains(ps, k)), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), given AS (
  SELECT *, ([5.0, 2.0, 1.0])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, ([-0.5, 0.0, 0.5])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS slope, 2.0::DOUBLE * source_size AS top FROM sources
), shared AS (
  SELECT 0 AS step, rank, weight, top, false AS full_, (SELECT 1.5 * sum(source_size) FROM given)::DOUBLE * weight / sum(weight) OVER () AS target FROM given
  UNION ALL
  SELECT step + 1, rank, weight, top, target >= top,
    CASE WHEN target >= top THEN top ELSE ((SELECT 1.5 * sum(source_size) FROM given)::DOUBLE - coalesce(sum(top) FILTER (WHERE target >= top) OVER (), 0)) * weight / sum(weight) FILTER (WHERE target < top) OVER () END
  FROM shared WHERE step < 40
), targets AS (
  SELECT source, source_size, slope, target FROM given JOIN (SELECT * FROM shared WHERE step = 40) USING (rank)
), totals AS (
  SELECT sum(target) AS all_words, sum(target * slope) AS lean FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, slope, all_words, lean, round(target)::BIGINT AS quota,
    (sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, totals
), took AS (
  SELECT *, greatest(0, least(size, quota - start)) AS a, greatest(0, least(size, quota - start - source_size)) AS b FROM placed
), timed AS (
  SELECT *, CASE WHEN slope = 0 THEN start / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target)) - (1 - slope)) / (2 * slope) END AS t1,
    CASE WHEN slope = 0 THEN (start + source_size) / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((start + source_size) / target)) - (1 - slope)) / (2 * slope) END AS t2
  FROM took
)
SELECT doc_id, size, source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a > 0 THEN floor(all_words * t1 + lean * (t1 * t1 - t1) + 0.001)::BIGINT END AS position,
  CASE WHEN b > 0 THEN floor(all_words * t2 + lean * (t2 * t2 - t2) + 0.001)::BIGINT END AS position_again
FROM timed
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), starts AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes)
), met AS (
  SELECT r, i, starts.n, item_id FROM starts JOIN windows USING (s) WHERE starts.n = windows.n
), hit AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r
), held AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op10_warc": OP10_SQL, "op13_decontamination": OP13_SQL}
