"""Registered corpus queries over the given tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, codes, decontaminate, filters, forest, licenses, packing, passages, quality, revisits, simhash, template,
               tokens)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside fold 0."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return template.main_texts(table(spark, sf_dir, "pages"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits derived from all pages, resolved; headers as sorted lines."""
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"])))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate classes of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations, rendered by turn."""
    return chat.rendered_turns(chat.paired_replies(table(spark, sf_dir, "conversations")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in four integer codebooks."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that earlier ones have; the kept words as a hash."""
    rows = passages.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters removes, by source."""
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_best_fit_packing, op3_benchmark_decontamination, op4_embedding_near_duplicates,
    op5_html_extraction, op6_warc_revisits, op7_license_scan, op8_token_counts, op9_simhash_near_duplicates,
    op10_preference_formatting, op11_vector_codes, op12_substring_dedup, op13_filter_interactions)}

REVISITS_ORACLE = r"""
WITH k AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
s AS (SELECT *, split_part(bare, '?', 1) AS place,
             CASE WHEN strpos(bare, '?') > 0 THEN regexp_replace(bare, '^[^?]*\?', '') ELSE '' END AS asked FROM k),
p AS (SELECT page_id, digest,
        regexp_replace(regexp_replace(lower(split_part(place, '/', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', ''), '\.html?$', '')
        || (CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) AS url_key
      FROM (SELECT *, list_sort(list_filter(string_split(asked, '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept FROM s)),
t AS (SELECT *, '"' || left(digest, 16) || '"' AS tag, 'day ' || (page_id % 28) AS day FROM p),
records AS (
  SELECT page_id * 3 AS record_id, url_key, page_id * 3600 AS moment, true AS is_full, digest,
         CASE WHEN page_id % 7 <> 3 THEN tag END AS etag, day AS modified, 'max-age=60' AS cache, NULL AS size,
         'text/html' AS kind, 'at ' || (page_id * 3600) AS date FROM t
  UNION ALL
  SELECT record_id, url_key, moment, false, CASE WHEN page_id % 2 = 0 THEN digest END,
         CASE WHEN page_id % 11 <> 5 THEN (CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END) || tag END,
         CASE WHEN page_id % 13 <> 4 THEN day END, 'max-age=' || k, '0', 'text/plain', 'at ' || moment
  FROM (SELECT *, page_id * 3 + k AS record_id,
               page_id * 3600 + k * 1800 + CASE WHEN k = 2 THEN page_id % 5 * 3600 ELSE 0 END AS moment
        FROM t, (SELECT unnest([1, 2]) AS k))),
joined AS (
  SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'digest': digest, 'etag': etag, 'modified': modified,
                            'kind': kind} END IGNORE NULLS)
            OVER (PARTITION BY url_key ORDER BY moment, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM records),
stated AS (
  SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(r.etag, '^W/', ''), modified = r.modified) AS agrees,
         digest = r.digest AS same FROM joined WHERE NOT is_full),
final AS (SELECT *, CASE WHEN r IS NULL THEN 'missing' WHEN NOT coalesce(same, true) OR NOT coalesce(agrees, true) THEN 'changed'
                    WHEN coalesce(agrees, same) IS NULL THEN 'unproven' ELSE 'resolved' END AS state FROM stated)
SELECT record_id, url_key, r.id AS target_id, state,
       CASE WHEN state = 'resolved'
            THEN concat_ws(chr(10), 'cache-control: ' || cache, 'content-type: ' || r.kind, 'date: ' || date,
                           'etag: ' || r.etag, 'last-modified: ' || coalesce(modified, r.modified))
            ELSE concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || size, 'content-type: ' || kind,
                           'date: ' || date, 'etag: ' || etag, 'last-modified: ' || modified) END AS headers,
       CASE WHEN state = 'resolved' THEN r.digest END AS digest
FROM final"""

ORACLE = {"op3_benchmark_decontamination": decontaminate.ORACLE, "op6_warc_revisits": REVISITS_ORACLE,
          "op10_preference_formatting": chat.ORACLE, "op11_vector_codes": codes.ORACLE,
          "op12_substring_dedup": passages.ORACLE, "op13_filter_interactions": filters.ORACLE}
