"""The queries of this subpackage by name, over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercantile.llm import bpe, decontamination, language, lexical, line_dedup, mixing, near_dedup, nearest, quality, spelling, substring_dedup, token_counts, token_files
from mercantile.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup_windows(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return mixing.mix(weights).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"), exact=1)


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    segments = token_files.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(segments)


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode_ids(bpe.encode_texts(table(spark, folder, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # the stages lie outside of this package, which the other queries do not need

    return corpus_pipeline.run(spark, folder)


def all_queries() -> dict[str, Query]:
    named = [op1_bag_minhash, op2_quality, op3_nearest, op4_token_counts, op5_substring_dedup, op6_mixing, op7_decontamination, op8_language, op9_line_dedup, op10_token_files]
    named += [op11_bpe, op12_lexical_search, op13_spelling_variants, pipeline]
    return {f.__name__: f for f in named}


# SUBSTRING_SQL: the words of every text, the windows by their words, and the words that no removed window covers.
SUBSTRING_SQL = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, place, array_to_string(words[place : place + 12], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts)),
first AS (SELECT run, min(doc_id) AS first_id FROM windows GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, spot FROM (
    SELECT w.doc_id, unnest(range(w.place, w.place + 13)) AS spot FROM windows w JOIN first f ON f.run = w.run WHERE w.doc_id > f.first_id)),
kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.spot) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM texts) t
  LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.spot = t.spot WHERE g.spot IS NULL GROUP BY t.doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

DECONTAMINATION_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(10, len(words)) AS size FROM items WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[place : place + size - 1], ' ') AS run
  FROM (SELECT item_id, size, words, unnest(range(1, len(words) - size + 2)) AS place FROM sized)),
sizes AS (SELECT DISTINCT size FROM item_windows),
windows AS (
  SELECT doc_id, size, place, array_to_string(words[place : place + size - 1], ' ') AS run
  FROM (SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS place FROM texts, sizes)),
hits AS (SELECT w.doc_id, w.place, w.size, i.item_id FROM windows w JOIN item_windows i ON i.size = w.size AND i.run = w.run),
hit_words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS spot FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit_words h ON h.doc_id = t.doc_id LEFT JOIN hit_items i ON i.doc_id = t.doc_id
"""


def oracle_queries() -> dict[str, str]:
    """SQL where it can state the result: the other operators are models, signatures, tokenizers or approximate searches."""
    return {"op5_substring_dedup": SUBSTRING_SQL, "op6_mixing": mixing.MIX_SQL, "op7_decontamination": DECONTAMINATION_SQL, "op12_lexical_search": lexical.SEARCH_SQL}
