"""The text operators as queries over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetfit.llm import (
    bpe,
    exact_dedup,
    html_extract,
    jaccard_join,
    mixing,
    ngram_lm,
    pii,
    substring_dedup,
    syncmers,
    token_alignment,
    token_counts,
    toxicity,
    whitening,
)
from fleetfit.llm.common import table

#: The tokenizer file that the queries use, by its public name.
TOKENIZER = "word_bpe_49k.json"
#: The two tokenizers that are aligned.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model trained outside the held-out fold."""
    docs = documents(spark, sf_dir, "text")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mix(documents(spark, sf_dir, "text", "source")).drop("source")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data; counts and digest are those of the base spans."""
    found = pii.personal_data(documents(spark, sf_dir, "text"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, as digests."""
    found = bpe.encode_documents(documents(spark, sf_dir, "text"), public_tokenizers.path(TOKENIZER))
    return found.select(
        "doc_id", "n_tokens", bpe.digest("ids").alias("ids_sha256"), bpe.digest("decoded").alias("decoded_sha256")
    )


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts; the cache begins empty."""
    cache = token_counts.new_cache(spark)
    return token_counts.token_counts(documents(spark, sf_dir, "text"), public_tokenizers.path(TOKENIZER), cache)


@query
def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out tenth."""
    return ngram_lm.held_out_scores(documents(spark, sf_dir, "text"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir, "text"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    return jaccard_join.jaccard_components(documents(spark, sf_dir, "text"), words=3, num=90, den=100)


@query
def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts, and how alike they are."""
    return syncmers.edited_likeness(documents(spark, sf_dir, "text"))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without windows of 13 words that an earlier one has."""
    found = substring_dedup.without_repeats(documents(spark, sf_dir, "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of all documents, and how common their linked pairs are."""
    paths = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)
    return token_alignment.aligned(documents(spark, sf_dir, "text"), *paths)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened by their leading components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


ORACLES["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), b AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight,
         coalesce(sum(3 * source_size) OVER f, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER f, 0)::BIGINT AS weight_before
  FROM t WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, most * (all_weight - weight_before) <= (all_size - most_before) * weight AS limited FROM b
), g AS (
  SELECT source, source_size, most,
         CASE WHEN limited THEN most::DOUBLE
              ELSE (all_size - coalesce(sum(most) FILTER (limited) OVER (), 0))::BIGINT::DOUBLE
                   / (all_weight - coalesce(sum(weight) FILTER (limited) OVER (), 0))::BIGINT::DOUBLE * weight END AS target
  FROM c
), w AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, most) AS words FROM g
), s AS (
  SELECT doc_id, size, w.source_size, target, words,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) END::BIGINT AS taken
FROM s
"""

ORACLES["op11_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS words FROM d, unnest(range(1, len(ws) - 11)) AS t(i)
), f AS (
  SELECT words, min(doc_id) AS least FROM g GROUP BY words HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, i FROM g JOIN f USING (words) WHERE least < doc_id), unnest(range(i, i + 13)) AS t(j)
), k AS (
  SELECT doc_id, count(c.j) AS n_removed, string_agg(ws[p.j], ' ' ORDER BY p.j) FILTER (c.j IS NULL) AS kept
  FROM (SELECT doc_id, ws, j FROM d, unnest(range(1, len(ws) + 1)) AS t(j)) p LEFT JOIN c USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
