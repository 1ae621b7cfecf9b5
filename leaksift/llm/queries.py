"""Queries of the operators: each applies one, with production settings, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksift.llm import decontamination, html, jaccard, licenses, mixing, negatives, neighbours, quality, repeats, runs, secrets, tokens, toxicity
from leaksift.queries.base import Registry, table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

MIX_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][((pos - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sizes)),
levels AS (SELECT *, row_number() OVER by_level AS place,
    ((SELECT sum(source_size) FROM sizes)::DOUBLE * 1.5 - coalesce(sum(cap) OVER earlier, 0)) /
    ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER earlier, 0)) AS level
    FROM ranked WINDOW by_level AS (ORDER BY cap / weight, pos),
    earlier AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM found) * weight, cap)) AS target, cap FROM levels),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM docs)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(before + size, quota) - before) + greatest(0, least(before + source_size + size, quota) - before - source_size))::BIGINT
    AS taken
FROM placed p JOIN (SELECT *, least(round(target)::BIGINT, cap::BIGINT) AS quota FROM targets) t ON p.source IS NOT DISTINCT FROM t.source
"""

NEGATIVES_SQL = """
WITH vectors AS (SELECT DISTINCT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER ranked::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW ranked AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER ranked <= 3
"""


@registry.add(MIX_SQL)
def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that a mix of all sources takes, from the pieces of the splitting tree."""
    return mixing.mix_plan(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@registry.add()
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document: base patterns and linked parts of credentials."""
    return secrets.secret_digest(secrets.secret_spans(table(spark, sf, "documents")))


@registry.add()
def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document by nearest-neighbour voting."""
    scored = quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@registry.add()
def op2_toxicity_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document by the pattern grammar."""
    scored = toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@registry.add()
def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, by collision counting."""
    return neighbours.nearest(table(spark, sf, "embeddings"))


@registry.add()
def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page by trees over DOM nodes."""
    return html.main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@registry.add()
def op4_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Class and number of near duplicates of every document: five-word shingles, similarity of 0.8 and more."""
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@registry.add()
def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items in every document, within a fifth of their words in edits."""
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@registry.add()
def op9_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of fifty words and more that occur again, per document."""
    return repeats.repeated_passages(table(spark, sf, "documents"))


@registry.add()
def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licenses in every document, by patience alignment with templates."""
    return licenses.license_spans(table(spark, sf, "documents"))


@registry.add()
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of words in every document, and what is left without their repeats."""
    return runs.run_digest(runs.periodic_runs(runs.with_planted_period(table(spark, sf, "documents"))))


@registry.add()
def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document, by a digest cache in the shared folder.

    The cache is new for every run of the query, so each run encodes every
    distinct text; a pipeline passes one that lasts.
    """
    import public_tokenizers

    cache = f"{tokens.shared_folder(spark)}/token_counts/{uuid.uuid4().hex}"
    return tokens.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


@registry.add(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its positives, by an inverted multi-index."""
    return negatives.hard_negatives(negatives.with_shifted_labels(table(spark, sf, "embeddings")))
