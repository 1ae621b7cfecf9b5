"""A training-data pipeline: quality, near duplicates, benchmark leaks, secrets, and the mix.

Every stage takes the documents that the one before it kept and returns them
with the columns of ``documents``; the last returns the mix: each document it
takes, with its pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksift.llm import decontamination, jaccard, mixing, quality, secrets
from leaksift.llm.common import fresh
from leaksift.llm.tokens import shared_folder

#: SQL cannot express the trained classifier or the signatures; the stages are tested against brute force.
ORACLE_SQL = None
MIX_COLUMNS = ("size", "target", "taken", "pieces")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("predicted") == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.without_near_duplicates(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with ``size``, ``target``, ``taken`` and ``pieces`` (shard, pass, first and last word).

    Columns of ``docs`` called like one of these are replaced.
    """
    plan = mixing.mix_plan(docs, named="_mix_digest").where(F.col("taken") > 0)
    key, digest, place = (fresh(docs, c) for c in ("_mix_key", "_mix_text", "_mix_place"))
    # Rows equal in key and text take the plan's rows one by one.
    turn = F.row_number().over(Window.partitionBy("doc_id", "_mix_digest").orderBy(F.desc("taken")))
    planned = plan.withColumn(place, turn).withColumnsRenamed({"doc_id": key, "_mix_digest": digest})
    docs = docs.drop(*MIX_COLUMNS)
    own = docs.withColumn(digest, mixing.row_digest(F.col("doc_id"), F.col("text")))
    own = own.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", digest).orderBy("n_chars")))
    same = own["doc_id"].eqNullSafe(planned[key]) & (own[digest] == planned[digest]) & (own[place] == planned[place])
    return own.join(planned, same).select(*[own[c] for c in docs.columns], *[planned[c] for c in MIX_COLUMNS])


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaked),
          ("secrets", mask_secrets), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    So every stage is computed once, and a lost executor costs at most a part
    of one stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
