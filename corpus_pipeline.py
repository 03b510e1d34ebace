"""A pipeline that prepares a corpus for training: each stage is one operator of gridloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, linededup, packing, pii, quality
from gridloom.llm.common import crc_remainder, materialize, read
from gridloom.llm.queries import PUBLIC_KEY


def like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the new text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    labels = read(spark, sf_dir, "labels")
    trusted = labels.where((crc_remainder(F.col("doc_id"), 5) != 0) & (F.col("quality") == 1)).select("doc_id")
    model = quality.fit(quality.featurize(docs), trusted)
    return quality.score_texts(docs, model, "_score").where("_score >= 0.3").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which they leave nothing but white space."""
    changed = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(r"\S")
    return like(docs, changed.where(~F.coalesce(emptied, F.lit(False))))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.drop_near_copies(docs)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get pseudonyms."""
    return like(docs, pii.pseudonymize(docs, PUBLIC_KEY))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, 1024, 0)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram jaccard join", near_copy_stage), ("pii", private_stage), ("packing", packing_stage)]

#: SQL can't express the trained and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
