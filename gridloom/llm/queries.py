"""Queries of this subpackage's operators, one for each, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, bpe, divergence, jaccard, linededup, maxscore, packing, periodic, pii, quality, rules, sharding, toxicity
from gridloom.llm.common import crc_remainder, read

Query = Callable[[SparkSession, str], DataFrame]


def scored(scores: DataFrame, divisor: int, remainder: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = crc_remainder(F.col("doc_id"), divisor) == remainder
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learn = labels.where(crc_remainder(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    return scored(toxicity.score(docs, toxicity.fit(docs, learn)), 3, 1, 0.7)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 40).drop("group_key")


#: The key of the registered query and the pipeline; real data need a secret of their own.
PUBLIC_KEY = b"gridloom public test key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PUBLIC_KEY)
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), "found")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), 1024, 0)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trusted = read(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return rules.apply_rules(docs, rules.fit(docs, trusted)).drop("llr")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_sets(read(spark, sf_dir, "documents")).drop("d1", "d2", "root")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    trusted = labels.where((crc_remainder(F.col("doc_id"), 5) != 0) & (F.col("quality") == 1)).select("doc_id")
    vectors = quality.featurize(docs)
    return scored(quality.score(vectors, quality.fit(vectors, trusted)), 5, 0, 0.3)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(periodic.plant(read(spark, sf_dir, "documents"))))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (op1_toxicity, op2_sharding, op3_pii, op4_packing, op5_rules, op6_line_dedup, op7_bpe, op8_nearest, op9_jaccard, op10_quality, op11_divergence, op12_periodic, op13_topk)
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_rules": rules.SQL, "op6_line_dedup": linededup.SQL, "op9_jaccard": jaccard.SQL, "op11_divergence": divergence.SQL, "op12_periodic": periodic.SQL, "op13_topk": maxscore.SQL}
