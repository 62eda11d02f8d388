"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontam, jaccard, langid, mining, neighbours, ngramlm, repeats, sharding, toxicity, unigram, urlfilter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.document_scores(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.document_counts(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.token_digests(table(spark, sf_dir, "documents"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op11_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.embedding_negatives(table(spark, sf_dir, "embeddings"))


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.kept_digests(table(spark, sf_dir, "documents"))


def op13_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bloom_lm": op1_bloom_lm,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_sharding": op4_sharding,
        "op5_token_counts": op5_token_counts,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_cross_polytope": op7_cross_polytope,
        "op8_url_filter": op8_url_filter,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_pca_negatives": op11_pca_negatives,
        "op12_debruijn_dedup": op12_debruijn_dedup,
        "op13_residue_whitening": op13_residue_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": urlfilter.ORACLE_SQL, "op9_decontamination": decontam.ORACLE_SQL}
