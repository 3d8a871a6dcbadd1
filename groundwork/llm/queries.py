"""The queries of this subpackage, for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, embeddings, exact, idstore, language, packing, simhash, subwords, suffixtree, toxicity, warc


def op1_pca_tiled_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.documents(spark, sf_dir))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(common.documents(spark, sf_dir))


def op4_simhash_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op5_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(common.documents(spark, sf_dir))


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh(spark, "token-ids")
    idstore.write(common.documents(spark, sf_dir), folder)
    return idstore.read(spark, folder)


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.documents(spark, sf_dir))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.round_trips(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pca_tiled_cosine, op2_best_fit_packing, op3_suffix_tree_scores, op4_simhash_ball_hashing, op5_digest_index_dedup, op6_toxicity_nnpu, op7_token_id_store, op8_warc_chunks, op9_language_naive_bayes, op10_merge_dropout)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pca_tiled_cosine": embeddings.ORACLE, "op5_digest_index_dedup": exact.ORACLE, "op8_warc_chunks": warc.ORACLE}
