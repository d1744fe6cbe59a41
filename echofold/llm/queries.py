"""The queries of this subpackage: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, licenses, media, ngram_join, packing, quality_crf, substring_dedup, suffix_dedup, toxicity, variants
from .bpe import encode
from .shared import documents, held_out
from .token_counts import token_counts


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for every document."""
    out = encode(documents(spark, sf_dir), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a classifier trained on the labelled ones."""
    docs = documents(spark, sf_dir)
    chain = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, chain).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that also start earlier."""
    return suffix_dedup.digest(suffix_dedup.dedup(documents(spark, sf_dir)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of an earlier one."""
    return substring_dedup.digest(substring_dedup.dedup(documents(spark, sf_dir)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a classifier trained on toxic and unlabelled ones."""
    docs = documents(spark, sf_dir)
    classifier = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, classifier).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image in archives and read back."""
    return media.media_columns(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.join(documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against the benchmark items."""
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(documents(spark, sf_dir), vocabulary_path())


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its near words and most frequent spelling."""
    return variants.group(documents(spark, sf_dir))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds, with sums of squared distances."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return centroids.digest(centroids.cluster(vectors))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_license_scan": op2_license_scan,
        "op3_quality": op3_quality,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_media": op7_media,
        "op8_ngram_join": op8_ngram_join,
        "op9_decontaminate": op9_decontaminate,
        "op10_token_counts": op10_token_counts,
        "op11_variants": op11_variants,
        "op12_best_fit": op12_best_fit,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.oracle(),
        "op4_suffix_dedup": suffix_dedup.ORACLE,
        "op5_substring_dedup": substring_dedup.ORACLE,
        "op8_ngram_join": ngram_join.ORACLE,
        "op9_decontaminate": decontaminate.ORACLE,
        "op11_variants": variants.ORACLE,
        "op13_centroids": centroids.oracle(),
    }
