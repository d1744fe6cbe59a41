"""A training-data pipeline: quality, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  Columns beside those of documents are left out,
whatever their names; an empty table gives an empty one with the same columns.  Texts are whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import bpe, decontaminate, ngram_join, quality_crf, shared, substring_dedup
from echofold.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject.

    Null and empty texts have the training fold's share of good documents as their score; repeated rows and rows without doc_id are scored like all others.
    """
    chain = quality_crf.train(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, chain, keep=COLUMNS[1:]).filter("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates.

    Texts without words, null and empty ones too, are duplicates of nothing and stay; rows without doc_id go.  Repeated rows of a document that
    stays all stay; of different texts with one doc_id, one is compared for all.
    """
    first = ngram_join.join(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(first, docs["doc_id"] == first["_kept"], "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; a text that keeps all its words stays as it is, one that keeps none of them goes.

    Null texts come out as empty ones and stay, having no words to lose; rows without doc_id go; repeated rows come out as often as they came in.
    """
    out = substring_dedup.dedup(docs, keep=("lang", "source", "n_chars"), as_it_was=True)
    cut = F.col("n_removed") > 0
    out = out.filter(~cut | (F.col("n_removed") < F.col("n_words")))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item.

    Null and empty texts hold nothing and stay, as do rows without doc_id; a doc_id goes with all its rows.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to, a row for each row: null texts as empty ones, a null doc_id as null."""
    out = bpe.encode(docs, vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: The classifier, the near-duplicate classes and the vocabulary aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table of its own in the shared folder and the next stage's input.  A stage's intermediate tables
    are deleted once its result is written, and so is its input."""
    docs = shared.documents(spark, sf_dir)
    with shared.own_tables() as stored:
        for name, stage in STAGES:
            docs = shared.store(stage(spark, docs, sf_dir), f"stage-{name}")
            shared.sweep(spark, docs, stored)
    return docs
