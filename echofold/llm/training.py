"""Bounded samples of labelled documents, from the training fold alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Training documents are whole texts of at most so many characters.
TRAINING_CHARS = 20_000


def labelled(documents: DataFrame, labels: DataFrame, label: str, n: int, only: int | None = None) -> pd.DataFrame:
    """text and label (0 or 1) of at most n labelled documents of the training fold, by the order of a hash of doc_id.

    A doc_id with both labels counts as 1.  The ids are bounded by n before they meet the texts, so they may be broadcast.
    """
    ids = labels.filter(f"doc_id IS NOT NULL AND {label} IS NOT NULL").filter(~shared.held_out())
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    if only is not None:
        ids = ids.filter(F.col("label") == only)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return take(documents, ids)


def unlabelled(documents: DataFrame, n: int) -> pd.DataFrame:
    """text of at most n documents of the training fold, whether labelled or not."""
    ids = documents.filter("doc_id IS NOT NULL").filter(~shared.held_out()).select("doc_id", F.lit(0).alias("label")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(n)
    return take(documents, ids)


def take(documents: DataFrame, ids: DataFrame) -> pd.DataFrame:
    """doc_id, text and label; repeated rows once, different texts of one doc_id each."""
    rows = documents.filter("text IS NOT NULL").filter(F.length("text") <= TRAINING_CHARS).select("doc_id", "text")
    return rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").toPandas()


def prior(labels: DataFrame, label: str) -> float:
    """The share of 1 among the training fold's labels; one half if there are none."""
    share = labels.filter("doc_id IS NOT NULL").filter(~shared.held_out()).agg(F.avg(F.col(label))).first()[0]
    return 0.5 if share is None else float(share)


