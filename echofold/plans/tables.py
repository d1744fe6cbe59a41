"""How the operators' inputs come from the tables at hand, in DataFrames and, as SQL views, in the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sliding windows, gaps and segments scaled to a month of events.
WIDTH, STEP = 3600.0, 600.0
SEGMENT, SEGMENT_EVERY = 3600.0, 7200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as comments."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("comment_id"), F.col("source").alias("author"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 97).alias("like_count"), (F.col("doc_id") % 5 == 0).alias("is_reply"))


COMMENTS = "SELECT doc_id AS comment_id, source AS author, coalesce(text, '') AS text, doc_id % 97 AS like_count, doc_id % 5 = 0 AS is_reply FROM documents"


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as chat: ts in seconds from the first one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts")).alias("us"))
    start = e.agg(F.min("us").alias("us0"))  # one row
    rows = e.crossJoin(F.broadcast(start))
    return rows.select(F.col("event_id").alias("row"), ((F.col("us") - F.col("us0")) / 1e6).alias("ts"), F.col("user_id").alias("author"), F.col("event_type").alias("kind"), F.concat(F.col("event_type"), F.lit(" "), F.col("user_id") % 7).alias("text"), F.greatest("value", F.lit(1)).cast("decimal(18,2)").alias("weight"))


CHAT = """SELECT event_id AS row, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS ts, user_id AS author, event_type AS kind, event_type || ' ' || CAST(user_id % 7 AS VARCHAR) AS text,
  greatest(CAST(value AS DECIMAL(18,2)), CAST(1 AS DECIMAL(18,2))) AS weight FROM events"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour in every two, over the span of the events."""
    last = chat(spark, sf_dir).agg(F.max("ts").alias("t"))
    n = F.floor(F.col("t") / SEGMENT_EVERY).cast("long")
    return last.filter("t IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("seq")).select("seq", (F.col("seq") * SEGMENT_EVERY).alias("start"), (F.col("seq") * SEGMENT_EVERY + SEGMENT).alias("end"))


SEGMENTS = f"SELECT i AS seq, i * {SEGMENT_EVERY} AS start, i * {SEGMENT_EVERY} + {SEGMENT} AS \"end\" FROM range(0, (SELECT CAST(floor(max(ts) / {SEGMENT_EVERY}) AS BIGINT) + 1 FROM chat)) r(i)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as threads."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("row"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"))


TURNS = "SELECT conv_id, turn AS row, role AS author, coalesce(text, '') AS text FROM conversations"


def with_views(body: str, *views: str) -> str:
    """SQL that starts with some of the views above."""
    named = {"comments": COMMENTS, "chat": CHAT, "segments": SEGMENTS, "turns": TURNS}
    return "WITH " + ", ".join(f"{v} AS ({named[v]})" for v in views) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_labels(lexicon: dict[str, list[str]], low: str) -> str:
    """The list of labels whose substrings occur, in order."""
    tests = ", ".join("CASE WHEN " + " OR ".join(f"contains({low}, '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in words) + f" THEN '{k}' END" for k, words in lexicon.items())
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"
