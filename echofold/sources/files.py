"""Comment and chat files, replay events, segments and captions as DataFrames with fixed schemas.

A missing path gives an empty table of the same schema.
"""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

COMMENT_COLUMNS = ["comment_id", "parent_comment_id", "author", "text", "published_at", "updated_at", "like_count", "is_reply", "reply_count", "video_id", "video_url"]
COMMENTS = "comment_id string, parent_comment_id string, author string, text string, published_at string, updated_at string, like_count long, is_reply boolean, reply_count long, video_id string, video_url string"
CHAT = "row long, comment_id string, ts double, author string, text string, kind string, likes long, weight long, source_type string"
SEGMENTS = "id string, seq int, start double, end double, text string, words array<struct<word:string,time:double>>"
REQUIRED = {"comment_id", "author", "text", "like_count"}
# Column names that stand for one another, in this order.
ALIASES = {"ts": ["timestamp_seconds", "time_seconds", "offset_seconds"], "text": ["text", "message", "content"]}


def _csv(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns as strings; quoted line breaks stay inside their cell."""
    try:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return None
        raise


def number(c: Column, kind: str = "long") -> Column:
    return F.coalesce(c.try_cast("double").cast(kind), F.lit(0).cast(kind))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments: numbers that can't be read are 0, flags are true for true, 1 and yes, blank texts go."""
    raw = _csv(spark, path)
    if raw is None or not REQUIRED <= set(raw.columns):
        return spark.createDataFrame([], COMMENTS)
    have = {c: F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in COMMENT_COLUMNS}
    have["text"] = F.coalesce(have["text"], F.lit(""))
    have["like_count"], have["reply_count"] = number(have["like_count"]), number(have["reply_count"])
    have["is_reply"] = F.coalesce(F.lower(F.trim(have["is_reply"])).isin("true", "1", "yes"), F.lit(False))
    return raw.select(*(v.alias(k) for k, v in have.items())).filter(T.has_text(F.col("text")))


def flatten_threads(df: DataFrame) -> DataFrame:
    """Comments of an API's answers: df(comment_id, parent_comment_id, is_reply, reply_count, snippet), a missing field as an empty text or 0."""
    field = lambda name: F.coalesce(F.col(f"snippet.{name}").cast("string"), F.lit(""))
    return df.select(
        "comment_id",
        "parent_comment_id",
        field("authorDisplayName").alias("author"),
        field("textDisplay").alias("text"),
        field("publishedAt").alias("published_at"),
        field("updatedAt").alias("updated_at"),
        F.coalesce(F.col("snippet.likeCount").cast("long"), F.lit(0).cast("long")).alias("like_count"),
        "is_reply",
        F.col("reply_count").cast("long").alias("reply_count"),
    )


def file_order(df: DataFrame) -> DataFrame:
    """row: the input order of one file's rows, from 0.  Each partition counts its own rows; only the partitions' sizes meet."""
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    own = Window.partitionBy("_part").orderBy("_id")
    rows = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(own) - 1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0))).select("_part", "_start")  # a row for each partition
    return rows.join(F.broadcast(starts), "_part").withColumn("row", (F.col("_start") + F.col("_at")).cast("long")).drop("_id", "_part", "_at", "_start")


def read_chat(spark: SparkSession, path: str, missing_time_as_zero: bool = False) -> DataFrame:
    """Live chat of one file: see chat_rows.  Ids count what is left."""
    raw = _csv(spark, path)
    return spark.createDataFrame([], CHAT) if raw is None else number_chat(file_order(chat_rows(raw, missing_time_as_zero)))


def chat_rows(raw: DataFrame, missing_time_as_zero: bool = False) -> DataFrame:
    """ts, author, text, kind, likes and the columns besides, of a table of strings: rows without a time of 0 or more, or with a blank text, go."""
    names = {n for columns in ALIASES.values() for n in columns} | {"author", "message_type", "likes"}
    pick = lambda names: next((F.col(n) for n in names if n in raw.columns), F.lit(None).cast("string"))
    ts = pick(ALIASES["ts"]).try_cast("double")
    rows = raw.select(
        (F.coalesce(ts, F.lit(0.0)) if missing_time_as_zero else ts).alias("ts"),
        F.coalesce(pick(["author"]), F.lit("unknown")).alias("author"),
        F.coalesce(pick(ALIASES["text"]), F.lit("")).alias("text"),
        F.coalesce(pick(["message_type"]), F.lit("text")).alias("kind"),
        number(pick(["likes"])).alias("likes"),
        *(F.col(c) for c in raw.columns if c not in names and c not in ("ts", "kind", "row", "comment_id", "weight", "source_type")),
    )
    return rows.filter((F.col("ts") >= 0) & T.has_text(F.col("text")))


def number_chat(rows: DataFrame) -> DataFrame:
    """Ids and weights of chat_rows with their row numbers; a message weighs as much as its likes, 1 at least."""
    extra = [c for c in rows.columns if c not in ("row", "ts", "author", "text", "kind", "likes")]
    return rows.select("row", F.concat(F.lit("lc_"), "row").alias("comment_id"), "ts", "author", "text", "kind", "likes", F.greatest("likes", F.lit(1)).cast("long").alias("weight"), F.lit("live_chat").alias("source_type"), *extra)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a JSON array, in its order."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SEGMENTS)
        raise
    return parse_segments(text).drop("file")


def parse_segments(text: DataFrame) -> DataFrame:
    """Segments of text(value), a JSON array in each row; file stays where there is one."""
    kind = "array<struct<id:string,start:double,end:double,text:string,words:array<struct<word:string,time:double>>>>"
    keep = [F.col("file")] if "file" in text.columns else [F.lit(None).cast("string").alias("file")]
    rows = text.select(*keep, F.posexplode(F.from_json("value", kind)).alias("i", "s"))
    return rows.select(
        "file", F.coalesce("s.id", F.format_string("seg_%04d", F.col("i") + 1)).alias("id"), (F.col("i") + 1).alias("seq"), F.coalesce("s.start", F.lit(0.0)).alias("start"), F.coalesce("s.end", F.lit(0.0)).alias("end"), F.coalesce("s.text", F.lit("")).alias("text"), "s.words"
    )


def segments_of(spark: SparkSession, root: str, video: str) -> DataFrame:
    """Segments by convention: lesson_<video>/segments.json below root; none for no video, a missing or an unreadable file."""
    if not video or video == "—":
        return spark.createDataFrame([], SEGMENTS)
    return read_segments(spark, f"{root}/lesson_{video}/segments.json")


SPIKES = "id long, anchor double, ws double, we double, n long, weight double"


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Spikes of a CSV, by weight; what can't be read is 0."""
    raw = _csv(spark, path)
    if raw is None:
        return spark.createDataFrame([], SPIKES)
    rows = file_order(raw.select(*(number(F.col(a), k).alias(b) for a, b, k in (("anchor_time", "anchor", "double"), ("window_start", "ws", "double"), ("window_end", "we", "double"), ("message_count", "n", "long"), ("weighted_score", "weight", "double")))))
    return rows.select(F.row_number().over(Window.orderBy(F.desc("weight"), "row")).cast("long").alias("id"), "anchor", "ws", "we", "n", "weight")  # a few dozen rows


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """phrase, n, type of a keyword CSV; a row of another type counts as a unigram."""
    raw = _csv(spark, path)
    if raw is None:
        return spark.createDataFrame([], "phrase string, n long, type string")
    return raw.select("phrase", number(F.col("count")).alias("n"), F.when(F.col("type") == "bigram", "bigram").otherwise("unigram").alias("type"))


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """author, comment_count, total_likes of an author CSV."""
    raw = _csv(spark, path)
    if raw is None:
        return spark.createDataFrame([], "author string, comment_count long, total_likes long")
    return raw.select("author", number(F.col("comment_count")).alias("comment_count"), number(F.col("total_likes")).alias("total_likes"))


def comment_totals(comments: DataFrame) -> DataFrame:
    """One row of what a report says of its comments."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return comments.agg(
        F.count_if(~F.col("is_reply")).alias("top_level"), F.count_if(F.col("is_reply")).alias("replies"), F.count("*").alias("total"), F.count_distinct("author").alias("authors"),
        zero(F.sum("like_count")).alias("likes"), zero(F.max("like_count")).alias("max_likes"),
    )


@dataclass(frozen=True)
class Config:
    """What a run is about, and which inputs it takes."""

    youtube_url: str
    download_video: bool = True
    analyze_subtitles: bool = True
    analyze_comments: bool = True
    analyze_live_chat: bool = True


def read_config(spark: SparkSession, path: str) -> Config:
    """A JSON object; flags that are missing are true, an address that is missing or blank is an error."""
    found = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    url = str(found.get("youtube_url") or "").strip()
    if not url:
        raise ValueError("youtube_url is missing")
    return Config(url, **{f.name: bool(found.get(f.name, True)) for f in fields(Config) if f.name != "youtube_url"})


def cached_roster(spark: SparkSession, path: str, fetch: Callable[[], Iterable[str]], days: float = 7.0, now: float | None = None) -> DataFrame:
    """name: a roster that fetch() gives, kept at path for some days.  An older copy serves where fetch fails, with a warning, and an empty table where there is none.

    Each fetch adds a file and the latest counts, so nothing that someone reads is overwritten.
    """
    now = time.time() if now is None else now
    schema = "name string, fetched double"
    try:
        kept = spark.read.schema(schema).json(path)
        age = kept.agg(F.max("fetched").alias("t")).first().t
    except AnalysisException:
        kept, age = spark.createDataFrame([], schema), None
    kept = kept.filter(F.col("fetched") == age) if age is not None else kept
    if age is not None and now - age < days * 86400:
        return kept.select("name").distinct()
    try:
        names = sorted({n for n in fetch() if n})
    except Exception as e:  # whatever a network call raises
        warnings.warn(f"the roster wasn't fetched: {e!r}", stacklevel=2)
        names = []
    if not names:
        return kept.select("name").distinct()
    spark.createDataFrame([(n, now) for n in names], schema).coalesce(1).write.mode("append").json(path)
    return spark.createDataFrame([(n,) for n in names], "name string")


# The renderers of a replay event, and the message types they give.
RENDERERS = {"liveChatTextMessageRenderer": "text", "liveChatPaidMessageRenderer": "superchat", "liveChatMembershipItemRenderer": "membership", "liveChatPaidStickerRenderer": "sticker"}
_RUNS = "struct<runs:array<struct<text:string,emoji:struct<shortcuts:array<string>,emojiId:string>>>>"
_ONE = f"struct<id:string,timestampUsecs:string,authorName:struct<simpleText:string>,authorExternalChannelId:string,message:{_RUNS},headerSubtext:{_RUNS},purchaseAmountText:struct<simpleText:string>>"
_ITEM = "struct<" + ",".join(f"{r}:{_ONE}" for r in RENDERERS) + ">"
REPLAY = f"struct<replayChatItemAction:struct<videoOffsetTimeMsec:string,actions:array<struct<addChatItemAction:struct<item:{_ITEM}>>>>>"


def runs_text(runs: Column) -> Column:
    emoji = lambda e: F.coalesce(F.get(e["shortcuts"], F.lit(0)), F.concat(F.lit("["), F.nullif(e["emojiId"], F.lit("")), F.lit("]")), F.lit("[emoji]"))
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.when(r["emoji"].isNotNull(), emoji(r["emoji"])), F.lit(""))), "")


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Chat events of a replay file, a JSON object a line: message_id, ts (null without an offset), kind, author, channel, text, amount, usecs.

    Blank lines, lines that aren't JSON, lines without an action and other renderers give nothing.
    """
    return parse_replay(spark.read.text(path))


def parse_replay(lines: DataFrame, whole: bool = False) -> DataFrame:
    """The events of lines(value): see read_replay.  whole: with row (the order of the lines), renderer and offset_ms besides."""
    lines = lines.withColumn("row", F.monotonically_increasing_id()).filter(T.has_text(F.col("value")))
    action = lines.select("row", F.from_json("value", REPLAY).getField("replayChatItemAction").alias("a")).filter("a IS NOT NULL")
    rows = action.select("row", F.col("a.videoOffsetTimeMsec").try_cast("long").alias("ms"), F.explode("a.actions").alias("x")).select("row", "ms", "x.addChatItemAction.item")
    one = F.coalesce(*(F.col(f"item.{r}") for r in RENDERERS))
    kind = F.coalesce(*(F.when(F.col(f"item.{r}").isNotNull(), k) for r, k in RENDERERS.items()))
    renderer = F.coalesce(*(F.when(F.col(f"item.{r}").isNotNull(), r) for r in RENDERERS))
    rows = rows.select("row", "ms", one.alias("r"), kind.alias("kind"), renderer.alias("renderer")).filter("r IS NOT NULL")
    runs = F.when(F.size(F.coalesce(F.col("r.message.runs"), F.array())) > 0, F.col("r.message.runs")).otherwise(F.col("r.headerSubtext.runs"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        empty(F.col("r.id")).alias("message_id"),
        T.seconds(F.col("ms")).alias("ts"),
        "kind",
        empty(F.col("r.authorName.simpleText")).alias("author"),
        empty(F.col("r.authorExternalChannelId")).alias("channel"),
        empty(runs_text(runs)).alias("text"),
        F.when(F.col("kind").isin("superchat", "sticker"), empty(F.col("r.purchaseAmountText.simpleText"))).otherwise("").alias("amount"),
        empty(F.col("r.timestampUsecs")).alias("usecs"),
        *([F.col("row"), F.col("renderer"), F.col("ms").alias("offset_ms")] if whole else []),
    )


def renderer_counts(events: DataFrame) -> DataFrame:
    """kind, n of replay events."""
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def replay_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, blank, bad (not JSON), without an action."""
    return line_statistics(spark.read.text(path))


def line_counts(value: Column) -> list[Column]:
    """Aggregates over lines: how many, blank ones, ones that aren't JSON, ones without an action."""
    text = T.strip(value)
    parsed = F.try_parse_json(text)
    has = F.try_variant_get(parsed, "$.replayChatItemAction", "variant").isNotNull()
    return [F.count("*").alias("lines"), F.count_if(text == "").alias("blank"), F.count_if((text != "") & parsed.isNull()).alias("bad"), F.count_if(parsed.isNotNull() & ~has).alias("other")]


def line_statistics(lines: DataFrame) -> DataFrame:
    return lines.agg(*line_counts(F.col("value")))


def observed_replay(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """The events of lines(value), whole (see parse_replay), and what line_statistics says of the lines, counted as the events are read: it is there (get) once
    the events were written."""
    seen = Observation("replay")
    return parse_replay(lines.observe(seen, *line_counts(F.col("value"))), whole=True), seen


_TIME = r"(\d{2}:\d{2}:\d{2}\.\d{3})"


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """video, seq, start, end, text, line of every cue that isn't a flash or empty; line keeps its tags for the word times."""
    return parse_captions(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("video"), "value"))


def parse_captions(files: DataFrame) -> DataFrame:
    """The cues of files(video, value): see read_captions."""
    files = files.select("video", F.regexp_replace("value", r"\r\n?", "\n").alias("v"))
    blocks = files.select("video", F.posexplode(F.split(F.trim(F.col("v"), F.lit(" \n\t")), r"\n\n+")).alias("seq", "b"))
    cue = rf"(?s)^(?:.*?\n)??[ \t]*{_TIME}\s*-->\s*{_TIME}[^\n]*\n?(.*)$"
    part = lambda k: F.regexp_extract("b", cue, k)
    rows = blocks.filter(F.col("b").rlike(cue)).select("video", "seq", T.vtt_seconds(part(1)).alias("start"), T.vtt_seconds(part(2)).alias("end"), part(3).alias("body"))
    said = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.filter(F.col("end") - F.col("start") >= 0.05).withColumn("line", F.element_at(said, -1)).filter(F.size(said) > 0)
    return rows.withColumn("text", F.trim(T.unescape(F.regexp_replace("line", "<[^>]+>", "")))).filter("text <> ''").select("video", "seq", "start", "end", "text", "line")


def caption_words(cues: DataFrame) -> DataFrame:
    """video, time, word: the tagged words, and the words before the first tag at the cue's start."""
    tagged = cues.select("video", F.explode(F.regexp_extract_all("line", F.lit(rf"<{_TIME}><c>.*?</c>"), F.lit(0))).alias("t"))
    tagged = tagged.select("video", T.vtt_seconds(F.regexp_extract("t", _TIME, 1)).alias("time"), F.trim(F.regexp_extract("t", "<c>(.*?)</c>", 1)).alias("word"))
    bare = cues.select("video", F.col("start").alias("time"), F.trim(F.regexp_extract("line", r"^([^<\s][^<]*?)(?=<|$)", 1)).alias("word"))
    return tagged.unionByName(bare).filter("word <> ''")
