"""Short videos, plans and the package that holds them.

Records: comment_id, text, author, likes, category, priority, players (an array), caption, segment, low, high, confidence, manual, signals (an array); by
priority, ties by comment_id.  A segment, a start or an end that is missing is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from .. import phrases as P
from ..functions import text as T
from . import chat as K
from . import highlights as H


@dataclass(frozen=True)
class Options:
    """Seconds before and after a point of chat, of a comment's clip, and how much goes into a short."""

    pre_roll: float = 10.0
    post_roll: float = 20.0
    shorts_pre_roll: float = 10.0
    shorts_post_roll: float = 5.0
    shorts: int = 5
    messages: int = 50


def seconds_of_cards(cards: Column) -> Column:
    """A short of comment cards: a hook, fifteen seconds a card, a call."""
    return (4 + 15 * cards + 3).cast("long")


def seconds_of_clip(length: Column) -> Column:
    return F.floor(F.lit(3.5) + length + 3.5).cast("long")


def missing(value: Column) -> Column:
    """Null for a start of exactly 0 too, which counts as missing."""
    return F.when(value != 0, value)


def card(role: str) -> Column:
    """A comment as plans show it."""
    fields = ["comment_id", "text", "author", "likes", "category", "emotion", "priority"]
    more = [F.array_join("players", "|").alias("players"), F.col("caption"), H.lookup(L.USAGE, F.col("category"), "mid_roll_summary_card").alias("usage")]
    place = [F.nullif("segment", F.lit("")).alias("segment"), missing(F.col("low")).alias("low"), missing(F.col("high")).alias("high"), F.col("confidence"), F.col("manual")]
    return F.struct(F.lit(role).alias("role"), *fields, *more, *place)


def concept_top(records: DataFrame, n: int = 5) -> DataFrame:
    """concept, rank and the record, of the best n of each concept."""
    chosen = H.concept_shorts(records, n)
    return chosen.join(records, "comment_id")


def concept_titles(top: DataFrame, players: list[str]) -> DataFrame:
    """concept, title, description: a place for a player takes the one named most often by the concept's records, the first named of equal ones."""
    named = top.select("concept", "rank", F.posexplode("players").alias("at", "player")).groupBy("concept", "player").agg(F.count("*").alias("n"), F.min(F.struct("rank", "at")).alias("first"))
    most = named.withColumn("_r", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "first"))).filter("_r = 1").select("concept", "player")
    title = H.lookup(P.CONCEPT_TITLE, F.col("concept"), "")
    name = F.coalesce("player", F.lit(players[0] if players else P.NOBODY))
    return top.select("concept").distinct().join(most, "concept", "left").select("concept", F.replace(title, F.lit(P.PLAYER_PLACE), name).alias("title"), H.lookup(P.CONCEPT_TEXT, F.col("concept"), "").alias("description"))


def concept_sequences(records: DataFrame, players: list[str], n: int = 5) -> DataFrame:
    """concept, title, description, hook, overlays (cards with their order), clips (segments that overlap none before by more than half), call, seconds."""
    top = concept_top(records, n)
    overlay = F.struct(F.col("rank").alias("order"), "comment_id", "text", "caption", "author", "likes", "category", F.nullif("segment", F.lit("")).alias("segment"), missing(F.col("low")).alias("low"), missing(F.col("high")).alias("high"), "confidence", "manual")
    hook = F.struct("text", "caption", "author", "likes")
    rows = top.groupBy("concept").agg(F.min_by(hook, "rank").alias("hook"), F.array_sort(F.collect_list(overlay)).alias("overlays"))
    with_clip = top.filter(T.has_text(F.col("segment"))).withColumn("_r", F.row_number().over(Window.partitionBy("concept", "segment").orderBy("rank"))).filter("_r = 1")
    spans = with_clip.select("concept", F.col("rank").alias("place"), F.col("rank").cast("long").alias("seq"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    note = F.when(F.col("manual"), P.fill(P.CLIP_UNSURE, confidence=F.col("confidence"))).otherwise(P.fill(P.CLIP_SURE, confidence=F.col("confidence")))
    kept = H.select_clips(spans, "concept", n).select("concept", F.col("place").alias("rank"))
    clips = kept.join(top, ["concept", "rank"]).groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("rank", "segment", F.col("low").alias("start"), F.col("high").alias("end"), "manual", note.alias("note")))).alias("clips"))
    out = rows.join(concept_titles(top, players), "concept").join(clips, "concept", "left")
    none = F.array().cast(clips.schema["clips"].dataType)
    return out.select("concept", "title", "description", "hook", "overlays", F.coalesce("clips", none).alias("clips"), F.lit(P.CALL).alias("call"), seconds_of_cards(F.size("overlays")).alias("seconds"))


def spike_sequences(spikes: DataFrame, chat: DataFrame, size: float, options: Options = Options()) -> DataFrame:
    """id, title, description, clip_start, clip_end, messages (the first of the window, by time), hook, clips (the one clip), overlays (the hook as a card), call, seconds,
    of the first spikes.

    spikes: id (the rank), ws, we, anchor, n, weight; chat: ts, row, text, author, likes, weight.
    """
    first = spikes.filter(F.col("id") <= options.shorts)
    rows = K.interval_join(chat.select("ts", "row", "text", "author", "likes", "weight"), first.select("id", "ws", "we"), size, "ws", "we")
    w = Window.partitionBy("id")
    rows = rows.withColumn("_t", F.row_number().over(w.orderBy("ts", "row"))).withColumn("_h", F.row_number().over(w.orderBy(F.desc("weight"), "ts", "row")))
    message = F.struct("_t", "ts", F.left("text", F.lit(120)).alias("text"), F.left(F.col("author").cast("string"), F.lit(32)).alias("author"), "likes")
    hook = F.struct(F.left("text", F.lit(200)).alias("text"), F.col("author").cast("string").alias("author"), "likes", F.left("text", F.lit(45)).alias("caption"))
    gathered = rows.filter((F.col("_t") <= options.messages) | (F.col("_h") == 1)).groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_t") <= options.messages, message))).alias("_m"), F.max(F.when(F.col("_h") == 1, hook)).alias("hook")
    )
    out = first.join(gathered, "id", "left")
    start, end = F.greatest(F.lit(0.0), F.col("anchor") - options.shorts_pre_roll), F.col("anchor") + options.shorts_post_roll
    s = F.floor("anchor").cast("long")
    time = F.format_string("%d:%02d", ((s - s % 60) / 60).cast("long"), s % 60)
    length = F.format_string("%.1f", end - start)
    none = F.struct(F.lit(P.SPIKE_HOOK).alias("text"), F.lit("").alias("author"), F.lit(0).cast("long").alias("likes"), F.lit(P.SPIKE_HOOK).alias("caption"))
    name = F.format_string("spike_%03d", F.col("id"))
    shown = T.once(F.coalesce("hook", none.cast(gathered.schema["hook"].dataType)))
    out = out.withColumn("hook", shown)
    clip = F.struct(name.alias("segment"), start.alias("start"), end.alias("end"), F.lit(False).alias("manual"), F.lit(P.CLIP_SPIKE).alias("note"))
    overlay = F.struct(
        F.lit(1).alias("order"), F.concat(name, F.lit("_hook")).alias("comment_id"), "hook.text", "hook.caption", "hook.author", "hook.likes", F.lit("clutch_hype").alias("category"),
        name.alias("segment"), start.alias("low"), end.alias("high"), F.lit("high").alias("confidence"), F.lit(False).alias("manual"),
    )
    return out.select(
        "id", P.fill(P.SPIKE_TITLE, rank=F.col("id"), time=time).alias("title"), P.fill(P.SPIKE_TEXT, n=F.col("n"), weight=F.format_string("%.0f", F.col("weight").cast("double")), time=time, length=length).alias("description"),
        start.alias("clip_start"), end.alias("clip_end"), F.coalesce("_m", F.array().cast(gathered.schema["_m"].dataType)).alias("messages"),
        "hook", F.array(clip).alias("clips"), F.array(overlay).alias("overlays"), F.lit(P.CALL).alias("call"), seconds_of_clip(end - start).alias("seconds"),
    )


def event_words(records: DataFrame) -> DataFrame:
    """event, n: events among the records' signals, by count."""
    rows = records.select(F.explode("signals").alias("s")).filter(F.col("s").startswith("event:"))
    return rows.groupBy(F.substring("s", F.lit(7), F.length("s")).alias("event")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event")


def titles(records: DataFrame, players: list[str]) -> DataFrame:
    """place, title: suggestions with the first two players, the most frequent event and the number of records; none without records."""
    event = event_words(records).limit(1).agg(F.coalesce(F.max("event"), F.lit(P.SCENE)).alias("event"))  # one row
    total = records.agg(F.count("*").alias("total")).filter("total > 0")  # one row
    first, second = (F.lit(players[i] if len(players) > i else other) for i, other in ((0, P.NOBODY), (1, P.OTHER)))
    values = {"first": first, "second": second, "event": F.col("event"), "total": F.col("total")}
    return total.crossJoin(event).select(F.posexplode(F.array(*(P.fill(t, **values) for t in P.TITLES))).alias("place", "title"))


def arcs(records: DataFrame, players: list[str], n: int = 3) -> DataFrame:
    """player, n, arc, categories (category(n), by count), top (cards of the best), peak: of records whose joined names hold the player's."""
    joined = F.array_join("players", "|")
    rows = records.withColumn("player", F.explode(F.array_compact(F.array(*(F.when(F.contains(joined, F.lit(p)), F.lit(p)) for p in players))) if players else F.array().cast("array<string>")))
    w = Window.partitionBy("player").orderBy(*H.by_priority())
    rows = rows.withColumn("_r", F.row_number().over(w))
    best = rows.filter(F.col("_r") <= n).groupBy("player").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", card("player_arc").alias("c")))), lambda x: x["c"]).alias("top"), F.min_by(card("peak"), "_r").alias("peak"))
    counts = rows.groupBy("player", "category").agg(F.count("*").alias("n"), F.min("_r").alias("at"))
    shares = counts.groupBy("player").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "at", "category"))), lambda x: F.concat(x["category"], F.lit("("), (-x["o"]).cast("string"), F.lit(")"))).alias("categories"))
    return H.sentiment_arc(rows, "player").join(shares, "player").join(best, "player")


def important(points: DataFrame, n: int = 3) -> DataFrame:
    """The turning points that a film shows: of critical or high weight, the first n in order.  points: place, weight."""
    return points.filter(F.col("weight").isin("critical", "high")).orderBy("place").limit(n)


def spike_mode(records: DataFrame, spikes: DataFrame) -> bool:
    """Whether shorts go by spikes: there are some, and a chat record stands at a time of its own, not in a segment.  Two flags reach the driver."""
    direct = records.filter((F.col("source_type") == "live_chat") & F.array_contains("signals", "live_chat_timestamp_direct"))
    return not direct.isEmpty() and not spikes.isEmpty()


def report_mode(chat: DataFrame | None) -> str:
    return "combined" if chat is not None and not chat.isEmpty() else "comments"


def skip_reason(segment: Column, manual: Column, confidence: Column) -> Column:
    return F.when(~T.has_text(segment), P.SKIP_NO_SEGMENT).when(manual, P.fill(P.SKIP_MANUAL, segment=segment)).otherwise(P.fill(P.SKIP_UNSURE, confidence=confidence))


def render_report(slots: DataFrame, key: str) -> DataFrame:
    """key, rendered, skipped, status, note of a video's slots (key, place, segment, low, high, manual, confidence): the first three reasons, and how many more."""
    ready = T.has_text(F.col("segment")) & missing(F.col("low")).isNotNull() & missing(F.col("high")).isNotNull() & ~F.col("manual") & F.col("confidence").isin("high", "medium")
    rows = slots.withColumn("_ready", F.coalesce(ready, F.lit(False)))
    rows = rows.withColumn("_s", F.when(~F.col("_ready"), F.row_number().over(Window.partitionBy(key, "_ready").orderBy("place"))))
    why = F.when(F.col("_s") <= 3, F.struct("_s", skip_reason(F.col("segment"), F.col("manual"), F.col("confidence")).alias("t")))
    out = rows.groupBy(key).agg(F.count_if("_ready").alias("rendered"), F.count_if(~F.col("_ready")).alias("skipped"), F.array_join(F.transform(F.array_sort(F.collect_list(why)), lambda x: x["t"]), "; ").alias("_shown"))
    tail = F.when(F.col("skipped") > 3, P.fill(P.SKIPPED_MORE, n=F.col("skipped") - 3)).otherwise("")
    note = F.when(F.col("skipped") > 0, F.concat(P.fill(P.SKIPPED, shown=F.col("_shown")), tail)).otherwise("")
    return out.select(key, "rendered", "skipped", F.when(F.col("rendered") > 0, "ok").otherwise("placeholder_only").alias("status"), note.alias("note"))


def master_plan(records: DataFrame, players: list[str], acts: dict[str, list[str]] = L.ACTS) -> dict[str, DataFrame]:
    """The plan's parts as tables: meta, opening_hook, acts, bridges, categories, player_arcs, turning_points, closing_note, key_event_keywords, title_suggestions.

    Every part is empty for an empty table, and meta says so.
    """
    own = H.act(records, acts)
    of = lambda rows, role: rows.select(card(role).alias("card"))
    points = H.turning_points(records).select(card("turning_point").alias("card"), H.narrative_weight(F.col("priority")).alias("weight"))
    meta = records.agg(F.count("*").alias("total_comments_used")).select("total_comments_used", F.lit(True).alias("needs_manual_sequence_review"), F.when(F.col("total_comments_used") > 0, P.PLAN_NOTE).otherwise(P.PLAN_EMPTY).alias("note"))
    return {
        "meta": meta,
        "opening_hook": of(H.first_of(records, ("dramatic", "analytical", "controversial", "funny", "clutch_hype"), 30), "opening_hook"),
        "acts": H.act_summary(own),
        "bridges": H.bridges(own),
        "categories": own.groupBy("act", "category").agg(F.count("*").alias("n")),
        "player_arcs": arcs(records, players),
        "turning_points": points,
        "closing_note": of(H.closing_note(records), "closing_note"),
        "key_event_keywords": event_words(records).select("event").orderBy("event"),
        "title_suggestions": titles(records, players),
    }


def meta(records: DataFrame, segments: DataFrame, spikes: DataFrame) -> DataFrame:
    """One row: records by source, segments, spikes, and whether shorts go by spikes."""
    count = lambda c, name: F.count_if(c).alias(name)
    chat = F.col("source_type") == "live_chat"
    rows = records.agg(count(F.col("source_type") == "comment", "comments"), count(chat, "messages"), count(chat & F.array_contains("signals", "live_chat_timestamp_direct"), "_direct"))
    rows = rows.crossJoin(segments.agg(F.count("*").alias("segments"))).crossJoin(spikes.agg(F.count("*").alias("spikes")))  # one row each
    return rows.select("comments", "messages", "segments", "spikes", (F.col("messages") > 0).alias("has_chat"), ((F.col("_direct") > 0) & (F.col("spikes") > 0)).alias("spike_mode"))


def build_package(records: DataFrame, segments: DataFrame, spikes: DataFrame, chat: DataFrame, players: list[str], size: float, options: Options = Options()) -> dict[str, DataFrame]:
    """All tables of a package; nothing is computed but the mode, until a table is written."""
    if spike_mode(records, spikes):
        shorts = spike_sequences(spikes, chat, size, options)
    else:
        shorts = concept_sequences(records, players, options.shorts)
    moments = H.moments(records.filter(T.has_text(F.col("segment"))))
    plan = {f"plan_{k}": v for k, v in master_plan(records, players).items()}
    return {"meta": meta(records, segments, spikes), "highlight_comments": records.orderBy(*H.by_priority()), "highlight_moments": moments, "spike_moments": spikes, "shorts_sequences": shorts, **plan}
