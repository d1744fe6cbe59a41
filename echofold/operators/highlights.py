"""Classification, priorities, moments and plans.

Records: comment_id, text, author, likes, category, priority (an exact number), ordered by priority, ties by comment_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from .. import phrases as P
from ..functions import text as T


def classify(df: DataFrame, categories: dict[str, list[str]] = L.CATEGORIES) -> DataFrame:
    """df with categories (an array in priority order) and category (its first)."""
    rows = df.withColumn("_low", T.once(F.lower(T.normalize_informal(F.col("text")))))
    rows = rows.withColumn("_found", T.once(T.labels(F.col("_low"), categories)))
    found = F.col("_found")
    doubtful = (F.length("text") > 80) & (F.contains("text", F.lit(";;")) | (F.regexp_count("text", F.lit(r"\.\.")) >= 2) | contains_raw(F.col("text"), L.CONTRAST))
    rest = F.array_remove(found, "clutch_hype")
    stronger = F.arrays_overlap(found, F.array(*(F.lit(c) for c in ("analytical", "critical", "controversial", "dramatic"))))
    settled = F.when(
        F.array_contains(found, "clutch_hype") & doubtful,
        F.when(stronger, rest).when(F.get(found, F.lit(0)) == "clutch_hype", F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit("analytical")))).otherwise(found),
    ).otherwise(found)
    settled = F.when(F.size(settled) == 0, F.array(F.lit("representative"))).otherwise(settled)
    rows = rows.withColumn("categories", T.once(settled))
    return rows.withColumn("category", F.get("categories", F.lit(0))).drop("_low", "_found")


def contains_raw(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def priority_terms(df: DataFrame, confidence: Column) -> DataFrame:
    """likes, max_likes and rest, such that the priority is least(100, 40 * likes / max(max_likes, 1) + rest / 100)."""
    most = df.agg(F.greatest(F.coalesce(F.max("likes"), F.lit(0)), F.lit(1)).alias("max_likes"))
    rest = T.emotion_hundredths(F.col("text")) * 8 + lookup(L.CATEGORY_WEIGHT, F.col("category"), 90) * 10 + lookup(L.CONFIDENCE_BONUS, confidence, 0) * 100
    return df.crossJoin(F.broadcast(most)).withColumn("rest", rest.cast("long"))  # one row


def priority(df: DataFrame, confidence: Column) -> DataFrame:
    """df with priority, from 0 to 100, unrounded."""
    rows = priority_terms(df, confidence)
    return rows.withColumn("priority", F.least(F.lit(100.0), 40 * F.col("likes") / F.col("max_likes") + F.col("rest") / 100.0)).drop("rest", "max_likes")


def detect_players(text: Column, players: list[str]) -> Column:
    """The players whose names a text holds, whatever the case, in the list's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in players))) if players else F.array().cast("array<string>")


def editor_notes(likes: Column, players: Column, category: Column, strength: Column) -> Column:
    """Advice in sentences: much liked, the players, the category's own, strong emotion (in hundredths); a default where there is none."""
    of_category = F.create_map(*(F.lit(x) for kv in P.NOTE_CATEGORY.items() for x in kv))[category]
    notes = F.concat_ws(
        " ",
        F.when(likes >= 10, P.fill(P.NOTE_LIKES, likes=likes)),
        F.when(F.size(players) > 0, P.fill(P.NOTE_PLAYERS, players=F.array_join(players, ", "))),
        of_category,
        F.when(strength >= 400, P.NOTE_STRONG),
    )
    return F.when(notes == "", P.NOTE_PLAIN).otherwise(notes)


def act(df: DataFrame, acts: dict[str, list[str]] = L.ACTS) -> DataFrame:
    """df with act: the first one whose word the text has, else the category's."""
    found = F.get(T.labels(F.col("_low"), acts), F.lit(0))
    return df.withColumn("_low", T.once(F.lower("text"))).withColumn("act", F.coalesce(found, lookup(L.ACT_OF_CATEGORY, F.col("category"), "act_2_buildup"))).drop("_low")


def narrative_weight(score: Column) -> Column:
    return F.when(score >= 70, "critical").when(score >= 50, "high").when(score >= 30, "medium").otherwise("low")


def by_priority(*first: Column) -> list[Column]:
    return [*first, F.desc("priority"), F.asc("comment_id")]


CONFIDENCE = ["none", "low", "medium", "high"]


def moments(matched: DataFrame) -> DataFrame:
    """A row for each segment, by the best priority.  matched: segment, comment_id, likes, priority, category, emotion (hundredths), confidence, players and
    signals (arrays), in records' order.  Segments that stand for single points of chat don't count.

    ids are the comments in order; players and events are unions, in alphabetical order; intensity is the mean emotion, from 1 to 5.
    """
    rank = lookup({c: i for i, c in enumerate(CONFIDENCE)}, F.col("confidence"), 0)
    for column in {"players", "signals"} - set(matched.columns):
        matched = matched.withColumn(column, F.array().cast("array<string>"))
    rows = matched.filter(~F.col("segment").startswith("lc_ts_"))
    order = Window.partitionBy("segment").orderBy(*by_priority())
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("_rank", rank)
    modes = rows.groupBy("segment", "category").agg(F.count("*").alias("n"), F.min("_at").alias("first")).groupBy("segment").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("category"))
    # Names and events go by their distinct values, ids by what the segment holds.
    union = lambda column, keep, name: rows.select("segment", F.explode(column).alias("_x")).filter(keep).distinct().groupBy("segment").agg(F.sort_array(F.collect_list(F.col("_x"))).alias(name))
    players = union("players", F.lit(True), "players")
    events = union(F.transform("signals", lambda x: F.when(x.startswith("event:"), F.substring(x, F.lit(7), F.length(x)))), F.col("_x").isNotNull(), "events")
    out = rows.groupBy("segment").agg(
        F.count("*").alias("n"),
        F.sum("likes").alias("likes"),
        F.max("priority").alias("max_priority"),
        F.sum("emotion").alias("emotion"),
        F.max("_rank").alias("rank"),
        F.min_by("comment_id", "_at").alias("top_comment"),
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "comment_id"))), lambda x: x["comment_id"]).alias("ids"),
    )
    best = F.get(F.array(*map(F.lit, CONFIDENCE)), F.col("rank"))
    none = F.array().cast("array<string>")
    out = out.join(modes, "segment").join(players, "segment", "left").join(events, "segment", "left").withColumn("confidence", best).drop("rank")
    out = out.withColumns({"players": F.coalesce("players", none), "events": F.coalesce("events", none), "intensity": F.col("emotion") / (100 * F.col("n")), "unsure": F.col("confidence").isin("low", "none")})
    return out.orderBy(F.desc("max_priority"), "segment")


def moment_notes(moments: DataFrame, segments: DataFrame) -> DataFrame:
    """segment, usage, notes of moments; segments: segment, start, end."""
    sure = P.fill(P.MOMENT_SPAN, start=T.minutes_clock(F.col("start")), end=T.minutes_clock(F.col("end")))
    notes = F.concat_ws(
        " ",
        F.when(F.col("unsure"), P.MOMENT_UNSURE).otherwise(sure),
        F.when(F.size("players") > 0, P.fill(P.MOMENT_PLAYERS, players=F.array_join("players", ", "))),
        P.fill(P.MOMENT_COUNT, n=F.col("n")),
    )
    return moments.join(segments, "segment").select("segment", lookup(L.USAGE, F.col("category"), "summary_overlay").alias("usage"), notes.alias("notes"))


def act_summary(df: DataFrame) -> DataFrame:
    """act, n, anchor (its best comment)."""
    return df.groupBy("act").agg(F.count("*").alias("n"), F.max_by("comment_id", F.struct("priority", -F.col("comment_id"))).alias("anchor"))


def bridges(df: DataFrame, preferred: tuple[str, ...] = ("analytical", "representative", "dramatic"), n: int = 3) -> DataFrame:
    """act, rank, comment_id: after an act's anchor, up to n of the preferred categories; where there are none, the next n of any.

    Two group limits, which take few rows of an act from each partition; what is left is a handful.
    """
    w = Window.partitionBy("act").orderBy(*by_priority())
    take = lambda rows, good: rows.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= n + 1).select("act", "at", "priority", "comment_id", F.lit(good).alias("good"))
    rows = take(df, False).unionByName(take(df.filter(F.col("category").isin(*preferred)), True))
    anchor = F.first_value(F.when(~F.col("good"), F.col("comment_id")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("anchor", anchor).filter("comment_id <> anchor")
    rows = rows.withColumn("any", F.max("good").over(Window.partitionBy("act"))).filter("good = any")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("act", "rank", "comment_id")


def first_of(df: DataFrame, order: tuple[str, ...], within: int | None = None) -> DataFrame:
    """The best record of the first category in order that has any among the top `within`; without one, the best record."""
    rows = df.orderBy(*by_priority()).limit(within) if within else df
    at = lookup({c: i for i, c in enumerate(order)}, F.col("category"), len(order))
    return rows.withColumn("_o", at).orderBy(*by_priority(F.asc("_o"))).limit(1).drop("_o")


def turning_points(df: DataFrame, order: tuple[str, ...] = ("dramatic", "controversial", "analytical", "critical"), n: int = 5) -> DataFrame:
    at = lookup({c: i for i, c in enumerate(order)}, F.col("category"), len(order))
    return df.withColumn("_o", at).filter(F.col("_o") < len(order)).orderBy(*by_priority(F.asc("_o"))).limit(n).drop("_o")


def closing_note(df: DataFrame, order: tuple[str, ...] = ("supportive", "emotional", "representative")) -> DataFrame:
    """The best liked record of the first category in order, else the last of the top 50 that isn't harsh."""
    at = lookup({c: i for i, c in enumerate(order)}, F.col("category"), len(order))
    liked = df.withColumn("_o", at).filter((F.col("_o") < len(order)) & (F.col("likes") >= 1)).orderBy(*by_priority(F.asc("_o"))).limit(1)
    rest = df.orderBy(*by_priority()).limit(50).filter(~F.col("category").isin("dramatic", "controversial", "critical")).orderBy(F.asc("priority"), F.desc("comment_id")).limit(1).withColumn("_o", F.lit(len(order)))
    return liked.unionByName(rest).orderBy("_o").limit(1).drop("_o")


# The concepts of short videos and the category each takes (none: all).
CONCEPTS = {"top_reactions": None, "funniest": "funny", "dramatic": "dramatic", "controversial": "controversial", "analytical": "analytical", "clutch": "clutch_hype"}


def concept_shorts(df: DataFrame, n: int = 5) -> DataFrame:
    """concept, rank, comment_id: the best n of each concept's candidates."""
    spark = df.sparkSession
    concepts = spark.createDataFrame(list(CONCEPTS.items()), "concept string, wanted string")
    rows = df.join(F.broadcast(concepts), F.col("wanted").isNull() | (F.col("wanted") == F.col("category")))  # six rows
    w = Window.partitionBy("concept").orderBy(*by_priority())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("concept", "rank", "comment_id")


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of the shorter interval that both have in common."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, both / shorter).otherwise(0.0)


def select_clips(df: DataFrame, key: str, most: int = 5) -> DataFrame:
    """key, place, seq: of the first `most` clips of each key, those that overlap none selected before by more than half of the shorter.  df: key, place, seq, low, high."""
    w = Window.partitionBy(key).orderBy("place")
    first = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    rows = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "seq", "low", "high"))).alias("c"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    kind = f"array<struct<place:{kinds['place']},seq:{kinds['seq']},low:{kinds['low']},high:{kinds['high']}>>"
    clear = lambda x, kept: F.forall(kept, lambda y: (overlap_ratio(x["low"], x["high"], y["low"], y["high"]) <= 0.5) & (x["seq"] != y["seq"]))
    fold = F.aggregate("c", F.array().cast(kind), lambda kept, x: F.when(clear(x, kept), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select(key, F.explode(fold).alias("s")).select(key, "s.place", "s.seq")


def renderable(df: DataFrame) -> DataFrame:
    """can_render and the reason why not; a start at exactly 0 counts as missing, as do spans of a point's own."""
    known = ~F.col("segment").startswith("lc_ts_") & (F.col("low") > 0) & F.col("high").isNotNull()
    sure = F.col("confidence").isin("high", "medium")
    return df.withColumn("can_render", known & sure).withColumn("reason", F.when(~known, "no_segment").when(~sure, "low_confidence").otherwise("ok"))


def sentiment_arc(df: DataFrame, key: str) -> DataFrame:
    """key, n, arc, by shares of category groups, in this order."""
    count = lambda *c: F.count_if(F.col("category").isin(*c))
    rows = df.groupBy(key).agg(F.count("*").alias("n"), count("clutch_hype", "emotional", "supportive").alias("p"), count("critical", "controversial").alias("m"), count("dramatic").alias("d"), count("analytical").alias("a"))
    arc = (
        F.when(F.col("m") * 5 >= F.col("n") * 2, "contested")
        .when((F.col("m") + F.col("d")) * 2 >= F.col("n"), "mixed")
        .when(F.col("p") * 2 >= F.col("n"), "positive")
        .when(F.col("a") * 5 >= F.col("n") * 2, "analytical_focus")
        .otherwise("mixed")
    )
    return rows.select(key, "n", arc.alias("arc"))
