"""Queries of time-stamped chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as K
from ..operators import entities as E
from ..operators import matching as M
from .tables import STEP, WIDTH, chat, table, turns, with_views

CANDIDATES = f"""exploded AS (SELECT row, ts, weight, unnest(range(greatest(0, CAST(floor((ts - {WIDTH}) / {STEP}) AS BIGINT) + 1), CAST(floor(ts / {STEP}) AS BIGINT) + 1)) AS k FROM chat),
candidates AS (SELECT k, count(*) AS n, sum(weight) AS weight FROM exploded GROUP BY k HAVING count(*) >= 3)"""
NMS = f"""ranked AS (SELECT k, n, weight, row_number() OVER (ORDER BY weight DESC, k) AS o FROM candidates),
fold AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS kept UNION ALL
  SELECT r.o, CASE WHEN len(kept) < 20 AND len(list_filter(kept, lambda y: abs(r.k - y) * {STEP} < {WIDTH / 2})) = 0 THEN list_append(kept, r.k) ELSE kept END FROM fold JOIN ranked r ON r.o = fold.o + 1),
final AS (SELECT kept FROM fold ORDER BY o DESC LIMIT 1),
spikes AS (SELECT r.k, r.n, r.weight, CAST(list_position(kept, r.k) AS INTEGER) AS rank FROM ranked r, final WHERE list_contains(kept, r.k))"""
GAP = 3600.0
#: White space around a text, as stated characters that mean the same to both engines.
STRIPPED = r"^[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"
SESSIONS = f"""gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY author ORDER BY ts, row) > {GAP} THEN 1 ELSE 0 END AS new FROM chat),
sess AS (SELECT *, sum(new) OVER (PARTITION BY author ORDER BY ts, row) AS session FROM gaps),
clusters AS (SELECT author, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last, list_sort(list(ts))[CAST(count(*) // 2 AS BIGINT) + 1] AS anchor FROM sess GROUP BY author, session)"""


def videos(spark, sf):
    """The chat of seven videos: users in groups, each with a first message of its own."""
    return chat(spark, sf).withColumn("video", F.col("author") % 7)


VIDEOS = f"""v AS (SELECT *, author % 7 AS video FROM chat), d AS (SELECT *, ts - min(ts) OVER (PARTITION BY video) AS d FROM v),
vx AS (SELECT video, row, ts, weight, unnest(range(greatest(0, CAST(floor((d - {WIDTH}) / {STEP}) AS BIGINT) + 1), CAST(floor(d / {STEP}) AS BIGINT) + 1)) AS k FROM d),
vc AS (SELECT video, k, count(*) AS n, sum(weight) AS weight FROM vx GROUP BY video, k HAVING count(*) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY weight DESC, k) AS o FROM vc),
fold AS (SELECT DISTINCT video, 0::BIGINT AS o, []::BIGINT[] AS kept FROM vc UNION ALL
  SELECT r.video, r.o, CASE WHEN len(kept) < 20 AND len(list_filter(kept, lambda y: abs(r.k - y) * {STEP} < {WIDTH / 2})) = 0 THEN list_append(kept, r.k) ELSE kept END FROM fold JOIN ranked r ON r.video = fold.video AND r.o = fold.o + 1),
final AS (SELECT video, arg_max(kept, o) AS kept FROM fold GROUP BY video),
vs AS (SELECT r.video, r.k, r.n, r.weight, CAST(list_position(kept, r.k) AS INTEGER) AS rank FROM ranked r JOIN final USING (video) WHERE list_contains(kept, r.k)),
vw AS (SELECT video, rank AS id, k * {STEP} AS ws, k * {STEP} + {WIDTH} AS we, k * {STEP} + {WIDTH / 2} AS anchor FROM vs)"""


def _videos(body: str) -> str:
    return with_views(f"+{VIDEOS} {body}", "chat").replace("WITH ", "WITH RECURSIVE ", 1)


def mixed_spans(spark, sf):
    """Messages within spans of a second, an hour and a month, in one table."""
    spans = _mixed(spark, sf)
    return K.interval_join(chat(spark, sf).select("ts", "weight"), spans).groupBy("id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def mixed_overlaps(spark, sf):
    """Spans of any lengths against each other: how many each meets, itself too."""
    spans = _mixed(spark, sf)
    rows = M.overlaps(spans.select(F.col("id").alias("seq"), F.col("low").alias("start"), F.col("high").alias("end")), spans)
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def _mixed(spark, sf):
    k = F.col("s_suppkey")
    length = F.when(k % 50 == 0, 2592000.0).when(k % 2 == 0, 1.0).otherwise(3600.0)
    s = table(spark, sf, "supplier").select(k.alias("id"), ((k * 7919) % 2592000).cast("double").alias("low"), length.alias("length"))
    return s.select("id", "low", (F.col("low") + F.col("length")).alias("high"))


MIXED = "mx AS (SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 2592000 AS DOUBLE) AS low, (s_suppkey * 7919) % 2592000 + CASE WHEN s_suppkey % 50 = 0 THEN 2592000.0 WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 3600.0 END AS high FROM supplier)"


def video_spikes(spark, sf):
    """Of every video: the spikes that are kept."""
    return K.select_spikes(K.spike_candidates(videos(spark, sf), WIDTH, STEP, keys="video"), WIDTH, STEP, keys="video")


def video_top_messages(spark, sf):
    return K.window_messages(videos(spark, sf), WIDTH, STEP, keys="video")


def video_rollup(spark, sf):
    """Messages around the spikes of each video, in seconds from its first one."""
    spans = K.spans_of(video_spikes(spark, sf), WIDTH, STEP, "video")
    told = K.from_start(videos(spark, sf).select("video", "ts"), ["video"]).select("video", F.col("_d").alias("ts"))
    return K.window_rollup(spans, told, WIDTH, "video")


def video_density(spark, sf):
    """The fullest stretch of each video."""
    from pyspark.sql import Window

    w = Window.partitionBy("video").orderBy(F.desc("n"), "bucket")
    return K.density(videos(spark, sf), 7200.0, "video").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def video_sessions(spark, sf):
    """Sessions of each video, all of its users as one."""
    return K.session_clusters(videos(spark, sf), "video", 600.0)


def video_opportunity(spark, sf):
    """Of a hundred for the best user of each video."""
    c = videos(spark, sf)
    m = c.groupBy("video", "author").agg(F.count_if(F.col("kind") == "purchase").alias("pos"), F.count_if(F.col("kind") == "click").alias("neg"))
    m = m.join(K.session_clusters(c, ["video", "author"], GAP).groupBy("video", "author").agg(F.count("*").alias("clusters")), ["video", "author"])
    m = m.withColumn("reactions", F.col("pos") + F.col("neg")).withColumn("positive", F.when(F.col("pos") + F.col("neg") > 0, F.col("pos") / (F.col("pos") + F.col("neg"))).otherwise(0.0))
    return E.opportunity(m, keys="video").select("video", "author", F.floor(F.col("raw") / F.col("best") * 1000000 + 0.5).cast("long").alias("score_millionths"))


def chat_filter(spark, sf):
    return K.relevant(chat(spark, sf), ["click", "purchase", "view"]).select("row", "kind")


def density_buckets(spark, sf):
    return K.density(chat(spark, sf), 7200.0)


def density_top(spark, sf):
    return K.density(chat(spark, sf), 7200.0).orderBy(F.desc("n"), "bucket").limit(20)


def candidates(spark, sf):
    return K.spike_candidates(chat(spark, sf), WIDTH, STEP)


def spike_top_messages(spark, sf):
    return K.window_messages(chat(spark, sf), WIDTH, STEP)


def spike_nms(spark, sf):
    return K.select_spikes(candidates(spark, sf), WIDTH, STEP)


def spikes(spark, sf):
    s = spike_nms(spark, sf).select(F.col("rank").alias("id"), (F.col("k") * STEP).alias("ws"))
    return s.select("id", "ws", (F.col("ws") + WIDTH).alias("we"), (F.col("ws") + WIDTH / 2).alias("anchor"))


SPIKES = f"sp AS (SELECT rank AS id, k * {STEP} AS ws, k * {STEP} + {WIDTH} AS we, k * {STEP} + {WIDTH / 2} AS anchor FROM spikes)"


def spike_window_rollup(spark, sf):
    return K.window_rollup(spikes(spark, sf), chat(spark, sf).select("ts"), WIDTH)


def spike_shorts(spark, sf):
    """Of the first five spikes: the clip before and after the anchor, and the first 50 messages of the window."""
    from pyspark.sql import Window

    s = spikes(spark, sf).filter("id <= 5")
    rows = K.interval_join(chat(spark, sf).select("row", "ts"), s, WIDTH, "ws", "we")
    w = Window.partitionBy("id").orderBy("ts", "row")
    rows = rows.withColumn("r", F.row_number().over(w)).filter("r <= 50")
    out = rows.groupBy("id").agg(F.count("*").alias("messages"), F.min_by("row", "r").alias("first_row"), F.first("anchor").alias("anchor"))
    return out.select("id", "messages", "first_row", F.greatest(F.lit(0.0), F.col("anchor") - 10).alias("clip_start"), (F.col("anchor") + 5).alias("clip_end"), F.floor(F.lit(3.5) + 15 + 3.5).cast("long").alias("seconds"))


def token_events_in_spikes(spark, sf):
    """Message kinds over all spikes; a message in two of them counts twice."""
    rows = K.interval_join(chat(spark, sf).select("ts", "kind"), spikes(spark, sf), WIDTH, "ws", "we")
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def reaction_totals(spark, sf):
    """The six most frequent texts of each spike, summed over spikes."""
    from pyspark.sql import Window

    rows = K.interval_join(chat(spark, sf).select("ts", "text"), spikes(spark, sf), WIDTH, "ws", "we").groupBy("id", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "text"))).filter("r <= 6")
    return rows.groupBy("text").agg(F.sum("n").alias("n"))


def rolling_display_offsets(spark, sf):
    """In milliseconds."""
    s = spikes(spark, sf)
    rows = K.interval_join(chat(spark, sf).select("row", "ts"), s, WIDTH, "ws", "we")
    out = K.display_offsets(rows, "id", "ws", 90.0, WIDTH)
    return out.select("id", "row", F.floor(F.col("at") * 1000 + 0.5).cast("long").alias("at_ms"))


def chat_phases(spark, sf):
    s = spikes(spark, sf)
    rows = K.interval_join(chat(spark, sf).select("row", "ts"), s, WIDTH, "ws", "we")
    return K.visible_phases(rows, "id", 4).select("id", "phase", F.array_join("shown", ",").alias("shown"))


def session_clusters(spark, sf):
    return K.session_clusters(chat(spark, sf), "author", GAP)


def cluster_reactions(spark, sf):
    """Messages around the sessions of every user, each once for a user."""
    own = session_clusters(spark, sf).select(F.col("author").alias("name"), "anchor")
    rows = K.attributed(own, chat(spark, sf), "name", 60.0)
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def late_stream_flag(spark, sf):
    return K.late_flags(chat(spark, sf), "author").groupBy("author").agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


def mention_rank_assoc(spark, sf):
    """For each user, the first four ranks of spikes with a message of theirs."""
    rows = K.interval_join(chat(spark, sf).select("author", "ts"), spikes(spark, sf), WIDTH, "ws", "we").select("author", "id").distinct()
    return rows.groupBy("author").agg(F.array_join(F.slice(F.sort_array(F.collect_list("id")), 1, 4), ",").alias("ranks"))


def player_metrics(spark, sf):
    """Mentions, clusters and reactions (purchases good, errors bad) of each user."""
    c = chat(spark, sf)
    own = c.groupBy("author").agg(F.count("*").alias("mentions"), F.count_if(F.col("kind") == "purchase").alias("pos"), F.count_if(F.col("kind") == "click").alias("neg"))
    return own.join(K.session_clusters(c, "author", GAP).groupBy("author").agg(F.count("*").alias("clusters")), "author")


def opportunity_score(spark, sf):
    m = player_metrics(spark, sf).withColumn("reactions", F.col("pos") + F.col("neg")).withColumn("positive", F.when(F.col("pos") + F.col("neg") > 0, F.col("pos") / (F.col("pos") + F.col("neg"))).otherwise(0.0))
    scored = E.opportunity(m)
    return scored.select("author", F.floor(F.col("raw") / F.col("best") * 1000000 + 0.5).cast("long").alias("score_millionths"))


def marketing_score(spark, sf):
    m = player_metrics(spark, sf).withColumn("rx", F.col("pos") + F.col("neg"))
    raw = m.withColumn("raw", E.marketing(F.col("rx") / F.col("mentions"), F.when(F.col("rx") > 0, F.col("pos") / F.col("rx")).otherwise(0.0), F.col("clusters"), F.col("mentions")))
    return raw.select("author", F.floor(F.col("raw") * 1000000 + 0.5).cast("long").alias("raw_millionths"))


def established(spark, sf):
    """Users by mentions without the two most mentioned, the first eight."""
    m = player_metrics(spark, sf)
    top = m.orderBy(F.desc("mentions"), "author").limit(2).select("author")
    return m.join(top, "author", "left_anti").orderBy(F.desc("mentions"), "author").limit(8).select("author", "mentions")


def upper_medians(spark, sf):
    return K.upper_medians(chat(spark, sf), "kind", "weight")


def compared_with_all(spark, sf):
    """Each user's messages against the upper median and the mean of all users."""
    own = chat(spark, sf).groupBy("author").agg(F.count("*").alias("n"))
    return K.compared(own, "n")


def informative_recent(spark, sf):
    """Of the last sixty turns of each role that say something: the newest of each text."""
    t = turns(spark, sf).select("author", F.regexp_replace("text", STRIPPED, "").alias("text"), (F.col("conv_id") * 1000 + F.col("row")).alias("row"))
    return K.recent_distinct(K.informative(t), "author").select("author", "row", "text")


def noise(spark, sf):
    """Words of the turns that are too short to say anything."""
    words = turns(spark, sf).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.filter(T.is_noise(F.col("word")))


def time_order(spark, sf):
    """The first hundred messages by time; a third has none and comes last."""
    return K.in_time_order(chat(spark, sf).withColumn("ts", F.when(F.col("row") % 3 > 0, F.col("ts")))).limit(100).select("row")


def time_order_seam(spark, sf):
    """A hundred rows in time order where those with a time end and those without one begin."""
    c = chat(spark, sf).withColumn("ts", F.when(F.col("row") % 3 > 0, F.col("ts")))
    timed = c.filter("ts IS NOT NULL").count()
    return K.in_time_order(c).offset(max(0, timed - 50)).limit(100).select("row", F.col("ts").isNotNull().alias("timed"))


def chat_totals(spark, sf):
    return chat(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last"))


def recent_distinct(spark, sf):
    return K.recent_distinct(chat(spark, sf).select("author", "row", "text"), "author").select("author", "row", "text")


def first_distinct(spark, sf):
    """The first five different texts of each role, compared whole but for white space around them."""
    t = turns(spark, sf).select("author", F.regexp_replace("text", STRIPPED, "").alias("text"), F.struct("conv_id", F.col("row").alias("turn")).alias("row"))
    return K.first_distinct(t, "author", 5).select("author", "rank", "text", "row.conv_id", "row.turn")


def active_participants(spark, sf):
    patterns = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("#"), F.right(F.col("n_nationkey").cast("string"), F.lit(1)), F.lit("0")).alias("pattern"))
    authors = table(spark, sf, "customer").select(F.concat(F.lit("cust#"), F.col("c_custkey").cast("string")).alias("author"))
    return E.active_participants(authors, patterns)


JOINED = "j AS (SELECT * FROM chat JOIN sp ON ts BETWEEN ws AND we)"
METRICS = "m AS (SELECT * FROM (SELECT author, count(*) AS mentions, count(*) FILTER (kind = 'purchase') AS pos, count(*) FILTER (kind = 'click') AS neg FROM chat GROUP BY author) JOIN (SELECT author, count(*) AS clusters FROM clusters GROUP BY author) USING (author))"


def _spiked(body: str) -> str:
    return with_views(f"+{CANDIDATES}, {NMS}, {SPIKES}, {JOINED} {body}", "chat").replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "chat_filter": (chat_filter, with_views("SELECT row, kind FROM chat WHERE kind IN ('click', 'purchase', 'view') AND ts IS NOT NULL AND regexp_matches(text, '[^\\x09-\\x0D\\x1C-\\x20\\x{85}\\p{Z}]')", "chat")),
    "mixed_spans": (mixed_spans, with_views(f"+{MIXED} SELECT id, count(*) AS n, sum(weight) AS weight FROM mx JOIN chat ON ts BETWEEN low AND high GROUP BY id", "chat")),
    "mixed_overlaps": (mixed_overlaps, f"WITH {MIXED} SELECT b.id, count(*) AS n, CAST(sum(a.id) AS BIGINT) AS seqs FROM mx a JOIN mx b ON a.high >= b.low AND a.low <= b.high GROUP BY b.id"),
    "video_spikes": (video_spikes, _videos("SELECT video, k, n, weight, rank FROM vs")),
    "video_top_messages": (video_top_messages, _videos("SELECT video, k, CAST(r AS INTEGER) AS rank, row FROM (SELECT *, row_number() OVER (PARTITION BY video, k ORDER BY weight DESC, ts, row) AS r, count(*) OVER (PARTITION BY video, k) AS c FROM vx) WHERE c >= 3 AND r <= 5")),
    "video_rollup": (video_rollup, _videos("SELECT video, id, count(*) FILTER (d BETWEEN ws AND we) AS peak, count(*) FILTER (d >= ws - 30 AND d < ws) AS buildup, count(*) FILTER (d BETWEEN anchor - 10 AND anchor + 5) AS tight FROM d JOIN vw USING (video) WHERE d BETWEEN ws - 30 AND greatest(we, anchor + 5) GROUP BY video, id")),
    "video_density": (video_density, with_views("SELECT video, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, bucket) AS r FROM (SELECT author % 7 AS video, CAST(floor(ts / 7200.0) AS BIGINT) AS bucket, count(*) AS n FROM chat GROUP BY 1, 2)) WHERE r = 1", "chat")),
    "video_sessions": (
        video_sessions,
        with_views("""+g AS (SELECT author % 7 AS video, ts, row, CASE WHEN ts - lag(ts) OVER (PARTITION BY author % 7 ORDER BY ts, row) > 600 THEN 1 ELSE 0 END AS new FROM chat), s AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY ts, row) AS session FROM g)
SELECT video, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last, list(ts ORDER BY ts, row)[CAST(count(*) // 2 AS BIGINT) + 1] AS anchor FROM s GROUP BY video, session""", "chat"),
    ),
    "video_opportunity": (
        video_opportunity,
        with_views(f"+{SESSIONS}, {METRICS}, o AS (SELECT author % 7 AS video, author, CAST(pos + neg AS DOUBLE) / clusters * (0.4 + 0.6 * CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0 END) AS raw FROM m WHERE clusters >= 2) SELECT video, author, CAST(floor(raw / max(raw) OVER (PARTITION BY video) * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM o", "chat"),
    ),
    "density_buckets": (density_buckets, with_views("SELECT CAST(floor(ts / 7200.0) AS BIGINT) AS bucket, count(*) AS n FROM chat GROUP BY 1", "chat")),
    "density_top": (density_top, with_views("SELECT CAST(floor(ts / 7200.0) AS BIGINT) AS bucket, count(*) AS n FROM chat GROUP BY 1 ORDER BY n DESC, bucket LIMIT 20", "chat")),
    "spike_candidates": (candidates, with_views(f"+{CANDIDATES} SELECT k, n, weight FROM candidates", "chat")),
    "spike_top_messages": (spike_top_messages, with_views(f"+{CANDIDATES} SELECT k, CAST(r AS INTEGER) AS rank, row FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY weight DESC, ts, row) AS r, count(*) OVER (PARTITION BY k) AS c FROM exploded) WHERE c >= 3 AND r <= 5", "chat")),
    "spike_nms": (spike_nms, _spiked("SELECT k, n, weight, rank FROM spikes")),
    "spike_window_rollup": (
        spike_window_rollup,
        _spiked("SELECT id, count(*) FILTER (ts BETWEEN ws AND we) AS peak, count(*) FILTER (ts >= ws - 30 AND ts < ws) AS buildup, count(*) FILTER (ts BETWEEN anchor - 10 AND anchor + 5) AS tight FROM chat JOIN sp ON ts BETWEEN ws - 30 AND greatest(we, anchor + 5) GROUP BY id"),
    ),
    "spike_shorts": (
        spike_shorts,
        _spiked("SELECT id, count(*) AS messages, min_by(row, r) AS first_row, greatest(0.0, any_value(anchor) - 10) AS clip_start, any_value(anchor) + 5 AS clip_end, CAST(22 AS BIGINT) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, row) AS r FROM j WHERE id <= 5) WHERE r <= 50 GROUP BY id"),
    ),
    "token_events_in_spikes": (token_events_in_spikes, _spiked("SELECT kind, count(*) AS n FROM j GROUP BY kind")),
    "reaction_totals": (reaction_totals, _spiked("SELECT text, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, text) AS r FROM (SELECT id, text, count(*) AS n FROM j GROUP BY ALL)) WHERE r <= 6 GROUP BY text")),
    "rolling_display_offsets": (
        rolling_display_offsets,
        _spiked(f"""SELECT id, row, CAST(floor(CASE WHEN n * 90.0 > {WIDTH} THEN i * ({WIDTH} / n) ELSE least(max(base - i * 90.0) OVER (PARTITION BY id ORDER BY ts, row ROWS UNBOUNDED PRECEDING) + i * 90.0, {WIDTH} - 0.1) END * 1000 + 0.5) AS BIGINT) AS at_ms
FROM (SELECT id, row, ts, ts - ws AS base, row_number() OVER (PARTITION BY id ORDER BY ts, row) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM j)"""),
    ),
    "chat_phases": (
        chat_phases,
        _spiked("SELECT id, CAST(p AS INTEGER) AS phase, array_to_string(list_slice(a, greatest(CAST(ceil((p + 1) * len(a) / 4) AS BIGINT) - 8, 0) + 1, CAST(ceil((p + 1) * len(a) / 4) AS BIGINT)), ',') AS shown FROM (SELECT id, list(row ORDER BY ts, row) AS a FROM j GROUP BY id), range(0, 4) q(p)"),
    ),
    "session_clusters": (session_clusters, with_views(f"+{SESSIONS} SELECT * FROM clusters", "chat")),
    "cluster_reactions": (cluster_reactions, with_views(f"+{SESSIONS} SELECT name, count(*) AS n FROM (SELECT DISTINCT c.author AS name, m.ts, m.author, m.text FROM clusters c JOIN chat m ON m.ts BETWEEN greatest(0.0, c.anchor - 10) AND c.anchor + 30) GROUP BY name", "chat")),
    "late_stream_flag": (late_stream_flag, with_views("SELECT author, count(*) FILTER (late) AS late, count(*) AS n FROM (SELECT author, ts > 0.75 * max(ts) OVER (PARTITION BY author) AS late FROM chat) GROUP BY author", "chat")),
    "mention_rank_assoc": (mention_rank_assoc, _spiked("SELECT author, array_to_string(list_slice(list_sort(list(DISTINCT id)), 1, 4), ',') AS ranks FROM j GROUP BY author")),
    "player_metrics": (player_metrics, with_views(f"+{SESSIONS}, {METRICS} SELECT * FROM m", "chat")),
    "opportunity_score": (
        opportunity_score,
        with_views(f"+{SESSIONS}, {METRICS}, o AS (SELECT author, CAST(pos + neg AS DOUBLE) / clusters * (0.4 + 0.6 * CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0 END) AS raw FROM m WHERE clusters >= 2) SELECT author, CAST(floor(raw / (SELECT max(raw) FROM o) * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM o", "chat"),
    ),
    "marketing_score": (
        marketing_score,
        with_views(f"+{SESSIONS}, {METRICS} SELECT author, CAST(floor((pos + neg) / mentions * (0.4 + 0.6 * CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0 END) * (1 + 0.2 * least(clusters, 3)) / log2(mentions + 2) * 1000000 + 0.5) AS BIGINT) AS raw_millionths FROM m", "chat"),
    ),
    "established": (established, with_views(f"+{SESSIONS}, {METRICS} SELECT author, mentions FROM (SELECT author, mentions, row_number() OVER (ORDER BY mentions DESC, author) AS r FROM m) WHERE r BETWEEN 3 AND 10", "chat")),
    "upper_medians": (upper_medians, with_views("SELECT kind, list_sort(list(weight))[CAST(count(*) // 2 AS BIGINT) + 1] AS upper_median FROM chat GROUP BY kind", "chat")),
    "compared_with_all": (compared_with_all, with_views("+u AS (SELECT author, count(*) AS n FROM chat GROUP BY author) SELECT author, n, n <= (SELECT list_sort(list(n))[CAST(count(*) // 2 AS BIGINT) + 1] FROM u) AS low, n > (SELECT avg(n) FROM u) AS above_mean FROM u", "chat")),
    "informative_recent": (
        informative_recent,
        with_views(f"""+t AS (SELECT author, regexp_replace(text, '{STRIPPED}', '', 'g') AS text, conv_id * 1000 + row AS row FROM turns),
i AS (SELECT * FROM t WHERE length(text) > 3 AND NOT regexp_full_match(text, 'ㅋ+|ㅎ+|[ㅠㅜ]+'))
SELECT author, row, text FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY row DESC) AS k FROM (SELECT author, text, max(row) AS row FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY row DESC) AS r FROM i) WHERE r <= 60 GROUP BY author, text)) WHERE k <= 5""", "turns"),
    ),
    "noise_words": (noise, with_views(f"+w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM turns) SELECT word FROM w WHERE length(regexp_replace(word, '{STRIPPED}', '', 'g')) <= 3 OR regexp_full_match(regexp_replace(word, '{STRIPPED}', '', 'g'), 'ㅋ+|ㅎ+|[ㅠㅜ]+')", "turns")),
    "time_order": (time_order, with_views("SELECT row FROM (SELECT row, CASE WHEN row % 3 > 0 THEN ts END AS ts FROM chat) ORDER BY ts NULLS LAST, row LIMIT 100", "chat")),
    "time_order_seam": (time_order_seam, with_views("+c AS (SELECT row, CASE WHEN row % 3 > 0 THEN ts END AS ts FROM chat) SELECT row, ts IS NOT NULL AS timed FROM (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, row) AS o FROM c), (SELECT greatest(0, count(ts) - 50) AS n FROM c) WHERE o > n AND o <= n + 100", "chat")),
    "chat_totals": (chat_totals, with_views("SELECT count(*) AS n, count(DISTINCT author) AS authors, max(ts) AS last FROM chat", "chat")),
    "recent_distinct": (
        recent_distinct,
        with_views("SELECT author, row, text FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY row DESC) AS k FROM (SELECT author, text, max(row) AS row FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY row DESC) AS r FROM chat) WHERE r <= 60 GROUP BY author, text)) WHERE k <= 5", "chat"),
    ),
    "first_distinct": (
        first_distinct,
        with_views(f"SELECT author, CAST(k AS INTEGER) AS rank, text, first.conv_id AS conv_id, first.turn AS turn FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY first) AS k FROM (SELECT author, regexp_replace(text, '{STRIPPED}', '', 'g') AS text, min({{'conv_id': conv_id, 'turn': row}}) AS first FROM turns GROUP BY 1, 2)) WHERE k <= 5", "turns"),
    ),
    "active_participants": (active_participants, "SELECT DISTINCT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE contains('cust#' || CAST(c_custkey AS VARCHAR), '#' || right(CAST(n_nationkey AS VARCHAR), 1) || '0'))"),
}
