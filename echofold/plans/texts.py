"""Queries of text functions, file formats and captions; files are built as columns from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from .. import stages
from ..functions import text as T
from ..operators import chat as K
from ..operators import enrich as N
from ..operators import subtitles as S
from ..sources import files, sinks
from .stories import TALK, scenes, talk
from .tables import chat, comments, quoted, segments, table, turns, with_views

VALUES = ["12.7", "-3", "abc", "", "  ", "NaN", "3661.9", " 59 "]
KOREAN = ["공태현", "버디", "이글", "홀인원", "OB", "웃음(ㅋ)", "역전"]


def _pick(values: list[str], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def loose_values(spark, sf):
    v = table(spark, sf, "nation").select("n_nationkey", _pick(VALUES, "n_nationkey").alias("v"))
    return v.select("n_nationkey", T.long_clock(F.col("v")).alias("clock"), T.valid_seconds(F.col("v")).alias("seconds"), T.or_dash(F.col("v")).alias("shown"))


def particles(spark, sf):
    w = table(spark, sf, "nation").select("n_nationkey", _pick(KOREAN, "n_nationkey").alias("w"))
    return w.select("n_nationkey", F.concat("w", T.particle(F.col("w"), "가", "이")).alias("subject"), F.concat("w", T.particle(F.col("w"), "를", "을")).alias("object"))


def pretty_labels(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.pretty(F.lower("n_name")).alias("label"))


def wrapped_text(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return b.select("item_id", F.array_join(T.wrapped(F.col("text")), "|").alias("lines"))


def previews(spark, sf):
    return comments(spark, sf).select("comment_id", T.preview(F.col("text"), 200).alias("preview"))


def titled_names(spark, sf):
    rows = turns(spark, sf).select("conv_id", "row", F.posexplode(T.titled(F.col("text"), L.SAMPLE_TITLED)).alias("place", "token"))
    return rows.select("conv_id", "row", "place", "token")


def thread_snippets(spark, sf):
    t = turns(spark, sf)
    snippet = F.struct(F.col("author").alias("authorDisplayName"), F.when(F.col("row") != 1, F.col("text")).alias("textDisplay"), F.lit(None).cast("string").alias("publishedAt"), F.lit("2024").alias("updatedAt"), F.when(F.col("row") > 0, F.col("row")).alias("likeCount"))
    key = lambda row: F.concat_ws(":", "conv_id", row)
    rows = t.select(key(F.col("row")).alias("comment_id"), F.when(F.col("row") > 0, key(F.lit(0))).alias("parent_comment_id"), (F.col("row") > 0).alias("is_reply"), F.lit(0).alias("reply_count"), snippet.alias("snippet"))
    return files.flatten_threads(rows)


def _replay(spark, sf):
    t = turns(spark, sf)
    kind = F.col("row") % 5
    emoji = F.struct(F.array(F.lit(":x:")).alias("shortcuts"), F.lit("E1").alias("emojiId"))
    said = F.struct(F.col("text"), F.lit(None).cast("struct<shortcuts:array<string>,emojiId:string>").alias("emoji"))
    runs = F.struct(F.array(said, F.struct(F.lit(None).cast("string").alias("text"), emoji.alias("emoji"))).alias("runs"))
    body = lambda **more: F.struct(F.concat_ws(":", "conv_id", "row").alias("id"), F.struct(F.col("author").alias("simpleText")).alias("authorName"), *(v.alias(k) for k, v in more.items()))
    price = F.struct(F.concat(F.lit("$"), F.col("row").cast("string")).alias("simpleText"))
    item = F.struct(
        F.when(kind == 0, body(message=runs)).alias("liveChatTextMessageRenderer"),
        F.when(kind == 1, body(message=runs, purchaseAmountText=price)).alias("liveChatPaidMessageRenderer"),
        F.when(kind == 2, body(headerSubtext=runs)).alias("liveChatMembershipItemRenderer"),
        F.when(kind == 3, body(purchaseAmountText=price)).alias("liveChatPaidStickerRenderer"),
        F.when(kind == 4, body(message=runs)).alias("liveChatViewerEngagementMessageRenderer"),
    )
    action = F.struct((F.col("conv_id") * 1001 + F.col("row")).cast("string").alias("videoOffsetTimeMsec"), F.array(F.struct(F.struct(item.alias("item")).alias("addChatItemAction"))).alias("actions"))
    return t.select(F.to_json(F.struct(action.alias("replayChatItemAction"))).alias("value"))


def replay_events(spark, sf):
    return files.parse_replay(_replay(spark, sf)).drop("channel", "usecs")


def replay_counts(spark, sf):
    return files.renderer_counts(files.parse_replay(_replay(spark, sf)))


def replay_lines(spark, sf):
    """Lines of a replay with blank, broken and other ones among them."""
    more = table(spark, sf, "nation").select(_pick(["", "  ", "{broken", '{"other": 1}'], "n_nationkey").alias("value"))
    return files.line_statistics(_replay(spark, sf).unionByName(more))


def _written_chat(spark, sf):
    """The files of an extraction of all conversations, with odd lines among them."""
    more = table(spark, sf, "nation").select(_pick(["", "  ", "{broken", '{"other": 1}'], "n_nationkey").alias("value"))
    return sinks.write_chat(_replay(spark, sf).unionByName(more), stages.of(spark).folder("chat"), {"status": "success"}, "v1", "u1")


def chat_csv(spark, sf):
    """Normalized chat written as one CSV file and read back."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(_written_chat(spark, sf)["normalized_csv"])
    return rows.select(F.col("timestamp_seconds").cast("double").alias("ts"), "timestamp_text", "author", F.coalesce("text", F.lit("")).alias("text"), "message_type", F.col("likes").cast("long").alias("likes"), F.coalesce("superchat_amount", F.lit("")).alias("amount"), "message_id", "video_id", "video_url", "source", "source_type")


def chat_json(spark, sf):
    """Raw and normalized JSON read back and joined."""
    written = _written_chat(spark, sf)
    raw, rows = (spark.read.option("multiLine", True).json(written[k]) for k in ("raw_json", "normalized_json"))
    return raw.select("message_id", "renderer_type", F.col("video_offset_ms").alias("ms"), F.md5("message_text").alias("digest")).join(rows.select("message_id", "timestamp_seconds", F.md5("text").alias("same")), "message_id")


def chat_log(spark, sf):
    """The counts of the log, read back."""
    lines = spark.read.text(_written_chat(spark, sf)["log"])
    rows = lines.select(F.regexp_extract("value", r"^ *([a-z_ ]+): +(\d+)$", 1).alias("name"), F.regexp_extract("value", r"(\d+)$", 1).alias("n"))
    return rows.filter("name <> ''").select("name", F.col("n").cast("long").alias("n"))


def segment_files(spark, sf):
    """A file for each benchmark item: its words as one segment, and one without fields."""
    b = table(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    first = F.struct(F.concat(F.lit("own_"), F.col("item_id").cast("string")).alias("id"), (F.col("item_id") * 1.5).alias("start"), (F.col("item_id") * 1.5 + 4).alias("end"), F.col("text"), F.array(F.struct(F.left("text", F.lit(3)).alias("word"), F.lit(0.5).alias("time"))).alias("words"))
    value = F.concat(F.lit("["), F.to_json(first), F.lit(", {}]"))
    rows = files.parse_segments(b.select(F.col("item_id").cast("string").alias("file"), value.alias("value")))
    return rows.select("file", "id", "seq", "start", "end", "text", F.coalesce(F.get("words", F.lit(0))["word"], F.lit("-")).alias("word"))


def _vtt(spark, sf):
    t = turns(spark, sf).withColumn("h", F.md5(F.concat_ws(":", "conv_id", "row")))
    at = lambda ms: F.format_string("00:00:%02d.%03d", F.floor(ms / 1000).cast("long"), (ms % 1000).cast("long"))
    start = F.col("row") * 2000
    cue = F.concat(at(start), F.lit(" --> "), at(start + 1500), F.lit("\nold\n"), F.left("h", F.lit(4)), F.lit("<"), at(start + 500), F.lit("><c> "), F.substring("h", F.lit(5), F.lit(4)), F.lit(" &amp;</c>"))
    files_ = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("v"))
    return files_.select(F.col("conv_id").cast("string").alias("video"), F.concat(F.lit("WEBVTT\n\n"), "v").alias("value"))


def caption_cues(spark, sf):
    return files.parse_captions(_vtt(spark, sf)).select("video", F.col("seq").cast("long").alias("seq"), "start", "end", "text")


def caption_words(spark, sf):
    return files.caption_words(files.parse_captions(_vtt(spark, sf)))


def caption_blocks(spark, sf):
    return S.srt(files.parse_captions(_vtt(spark, sf))).select("video", F.col("seq").cast("long").alias("seq"), "block")


def _cues(spark, sf, start, end, text):
    t = turns(spark, sf).withColumn("h", F.md5(F.concat_ws(":", "conv_id", "row")))
    return t.select(F.col("conv_id").cast("string").alias("video"), F.col("row").cast("int").alias("seq"), start.cast("double").alias("start"), end.cast("double").alias("end"), text.alias("text"))


def caption_collapse(spark, sf):
    """Cues that overlap in pairs, of different lengths."""
    row = F.col("row")
    cues = _cues(spark, sf, row * 2, F.when(row % 2 == 0, row * 2 + 3).otherwise(row * 2 + 2), F.left("h", F.conv(F.left("h", F.lit(1)), 16, 10).cast("int")))
    return S.collapse(cues).select("video", F.col("seq").cast("long").alias("seq"), "text")


def caption_sentences(spark, sf):
    """Three cues a sentence, each said twice."""
    row = F.col("row")
    text = F.concat(F.left("h", F.lit(8)), F.when(row % 3 == 2, ".").otherwise(""))
    cues = _cues(spark, sf, row * 2, row * 2 + 1.5, text)
    twice = cues.unionByName(cues.select("video", "seq", (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.25).alias("end"), "text").filter(~F.col("text").endswith("."))).withColumn("seq", (F.col("seq") * 2 + F.when(F.col("start") % 2 == 0, 0).otherwise(1)).cast("int"))
    return S.sentences(twice)


def caption_thinning(spark, sf):
    """Words 0.4 ms apart: one in three stays."""
    t = turns(spark, sf).select(F.col("conv_id").cast("string").alias("video"), (F.col("row") * 0.0004).alias("time"), F.col("row").cast("string").alias("word"))
    return S.thin_words(t).select("video", "word")


def caption_assignment(spark, sf):
    """Messages as words of the segments in which they begin."""
    s = segments(spark, sf).select(F.lit("v").alias("video"), F.format_string("seg_%04d", "seq").alias("id"), "start", "end")
    w = chat(spark, sf).select(F.lit("v").alias("video"), F.col("ts").alias("time"), F.col("row").cast("string").alias("word"))
    out = S.assign_words(s, w, 3600.0)
    return out.select("id", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n"), F.get("words", F.lit(0))["time"].alias("first"))


def _raw_chat(spark, sf):
    c = chat(spark, sf)
    ts = F.when(F.col("row") % 7 == 0, "").when(F.col("row") % 7 == 1, "x").when(F.col("row") % 7 == 2, "-1").otherwise(F.floor("ts").cast("string"))
    text = F.when(F.col("row") % 11 == 0, " \t\n").otherwise(F.col("text"))
    return c.select(F.col("row").cast("string").alias("key"), ts.alias("time_seconds"), text.alias("message"), F.when(F.col("row") % 5 > 0, F.col("author").cast("string")).alias("author"), F.when(F.col("row") % 3 == 0, "n/a").otherwise(F.col("author").cast("string")).alias("likes"))


def chat_table(spark, sf):
    """Rows that have a time, and all with a time of 0 for those that lack one."""
    raw = _raw_chat(spark, sf)
    return files.chat_rows(raw).withColumn("all", F.lit(False)).unionByName(files.chat_rows(raw, True).withColumn("all", F.lit(True)))


def comment_totals(spark, sf):
    return files.comment_totals(comments(spark, sf))


def words_in_spikes(spark, sf):
    rows = K.interval_join(talk(spark, sf), scenes(spark, sf), 60.0, "ws", "we")
    return N.words_in_spikes(rows, L.SAMPLE_EVENTS)


V = f"[{quoted(VALUES)}][CAST(n_nationkey % {len(VALUES)} AS INTEGER) + 1]"
CUES = "cue AS (SELECT CAST(conv_id AS VARCHAR) AS video, row, row * 2.0 AS start, md5(conv_id || ':' || row) AS h FROM turns)"
_closed = {"공태현": True, "버디": False, "이글": True, "홀인원": True, "OB": False, "웃음(ㅋ)": False, "역전": True}

CLOCK_SQL = "(CASE WHEN {0} >= 3600 THEN printf('%02d:', ({0}) // 3600) ELSE '' END || printf('%02d:%02d', ({0}) % 3600 // 60, ({0}) % 60))"
KIND_SQL = "['text', 'superchat', 'membership', 'sticker'][CAST(row % 5 AS INTEGER) + 1]"


QUERIES = {
    "loose_values": (
        loose_values,
        f"""SELECT n_nationkey, CASE WHEN s IS NULL THEN '--:--' ELSE printf('%d:%02d:%02d', CAST(trunc(s) AS BIGINT) // 3600, CAST(trunc(s) AS BIGINT) % 3600 // 60, CAST(trunc(s) AS BIGINT) % 60) END AS clock, CASE WHEN s >= 0 THEN s END AS seconds, CASE WHEN trim(v) = '' THEN '—' ELSE trim(v) END AS shown
FROM (SELECT n_nationkey, v, CASE WHEN isnan(try_cast(trim(v) AS DOUBLE)) THEN NULL ELSE try_cast(trim(v) AS DOUBLE) END AS s FROM (SELECT n_nationkey, {V} AS v FROM nation))""",
    ),
    "particles": (
        particles,
        f"SELECT n_nationkey, w || CASE WHEN c THEN '이' ELSE '가' END AS subject, w || CASE WHEN c THEN '을' ELSE '를' END AS object FROM (SELECT n_nationkey, [{quoted(KOREAN)}][CAST(n_nationkey % {len(KOREAN)} AS INTEGER) + 1] AS w, [{', '.join(str(_closed[k]).lower() for k in KOREAN)}][CAST(n_nationkey % {len(KOREAN)} AS INTEGER) + 1] AS c FROM nation)",
    ),
    "pretty_labels": (pretty_labels, "SELECT n_nationkey, 'Nation ' || string_split(n_name, '_')[2] AS label FROM nation"),
    "wrapped_text": (
        wrapped_text,
        r"""WITH RECURSIVE w AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM benchmark),
f AS (SELECT item_id, w, 0 AS i, []::VARCHAR[] AS lines, '' AS now FROM w UNION ALL
  SELECT item_id, w, i + 1, CASE WHEN length(now) + length(w[i + 1]) + 1 > 55 THEN list_append(lines, now) ELSE lines END, CASE WHEN length(now) + length(w[i + 1]) + 1 > 55 OR now = '' THEN w[i + 1] ELSE now || ' ' || w[i + 1] END FROM f WHERE i < len(w))
SELECT item_id, array_to_string(CASE WHEN now = '' THEN lines ELSE list_append(lines, now) END, '|') AS lines FROM f WHERE i = len(w)""",
    ),
    "previews": (previews, with_views(r"SELECT comment_id, CASE WHEN length(text) > 200 THEN regexp_replace(left(text, 200), '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+\z', '') || '…' ELSE text END AS preview FROM comments", "comments")),
    "titled_names": (titled_names, with_views(f"SELECT conv_id, row, CAST(i - 1 AS INTEGER) AS place, token FROM (SELECT conv_id, row, unnest(f) AS token, generate_subscripts(f, 1) AS i FROM (SELECT conv_id, row, regexp_extract_all(text, '{L.SAMPLE_TITLED}') AS f FROM turns))", "turns")),
    "thread_snippets": (
        thread_snippets,
        with_views("SELECT conv_id || ':' || row AS comment_id, CASE WHEN row > 0 THEN conv_id || ':0' END AS parent_comment_id, author, CASE WHEN row <> 1 THEN text ELSE '' END AS text, '' AS published_at, '2024' AS updated_at, CAST(row AS BIGINT) AS like_count, row > 0 AS is_reply, CAST(0 AS BIGINT) AS reply_count FROM turns", "turns"),
    ),
    "replay_events": (
        replay_events,
        with_views("""SELECT conv_id || ':' || row AS message_id, (conv_id * 1001 + row) / 1000 AS ts, ['text', 'superchat', 'membership', 'sticker'][CAST(row % 5 AS INTEGER) + 1] AS kind, author, CASE WHEN row % 5 < 3 THEN text || ':x:' ELSE '' END AS text, CASE WHEN row % 5 IN (1, 3) THEN '$' || row ELSE '' END AS amount FROM turns WHERE row % 5 < 4""", "turns"),
    ),
    "replay_counts": (replay_counts, with_views("SELECT ['text', 'superchat', 'membership', 'sticker'][CAST(row % 5 AS INTEGER) + 1] AS kind, count(*) AS n FROM turns WHERE row % 5 < 4 GROUP BY 1", "turns")),
    "replay_lines": (replay_lines, "SELECT (SELECT count(*) FROM conversations) + count(*) AS lines, count(*) FILTER (n_nationkey % 4 < 2) AS blank, count(*) FILTER (n_nationkey % 4 = 2) AS bad, count(*) FILTER (n_nationkey % 4 = 3) AS other FROM nation"),
    "chat_csv": (
        chat_csv,
        with_views(f"""SELECT (conv_id * 1001 + row) / 1000 AS ts, {CLOCK_SQL.format("(conv_id * 1001 + row) // 1000")} AS timestamp_text, author, CASE WHEN row % 5 < 3 THEN text || ':x:' ELSE '' END AS text, {KIND_SQL} AS message_type, CAST(0 AS BIGINT) AS likes, CASE WHEN row % 5 IN (1, 3) THEN '$' || row ELSE '' END AS amount, conv_id || ':' || row AS message_id, 'v1' AS video_id, 'u1' AS video_url, 'live_chat_replay' AS source, 'live_chat' AS source_type FROM turns WHERE row % 5 < 4""", "turns"),
    ),
    "chat_json": (
        chat_json,
        with_views(f"""SELECT conv_id || ':' || row AS message_id, ['liveChatTextMessageRenderer', 'liveChatPaidMessageRenderer', 'liveChatMembershipItemRenderer', 'liveChatPaidStickerRenderer'][CAST(row % 5 AS INTEGER) + 1] AS renderer_type, conv_id * 1001 + row AS ms, md5(CASE WHEN row % 5 < 3 THEN text || ':x:' ELSE '' END) AS digest, (conv_id * 1001 + row) / 1000 AS timestamp_seconds, md5(CASE WHEN row % 5 < 3 THEN text || ':x:' ELSE '' END) AS same FROM turns WHERE row % 5 < 4""", "turns"),
    ),
    "chat_log": (
        chat_log,
        with_views("""+n AS (SELECT (SELECT count(*) FROM turns) AS t, (SELECT count(*) FROM turns WHERE row % 5 < 4) AS e, count(*) AS a, count(*) FILTER (n_nationkey % 4 = 2) AS bad FROM nation)
SELECT 'lines_read' AS name, t + a AS n FROM n UNION ALL SELECT 'lines_skipped', a - bad FROM n UNION ALL SELECT 'lines_error', bad FROM n UNION ALL SELECT 'events_extracted', e FROM n UNION ALL SELECT 'normalized records', e FROM n""", "turns"),
    ),
    "segment_files": (
        segment_files,
        """SELECT CAST(item_id AS VARCHAR) AS file, 'own_' || item_id AS id, 1 AS seq, item_id * 1.5 AS start, item_id * 1.5 + 4 AS "end", coalesce(text, '') AS text, left(coalesce(text, ''), 3) AS word FROM benchmark UNION ALL SELECT CAST(item_id AS VARCHAR), 'seg_0002', 2, 0.0, 0.0, '', '-' FROM benchmark""",
    ),
    "caption_cues": (caption_cues, with_views(f"+{CUES} SELECT video, row + 1 AS seq, start, start + 1.5 AS \"end\", left(h, 4) || ' ' || substring(h, 5, 4) || ' &' AS text FROM cue", "turns")),
    "caption_words": (caption_words, with_views(f"+{CUES} SELECT video, start + 0.5 AS time, substring(h, 5, 4) || ' &amp;' AS word FROM cue UNION ALL SELECT video, start, left(h, 4) FROM cue", "turns")),
    "caption_blocks": (
        caption_blocks,
        with_views(f"+{CUES} SELECT video, row + 1 AS seq, (row_number() OVER (PARTITION BY video ORDER BY row)) || chr(10) || printf('00:00:%02d,000 --> 00:00:%02d,500', row * 2, row * 2 + 1) || chr(10) || left(h, 4) || ' ' || substring(h, 5, 4) || ' &' AS block FROM cue", "turns"),
    ),
    "caption_collapse": (
        caption_collapse,
        with_views(f"+{CUES}, p AS (SELECT video, row, left(h, CAST('0x' || left(h, 1) AS INTEGER)) AS text FROM cue) SELECT video, row AS seq, text FROM (SELECT *, row_number() OVER (PARTITION BY video, row // 2 ORDER BY length(text) DESC, row) AS r FROM p) WHERE r = 1", "turns"),
    ),
    "caption_sentences": (
        caption_sentences,
        with_views(f"+{CUES} SELECT video, printf('seg_%04d', k) AS id, CAST(k AS INTEGER) AS seq, start, \"end\", text FROM (SELECT video, row // 3 + 1 AS k, min(start) AS start, max(start) + 1.5 AS \"end\", string_agg(left(h, 8), ' ' ORDER BY row) || CASE WHEN count(*) = 3 THEN '.' ELSE '' END AS text FROM cue GROUP BY video, row // 3)", "turns"),
    ),
    "caption_thinning": (caption_thinning, with_views("SELECT CAST(conv_id AS VARCHAR) AS video, CAST(row AS VARCHAR) AS word FROM turns WHERE row % 3 = 0", "turns")),
    "caption_assignment": (caption_assignment, with_views("SELECT printf('seg_%04d', seq) AS id, count(ts) AS n, min(ts) AS first FROM segments LEFT JOIN chat ON ts >= start AND ts < \"end\" GROUP BY seq", "chat", "segments")),
    "chat_table": (
        chat_table,
        with_views(r"""+r AS (SELECT CAST(row AS VARCHAR) AS key, CASE WHEN row % 7 > 2 THEN floor(ts) WHEN row % 7 = 2 THEN -1.0 END AS ts, CASE WHEN row % 5 > 0 THEN CAST(author AS VARCHAR) ELSE 'unknown' END AS author, text, 'text' AS kind, CASE WHEN row % 3 = 0 THEN 0 ELSE author END AS likes FROM chat WHERE row % 11 > 0)
SELECT key, ts, author, text, kind, likes, false AS "all" FROM r WHERE ts >= 0 UNION ALL SELECT key, coalesce(ts, 0), author, text, kind, likes, true FROM r WHERE coalesce(ts, 0) >= 0""", "chat"),
    ),
    "comment_totals": (comment_totals, with_views("SELECT count(*) FILTER (NOT is_reply) AS top_level, count(*) FILTER (is_reply) AS replies, count(*) AS total, count(DISTINCT author) AS authors, CAST(sum(like_count) AS BIGINT) AS likes, max(like_count) AS max_likes FROM comments", "comments")),
    "words_in_spikes": (
        words_in_spikes,
        with_views(f"""+{TALK}, w AS (SELECT unnest(regexp_split_to_array(regexp_replace(text, '^[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+|[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+\\z', '', 'g'), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+')) AS w FROM talk JOIN sc ON ts BETWEEN ws AND we),
c AS (SELECT CASE WHEN w IN ({quoted(L.SAMPLE_EVENTS)}) THEN 'event' ELSE 'word' END AS kind, CASE w {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SAMPLE_EVENTS.items())} ELSE w END AS word, count(*) AS n FROM w WHERE length(w) >= 2 GROUP BY 1, 2)
SELECT kind, word, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, word) AS r FROM c) WHERE r <= CASE WHEN kind = 'event' THEN 10 ELSE 15 END""", "turns"),
    ),
}
