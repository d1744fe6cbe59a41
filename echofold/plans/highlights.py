"""Queries of matching, classification, priorities, plans and people."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicons as L
from .. import phrases as P
from ..functions import text as T
from ..operators import entities as E
from ..operators import highlights as H
from ..operators import matching as M
from .tables import chat, comments, quoted, segments, sql_labels, table, turns, with_views

NEAR, MEDIUM = 1200.0, 600.0
CATEGORIES, ACTS = L.SAMPLE_CATEGORIES, L.SAMPLE_ACTS
PLAYERS = ["Herea", "Thion", "Oron", "The"]
#: Unlike those, these occur in lower-cased words.
WORD_PLAYERS = ["ther", "tion"]
EVENTS = ["tion", "ring", "par", "lead", "green", "pin"]
MATCH_WORDS = L.MATCH_STOPWORDS

FIRST_IN = "hit AS (SELECT row, min(seq) AS in_seq FROM chat JOIN segments ON ts BETWEEN start AND \"end\" GROUP BY row)"
NEAREST = f"near AS (SELECT row, seq AS near_seq, dist FROM (SELECT row, seq, abs((start + \"end\") / 2 - ts) AS dist, row_number() OVER (PARTITION BY row ORDER BY abs((start + \"end\") / 2 - ts), seq) AS r FROM chat JOIN segments ON abs((start + \"end\") / 2 - ts) <= {NEAR}) WHERE r = 1)"
MATCHED = f"""matched AS (SELECT c.row, coalesce(printf('seg_%04d', s.seq), printf('lc_ts_%06d', CAST(floor(ts) AS BIGINT))) AS segment, coalesce(start, greatest(0.0, ts - 10)) AS low, coalesce("end", ts + 20) AS high,
  CASE WHEN in_seq IS NOT NULL THEN 'high' WHEN dist <= {MEDIUM} THEN 'medium' WHEN dist IS NOT NULL THEN 'low' ELSE 'high' END AS confidence
  FROM chat c LEFT JOIN hit USING (row) LEFT JOIN near USING (row) LEFT JOIN segments s ON s.seq = coalesce(in_seq, near_seq))"""
TIMES = f"{FIRST_IN}, {NEAREST}, {MATCHED}"

EMOTION = "greatest(100, least(500, 100 + CASE WHEN len(text) - len(replace(text, 'ㅋ', '')) > 1 THEN least((len(text) - len(replace(text, 'ㅋ', '')) - 1) * 25, 200) ELSE 0 END + least((len(text) - len(replace(replace(text, 'ㅠ', ''), 'ㅜ', ''))) * 35, 150) + least((len(text) - len(replace(text, '!', ''))) * 20, 100) + least((len(text) - len(replace(text, ';;', ''))) // 2 * 50, 100) + CASE WHEN len(text) > 100 THEN 50 ELSE 0 END))"
DOUBT = "(len(text) > 80 AND (contains(text, ';;') OR len(text) - len(replace(text, '..', '')) >= 4 OR " + " OR ".join(f"contains(text, '{w}')" for w in L.CONTRAST) + "))"
CLASSIFIED = f"""found AS (SELECT *, {sql_labels(CATEGORIES, "lower(replace(replace(replace(text, '않됬', '안됐'), '됬', '됐'), '겟', '겠'))")} AS f FROM comments),
settled AS (SELECT *, CASE WHEN list_contains(f, 'clutch_hype') AND {DOUBT} THEN CASE WHEN list_has_any(f, ['analytical', 'critical', 'controversial', 'dramatic']) THEN list_filter(f, lambda x: x <> 'clutch_hype')
  WHEN f[1] = 'clutch_hype' THEN CASE WHEN len(f) > 1 THEN list_filter(f, lambda x: x <> 'clutch_hype') ELSE ['analytical'] END ELSE f END WHEN len(f) = 0 THEN ['representative'] ELSE f END AS categories FROM found),
classified AS (SELECT comment_id, author, text, like_count AS likes, categories, categories[1] AS category, CAST({EMOTION} AS BIGINT) AS emotion FROM settled)"""
WEIGHTS = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.CATEGORY_WEIGHT.items()) + " ELSE 90 END"
SCORED = f"scored AS (SELECT *, least(100.0, 40 * likes / (SELECT greatest(max(likes), 1) FROM classified) + (emotion * 8 + {WEIGHTS} * 10) / 100.0) AS priority FROM classified)"
ACT = f"acted AS (SELECT *, coalesce(({sql_labels(ACTS, 'lower(text)')})[1], CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.ACT_OF_CATEGORY.items()) + " ELSE 'act_2_buildup' END) AS act FROM scored)"
RECORDS = f"{CLASSIFIED}, {SCORED}"


def point_in_interval(spark, sf):
    return M.point_in_interval(chat(spark, sf), segments(spark, sf))


def nearest_segment(spark, sf):
    return M.nearest(chat(spark, sf), segments(spark, sf), NEAR)


def matched(spark, sf):
    return M.match_by_time(chat(spark, sf), segments(spark, sf), None, NEAR, MEDIUM)


def match_cascade(spark, sf):
    return matched(spark, sf)


def interval_overlap_context(spark, sf):
    """Segments that overlap the span before each of the first days' noons."""
    spans = segments(spark, sf).select(F.col("seq").alias("id"), (F.col("start") - 9000).alias("low"), (F.col("start") + 4000).alias("high"))
    rows = M.overlaps(segments(spark, sf), spans)
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("seq")), ",").alias("seqs"))


def _sides(spark, sf, expression):
    d = comments(spark, sf).select(F.col("comment_id").alias("id"), T.once(expression(F.col("text"))).alias("x"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), T.once(expression(F.coalesce("text", F.lit("")))).alias("x"))
    return d, b


def signal_match(spark, sf):
    d, b = _sides(spark, sf, lambda c: T.signals(c, PLAYERS, EVENTS))
    out = M.signal_match(d.withColumnRenamed("x", "signals"), b.withColumnRenamed("x", "signals"))
    return out.withColumn("signals", F.array_join("signals", ","))


def _word_sides(spark, sf):
    return (x.withColumnRenamed("x", "words") for x in _sides(spark, sf, lambda c: T.content_words(c, MATCH_WORDS)))


def jaccard_match(spark, sf):
    """The best item for every comment that has a word in common with any, however low the score."""
    out = M.best_word_match(*_word_sides(spark, sf), WORD_PLAYERS)
    return out.select("id", "seq", F.col("common").cast("long").alias("common"), F.col("either").cast("long").alias("either"), F.col("named").cast("long").alias("named"), F.array_join("overlap", ",").alias("overlap"))


def two_pass_match(spark, sf):
    """Signals first, words where they are better; words never count for more than low."""
    a = signal_match(spark, sf).select("id", "seq", "confidence")
    b = M.word_confidence(M.word_match(*_word_sides(spark, sf), WORD_PLAYERS))
    return M.coalesce_matches(a, b)


def classified(spark, sf):
    rows = H.classify(comments(spark, sf), CATEGORIES).withColumn("emotion", T.emotion_hundredths(F.col("text")).cast("long"))
    return rows.select("comment_id", "author", "text", F.col("like_count").alias("likes"), "categories", "category", "emotion")


def records(spark, sf):
    return H.priority(classified(spark, sf), F.lit("none"))


def category_classify(spark, sf):
    return classified(spark, sf).select("comment_id", "category", F.array_join("categories", "|").alias("categories"))


def emotion_strength(spark, sf):
    return classified(spark, sf).select("comment_id", "emotion")


def caption(spark, sf):
    return comments(spark, sf).select("comment_id", T.caption(F.col("text")).alias("caption"))


def priority_score(spark, sf):
    return records(spark, sf).select("comment_id", "priority")


def editor_notes(spark, sf):
    rows = classified(spark, sf)
    return rows.select("comment_id", H.lookup(L.USAGE, F.col("category"), "mid_roll_summary_card").alias("usage"), H.editor_notes(F.col("likes"), H.detect_players(F.col("text"), PLAYERS), F.col("category"), F.col("emotion")).alias("notes"))


def act_assignment(spark, sf):
    return H.act(records(spark, sf), ACTS).select("comment_id", "act", H.narrative_weight(F.col("priority")).alias("weight"))


def act_summary(spark, sf):
    return H.act_summary(H.act(records(spark, sf), ACTS))


def act_bridges(spark, sf):
    return H.bridges(H.act(records(spark, sf), ACTS))


def category_distribution(spark, sf):
    return H.act(records(spark, sf), ACTS).groupBy("act", "category").agg(F.count("*").alias("n"))


def opening_hook(spark, sf):
    return H.first_of(records(spark, sf), ("dramatic", "analytical", "controversial", "funny", "clutch_hype"), 30).select("comment_id", "category")


def turning_points(spark, sf):
    return H.turning_points(records(spark, sf)).select("comment_id", "category")


def closing_note(spark, sf):
    return H.closing_note(records(spark, sf)).select("comment_id", "category")


def concept_shorts(spark, sf):
    return H.concept_shorts(records(spark, sf))


def player_arcs(spark, sf):
    """Records that name each player: number, arc and best."""
    named = records(spark, sf).select("comment_id", "category", "priority", F.explode(H.detect_players(F.col("text"), PLAYERS)).alias("player"))
    best = named.groupBy("player").agg(F.max_by("comment_id", F.struct("priority", -F.col("comment_id"))).alias("peak"))
    return H.sentiment_arc(named, "player").join(best, "player")


def player_sentiment_arc(spark, sf):
    return H.sentiment_arc(classified(spark, sf), "author")


def combined_sources(spark, sf):
    """Comments and chat as one table; columns that one side lacks are null."""
    a = comments(spark, sf).select("comment_id", "like_count", F.lit("comment").alias("source_type"))
    b = chat(spark, sf).select(F.col("row").alias("comment_id"), "ts", F.lit("live_chat").alias("source_type"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source_type").agg(F.count("*").alias("n"), F.count("like_count").alias("with_likes"), F.count("ts").alias("with_time"))


def _moments(spark, sf):
    rows = matched(spark, sf).join(chat(spark, sf).select("row", "kind", "weight", "author"), "row")
    players = F.array(F.concat(F.lit("p"), F.col("author") % 3))
    signals = F.array(F.concat(F.lit("event:"), "kind"), F.concat(F.lit("hole:"), "kind"))
    return H.moments(rows.select("segment", F.col("row").alias("comment_id"), (F.col("author") % 5).alias("likes"), F.col("weight").alias("priority"), F.col("kind").alias("category"), (F.col("author") % 7).alias("emotion"), "confidence", players.alias("players"), signals.alias("signals")))


def segment_moments(spark, sf):
    """Chat by segment: kinds stand for categories and events, weights for priorities."""
    return _moments(spark, sf).withColumns({"players": F.array_join("players", "|"), "events": F.array_join("events", "|"), "ids": F.md5(F.array_join("ids", "|"))})


def moment_notes(spark, sf):
    spans = segments(spark, sf).select(F.format_string("seg_%04d", "seq").alias("segment"), "start", "end")
    return H.moment_notes(_moments(spark, sf), spans)


def render_gate(spark, sf):
    return H.renderable(matched(spark, sf)).select("row", "can_render", "reason")


def render_plan(spark, sf):
    return H.renderable(matched(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


def clip_overlap_select(spark, sf):
    """For each user, of the first five clips by weight those that don't overlap one kept before by half."""
    rows = chat(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("weight"), "row")))
    clips = rows.select("author", "place", F.col("row").alias("seq"), (F.col("ts") - 200000).alias("low"), (F.col("ts") + 200000).alias("high"))
    return H.select_clips(clips, "author")


def message_layer(spark, sf):
    return turns(spark, sf).select("conv_id", "row", E.message_layer(F.col("text"), ["for", "what", "how"], ["the", "best", "on"]).alias("layer"))


def layer_ratio(spark, sf):
    """Mixed messages count in both layers."""
    rows = message_layer(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("layer").isin("event", "mixed")).alias("event"), F.count_if(F.col("layer").isin("internal", "mixed")).alias("internal"))
    return rows.withColumn("buzz", E.buzz(F.col("event") / F.col("n"), F.col("n") >= 3, F.col("internal") / F.col("n"), F.col("n") >= 5))


def reaction_profile(spark, sf):
    return E.reaction_counts(turns(spark, sf), reactions={"the": "article", "and": "and", "for": "for"}, more={"der": "artikel"})


LETTERS = "translate(md5(n_name), '0123456789', 'ghijklmnop')"


def roster(spark, sf):
    """Invented names, of four letters."""
    return table(spark, sf, "nation").select(F.expr(f"left({LETTERS}, 4)").alias("name"))


def alias_resolution(spark, sf):
    """Names in many disguises against the names and a few aliases."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.expr(f"left({LETTERS}, 4)").alias("name"))
    shapes = [F.col("name"), F.concat("name", F.lit("프로")), F.expr("right(name, 2)"), F.expr("right(name, 3) || '선수님'"), F.expr("right(name, 3)"), F.concat(F.lit("x"), "name"), F.expr("'x' || name || '형'"), F.expr("'y' || name || '님'"), F.lit("z")]
    aliases = n.filter("k % 2 = 1").select(F.expr("'x' || name").alias("alias"), F.upper("name").alias("canonical"))
    aliases = aliases.unionByName(n.filter("k % 3 = 0").select(F.expr("'y' || name || '프로'").alias("alias"), F.concat(F.lit("Y "), "name").alias("canonical")))
    aliases = aliases.unionByName(n.filter("k % 5 = 0").select(F.expr("name || '선수'").alias("alias"), F.concat(F.lit("Z "), "name").alias("canonical")))
    return E.resolve(n.select(F.explode(F.array(*shapes)).alias("token")), roster(spark, sf), aliases)


def fuzzy_resolution(spark, sf):
    """Names of eight letters with the last one changed."""
    n = table(spark, sf, "nation").select(F.expr(f"left({LETTERS}, 8)").alias("name"))
    return E.resolve_fuzzy(n.select(F.expr("left(name, 7) || '_'").alias("token")), n)


def corrected_names(spark, sf):
    """The same names, and some that are like none."""
    n = table(spark, sf, "nation").select(F.expr(f"left({LETTERS}, 8)").alias("name"))
    tokens = n.select(F.explode(F.array(F.col("name"), F.expr("left(name, 7) || '_'"), F.expr("left(name, 7)"), F.expr("'_' || name"))).alias("token"))
    return E.corrected(tokens, n)


def name_mentions(spark, sf):
    """Words of the benchmark, of four letters, anywhere in the turns."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("name")).filter("length(name) = 4").distinct()
    return E.mentions(turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("row")).alias("row"), "text"), words)


def commentary_mood(spark, sf):
    return turns(spark, sf).select("conv_id", "row", E.mood(F.col("text"), ["the", "ing", "and", "best"], ["der", "ei"]).alias("mood"))


def context_names(spark, sf):
    """Which of the roster's names that end alike each conversation means."""
    t = turns(spark, sf)
    texts = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ").alias("text"))
    names = spark.createDataFrame([(x,) for x in L.SAMPLE_ROSTER], "name string")
    aliases = spark.createDataFrame(list(L.SAMPLE_ALIASES.items()), "alias string, canonical string")
    tokens = texts.select("conv_id", F.explode(F.array(F.lit("eon"), F.lit("heonter"), F.lit("nt"))).alias("token"))
    known = t.filter(F.col("row") == 0).filter(F.contains("text", F.lit("heon"))).select("conv_id", F.lit("heon").alias("name"))
    candidates = E.candidates_of(tokens, names, aliases, ["ter"], L.SAMPLE_FORMS)
    return E.disambiguate_in(tokens, candidates, texts, known, "conv_id")


def video_ids(spark, sf):
    """Ids back from every form of address, and from one that is none."""
    forms = ["https://host/watch?v={}&t=1", "https://youtu.be/{}?x", "https://www.youtube.com/live/{}", "  {} ", "https://host/{}/other"]
    form = F.get(F.array(*map(F.lit, forms)), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf, "pages").select("page_id", T.video_id(F.replace(form, F.lit("{}"), F.left(F.md5(F.col("url")), F.lit(11)))).alias("found"))


def clock_formats(spark, sf):
    t = chat(spark, sf)
    tenths = F.floor(F.col("ts") * 10) / 10
    return t.select("row", T.clock(F.col("ts")).alias("clock"), T.minutes_clock(F.col("ts")).alias("minutes"), T.srt_clock(tenths).alias("srt"), T.long_clock(F.floor("ts").cast("string")).alias("long"))


def signals_sql(column: str) -> str:
    low = f"lower({column})"
    named = ", ".join(f"CASE WHEN contains({low}, '{p.lower()}') THEN 'player:{p}' END" for p in PLAYERS)
    event = ", ".join(f"CASE WHEN contains({low}, '{e}') THEN 'event:{e}' END" for e in EVENTS)
    holes = ", ".join(f"list_transform(regexp_extract_all({low}, '{p}', 1), lambda h: 'hole:' || h)" for p in (r"(\d{1,2})\s*번\s*홀", r"hole\s*(\d{1,2})", r"#(\d{1,2})", r"(\d{1,2})(?:st|nd|rd|th)\s+hole"))
    return f"list_distinct(list_filter(flatten([[{named}], {holes}, [{event}]]), lambda x: x IS NOT NULL))"


def words_sql(column: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2 AND t NOT IN ({quoted(MATCH_WORDS)}) AND NOT regexp_full_match(t, '\p{{Nd}}+')))"


SIGNALS = f"""a AS (SELECT DISTINCT id, s FROM (SELECT comment_id AS id, unnest({signals_sql("text")}) AS s FROM comments)), b AS (SELECT DISTINCT seq, s FROM (SELECT item_id AS seq, unnest({signals_sql("text")}) AS s FROM benchmark)),
sig AS (SELECT id, seq, score, signals, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS r FROM (SELECT id, seq, CAST(sum(CASE WHEN s LIKE 'player:%' THEN 3 WHEN s LIKE 'hole:%' THEN 4 ELSE 2 END) AS BIGINT) AS score, array_to_string(list_sort(list(s)), ',') AS signals FROM a JOIN b USING (s) GROUP BY id, seq)) WHERE r = 1)"""
JACCARD = f"""wa AS (SELECT id, len(w) AS na, unnest(w) AS t FROM (SELECT comment_id AS id, {words_sql("text")} AS w FROM comments)), wb AS (SELECT seq, len(w) AS nb, unnest(w) AS t FROM (SELECT item_id AS seq, {words_sql("text")} AS w FROM benchmark)),
jac AS (SELECT id, seq, common, either, named, overlap FROM (SELECT *, na + nb - common AS either, row_number() OVER (PARTITION BY id ORDER BY common / (na + nb - common) + named * 0.06 DESC, seq) AS r FROM (
  SELECT id, seq, count(*) AS common, any_value(na) AS na, any_value(nb) AS nb, {" + ".join(f"max(CAST(contains(t, '{p}') AS BIGINT))" for p in WORD_PLAYERS)} AS named, array_to_string(list_slice(list_sort(list(t)), 1, 6), ',') AS overlap FROM wa JOIN wb USING (t) GROUP BY id, seq)) WHERE r = 1)"""
SQUEEZED = r"trim(regexp_replace(regexp_replace(text, 'ㅋ{2,}', 'ㅋ', 'g'), '[ㅠㅜ]{2,}', 'ㅠ', 'g'), E' \t\n\r\x0b\x0c')"
CAPTION = rf"""SELECT comment_id, CASE WHEN cut = '' THEN left(text, 45) ELSE cut END AS caption FROM (SELECT *, CASE WHEN length(chosen) > 45 THEN rtrim(left(chosen, 45), E' \t\n\r\x0b\x0c') || '…' ELSE chosen END AS cut FROM (
SELECT *, CASE WHEN length(sentence) >= 4 THEN sentence ELSE squeezed END AS chosen FROM (SELECT *, trim(regexp_extract(squeezed, '(?s)^.*?[.!?；;。…]+', 0), E' \t\n\r\x0b\x0c') AS sentence FROM (SELECT comment_id, text, {SQUEEZED} AS squeezed FROM comments))))"""


def _ordered(cats: tuple[str, ...]) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cats)) + f" ELSE {len(cats)} END"


TOKENS_OF = r"regexp_split_to_array(trim(text), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+')"
LAYER = f"""layered AS (SELECT conv_id, row, CASE WHEN trim(text) = '' THEN 'mixed' WHEN regexp_matches(text, '@\\S') THEN 'internal' WHEN list_has_any(w, ['for', 'what', 'how']) AND NOT list_has_any(w, ['the', 'best', 'on']) THEN 'internal' WHEN list_has_any(w, ['the', 'best', 'on']) THEN 'event'
 WHEN len(k) > 0 AND len(list_filter(k, lambda x: x NOT IN ({quoted(L.REACTIONS)}))) = 0 THEN 'event' ELSE 'mixed' END AS layer FROM (SELECT *, {TOKENS_OF} AS w, list_filter({TOKENS_OF}, lambda x: length(x) >= 2) AS k FROM turns))"""
FOLD = """clips AS (SELECT author, row_number() OVER (PARTITION BY author ORDER BY weight DESC, row) AS place, row AS seq, ts - 200000 AS low, ts + 200000 AS high FROM chat),
fold AS (SELECT DISTINCT author, 0::BIGINT AS o, []::STRUCT(place BIGINT, seq BIGINT, low DOUBLE, high DOUBLE)[] AS kept FROM clips UNION ALL
 SELECT f.author, c.place, CASE WHEN len(list_filter(kept, lambda y: greatest(0.0, least(c.high, y.high) - greatest(c.low, y.low)) / least(c.high - c.low, y.high - y.low) > 0.5)) = 0 THEN list_append(kept, {'place': c.place, 'seq': c.seq, 'low': c.low, 'high': c.high}) ELSE kept END
 FROM fold f JOIN clips c ON c.author = f.author AND c.place = f.o + 1 WHERE c.place <= 5)"""

MINUTES = "printf('%02d:%02d', CAST(floor({0}) AS BIGINT) // 60, CAST(floor({0}) AS BIGINT) % 60)"
MOMENTS = """r AS (SELECT segment, row, author % 5 AS likes, weight AS priority, kind, author, author % 7 AS emotion, confidence, row_number() OVER (PARTITION BY segment ORDER BY weight DESC, row) AS pos FROM matched JOIN chat USING (row) WHERE segment NOT LIKE 'lc_ts_%'),
k AS (SELECT segment, kind AS category, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, min(pos)) AS q FROM r GROUP BY segment, kind),
mo AS (SELECT r.segment, count(*) AS n, CAST(sum(likes) AS BIGINT) AS likes, max(priority) AS max_priority, CAST(sum(emotion) AS BIGINT) AS emotion, min_by(row, pos) AS top_comment, any_value(k.category) AS category,
 CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS confidence,
 array_to_string(list_sort(list(DISTINCT 'p' || (author % 3))), '|') AS players, array_to_string(list_sort(list(DISTINCT kind)), '|') AS events, string_agg(row, '|' ORDER BY pos) AS ids FROM r JOIN k ON k.segment = r.segment AND q = 1 GROUP BY r.segment)"""
LETTERS_SQL = "translate(md5(n_name), '0123456789', 'ghijklmnop')"

QUERIES = {
    "point_in_interval": (point_in_interval, with_views(f"+{FIRST_IN} SELECT row, in_seq AS seq FROM hit", "chat", "segments")),
    "nearest_segment": (nearest_segment, with_views(f"+{NEAREST} SELECT row, near_seq AS seq, dist FROM near", "chat", "segments")),
    "match_cascade": (match_cascade, with_views(f"+{TIMES} SELECT * FROM matched", "chat", "segments")),
    "interval_overlap_context": (interval_overlap_context, with_views('SELECT b.seq AS id, array_to_string(list_sort(list(a.seq)), \',\') AS seqs FROM segments a JOIN segments b ON a."end" >= b.start - 9000 AND a.start <= b.start + 4000 GROUP BY b.seq', "chat", "segments")),
    "signal_match": (signal_match, with_views(f"+{SIGNALS} SELECT id, seq, score, confidence, signals FROM sig", "comments")),
    "jaccard_match": (jaccard_match, with_views(f"+{JACCARD} SELECT id, seq, common, either, CAST(named AS BIGINT) AS named, overlap FROM jac", "comments")),
    "two_pass_match": (
        two_pass_match,
        with_views(f"""+{SIGNALS}, {JACCARD}, j AS (SELECT * FROM jac WHERE common * 100 + named * 6 * either >= either * 7)
SELECT coalesce(sig.id, j.id) AS id, CASE WHEN sig.id IS NOT NULL THEN sig.seq ELSE j.seq END AS seq, CASE WHEN sig.id IS NOT NULL THEN sig.confidence ELSE 'low' END AS confidence FROM sig FULL JOIN j ON sig.id = j.id""", "comments"),
    ),
    "category_classify": (category_classify, with_views(f"+{CLASSIFIED} SELECT comment_id, category, array_to_string(categories, '|') AS categories FROM classified", "comments")),
    "emotion_strength": (emotion_strength, with_views(f"+{CLASSIFIED} SELECT comment_id, emotion FROM classified", "comments")),
    "caption": (caption, with_views(CAPTION, "comments")),
    "priority_score": (priority_score, with_views(f"+{RECORDS} SELECT comment_id, priority FROM scored", "comments")),
    "editor_notes": (
        editor_notes,
        with_views(
            f"""+{CLASSIFIED} SELECT comment_id, CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.USAGE.items())} END AS usage,
concat_ws(' ', CASE WHEN likes >= 10 THEN {P.fill_sql(P.NOTE_LIKES, likes="likes")} END, CASE WHEN len(named) > 0 THEN {P.fill_sql(P.NOTE_PLAYERS, players="array_to_string(named, ', ')")} END,
  CASE category {" ".join(f"WHEN '{k}' THEN {quoted([v])}" for k, v in P.NOTE_CATEGORY.items())} END, CASE WHEN emotion >= 400 THEN '{P.NOTE_STRONG}' END) AS notes
FROM (SELECT *, list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{p.lower()}') THEN '{p}' END" for p in PLAYERS)}], lambda x: x IS NOT NULL) AS named FROM classified)""",
            "comments",
        ),
    ),
    "act_assignment": (act_assignment, with_views(f"+{RECORDS}, {ACT} SELECT comment_id, act, CASE WHEN priority >= 70 THEN 'critical' WHEN priority >= 50 THEN 'high' WHEN priority >= 30 THEN 'medium' ELSE 'low' END AS weight FROM acted", "comments")),
    "act_summary": (act_summary, with_views(f"+{RECORDS}, {ACT} SELECT act, count(*) AS n, list(comment_id ORDER BY priority DESC, comment_id)[1] AS anchor FROM acted GROUP BY act", "comments")),
    "act_bridges": (
        act_bridges,
        with_views(f"""+{RECORDS}, {ACT}, p AS (SELECT *, row_number() OVER (PARTITION BY act ORDER BY priority DESC, comment_id) AS pos, category IN ('analytical', 'representative', 'dramatic') AS good FROM acted),
q AS (SELECT *, bool_or(good) OVER (PARTITION BY act) AS anyone FROM p WHERE pos > 1)
SELECT act, CAST(r AS INTEGER) AS rank, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY act ORDER BY priority DESC, comment_id) AS r FROM q WHERE good OR (NOT anyone AND pos <= 4)) WHERE r <= 3""", "comments"),
    ),
    "category_distribution": (category_distribution, with_views(f"+{RECORDS}, {ACT} SELECT act, category, count(*) AS n FROM acted GROUP BY act, category", "comments")),
    "opening_hook": (opening_hook, with_views(f"+{RECORDS} SELECT comment_id, category FROM (SELECT * FROM scored ORDER BY priority DESC, comment_id LIMIT 30) ORDER BY {_ordered(('dramatic', 'analytical', 'controversial', 'funny', 'clutch_hype'))}, priority DESC, comment_id LIMIT 1", "comments")),
    "turning_points": (turning_points, with_views(f"+{RECORDS} SELECT comment_id, category FROM scored WHERE category IN ('dramatic', 'controversial', 'analytical', 'critical') ORDER BY {_ordered(('dramatic', 'controversial', 'analytical', 'critical'))}, priority DESC, comment_id LIMIT 5", "comments")),
    "closing_note": (closing_note, with_views(f"+{RECORDS} SELECT comment_id, category FROM scored WHERE category IN ('supportive', 'emotional', 'representative') AND likes >= 1 ORDER BY {_ordered(('supportive', 'emotional', 'representative'))}, priority DESC, comment_id LIMIT 1", "comments")),
    "concept_shorts": (
        concept_shorts,
        with_views(f"+{RECORDS}, c(concept, wanted) AS (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in H.CONCEPTS.items()) + ") SELECT concept, CAST(r AS INTEGER) AS rank, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY priority DESC, comment_id) AS r FROM scored JOIN c ON wanted IS NULL OR wanted = category) WHERE r <= 5", "comments"),
    ),
    "player_arcs": (player_arcs, None),
    "player_sentiment_arc": (player_sentiment_arc, None),
    "combined_sources": (combined_sources, with_views("SELECT 'comment' AS source_type, count(*) AS n, count(like_count) AS with_likes, CAST(0 AS BIGINT) AS with_time FROM comments UNION ALL SELECT 'live_chat', count(*), 0, count(ts) FROM chat", "comments", "chat")),
    "segment_moments": (segment_moments, with_views(f"+{TIMES}, {MOMENTS} SELECT segment, n, likes, max_priority, emotion, top_comment, category, confidence, players, events, md5(ids) AS ids, emotion / (100 * n) AS intensity, confidence IN ('low', 'none') AS unsure FROM mo", "chat", "segments")),
    "moment_notes": (
        moment_notes,
        with_views(
            f"""+{TIMES}, {MOMENTS} SELECT segment, 'summary_overlay' AS usage, concat_ws(' ', CASE WHEN confidence IN ('low', 'none') THEN '{P.MOMENT_UNSURE}' ELSE {P.fill_sql(P.MOMENT_SPAN, start=MINUTES.format("start"), end=MINUTES.format('"end"'))} END,
{P.fill_sql(P.MOMENT_PLAYERS, players="replace(players, '|', ', ')")}, {P.fill_sql(P.MOMENT_COUNT, n="n")}) AS notes FROM mo JOIN segments ON segment = printf('seg_%04d', seq)""",
            "chat",
            "segments",
        ),
    ),
    "render_gate": (render_gate, with_views(f"+{TIMES} SELECT row, segment NOT LIKE 'lc_ts_%' AND low > 0 AND confidence IN ('high', 'medium') AS can_render, CASE WHEN segment LIKE 'lc_ts_%' OR low <= 0 THEN 'no_segment' WHEN confidence NOT IN ('high', 'medium') THEN 'low_confidence' ELSE 'ok' END AS reason FROM matched", "chat", "segments")),
    "render_plan": (render_plan, with_views(f"+{TIMES} SELECT CASE WHEN segment LIKE 'lc_ts_%' OR low <= 0 THEN 'no_segment' WHEN confidence NOT IN ('high', 'medium') THEN 'low_confidence' ELSE 'ok' END AS reason, count(*) AS n FROM matched GROUP BY 1", "chat", "segments")),
    "clip_overlap_select": (clip_overlap_select, with_views(f"+{FOLD} SELECT author, s.place AS place, s.seq AS seq FROM (SELECT author, unnest(kept) AS s FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY o DESC) AS r FROM fold) WHERE r = 1)", "chat").replace("WITH ", "WITH RECURSIVE ", 1)),
    "message_layer": (message_layer, with_views(f"+{LAYER} SELECT conv_id, row, layer FROM layered", "turns")),
    "layer_ratio": (
        layer_ratio,
        with_views(f"+{LAYER} SELECT conv_id, n, event, internal, CASE WHEN event / n >= 0.4 AND n >= 3 AND internal / n >= 0.3 AND n >= 5 THEN 'mixed' WHEN event / n >= 0.4 AND n >= 3 THEN 'broadcast_event' WHEN internal / n >= 0.3 AND n >= 5 THEN 'participant_driven' ELSE 'general' END AS buzz FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (layer IN ('event', 'mixed')) AS event, count(*) FILTER (layer IN ('internal', 'mixed')) AS internal FROM layered GROUP BY conv_id)", "turns"),
    ),
    "reaction_profile": (reaction_profile, with_views(f"SELECT CASE t WHEN 'the' THEN 'article' WHEN 'and' THEN 'and' WHEN 'for' THEN 'for' ELSE 'artikel' END AS reaction, count(*) AS n FROM (SELECT unnest({TOKENS_OF}) AS t FROM turns) WHERE t IN ('the', 'and', 'for', 'der') GROUP BY 1", "turns")),
    "alias_resolution": (
        alias_resolution,
        f"""WITH n AS (SELECT n_nationkey AS k, left({LETTERS_SQL}, 4) AS name FROM nation),
t AS (SELECT DISTINCT token FROM (SELECT unnest([name, name || '프로', right(name, 2), right(name, 3) || '선수님', right(name, 3), 'x' || name, 'x' || name || '형', 'y' || name || '님', 'z']) AS token FROM n) WHERE length(token) >= 2),
al AS (SELECT 'x' || name AS alias, upper(name) AS canonical FROM n WHERE k % 2 = 1 UNION ALL SELECT 'y' || name || '프로', 'Y ' || name FROM n WHERE k % 3 = 0 UNION ALL SELECT name || '선수', 'Z ' || name FROM n WHERE k % 5 = 0),
b AS (SELECT token, nullif(regexp_replace(token, '(프로님|선수님|형님|프로|선수|햄|형|님)$', ''), token) AS base FROM t),
c AS (SELECT name, CASE WHEN k % 5 = 0 THEN 'Z ' || name ELSE name END AS canonical FROM n),
g AS (SELECT given, any_value(canonical) AS canonical FROM (SELECT right(name, s) AS given, canonical FROM c, (VALUES (2), (3)) v(s)) GROUP BY given HAVING count(*) = 1),
l AS (SELECT 'alias' AS kind, alias AS key, canonical AS name FROM al UNION ALL SELECT 'name', name, canonical FROM c UNION ALL SELECT 'given', given, canonical FROM g),
w AS (SELECT token, 1 AS ord, 1 AS level, 'alias' AS kind, token AS key FROM b UNION ALL SELECT token, 2, 2, 'name', token FROM b UNION ALL SELECT token, 3 + i, 3, 'alias', base || f FROM b, (VALUES (0, ''), (1, '프로'), (2, '선수'), (3, '프로님'), (4, '선수님'), (5, '형')) v(i, f)
  UNION ALL SELECT token, 9, 4, 'name', base FROM b UNION ALL SELECT token, 10, 5, 'given', base FROM b UNION ALL SELECT token, 11, 6, 'given', token FROM b),
f AS (SELECT token, level, name, row_number() OVER (PARTITION BY token ORDER BY ord) AS r FROM w JOIN l USING (kind, key))
SELECT token, name, level FROM t LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (token)""",
    ),
    # Random names: what keeps the first seven letters is alone in being similar enough.
    "fuzzy_resolution": (fuzzy_resolution, f"WITH n AS (SELECT left({LETTERS_SQL}, 8) AS name FROM nation) SELECT left(name, 7) || '_' AS token, max(name) AS name FROM n GROUP BY 1"),
    "corrected_names": (
        corrected_names,
        f"""WITH n AS (SELECT DISTINCT left({LETTERS_SQL}, 8) AS name FROM nation)
SELECT DISTINCT token, CASE WHEN token LIKE '\\_%' ESCAPE '\\' THEN token ELSE name END AS name FROM (SELECT name, unnest([name, left(name, 7) || '_', left(name, 7), '_' || name]) AS token FROM n)""",
    ),
    "name_mentions": (name_mentions, with_views("+v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS name FROM benchmark) SELECT conv_id * 1000 + row AS row, name FROM turns JOIN v ON contains(text, name) WHERE length(name) = 4", "turns")),
    "commentary_mood": (
        commentary_mood,
        with_views("SELECT conv_id, row, CASE WHEN e >= 3 THEN 'strong' WHEN e >= 2 THEN 'surprised' WHEN e >= 1 THEN 'attentive' WHEN t >= 1 THEN 'tense' END AS mood FROM (SELECT *, contains(text, 'the')::INT + contains(text, 'ing')::INT + contains(text, 'and')::INT + contains(text, 'best')::INT AS e, contains(text, 'der')::INT + contains(text, 'ei')::INT AS t FROM turns)", "turns"),
    ),
    "context_names": (
        context_names,
        with_views(f"""+x AS (SELECT conv_id, string_agg(text, ' ' ORDER BY row) AS text, max(CASE WHEN row = 0 AND contains(text, 'heon') THEN 1 ELSE 0 END) AS known FROM turns GROUP BY conv_id),
c(token, official, name) AS (SELECT token, official, CASE official {" ".join(f"WHEN '{a}' THEN '{n}'" for a, n in L.SAMPLE_ALIASES.items())} ELSE official END
  FROM (SELECT token, given, unnest(list_filter([{quoted(L.SAMPLE_ROSTER)}], lambda x: length(x) > length(given) AND x LIKE '%' || given)) AS official FROM (VALUES ('eon', 'eon'), ('heonter', 'heon'), ('nt', 'nt')) v(token, given) WHERE length(given) <= 3)),
s AS (SELECT conv_id, token, name, CASE WHEN known = 1 AND name = 'heon' THEN 4 ELSE 0 END + 2 * ((length(text) - length(replace(text, official, ''))) // length(official)) + CASE WHEN name <> official THEN (length(text) - length(replace(text, name, ''))) // length(name) ELSE 0 END AS score FROM x, c),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, token ORDER BY score DESC, name) AS r, coalesce(lead(score) OVER (PARTITION BY conv_id, token ORDER BY score DESC, name), 0) AS next, count(*) OVER (PARTITION BY token) AS many FROM s)
SELECT conv_id, token, name FROM r WHERE r = 1 AND score >= 2 AND score - next >= 2 AND (SELECT count(*) FROM c WHERE c.token = r.token) > 1""", "turns"),
    ),
    "video_ids": (video_ids, "SELECT page_id, CASE WHEN page_id % 5 < 4 THEN left(md5(url), 11) END AS found FROM pages"),
    "clock_formats": (
        clock_formats,
        with_views("""SELECT row, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, printf('%02d:%02d', s // 60, s % 60) AS minutes,
printf('%02d:%02d:%02d,%03d', s // 3600, s % 3600 // 60, s % 60, CAST(floor(ts * 10) AS BIGINT) % 10 * 100) AS srt, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS long FROM (SELECT row, ts, CAST(floor(ts) AS BIGINT) AS s FROM chat)""", "chat"),
    ),
}

ARC = "CASE WHEN m * 5 >= n * 2 THEN 'contested' WHEN (m + d) * 2 >= n THEN 'mixed' WHEN p * 2 >= n THEN 'positive' WHEN a * 5 >= n * 2 THEN 'analytical_focus' ELSE 'mixed' END"
SHARES = "count(*) AS n, count(*) FILTER (category IN ('clutch_hype', 'emotional', 'supportive')) AS p, count(*) FILTER (category IN ('critical', 'controversial')) AS m, count(*) FILTER (category = 'dramatic') AS d, count(*) FILTER (category = 'analytical') AS a"
QUERIES["player_sentiment_arc"] = (player_sentiment_arc, with_views(f"+{CLASSIFIED} SELECT author, n, {ARC} AS arc FROM (SELECT author, {SHARES} FROM classified GROUP BY author)", "comments"))
QUERIES["player_arcs"] = (
    player_arcs,
    with_views(f"+{RECORDS} SELECT player, n, {ARC} AS arc, peak FROM (SELECT player, {SHARES}, list(comment_id ORDER BY priority DESC, comment_id)[1] AS peak FROM scored JOIN (VALUES " + ", ".join(f"('{p}')" for p in PLAYERS) + ") v(player) ON contains(lower(text), lower(player)) GROUP BY player)", "comments"),
)
