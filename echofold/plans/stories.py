"""Queries of spikes' stories, people's metrics and packages, over conversations as time-stamped talk and benchmark items as captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from .. import phrases as P
from .. import stages
from ..functions import text as T
from ..operators import chat as K
from ..operators import comments as C
from ..operators import enrich as N
from ..operators import entities as E
from ..operators import highlights as H
from ..operators import matching as M
from ..operators import package as G
from ..sources import plan_files
from . import chat as chat_plans
from . import comments as comment_plans
from . import highlights as highlight_plans
from .highlights import ACT, CLASSIFIED, PLAYERS, RECORDS, TIMES
from .tables import chat, comments, quoted, segments, sql_labels, table, turns, with_views

REACTIONS = {"the": "감탄·대박", "and": "웃음·재미", "in": "안타까움·슬픔", "der": "충격·당황", "la": "응원·격려", "ha": "진짜"}
MOOD_WORDS, TENSE_WORDS = ["ther", "tion", "heit", "ou"], ["th", "en"]
TITLED = [L.SAMPLE_TITLED]
RESOLVING = {"suffixes": L.SAMPLE_SUFFIXES, "forms": L.SAMPLE_FORMS, "base_forms": L.SAMPLE_BASE_FORMS}
WORDS = {"events": L.SAMPLE_EVENTS, "not_now": L.SAMPLE_NOT_NOW, "cheer": L.SAMPLE_CHEER, "sure": L.SAMPLE_SURE, "reactions": REACTIONS, "excited": MOOD_WORDS, "tense": TENSE_WORDS, "patterns": TITLED, "spaced": L.SAMPLE_TITLED, "resolving": RESOLVING}
HOSTS = [("zont", "channel_host"), ("Ather B", "channel_participant"), ("heon", "professional_player")]
PRESENT = [("zont", "zont"), ("zont", "hea"), ("Ather B", "ather")]
LAYER_WORDS = (["for", "what", "how"], ["the", "best", "on"])


def talk(spark, sf):
    """Twenty seconds a conversation, two seconds a turn."""
    t = turns(spark, sf)
    layer = E.message_layer(F.col("text"), *LAYER_WORDS)
    return t.select((F.col("conv_id") * 1000 + F.col("row")).alias("row"), (F.col("conv_id") * 20.0 + F.col("row") * 2).alias("ts"), "author", "text", layer.alias("layer"))


def scenes(spark, sf):
    """A spike for each conversation."""
    c = turns(spark, sf).select("conv_id").distinct()
    return c.select(F.col("conv_id").alias("id"), (F.col("conv_id") * 20.0).alias("ws"), (F.col("conv_id") * 20.0 + 14).alias("we"), (F.col("conv_id") * 20.0 + 5).alias("anchor"))


def captions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), (F.col("item_id") * 45.0).alias("start"), (F.col("item_id") * 45.0 + 30).alias("end"), F.coalesce("text", F.lit("")).alias("text"))


def names(spark):
    roster = spark.createDataFrame([(x,) for x in L.SAMPLE_ROSTER], "name string")
    aliases = spark.createDataFrame(list(L.SAMPLE_ALIASES.items()), "alias string, canonical string")
    return roster, aliases, spark.createDataFrame(HOSTS, "name string, role string")


def enriched(spark, sf):
    roster, aliases, registry = names(spark)
    present = spark.createDataFrame(PRESENT, "name string, alias string")
    return N.enrich(scenes(spark, sf), talk(spark, sf), captions(spark, sf), roster, aliases, 60.0, registry, present, WORDS)


def spike_context(spark, sf):
    return N.context(scenes(spark, sf), captions(spark, sf), 60.0)


def spoken_events(spark, sf):
    return enriched(spark, sf)["events"].select("id", F.array_join("events", "|").alias("events"))


def spike_mentions(spark, sf):
    return enriched(spark, sf)["mentions"]


def spike_events(spark, sf):
    return enriched(spark, sf)["chat_events"]


def spike_people(spark, sf):
    return enriched(spark, sf)["people"]


def spike_primary(spark, sf):
    return enriched(spark, sf)["primary"]


def spike_reactions(spark, sf):
    return enriched(spark, sf)["reactions"]


def spike_narrative(spark, sf):
    return enriched(spark, sf)["narrative"]


def buzz_summary(spark, sf):
    return enriched(spark, sf)["buzz"]


def evidence_marks(spark, sf):
    c = spike_context(spark, sf)
    return c.select("id", E.evidence_mark(F.col("evidence") != "none", F.col("evidence")).alias("mark"), E.rank_label(F.col("id") + 1).alias("label"))


def crowd(spark, sf):
    """The messages, and whom they name: each a stage table."""
    keep = stages.of(spark).keep
    roster, aliases, registry = names(spark)
    messages = keep(talk(spark, sf), "messages")
    named = E.players_only(N.named_in(messages, roster, aliases, ["row", "ts"], TITLED, **RESOLVING), registry).select("row", "ts", "name")
    return messages, keep(named, "named")


def people_in_messages(spark, sf):
    return crowd(spark, sf)[1].select("row", "name")


def _metrics(messages, named):
    return N.people_metrics(messages, named, 60.0, reactions=REACTIONS)


def people_metrics(spark, sf):
    """Every person who is named, with the reactions around."""
    return _metrics(*crowd(spark, sf)).withColumn("top", F.array_join("top", "  ·  "))


def _in_spikes(spark, sf):
    """The stage tables of crowd, and what people_metrics and spike_ranks say of everyone who is named in a spike, one too."""
    messages, named = crowd(spark, sf)
    return messages, named, stages.of(spark).keep(_metrics(messages, named).join(N.spike_ranks(named, _numbered(spark, sf), 60.0), "name"), "metrics")


def _numbered(spark, sf):
    return scenes(spark, sf).withColumn("rank", F.col("id") + 1)


def people_scores(spark, sf):
    """Opportunity and marketing scores, of a hundred for the best."""
    m = _in_spikes(spark, sf)[2]
    share = F.when(F.col("reactions") > 0, F.col("good") / F.col("reactions")).otherwise(0.0)
    m = m.withColumn("positive", share).withColumn("raw", E.marketing(F.col("reactions") / F.col("mentions"), share, F.size("ranks"), F.col("mentions")))
    opportunity = E.out_of_best(E.opportunity(m.select("name", "reactions", "clusters", "positive")).select("name", F.col("raw").alias("o")), "o", "opportunity").select("name", "opportunity")
    return E.out_of_best(m, "raw", "marketing").select("name", "marketing").join(opportunity, "name", "left")


def people_reasons(spark, sf):
    """Why each person is proposed, and for what."""
    m = _in_spikes(spark, sf)[2]
    m = m.withColumn("rate", F.floor(F.col("reactions") / F.col("mentions") * 100) / 100).withColumn("positive", F.when(F.col("reactions") > 0, F.col("good") / F.col("reactions")).otherwise(0.0))
    low = K.compared(m.select("name", "mentions"), "mentions").select("name", "low")
    high = K.compared(m.select("name", "rate"), "rate").select("name", "above_mean")
    m = m.join(low, "name").join(high, "name")
    return m.select("name", E.reasons(F.col("low"), F.col("above_mean"), F.col("rate"), F.col("positive"), F.col("ranks")).alias("reason"), E.suggestion(F.col("label"), F.col("ranks")).alias("suggestion"))


TONES = (["heon", "ou"], ["the", "ion"], ["tion", "und", "que"])


def tone_words(spark, sf):
    messages, named = crowd(spark, sf)
    return N.tone(N.told_of(messages, named.select("name").distinct(), names(spark)[1]), *TONES)


def _told(spark, messages, people):
    return stages.of(spark).keep(N.told_of(messages, people, names(spark)[1]), "told")


def discovery(spark, sf):
    """How each person's reception reads, and what to make of it."""
    messages, _, m = _in_spikes(spark, sf)
    return N.discovery(m.join(N.tone(_told(spark, messages, m), *TONES), "name"))


def _links(spark, sf, links):
    """links (name, rank, ...) of people and spikes with the spikes' commentary and first event."""
    known = enriched(spark, sf)
    s = scenes(spark, sf).select((F.col("id") + 1).alias("rank"), "id", "ws", "we", "anchor").join(known["context"], "id").join(known["chat_events"].filter("rank = 1").select("id", "event"), "id", "left")
    return links.join(s.select("rank", "ws", "we", "anchor", "pre_text", "concurrent_text", "event"), "rank")


def discovery_context(spark, sf):
    """What is known of every spike in which a person is named."""
    return N.discovery_context(_links(spark, sf, N.spikes_of(crowd(spark, sf)[1], _numbered(spark, sf), 60.0)))


def discovery_cards(spark, sf):
    """All of a person's card: the spikes, what was said in them and elsewhere, and what it comes to."""
    messages, _, m = _in_spikes(spark, sf)
    first = m.select("name", F.posexplode("ranks").alias("place", "rank")).filter("place < 3").drop("place")
    links = stages.of(spark).keep(_links(spark, sf, first), "links")
    told = _told(spark, messages, m)
    people = m.join(N.tone(told, *TONES), "name")
    out = N.discovery_cards(people, N.discovery_context(links), N.chat_samples(links, told), N.tone_samples(told, *TONES))
    return out.select("name", *(F.array_join(c, "\n").alias(c) for c in ("context", "samples", "newcomer_said", "praise_said", "lasting_said")), "reaction", "interpretation", "action")


def roster_mentions(spark, sf):
    """Every word of the benchmark as a name that messages may hold: how many of them do."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).filter(F.length("name") >= 3).distinct()
    return E.mention_counts(turns(spark, sf), words)


def official_names(spark, sf):
    """Names of parts, with endings, against a roster of some."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("bare"))
    ending = F.get(F.array(*map(F.lit, ["", *L.DISPLAY_ENDINGS, " 님"])), (F.col("p_partkey") % 7).cast("int"))
    roster = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name"))
    return E.official(p.select("p_partkey", F.concat("bare", ending).alias("name")), roster)


def plausible_names(spark, sf):
    """Words and endings that no name has."""
    n = table(spark, sf, "nation")
    ends = ["", *L.NO_NAME_ENDINGS, "민"]
    rows = n.select("n_nationkey", F.posexplode(F.array(*map(F.lit, ends))).alias("at", "e")).select("n_nationkey", "at", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "김").otherwise("장타"), F.when(F.col("n_nationkey") % 4 > 1, F.col("e")).otherwise("")).alias("word"))
    return rows.select("n_nationkey", F.col("at").cast("long").alias("place"), E.plausible(F.col("word"), ["김는"]).alias("ok"))


def records(spark, sf):
    """Comments as records with everything a package wants; every third has a segment."""
    rows = highlight_plans.records(spark, sf).withColumn("players", H.detect_players(F.col("text"), PLAYERS))
    k = F.col("comment_id")
    seg = F.when(k % 3 == 0, F.format_string("seg_%04d", k % 50)).otherwise("")
    low = F.when(k % 3 == 0, (k % 50) * 30.0)
    sure = F.get(F.array(*map(F.lit, ["high", "medium", "low"])), (k % 3 + k % 2).cast("int"))
    return rows.select(
        "comment_id", "text", "author", "likes", "category", "priority", "emotion", "players", T.caption(F.col("text")).alias("caption"), seg.alias("segment"), low.alias("low"), (low + 40).alias("high"), sure.alias("confidence"), (k % 4 == 0).alias("manual"),
        T.signals(F.col("text"), [], ["tion", "ring", "lead"]).alias("signals"), F.when(k % 2 == 0, "comment").otherwise("live_chat").alias("source_type"),
    )


def concept_sequences(spark, sf):
    s = G.concept_sequences(stages.of(spark).keep(records(spark, sf), "records"), PLAYERS)
    overlays = F.array_join(F.transform("overlays", lambda o: F.concat_ws(":", o["comment_id"].cast("string"), F.coalesce(o["segment"], F.lit("-")), F.coalesce(o["low"].cast("int").cast("string"), F.lit("-")))), ",")
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c["segment"], c["note"])), ",")
    return s.select("concept", "title", "description", F.col("hook.caption").alias("hook"), overlays.alias("overlays"), clips.alias("clips"), "call", "seconds")


def spike_sequences(spark, sf):
    c = chat(spark, sf).withColumn("likes", F.col("author"))
    s = chat_plans.spike_nms(spark, sf).select(F.col("rank").cast("long").alias("id"), (F.col("k") * chat_plans.STEP).alias("ws"), "n", "weight")
    s = s.select("id", "ws", (F.col("ws") + chat_plans.WIDTH).alias("we"), (F.col("ws") + chat_plans.WIDTH / 2).alias("anchor"), "n", F.floor("weight").alias("weight"))
    out = G.spike_sequences(s, c, chat_plans.WIDTH)
    said = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["author"], m["text"])), ",")
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c["segment"], c["end"] - c["start"], c["note"])), ",")
    overlays = F.array_join(F.transform("overlays", lambda o: F.concat_ws(":", o["comment_id"], o["caption"], o["category"], o["segment"])), ",")
    return out.select("id", "title", "description", "clip_start", "clip_end", said.alias("messages"), F.concat_ws(":", "hook.author", "hook.caption").alias("hook"), clips.alias("clips"), overlays.alias("overlays"), "seconds")


def event_words(spark, sf):
    return G.event_words(records(spark, sf))


def title_suggestions(spark, sf):
    return G.titles(records(spark, sf), PLAYERS)


def plan_arcs(spark, sf):
    a = G.arcs(records(spark, sf), PLAYERS)
    ids = F.array_join(F.transform("top", lambda c: c["comment_id"].cast("string")), ",")
    return a.select("player", "n", "arc", F.array_join("categories", ",").alias("categories"), ids.alias("top"), F.col("peak.comment_id").alias("peak"))


def important_points(spark, sf):
    p = H.turning_points(records(spark, sf))
    order = {c: i for i, c in enumerate(("dramatic", "controversial", "analytical", "critical"))}
    place = F.struct(H.lookup(order, F.col("category"), 9).alias("a"), (-F.col("priority")).alias("b"), F.col("comment_id").alias("c"))
    return G.important(p.select("comment_id", place.alias("place"), H.narrative_weight(F.col("priority")).alias("weight"))).select("comment_id", "weight")


def package_meta(spark, sf):
    return G.meta(records(spark, sf), segments(spark, sf), chat_plans.spikes(spark, sf))


def package_by_spikes(spark, sf):
    """The same where chat records stand at times of their own: shorts go by spikes."""
    direct = F.when(F.col("source_type") == "live_chat", F.array(F.lit("live_chat_timestamp_direct"))).otherwise(F.col("signals"))
    return G.meta(records(spark, sf).withColumn("signals", direct), segments(spark, sf), chat_plans.spikes(spark, sf))


def package_shorts(spark, sf):
    """The shorts of that package: the mode chooses what they are."""
    direct = F.when(F.col("source_type") == "live_chat", F.array(F.lit("live_chat_timestamp_direct"))).otherwise(F.col("signals"))
    own = stages.of(spark).keep(records(spark, sf).withColumn("signals", direct), "records")
    s = chat_plans.spike_nms(spark, sf).select(F.col("rank").cast("long").alias("id"), (F.col("k") * chat_plans.STEP).alias("ws"), "n", F.floor("weight").alias("weight"))
    s = stages.of(spark).keep(s.select("id", "ws", (F.col("ws") + chat_plans.WIDTH).alias("we"), (F.col("ws") + chat_plans.WIDTH / 2).alias("anchor"), "n", "weight"), "spikes")
    package = G.build_package(own, segments(spark, sf), s, chat(spark, sf).withColumn("likes", F.col("author")), PLAYERS, chat_plans.WIDTH)
    return package["shorts_sequences"].select("id", "title", "clip_start", F.size("messages").cast("long").alias("messages"))


def package_parts(spark, sf):
    """The cards of the plan, by part."""
    own = stages.of(spark).keep(records(spark, sf), "records")
    plan = G.master_plan(own, PLAYERS, L.SAMPLE_ACTS)
    rows = None
    for part in ("opening_hook", "turning_points", "closing_note"):
        cards = plan[part].select(F.lit(part).alias("part"), "card.comment_id", "card.role", "card.usage", F.md5("card.caption").alias("caption"))
        rows = cards if rows is None else rows.unionByName(cards)
    return rows


def chatters(spark, sf):
    """Totals of chat with nameless authors and messages of other kinds."""
    t = turns(spark, sf).select("author", "conv_id", "row", (F.col("conv_id") * 20.0 + F.col("row")).alias("ts"))
    who = F.when(F.col("row") % 3 > 0, F.concat("author", F.col("conv_id").cast("string"))).otherwise("")
    kind = F.get(F.array(F.lit("text"), F.lit("superchat"), F.lit(""), F.lit(None)), (F.col("row") % 4).cast("int"))
    return K.totals(t.select("ts", who.alias("author"), kind.alias("kind")))


def plan_counts(spark, sf):
    """How many rows each part of the plan has."""
    plan = G.master_plan(stages.of(spark).keep(records(spark, sf), "records"), PLAYERS, L.SAMPLE_ACTS)
    rows = None
    for part, df in plan.items():
        n = df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
        rows = n if rows is None else rows.unionByName(n)
    return rows


def _plan_files(spark, sf):
    """The plan of all comments, written and named: each comment is classified once."""
    kept = stages.of(spark)
    own = kept.keep(records(spark, sf), "records")
    return plan_files.write_plan(G.master_plan(own, PLAYERS, L.SAMPLE_ACTS), own, PLAYERS, kept.folder("plan"), "v1", "t")


def plan_json(spark, sf):
    """The acts of the plan's JSON file, read back."""
    card = "struct<comment_id:bigint,text:string>"
    kind = f"struct<acts:array<struct<act_id:string,comment_count:bigint,anchor_comment:{card},bridge_comments:array<{card}>,category_distribution:map<string,bigint>>>>"
    text = spark.read.text(_plan_files(spark, sf)["plan_json"], wholetext=True)
    rows = text.select(F.explode(F.from_json("value", kind)["acts"]).alias("a")).select("a.*")
    counted = F.array_sort(F.transform(F.map_entries("category_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    bridges = F.array_join(F.transform("bridge_comments", lambda c: c["comment_id"].cast("string")), ",")
    return rows.select("act_id", "comment_count", F.col("anchor_comment.comment_id").alias("anchor"), F.md5("anchor_comment.text").alias("digest"), bridges.alias("bridges"), F.array_join(counted, ",").alias("categories"))


def plan_script(spark, sf):
    """The turning points of the plan's script, read back."""
    lines = spark.read.text(_plan_files(spark, sf)["plan_script"]).select("value")
    return lines.filter(F.col("value").rlike(r"^\| (critical|high|medium|low) \|")).select(F.split("value", r" \| ").alias("c")).select(F.substring(F.get("c", F.lit(0)), F.lit(3), F.lit(99)).alias("weight"), F.get("c", F.lit(1)).alias("category"), F.get("c", F.lit(2)).cast("long").alias("likes"))


def comment_cards(spark, sf):
    return records(spark, sf).select(G.card("peak").alias("c")).select("c.role", "c.comment_id", "c.players", "c.usage", "c.segment", "c.low", "c.high", "c.manual")


def render_report(spark, sf):
    r = records(spark, sf)
    return G.render_report(r.select("author", F.col("comment_id").alias("place"), "segment", "low", "high", "manual", "confidence"), "author")


def recommendations(spark, sf):
    return C.recommendations(_facts(spark, sf))


def marketing_angles(spark, sf):
    return C.marketing_angles(_facts(spark, sf))


def thread_recommendations(spark, sf):
    """The same of conversations as threads of replies."""
    return C.recommendations(C.Analysis.of(threads(spark, sf), comment_plans.STOP, comment_plans.LEX).facts())


def threads(spark, sf):
    t = turns(spark, sf)
    return t.select((F.col("conv_id") * 1000 + F.col("row")).alias("comment_id"), "author", "text", ((F.col("conv_id") + F.col("row")) % 7).alias("like_count"), (F.col("row") > 0).alias("is_reply"))


def _facts(spark, sf):
    return C.Analysis.of(comments(spark, sf), comment_plans.STOP, comment_plans.LEX).facts()


def notable_entities(spark, sf):
    return C.notable(C.entity_candidates(comments(spark, sf), comment_plans.STOP))


def highlight_signals(spark, sf):
    return C.highlight_signals(comments(spark, sf))


def min_likes(spark, sf):
    return C.at_least_liked(comments(spark, sf), 90).select("comment_id", "like_count")


def word_confidence(spark, sf):
    d, b = highlight_plans._sides(spark, sf, lambda c: T.content_words(c, highlight_plans.MATCH_WORDS))
    out = M.word_confidence(M.word_match(d.withColumnRenamed("x", "words"), b.withColumnRenamed("x", "words"), highlight_plans.WORD_PLAYERS))
    return out.select("id", "seq", "confidence", F.array_join("signals", ",").alias("signals"))


# ---- the same in SQL

EVENT_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SAMPLE_EVENTS.items()) + " END"
SQL_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}|{SQL_SPACE}\\z', '', 'g')"


TALK = f"""talk AS (SELECT conv_id * 1000 + row AS row, conv_id * 20.0 + row * 2 AS ts, conv_id, author, text, layer FROM turns JOIN layered USING (conv_id, row)),
sc AS (SELECT DISTINCT conv_id AS id, conv_id * 20.0 AS ws, conv_id * 20.0 + 14 AS we, conv_id * 20.0 + 5 AS anchor FROM turns),
cap AS (SELECT item_id AS seq, item_id * 45.0 AS start, item_id * 45.0 + 30 AS stop, {_strip("text")} AS text FROM benchmark WHERE regexp_matches(coalesce(text, ''), '[^\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]'))"""
TALK = highlight_plans.LAYER + ", " + TALK
CONTEXT = """cx0 AS (SELECT id, left(coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (stop >= greatest(0, anchor - 15) AND start <= anchor), ''), 300) AS pre_text,
  left(coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (stop >= ws AND start <= we), ''), 300) AS concurrent_text, left(coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (stop >= greatest(0, anchor - 60) AND start <= we + 10), ''), 400) AS all_text FROM sc LEFT JOIN cap ON stop >= greatest(0, anchor - 60) AND start <= we + 10 GROUP BY id),
cx AS (SELECT *, CASE WHEN pre_text <> '' AND concurrent_text <> '' THEN 'both' WHEN pre_text <> '' THEN 'pre_spike' WHEN concurrent_text <> '' THEN 'concurrent' ELSE 'none' END AS evidence, pre_text || ' ' || concurrent_text AS near FROM cx0)"""
SPOKEN = f"""ew AS (SELECT id, near, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, near, regexp_split_to_array(near, '{SQL_SPACE}') AS w FROM cx)),
eo AS (SELECT id, w, min(i) AS i, any_value(near) AS near FROM ew WHERE w IN ({quoted(L.SAMPLE_EVENTS)}) GROUP BY id, w),
ep AS (SELECT id, w, i, near, unnest(range(1, length(near) - length(w) + 2)) AS p FROM eo),
ev AS (SELECT id, {EVENT_CASE.format("w")} AS event, min(i) AS i FROM ep WHERE substring(near, p, length(w)) = w AND NOT regexp_matches(substring(near, greatest(1, p - 30), p - 1 + 40 - greatest(0, p - 31)), '{L.SAMPLE_NOT_NOW}') GROUP BY 1, 2),
es AS (SELECT id, coalesce(string_agg(event, '|' ORDER BY i), '') AS events, min_by(event, i) AS first_event FROM cx LEFT JOIN ev USING (id) GROUP BY id)"""
_SUFFIX = "|".join(L.SAMPLE_SUFFIXES)
_ALIASES = ", ".join(f"('{a}', '{c}')" for a, c in L.SAMPLE_ALIASES.items())
_ROSTER = ", ".join(f"('{n}')" for n in L.SAMPLE_ROSTER)
_forms = lambda column, forms: "[" + ", ".join(f"{column} || '{f}'" for f in ["", *forms]) + "]"
#: Names of tokens: the levels of resolution as keys of one lookup.
RESOLVED = f"""al(alias, canonical) AS (VALUES {_ALIASES}), ro(name) AS (VALUES {_ROSTER}),
ca AS (SELECT ro.name, coalesce(min_by(canonical, i), ro.name) AS canonical FROM (SELECT name, unnest({_forms("name", L.SAMPLE_FORMS)}) AS alias, unnest(range({len(L.SAMPLE_FORMS) + 1})) AS i FROM ro) f JOIN al USING (alias) RIGHT JOIN ro ON ro.name = f.name GROUP BY ro.name),
gi AS (SELECT given, any_value(canonical) AS canonical FROM (SELECT right(name, k) AS given, canonical FROM ca, (VALUES (2), (3)) v(k) WHERE length(name) > k) GROUP BY given HAVING count(*) = 1),
lk AS (SELECT 'alias' AS kind, alias AS key, canonical AS name FROM al UNION ALL SELECT 'name', name, canonical FROM ca UNION ALL SELECT 'given', given, canonical FROM gi),
tb AS (SELECT token, CASE WHEN length(base) >= 2 AND base <> token THEN base END AS base FROM (SELECT DISTINCT token, regexp_replace(token, '({_SUFFIX})$', '') AS base FROM tokens WHERE length(token) >= 2)),
wk AS (SELECT token, 1 AS ord, 'alias' AS kind, token AS key FROM tb UNION ALL SELECT token, 2, 'name', token FROM tb
  UNION ALL SELECT token, 3 + unnest(range({len(L.SAMPLE_BASE_FORMS) + 1})), 'alias', unnest({_forms("base", L.SAMPLE_BASE_FORMS)}) FROM tb WHERE base IS NOT NULL
  UNION ALL SELECT token, 20, 'name', base FROM tb UNION ALL SELECT token, 21, 'given', base FROM tb UNION ALL SELECT token, 22, 'given', token FROM tb),
rs AS (SELECT token, min_by(name, ord) AS name FROM wk JOIN lk USING (kind, key) GROUP BY token)"""
_HOSTS = quoted(n for n, role in HOSTS if role in L.NOT_PLAYERS)
TOKENS = f"""talked AS (SELECT row, unnest(regexp_extract_all(text, '{L.SAMPLE_TITLED}')) AS token FROM talk), said AS (SELECT id, unnest(f) AS token, generate_subscripts(f, 1) AS place FROM (SELECT id, regexp_extract_all(near, '{L.SAMPLE_TITLED}') AS f FROM cx)),
tokens AS (SELECT token FROM talked UNION SELECT token FROM said)"""
NAMED = f"""nm AS (SELECT DISTINCT row, name FROM (SELECT row, name FROM talked JOIN rs USING (token) UNION ALL SELECT row, coalesce(canonical, name) FROM talk JOIN ro ON length(name) >= 3 AND contains(text, name) LEFT JOIN al ON alias = name) WHERE name NOT IN ({_HOSTS}))"""
SCENE = f"""around AS (SELECT sc.id, talk.row, talk.ts, text, layer, ts BETWEEN greatest(0, anchor - 10) AND anchor + 5 AS tight, ts BETWEEN ws AND we AS peak, ts >= greatest(0, ws - 30) AND ts <= we AS near FROM sc JOIN talk ON ts BETWEEN greatest(0, least(ws - 30, anchor - 10)) AND greatest(we, anchor + 5)),
ms AS (SELECT id, row, tight, text FROM around WHERE layer IN ('event', 'mixed') AND (tight OR near)),
mn AS (SELECT id, row, tight, name FROM ms JOIN nm USING (row)),
me AS (SELECT id, row, tight, {EVENT_CASE.format("w")} AS event FROM (SELECT id, row, tight, regexp_extract(text, '{L.SAMPLE_CHEER}', 1) AS wish, unnest({highlight_plans.TOKENS_OF.replace("trim(text)", _strip("text"))}) AS w FROM ms) WHERE w IN ({quoted(L.SAMPLE_EVENTS)}) AND w <> wish),
ne AS (SELECT id FROM mn WHERE tight UNION SELECT id FROM me WHERE tight),
mp AS (SELECT id, name, count(*) AS n FROM mn WHERE tight OR id NOT IN (SELECT id FROM ne) GROUP BY id, name),
mv AS (SELECT id, event, count(*) AS n FROM me WHERE tight OR id NOT IN (SELECT id FROM ne) GROUP BY id, event HAVING event NOT IN ({quoted(L.SAMPLE_SURE)}) OR count(*) >= 2),
pm AS (SELECT * FROM (SELECT id, name, n, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, name) AS INTEGER) AS rank FROM mp) WHERE rank <= 8),
pv AS (SELECT * FROM (SELECT id, event, n, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, event) AS INTEGER) AS rank FROM mv) WHERE rank <= 8),
sn AS (SELECT id, name, min(place) AS place FROM said JOIN rs USING (token) WHERE name NOT IN ({_HOSTS}) GROUP BY id, name),
pe AS (SELECT id, name, n, CAST(row_number() OVER (PARTITION BY id ORDER BY s, p) - 1 AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY s, p) AS r FROM (SELECT id, name, 99 AS n, 0 AS s, place AS p FROM sn UNION ALL SELECT id, name, n, 1, rank FROM pm)) WHERE r = 1),
hd AS (SELECT sn.id, name, count(*) AS h FROM sn JOIN around a ON a.id = sn.id AND peak AND contains(text, name) GROUP BY sn.id, name),
pr AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name FROM (SELECT * FROM (SELECT sn.id, sn.name, row_number() OVER (PARTITION BY sn.id ORDER BY pm.name IS NULL, CASE WHEN pm.name IS NULL THEN -coalesce(h, 0) ELSE 0 END, place) AS r FROM sn LEFT JOIN hd USING (id, name) LEFT JOIN pm ON pm.id = sn.id AND pm.name = sn.name) WHERE r = 1) a
  FULL JOIN (SELECT id, name FROM pm WHERE rank = 1) b ON a.id = b.id),
re AS (SELECT id, kind, count(*) AS n FROM (SELECT id, CASE w {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REACTIONS.items())} END AS kind FROM (SELECT id, unnest({highlight_plans.TOKENS_OF.replace("trim(text)", _strip("text"))}) AS w FROM around WHERE peak AND layer IN ('event', 'mixed'))) WHERE kind IS NOT NULL GROUP BY id, kind)"""
STORY = f"{TALK}, {CONTEXT}, {SPOKEN}, {TOKENS}, {RESOLVED}, {NAMED}, {SCENE}"
BASE = """bs AS (SELECT cx.*, p0.name AS first, p1.name AS second, pr.name AS main, pv.event AS said, es.first_event, rk.kind, rk.profile, coalesce(event_n, 0) AS event_n, coalesce(internal_n, 0) AS internal_n FROM cx LEFT JOIN pe p0 ON p0.id = cx.id AND p0.place = 0 LEFT JOIN pe p1 ON p1.id = cx.id AND p1.place = 1 LEFT JOIN pr ON pr.id = cx.id LEFT JOIN pv ON pv.id = cx.id AND pv.rank = 1 LEFT JOIN es ON es.id = cx.id
  LEFT JOIN (SELECT id, min_by(kind, o) AS kind, string_agg(kind || '(' || n || ')', ', ' ORDER BY o) FILTER (o <= 3) AS profile FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, kind) AS o FROM re) GROUP BY id) rk ON rk.id = cx.id
  LEFT JOIN (SELECT id, count(*) FILTER (layer IN ('event', 'mixed')) AS event_n, count(*) FILTER (layer IN ('internal', 'mixed')) AS internal_n FROM around WHERE peak GROUP BY id) n ON n.id = cx.id)"""


def _subject(player: str, event: str) -> str:
    return f"CASE WHEN {player} IS NOT NULL AND {event} IS NOT NULL THEN {P.fill_sql(P.SUBJECT_BOTH, player=player, event=event)} WHEN {player} IS NOT NULL THEN {P.fill_sql(P.SUBJECT_PLAYER, player=player)} WHEN {event} IS NOT NULL THEN {P.fill_sql(P.SUBJECT_EVENT, event=event)} END"


def _snippet(text: str, limit: int, ends: list[str]) -> str:
    cut = f"regexp_replace(left({text}, {limit}), '{SQL_SPACE}\\z', '')"
    return f"(CASE WHEN {cut} <> '' AND NOT ({' OR '.join(f'ends_with({cut}, {quoted([e])})' for e in ends)}) THEN {cut} || '...' ELSE {cut} END)"


def _particle(word: str, vowel: str, consonant: str) -> str:
    code = f"unicode(right({word}, 1))"
    return f"(CASE WHEN {code} BETWEEN 44032 AND 55203 AND ({code} - 44032) % 28 > 0 THEN '{consonant}' ELSE '{vowel}' END)"


_LABEL = f"(CASE WHEN evidence IN ('pre_spike', 'both') THEN '{P.CAUSE_BEFORE}' ELSE '{P.CAUSE_DURING}' END)"
_CUT = _snippet("best", 90, N.SENTENCE_ENDS)
NARRATIVE = f"""+{STORY}, {BASE}, q AS (SELECT *, evidence <> 'none' AS has, CASE WHEN pre_text <> '' THEN {_strip("pre_text")} ELSE {_strip("concurrent_text")} END AS best, coalesce(CASE WHEN second IS NOT NULL THEN {P.fill_sql(P.PAIR, first="first", second="second")} END, main, first) AS one FROM bs),
z AS (SELECT *, {_subject("one", "said")} AS about FROM q)
SELECT id, CASE WHEN has AND about IS NOT NULL THEN {P.fill_sql(P.CAUSE_BOTH, label=_LABEL, snippet=_CUT, subject="about")} WHEN has THEN {P.fill_sql(P.CAUSE_SPOKEN, label=_LABEL, snippet=_CUT)} WHEN about IS NOT NULL THEN {P.fill_sql(P.CAUSE_CHAT, subject="about")} ELSE '{P.CAUSE_NONE}' END AS cause,
CASE WHEN profile IS NOT NULL THEN {P.fill_sql(P.REACTION, n="event_n", profile="profile")} ELSE {P.fill_sql(P.REACTION_NONE, n="event_n")} END AS reaction,
CASE WHEN has AND about IS NOT NULL AND kind IS NOT NULL THEN {P.fill_sql(P.READ_BOTH, subject="about", reaction="kind")} WHEN has AND kind IS NOT NULL THEN {P.fill_sql(P.READ_SPOKEN, reaction="kind", n="event_n")} WHEN has THEN '{P.READ_SPOKEN_ONLY}'
 WHEN about IS NOT NULL AND kind IS NOT NULL THEN {P.fill_sql(P.READ_CHAT, subject="about", reaction="kind")} ELSE '{P.READ_NONE}' END AS interpretation,
CASE WHEN about IS NOT NULL AND kind IS NOT NULL THEN {P.fill_sql(P.SHORT_BOTH, subject="about", reaction="kind")} WHEN about IS NOT NULL THEN about WHEN best <> '' THEN CASE WHEN length(best) > 35 THEN left(best, 35) || '...' ELSE best END ELSE '{P.SHORT_NONE}' END AS short FROM z"""
_MOOD_HITS = lambda words: " + ".join(f"contains(near, '{w}')::INT" for w in words)
_V = {"player": "player", "event": "event", "person": "person", "felt": "felt", "reaction": "kind"}
_pick = lambda template, **more: P.fill_sql(template, **{k: v for k, v in (_V | more).items() if "{" + k + "}" in template})
BUZZ = f"""+{STORY}, {BASE}, pn(name, alias) AS (VALUES {", ".join(f"('{n}', '{a}')" for n, a in PRESENT)}),
ph AS (SELECT id, min(name) AS name FROM around JOIN pn ON contains(text, alias) WHERE peak AND layer IN ('internal', 'mixed') GROUP BY id), pf AS (SELECT id, min_by(name, place) AS name FROM pe WHERE name IN (SELECT name FROM pn) GROUP BY id),
q AS (SELECT bs.id, event_n / greatest(event_n + internal_n, 1) AS share, evidence <> 'none' AS spoken, coalesce(main, first) AS player, coalesce(first_event, said) AS event, said, kind, coalesce(pf.name, ph.name) AS person,
  CASE WHEN e >= 3 THEN '{P.MOODS["strong"]}' WHEN e >= 2 THEN '{P.MOODS["surprised"]}' WHEN e >= 1 THEN '{P.MOODS["attentive"]}' WHEN t >= 1 THEN '{P.MOODS["tense"]}' END AS mood FROM (SELECT *, {_MOOD_HITS(MOOD_WORDS)} AS e, {_MOOD_HITS(TENSE_WORDS)} AS t FROM bs) bs LEFT JOIN pf USING (id) LEFT JOIN ph USING (id)),
z AS (SELECT *, share >= 0.4 AND (said IS NOT NULL OR spoken) AS a, 1 - share >= 0.3 AND person IS NOT NULL AS b,
  CASE WHEN mood IS NOT NULL AND kind IS NOT NULL THEN {P.fill_sql(P.FELT_BOTH, mood="mood", reaction="kind", ro=_particle("kind", "로", "으로"))} WHEN mood IS NOT NULL THEN {P.fill_sql(P.FELT_SPOKEN, mood="mood")} WHEN kind IS NOT NULL THEN {P.fill_sql(P.FELT_CHAT, reaction="kind", ro=_particle("kind", "로", "으로"))} ELSE '{P.FELT_NONE}' END AS felt FROM q),
y AS (SELECT *, CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'broadcast_event' WHEN b THEN 'participant_driven' ELSE 'general' END AS buzz FROM z)
SELECT id, buzz, CASE buzz {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.BUZZ_LABEL.items())} END AS label, coalesce({_subject("player", "event")}, CASE WHEN spoken THEN '{P.HEADLINE_SPOKEN}' ELSE '{P.HEADLINE_NONE}' END) AS headline,
CASE buzz WHEN 'broadcast_event' THEN coalesce({_pick(P.BUZZ_EVENT["both"], ga=_particle("player", "가", "이"), eul=_particle("event", "를", "을"))}, {_pick(P.BUZZ_EVENT["player"])}, {_pick(P.BUZZ_EVENT["event"])}, {_pick(P.BUZZ_EVENT["none"])})
 WHEN 'participant_driven' THEN coalesce({_pick(P.BUZZ_PERSON["reaction"], ga=_particle("person", "가", "이"))}, {_pick(P.BUZZ_PERSON["none"])}) WHEN 'mixed' THEN coalesce({_pick(P.BUZZ_MIXED["both"])}, {_pick(P.BUZZ_MIXED["player"])}, {_pick(P.BUZZ_MIXED["none"])})
 ELSE coalesce({_pick(P.BUZZ_GENERAL["reaction"])}, '{P.BUZZ_GENERAL["none"]}') END AS narrative FROM y"""
_some = lambda kinds: f"CAST(coalesce(sum(n) FILTER (kind IN ({quoted(kinds)})), 0) AS BIGINT)"
METRICS = f"""tm AS (SELECT name, ts, row FROM nm JOIN talk USING (row)), gp AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY name ORDER BY ts, row) > 60 THEN 1 ELSE 0 END AS new FROM tm),
ss AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY ts, row) AS session FROM gp), cl AS (SELECT name, session, list_sort(list(ts))[CAST(count(*) // 2 AS BIGINT) + 1] AS anchor FROM ss GROUP BY name, session),
rx AS (SELECT name, kind, count(*) AS n FROM (SELECT name, CASE w {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REACTIONS.items())} END AS kind FROM (SELECT name, unnest({highlight_plans.TOKENS_OF.replace("trim(text)", _strip("text"))}) AS w FROM (SELECT DISTINCT cl.name, talk.ts, author, text FROM cl JOIN talk ON ts BETWEEN greatest(0, anchor - 10) AND anchor + 30))) WHERE kind IS NOT NULL GROUP BY name, kind),
rt AS (SELECT name, CAST(sum(n) AS BIGINT) AS reactions, {_some(L.GOOD_REACTIONS)} AS good, {_some(L.BAD_REACTIONS)} AS bad, {_some(L.TENSE_REACTIONS)} AS tense, string_agg(kind || '(' || n || ')', '  ·  ' ORDER BY n DESC, kind) FILTER (o <= 5) AS top, min_by(kind, o) AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, kind) AS o FROM rx) GROUP BY name),
pp AS (SELECT name, mentions, clusters, coalesce(reactions, 0) AS reactions, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(tense, 0) AS tense, coalesce(top, '') AS top, dominant FROM (SELECT name, count(*) AS mentions FROM tm GROUP BY name) JOIN (SELECT name, count(*) AS clusters FROM cl GROUP BY name) USING (name) LEFT JOIN rt USING (name)),
pl AS (SELECT *, coalesce(CASE dominant {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.SENTIMENT_OF.items())} END, CASE WHEN reactions > 0 AND good * 10 >= reactions * 6 THEN '{P.SENTIMENT_GOOD}' WHEN tense > good AND tense > bad THEN '{P.SENTIMENT_TENSE}' ELSE '{P.SENTIMENT_MIXED}' END) AS label FROM pp),
rn AS (SELECT name, list_slice(list_sort(list(DISTINCT id + 1)), 1, 4) AS ranks FROM tm JOIN sc ON ts BETWEEN ws AND we GROUP BY name),
ps AS (SELECT *, CASE WHEN reactions > 0 THEN good / reactions ELSE 0 END AS positive, floor(reactions / mentions * 100) / 100 AS rate FROM pl JOIN rn USING (name))"""
PEOPLE = f"{STORY}, {METRICS}"
_LINK = f"(CASE WHEN len(ranks) > 0 THEN {P.fill_sql(P.LINKED, rank='ranks[1]')} ELSE '' END)"
_rounded = lambda part, whole, digits: f"coalesce(floor(({2 * 10**digits} * {part} + {whole}) / nullif(2 * {whole}, 0)) / {10**digits}, 0)"
RATES = f"{_rounded('reactions', 'clusters', 1)} AS per_event, {_rounded('reactions', 'mentions', 2)} AS per_mention, {_rounded('good', 'reactions', 2)} AS positive"
_any = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
TONE = f"""st AS (SELECT DISTINCT name, replace(replace(name, ' 프로', ''), ' 선수', '') AS term FROM nm UNION SELECT canonical, alias FROM al WHERE canonical IN (SELECT name FROM nm)),
tw AS (SELECT *, ts > 0.75 * max(ts) OVER (PARTITION BY name) AS late, lower(text) AS low FROM (SELECT DISTINCT name, row, ts, text FROM talk JOIN st ON contains(text, term))),
tn AS (SELECT name, count(*) FILTER ({_any(TONES[0])}) AS newcomer_n, count(*) FILTER ({_any(TONES[1])}) AS praise_n, count(*) FILTER (late AND {_any(TONES[2])}) AS lasting_n, min_by(text, {{'ts': ts, 'row': row}}) FILTER (late AND {_any(TONES[2])}) AS said FROM tw GROUP BY name)"""
READING = f"""CASE WHEN lasting_n > 0 AND len(ranks) >= 2 THEN {P.fill_sql(P.LASTING, mentions="mentions", said="left(said, 25)")} WHEN len(ranks) >= 2 AND clusters >= 2 THEN {P.fill_sql(P.SPREAD, clusters="clusters")} ELSE {P.fill_sql(P.FIRST_LOOK, mentions="mentions", sentiment="label")} END AS interpretation,
CASE WHEN label IN ('감탄·대박', '놀람·흥분') OR praise_n >= 3 THEN {P.fill_sql(P.ACTION_SKILL, linked=_LINK, name="name")} WHEN newcomer_n >= 2 THEN {P.fill_sql(P.ACTION_FOUND, linked=_LINK)} WHEN label = '응원·격려' THEN {P.fill_sql(P.ACTION_CHEER, linked=_LINK)} ELSE {P.fill_sql(P.ACTION_ELSE, linked=_LINK)} END AS action"""
_found = lambda links: f"""dl AS ({links}), dx AS (SELECT dl.name, dl.rank, ws, we, event, CASE WHEN pre_text <> '' THEN {_strip("pre_text")} ELSE {_strip("concurrent_text")} END AS best, printf('%d:%02d:%02d', CAST(anchor AS BIGINT) // 3600, CAST(anchor AS BIGINT) % 3600 // 60, CAST(anchor AS BIGINT) % 60) AS time
 FROM dl JOIN sc ON sc.id + 1 = dl.rank JOIN cx ON cx.id = sc.id LEFT JOIN pv ON pv.id = sc.id AND pv.rank = 1),
dy AS (SELECT name, rank, CASE WHEN best <> '' THEN {P.fill_sql(P.FOUND_SPOKEN, rank="rank", time="time", snippet=_snippet("best", 80, ["다", "요", ".", "。"]))} || coalesce({P.fill_sql(P.FOUND_SPOKEN_EVENT, event="event")}, '') WHEN event IS NOT NULL THEN {P.fill_sql(P.FOUND_EVENT, rank="rank", time="time", name="name", event="event")} ELSE {P.fill_sql(P.FOUND_CHAT, rank="rank", time="time", name="name")} END AS line FROM dx)"""  # noqa: E731
FOUND = _found("SELECT name, unnest(ranks[1:3]) AS rank FROM rn")
FOUND_ALL = _found("SELECT DISTINCT name, id + 1 AS rank FROM tm JOIN sc ON ts BETWEEN ws AND we")
_said = lambda kind, i, n: f"sd{i} AS (SELECT name, string_agg(text, chr(10) ORDER BY r) AS {kind}_said FROM (SELECT name, text, row_number() OVER (PARTITION BY name ORDER BY ts, row) AS r FROM tw WHERE {'late AND ' if i == 2 else ''}{_any(TONES[i])}) WHERE r <= {n} GROUP BY name)"
REC = f"""rec AS (SELECT *, list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{p.lower()}') THEN '{p}' END" for p in PLAYERS)}], lambda x: x IS NOT NULL) AS players, CASE WHEN comment_id % 3 = 0 THEN printf('seg_%04d', comment_id % 50) ELSE '' END AS segment, CASE WHEN comment_id % 3 = 0 THEN (comment_id % 50) * 30.0 END AS low,
  ['high', 'medium', 'low'][CAST(comment_id % 3 + comment_id % 2 AS INTEGER) + 1] AS confidence, comment_id % 4 = 0 AS manual, CASE WHEN comment_id % 2 = 0 THEN 'comment' ELSE 'live_chat' END AS source_type, list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{e}') THEN '{e}' END" for e in ("tion", "ring", "lead"))}], lambda x: x IS NOT NULL) AS events FROM scored)"""
CONCEPT = f"""c(concept, wanted) AS (VALUES {", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in H.CONCEPTS.items())}), cap AS ({highlight_plans.CAPTION}),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY priority DESC, comment_id) AS rank FROM rec JOIN c ON wanted IS NULL OR wanted = category) WHERE rank <= 5),
cn AS (SELECT concept, player, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, min(rank * 100 + ord)) AS r FROM (SELECT concept, rank, unnest(players) AS player, generate_subscripts(players, 1) AS ord FROM ct) GROUP BY concept, player),
sp AS (SELECT *, row_number() OVER (PARTITION BY concept, segment ORDER BY rank) AS o FROM ct WHERE segment <> ''),
fold AS (SELECT DISTINCT concept, 0::BIGINT AS i, []::STRUCT(rank BIGINT, low DOUBLE, high DOUBLE)[] AS kept FROM sp UNION ALL
  SELECT f.concept, f.i + 1, CASE WHEN s.rank IS NOT NULL AND len(list_filter(kept, lambda y: greatest(0.0, least(s.low + 40, y.high) - greatest(s.low, y.low)) / 40 > 0.5)) = 0 THEN list_append(kept, {{'rank': s.rank, 'low': s.low, 'high': s.low + 40}}) ELSE kept END FROM fold f LEFT JOIN (SELECT * FROM sp WHERE o = 1) s ON s.concept = f.concept AND s.rank = f.i + 1 WHERE f.i < 5),
kp AS (SELECT concept, unnest(kept).rank AS rank FROM fold WHERE i = 5),
cc AS (SELECT concept, string_agg(segment || ':' || CASE WHEN manual THEN {P.fill_sql(P.CLIP_UNSURE, confidence="confidence")} ELSE {P.fill_sql(P.CLIP_SURE, confidence="confidence")} END, ',' ORDER BY rank) AS clips FROM ct JOIN kp USING (concept, rank) GROUP BY concept)"""
_case = lambda column, table: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted([v])}" for k, v in table.items()) + " END"
_READY = "(segment <> '' AND coalesce(low, 0) <> 0 AND NOT manual AND confidence IN ('high', 'medium'))"
_WHY = f"CASE WHEN segment = '' THEN '{P.SKIP_NO_SEGMENT}' WHEN manual THEN {P.fill_sql(P.SKIP_MANUAL, segment='segment')} ELSE {P.fill_sql(P.SKIP_UNSURE, confidence='confidence')} END"
FACTS = f"""+{comment_plans.WORDS}, {comment_plans.UNI}, {comment_plans.BI}, {comment_plans.TOPICS}, {comment_plans.ENTITIES}, {comment_plans.THEMES}, {comment_plans.LABELS}, {comment_plans.PROFILE},
f AS (SELECT (SELECT coalesce(list(phrase ORDER BY n DESC, type, phrase), []) FROM topics) AS topics, (SELECT coalesce(list(word ORDER BY n DESC, word), []) FROM (SELECT * FROM entities ORDER BY n DESC, word LIMIT 20)) AS entities, (SELECT coalesce(list(phrase ORDER BY he DESC, phrase), []) FROM themes) AS themes,
  (SELECT label FROM profile WHERE dominant) AS mood, count(*) AS total, count(*) FILTER (is_reply) AS replies, sum(like_count) AS likes FROM comments)"""
_top = lambda column, n: f"array_to_string({column}[1:{n}], ', ')"


def _lines(*lines: str) -> str:
    return "SELECT CAST(i - 1 AS INTEGER) AS place, text FROM (SELECT unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT list_filter([" + ", ".join(lines) + "], lambda x: x IS NOT NULL) AS l FROM f WHERE total > 0))"


RECOMMEND = FACTS + _lines(
    f"CASE WHEN len(topics) > 0 THEN {P.fill_sql(P.RECOMMEND['topics'], topics=_top('topics', 3))} END",
    f"CASE WHEN len(entities) > 0 THEN {P.fill_sql(P.RECOMMEND['entities'], names=_top('entities', 4))} END",
    f"CASE WHEN len(themes) > 0 THEN {P.fill_sql(P.RECOMMEND['themes'], themes=_top('themes', 4))} END",
    _case("mood", P.RECOMMEND_MOOD),
    f"CASE WHEN replies * 5 > total * 2 THEN {P.fill_sql(P.RECOMMEND['debate'], share="printf('%.0f%%', 100.0 * replies / greatest(total, 1))")} END",
    f"CASE WHEN likes < total AND total > 50 THEN {quoted([P.RECOMMEND['low_likes']])} END",
    f"CASE WHEN len(topics) >= 5 THEN {quoted([P.RECOMMEND['recap']])} END",
    f"CASE WHEN len(themes) > 0 OR len(topics) > 0 THEN {P.fill_sql(P.RECOMMEND['clips'], topics='CASE WHEN len(themes) > 0 THEN ' + _top('themes', 3) + ' ELSE ' + _top('topics', 3) + ' END')} END",
)
_INITCAP = "array_to_string(list_transform(string_split(topics[1], ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"
ANGLES = FACTS + _lines(
    f"CASE WHEN len(topics) > 0 THEN {P.fill_sql(P.ANGLES['topic'], topic=_INITCAP)} END",
    f"CASE WHEN len(entities) > 0 THEN {P.fill_sql(P.ANGLES['name'], name='entities[1]')} END",
    f"CASE WHEN mood IN ('cheering_support', 'positive') THEN {quoted([P.ANGLES['goodwill']])} END",
    f"CASE WHEN mood = 'surprise_excitement' THEN {quoted([P.ANGLES['excitement']])} END",
    quoted([P.ANGLES["copy"]]),
)
_BARE = "(CASE " + " ".join(f"WHEN ends_with(name, '{e}') THEN left(name, length(name) - {len(e)})" for e in L.DISPLAY_ENDINGS) + " ELSE name END)"
_ENDS = " OR ".join(f"ends_with(word, '{e}')" for e in L.NO_NAME_ENDINGS)
SEQUENCE_TIME = "printf('%d:%02d', CAST(floor(anchor) AS BIGINT) // 60, CAST(floor(anchor) AS BIGINT) % 60)"


def _story(body: str) -> str:
    return with_views(f"+{STORY} {body}", "turns")


def _people(body: str) -> str:
    return with_views(f"+{PEOPLE}{'' if body.startswith(',') else ' '}{body}", "turns")


def _records(body: str, more: str = "") -> str:
    return with_views(f"+{RECORDS}, {REC}{more} {body}", "comments")


QUERIES = {
    "spike_context": (spike_context, _story("SELECT id, pre_text, concurrent_text, all_text, evidence FROM cx")),
    "spoken_events": (spoken_events, _story("SELECT id, events FROM es")),
    "spike_mentions": (spike_mentions, _story("SELECT id, name, n, rank FROM pm")),
    "spike_events": (spike_events, _story("SELECT id, event, n, rank FROM pv")),
    "spike_people": (spike_people, _story("SELECT id, name, CAST(n AS BIGINT) AS n, place FROM pe")),
    "spike_primary": (spike_primary, _story("SELECT id, name FROM pr")),
    "spike_reactions": (spike_reactions, _story("SELECT id, kind, n FROM re")),
    "spike_narrative": (spike_narrative, with_views(NARRATIVE, "turns")),
    "buzz_summary": (buzz_summary, with_views(BUZZ, "turns")),
    "evidence_marks": (evidence_marks, _story("SELECT id, CASE WHEN evidence IN ('both', 'pre_spike') THEN '◎' WHEN evidence <> 'none' THEN '○' ELSE '△' END AS mark, CASE WHEN id < 3 THEN '★' || (id + 1) WHEN id < 6 THEN '권장' ELSE '참고' END AS label FROM cx")),
    "people_in_messages": (people_in_messages, _story("SELECT row, name FROM nm")),
    "people_metrics": (people_metrics, _people(f"SELECT name, mentions, clusters, reactions, good, bad, tense, top, dominant, label, {RATES} FROM pl")),
    "people_scores": (
        people_scores,
        _people(""", o AS (SELECT name, reactions / clusters * (0.4 + 0.6 * positive) AS o FROM ps WHERE clusters >= 2), m AS (SELECT name, reactions / mentions * (0.4 + 0.6 * positive) * (1 + 0.2 * least(len(ranks), 3)) / log2(mentions + 2) AS m FROM ps)
SELECT name, CAST(CASE WHEN (SELECT max(m) FROM m) > 0 THEN floor(m / (SELECT max(m) FROM m) * 100 + 0.5) ELSE 0 END AS BIGINT) AS marketing, CAST(CASE WHEN (SELECT max(o) FROM o) > 0 THEN floor(o / (SELECT max(o) FROM o) * 100 + 0.5) WHEN o IS NOT NULL THEN 0 END AS BIGINT) AS opportunity FROM m LEFT JOIN o USING (name)"""),
    ),
    "people_reasons": (
        people_reasons,
        _people(f"""SELECT name, CASE WHEN r = '' THEN '{P.REASON_NONE}' ELSE r END AS reason, CASE label {" ".join(f"WHEN '{k}' THEN {P.fill_sql(v, linked=_LINK)}" for k, v in P.SUGGEST.items())} ELSE {P.fill_sql(P.SUGGEST_ELSE, linked=_LINK)} END AS suggestion FROM (SELECT *,
 concat_ws('  ·  ', CASE WHEN mentions <= (SELECT list_sort(list(mentions))[CAST(count(*) // 2 AS BIGINT) + 1] FROM ps) THEN '{P.REASON_FEW}' END, CASE WHEN rate > (SELECT avg(rate) FROM ps) THEN {P.fill_sql(P.REASON_MUCH, rate="printf('%.2f', rate)")} END,
  CASE WHEN positive >= 0.55 THEN {P.fill_sql(P.REASON_GOOD, share="CAST(floor(positive * 100) AS BIGINT)")} END, CASE WHEN len(ranks) > 0 THEN {P.fill_sql(P.REASON_SPIKES, ranks="array_to_string(list_transform(ranks[1:2], lambda x: '#' || x || '위'), ', ')")} END) AS r FROM ps)"""),
    ),
    "tone_words": (tone_words, with_views(f"+{STORY}, {TONE} SELECT * FROM tn", "turns")),
    "discovery": (discovery, with_views(f"+{PEOPLE}, {TONE} SELECT name, {READING} FROM ps JOIN tn USING (name)", "turns")),
    "discovery_context": (discovery_context, _people(f", {FOUND_ALL} SELECT name, rank, line FROM dy")),
    "discovery_cards": (
        discovery_cards,
        with_views(
            f"""+{PEOPLE}, {TONE}, {FOUND}, dm AS (SELECT tw.name, min({{'rank': rank, 'row': row}}) AS o, min_by(text, {{'rank': rank, 'row': row}}) AS text FROM tw JOIN dx USING (name) WHERE ts BETWEEN greatest(0, ws - 60) AND we AND length({_strip("text")}) > 3 GROUP BY tw.name, {_strip("text")}),
ds AS (SELECT name, string_agg(text, chr(10) ORDER BY o) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS r FROM dm) WHERE r <= 6 GROUP BY name), dc AS (SELECT name, string_agg(line, chr(10) ORDER BY rank) AS context FROM dy GROUP BY name), {", ".join(_said(*x) for x in (("newcomer", 0, 3), ("praise", 1, 3), ("lasting", 2, 2)))}
SELECT ps.name, coalesce(context, '') AS context, coalesce(samples, '') AS samples, coalesce(newcomer_said, '') AS newcomer_said, coalesce(praise_said, '') AS praise_said, coalesce(lasting_said, '') AS lasting_said,
{P.fill_sql(P.FOUND_REACTION, mentions="mentions", clusters="clusters", share=f"CAST(floor({_rounded('good', 'reactions', 2)} * 100) AS BIGINT)", rate=f"printf('%.1f', {_rounded('reactions', 'clusters', 1)})", kinds="CASE WHEN top <> '' THEN array_to_string(string_split(top, '  ·  ')[1:3], '  ·  ') ELSE '—' END")} AS reaction, {READING}
FROM ps JOIN tn USING (name) LEFT JOIN dc USING (name) LEFT JOIN ds USING (name) LEFT JOIN sd0 USING (name) LEFT JOIN sd1 USING (name) LEFT JOIN sd2 USING (name)""",
            "turns",
        ),
    ),
    "roster_mentions": (roster_mentions, with_views("""+w AS (SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS name FROM benchmark) WHERE length(name) >= 3) SELECT name, count(*) AS n FROM w JOIN turns ON contains(text, name) GROUP BY name""", "turns")),
    "official_names": (official_names, f"SELECT p_partkey, name FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) || [{quoted(['', *L.DISPLAY_ENDINGS, ' 님'])}][CAST(p_partkey % 7 AS INTEGER) + 1] AS name FROM part) WHERE {_BARE} IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"),
    "plausible_names": (
        plausible_names,
        f"""SELECT n_nationkey, place, length(word) >= 2 AND (word = '김는' OR (NOT ({_ENDS}) AND word NOT IN ({quoted(L.NO_NAMES)}))) AS ok FROM (SELECT n_nationkey, CAST(i - 1 AS BIGINT) AS place, CASE WHEN n_nationkey % 2 = 0 THEN '김' ELSE '장타' END || CASE WHEN n_nationkey % 4 > 1 THEN e ELSE '' END AS word
FROM (SELECT n_nationkey, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT n_nationkey, [{quoted(['', *L.NO_NAME_ENDINGS, '민'])}] AS l FROM nation)))""",
    ),
    "concept_sequences": (
        concept_sequences,
        _records(
            f"""SELECT ct.concept, replace({_case("ct.concept", P.CONCEPT_TITLE)}, '{P.PLAYER_PLACE}', coalesce(any_value(cn.player), '{PLAYERS[0]}')) AS title, {_case("ct.concept", P.CONCEPT_TEXT)} AS description, min_by(cap.caption, rank) AS hook,
string_agg(ct.comment_id || ':' || coalesce(nullif(segment, ''), '-') || ':' || coalesce(CAST(CAST(nullif(low, 0) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY rank) AS overlays, coalesce(any_value(clips), '') AS clips, '{P.CALL}' AS call, 4 + 15 * count(*) + 3 AS seconds
FROM ct JOIN cap ON cap.comment_id = ct.comment_id LEFT JOIN cn ON cn.concept = ct.concept AND cn.r = 1 LEFT JOIN cc ON cc.concept = ct.concept GROUP BY ct.concept""",
            f", {CONCEPT}",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "spike_sequences": (
        spike_sequences,
        chat_plans._spiked(
            f""", w AS (SELECT id, anchor, row, text, author, row_number() OVER (PARTITION BY id ORDER BY ts, row) AS t, row_number() OVER (PARTITION BY id ORDER BY weight DESC, ts, row) AS h FROM j WHERE id <= 5),
a AS (SELECT id, any_value(anchor) AS anchor, string_agg(author || ':' || text, ',' ORDER BY t) FILTER (t <= 50) AS messages, any_value(author || ':' || left(text, 45)) FILTER (h = 1) AS hook, any_value(left(text, 45)) FILTER (h = 1) AS caption FROM w GROUP BY id)
SELECT CAST(id AS BIGINT) AS id, {P.fill_sql(P.SPIKE_TITLE, rank="id", time=SEQUENCE_TIME)} AS title, {P.fill_sql(P.SPIKE_TEXT, n="n", weight="CAST(floor(weight) AS BIGINT)", time=SEQUENCE_TIME, length="'15.0'")} AS description, greatest(0.0, anchor - 10) AS clip_start, anchor + 5 AS clip_end, messages, hook, printf('spike_%03d', id) || ':15.0:{P.CLIP_SPIKE}' AS clips, printf('spike_%03d', id) || '_hook:' || caption || ':clutch_hype:' || printf('spike_%03d', id) AS overlays, CAST(22 AS BIGINT) AS seconds FROM a JOIN spikes ON rank = id"""
        ),
    ),
    "event_words": (event_words, _records("SELECT event, count(*) AS n FROM (SELECT unnest(events) AS event FROM rec) GROUP BY event")),
    "title_suggestions": (
        title_suggestions,
        _records(
            f"""SELECT CAST(i - 1 AS INTEGER) AS place, title FROM (SELECT unnest(l) AS title, generate_subscripts(l, 1) AS i FROM (SELECT [{", ".join(P.fill_sql(t, **{k: v for k, v in {"first": f"'{PLAYERS[0]}'", "second": f"'{PLAYERS[1]}'", "event": "event", "total": "total"}.items() if "{" + k + "}" in t}) for t in P.TITLES)}] AS l
FROM (SELECT count(*) AS total, coalesce((SELECT event FROM (SELECT unnest(events) AS event FROM rec) GROUP BY event ORDER BY count(*) DESC, event LIMIT 1), '{P.SCENE}') AS event FROM rec) WHERE total > 0))"""
        ),
    ),
    "plan_arcs": (
        plan_arcs,
        _records(
            f"""SELECT player, n, {highlight_plans.ARC} AS arc, categories, top, peak FROM (SELECT player, {highlight_plans.SHARES}, string_agg(comment_id, ',' ORDER BY pos) FILTER (pos <= 3) AS top, min_by(comment_id, pos) AS peak FROM pa GROUP BY player) JOIN (SELECT player, string_agg(category || '(' || k || ')', ',' ORDER BY k DESC, ord) AS categories FROM (SELECT player, category, count(*) AS k, min(pos) AS ord FROM pa GROUP BY player, category) GROUP BY player) USING (player)""",
            f""", pa AS (SELECT player, comment_id, category, row_number() OVER (PARTITION BY player ORDER BY priority DESC, comment_id) AS pos FROM rec JOIN (VALUES {", ".join(f"('{p}')" for p in PLAYERS)}) v(player) ON contains(array_to_string(players, '|'), player))""",
        ),
    ),
    "important_points": (
        important_points,
        _records(f"""SELECT comment_id, CASE WHEN priority >= 70 THEN 'critical' ELSE 'high' END AS weight FROM (SELECT *, row_number() OVER (ORDER BY {highlight_plans._ordered(("dramatic", "controversial", "analytical", "critical"))}, priority DESC, comment_id) AS o FROM rec WHERE category IN ('dramatic', 'controversial', 'analytical', 'critical') ORDER BY o LIMIT 5) WHERE priority >= 50 ORDER BY o LIMIT 3"""),
    ),
    "package_meta": (
        package_meta,
        with_views(f"+{RECORDS}, {REC}, {chat_plans.CANDIDATES}, {chat_plans.NMS} SELECT count(*) FILTER (source_type = 'comment') AS comments, count(*) FILTER (source_type = 'live_chat') AS messages, (SELECT count(*) FROM segments) AS segments, (SELECT count(*) FROM spikes) AS spikes, count(*) FILTER (source_type = 'live_chat') > 0 AS has_chat, false AS spike_mode FROM rec", "comments", "chat", "segments").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "package_by_spikes": (
        package_by_spikes,
        with_views(f"+{RECORDS}, {REC}, {chat_plans.CANDIDATES}, {chat_plans.NMS} SELECT count(*) FILTER (source_type = 'comment') AS comments, count(*) FILTER (source_type = 'live_chat') AS messages, (SELECT count(*) FROM segments) AS segments, (SELECT count(*) FROM spikes) AS spikes, count(*) FILTER (source_type = 'live_chat') > 0 AS has_chat, count(*) FILTER (source_type = 'live_chat') > 0 AND (SELECT count(*) FROM spikes) > 0 AS spike_mode FROM rec", "comments", "chat", "segments").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "package_shorts": (
        package_shorts,
        chat_plans._spiked(f", w AS (SELECT id, any_value(anchor) AS anchor, count(*) AS c FROM j WHERE id <= 5 GROUP BY id) SELECT CAST(id AS BIGINT) AS id, {P.fill_sql(P.SPIKE_TITLE, rank='id', time=SEQUENCE_TIME)} AS title, greatest(0.0, anchor - 10) AS clip_start, least(c, 50) AS messages FROM w"),
    ),
    "package_parts": (
        package_parts,
        _records(
            f"""SELECT part, p.comment_id, part_role AS role, {_case("p.category", L.USAGE)} AS usage, md5(cap.caption) AS caption FROM (
SELECT 'opening_hook' AS part, 'opening_hook' AS part_role, * FROM (SELECT comment_id, category FROM (SELECT * FROM rec ORDER BY priority DESC, comment_id LIMIT 30) ORDER BY {highlight_plans._ordered(('dramatic', 'analytical', 'controversial', 'funny', 'clutch_hype'))}, priority DESC, comment_id LIMIT 1)
UNION ALL SELECT 'turning_points', 'turning_point', * FROM (SELECT comment_id, category FROM rec WHERE category IN ('dramatic', 'controversial', 'analytical', 'critical') ORDER BY {highlight_plans._ordered(('dramatic', 'controversial', 'analytical', 'critical'))}, priority DESC, comment_id LIMIT 5)
UNION ALL SELECT 'closing_note', 'closing_note', * FROM (SELECT comment_id, category FROM rec WHERE category IN ('supportive', 'emotional', 'representative') AND likes >= 1 ORDER BY {highlight_plans._ordered(('supportive', 'emotional', 'representative'))}, priority DESC, comment_id LIMIT 1)) p JOIN cap ON cap.comment_id = p.comment_id""",
            f", cap AS ({highlight_plans.CAPTION})",
        ),
    ),
    "chatters": (chatters, with_views("SELECT count(*) AS messages, count(*) FILTER (row % 4 <> 1) AS texts, count(DISTINCT author || conv_id) FILTER (row % 3 > 0) AS chatters, max(conv_id * 20.0 + row) AS last FROM turns", "turns")),
    "plan_counts": (
        plan_counts,
        _records(
            """SELECT 'meta' AS part, 1 AS n UNION ALL SELECT 'opening_hook', least(1, count(*)) FROM rec UNION ALL SELECT 'acts', count(DISTINCT act) FROM acted
UNION ALL SELECT 'bridges', coalesce(CAST(sum(least(3, CASE WHEN good > 0 THEN good ELSE n - 1 END)) AS BIGINT), 0) FROM (SELECT act, count(*) AS n, count(*) FILTER (pos > 1 AND category IN ('analytical', 'representative', 'dramatic')) AS good FROM (SELECT *, row_number() OVER (PARTITION BY act ORDER BY priority DESC, comment_id) AS pos FROM acted) GROUP BY act)
UNION ALL SELECT 'categories', count(*) FROM (SELECT DISTINCT act, category FROM acted) UNION ALL SELECT 'player_arcs', count(DISTINCT p) FROM (SELECT unnest(players) AS p FROM rec) UNION ALL SELECT 'turning_points', least(5, count(*)) FROM rec WHERE category IN ('dramatic', 'controversial', 'analytical', 'critical')
UNION ALL SELECT 'closing_note', least(1, count(*)) FROM rec UNION ALL SELECT 'key_event_keywords', count(DISTINCT e) FROM (SELECT unnest(events) AS e FROM rec) UNION ALL SELECT 'title_suggestions', 5""",
            f", {ACT}",
        ),
    ),
    "plan_json": (
        plan_json,
        _records(
            f"""SELECT l.act AS act_id, coalesce(n, 0) AS comment_count, anchor, md5(text) AS digest, coalesce(bridges, '') AS bridges, coalesce(categories, '') AS categories FROM (VALUES {", ".join(f"('{a}')" for a in P.ACT_LABELS)}) l(act)
LEFT JOIN (SELECT act, count(*) AS n, arg_min(comment_id, pos) AS anchor, arg_min(text, pos) AS text FROM p GROUP BY act) a ON a.act = l.act LEFT JOIN (SELECT act, string_agg(category || ':' || k, ',' ORDER BY category || ':' || k) AS categories FROM (SELECT act, category, count(*) AS k FROM acted GROUP BY act, category) GROUP BY act) c ON c.act = l.act
LEFT JOIN (SELECT act, string_agg(comment_id, ',' ORDER BY r) AS bridges FROM (SELECT *, row_number() OVER (PARTITION BY act ORDER BY pos) AS r FROM q WHERE good OR (NOT anyone AND pos <= 4)) WHERE r <= 3 GROUP BY act) b ON b.act = l.act""",
            f""", {ACT}, p AS (SELECT *, row_number() OVER (PARTITION BY act ORDER BY priority DESC, comment_id) AS pos, category IN ('analytical', 'representative', 'dramatic') AS good FROM acted), q AS (SELECT *, bool_or(good) OVER (PARTITION BY act) AS anyone FROM p WHERE pos > 1)""",
        ),
    ),
    "plan_script": (
        plan_script,
        _records(f"""SELECT CASE WHEN priority >= 70 THEN 'critical' WHEN priority >= 50 THEN 'high' WHEN priority >= 30 THEN 'medium' ELSE 'low' END AS weight, category, likes FROM rec WHERE category IN ('dramatic', 'controversial', 'analytical', 'critical') ORDER BY {highlight_plans._ordered(("dramatic", "controversial", "analytical", "critical"))}, priority DESC, comment_id LIMIT 5"""),
    ),
    "comment_cards": (comment_cards, _records(f"SELECT 'peak' AS role, comment_id, array_to_string(players, '|') AS players, {_case('category', L.USAGE)} AS usage, nullif(segment, '') AS segment, nullif(low, 0) AS low, low + 40 AS high, manual FROM rec")),
    "render_report": (
        render_report,
        _records(
            f"""SELECT author, count(*) FILTER (ready) AS rendered, count(*) FILTER (NOT ready) AS skipped, CASE WHEN count(*) FILTER (ready) > 0 THEN 'ok' ELSE 'placeholder_only' END AS status,
CASE WHEN count(*) FILTER (NOT ready) > 0 THEN {P.fill_sql(P.SKIPPED, shown="string_agg(why, '; ' ORDER BY o) FILTER (NOT ready AND o <= 3)")} || CASE WHEN count(*) FILTER (NOT ready) > 3 THEN {P.fill_sql(P.SKIPPED_MORE, n="(count(*) FILTER (NOT ready) - 3)")} ELSE '' END ELSE '' END AS note
FROM (SELECT *, row_number() OVER (PARTITION BY author, ready ORDER BY comment_id) AS o FROM (SELECT author, comment_id, {_READY} AS ready, {_WHY} AS why FROM rec)) GROUP BY author"""
        ),
    ),
    "recommendations": (recommendations, with_views(RECOMMEND, "comments")),
    "thread_recommendations": (
        thread_recommendations,
        with_views("+comments AS (SELECT conv_id * 1000 + row AS comment_id, author, text, (conv_id + row) % 7 AS like_count, row > 0 AS is_reply FROM turns), " + RECOMMEND.removeprefix("+"), "turns"),
    ),
    "marketing_angles": (marketing_angles, with_views(ANGLES, "comments")),
    "notable_entities": (notable_entities, with_views(f"+{comment_plans.ENTITIES} SELECT word, n FROM entities ORDER BY n DESC, word LIMIT 20", "comments")),
    "highlight_signals": (highlight_signals, with_views("SELECT comment_id, author, left(text, 120) AS preview, like_count AS likes, '" + P.SIGNAL_NOTE + "' AS note FROM comments ORDER BY like_count DESC, comment_id LIMIT 10", "comments")),
    "min_likes": (min_likes, with_views("SELECT comment_id, like_count FROM comments WHERE like_count >= 90", "comments")),
    "word_confidence": (word_confidence, with_views(f"+{highlight_plans.JACCARD} SELECT id, seq, 'low' AS confidence, 'overlap:' || replace(overlap, ',', ',overlap:') AS signals FROM jac WHERE common * 100 + named * 6 * either >= either * 7", "comments")),
}
