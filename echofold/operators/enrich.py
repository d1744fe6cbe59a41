"""What happened in a spike: commentary around it, who and what is spoken of, and how that reads.

Spikes have id, ws, we and anchor; segments seq, start, end and text; messages ts, row and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from .. import phrases as P
from .. import stages
from ..functions import text as T
from . import entities as E
from .chat import interval_join
from .matching import overlaps
from .terms import contained


def context(spikes: DataFrame, segments: DataFrame, size: float | None = None) -> DataFrame:
    """id, pre_text (from 15 s before the anchor), concurrent_text (the window), all_text (from 60 s before the anchor to 10 s behind the window) and
    evidence, for every spike.  Texts are joined in order and cut to 300, 300 and 400 characters."""
    early, wide = F.greatest(F.lit(0.0), F.col("anchor") - 15), F.greatest(F.lit(0.0), F.col("anchor") - 60)
    spans = spikes.withColumn("low", F.least(wide, "ws")).withColumn("high", F.greatest(F.col("we") + 10, F.col("anchor")))
    spoken = segments.filter(T.has_text(F.col("text"))).select("seq", "start", "end", T.strip(F.col("text")).alias("text"))
    rows = overlaps(spoken, spans, size)

    def within(low: Column, high: Column, limit: int) -> Column:
        own = F.when((F.col("end") >= low) & (F.col("start") <= high), F.struct("seq", "text"))
        return F.left(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), " "), F.lit(limit))

    found = rows.groupBy("id").agg(
        within(early, F.col("anchor"), 300).alias("pre_text"),
        within(F.col("ws"), F.col("we"), 300).alias("concurrent_text"),
        within(wide, F.col("we") + 10, 400).alias("all_text"),
    )
    out = spikes.select("id").join(found, "id", "left").select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("pre_text", "concurrent_text", "all_text")))
    before, during = T.has_text(F.col("pre_text")), T.has_text(F.col("concurrent_text"))
    return out.withColumn("evidence", F.when(before & during, "both").when(before, "pre_spike").when(during, "concurrent").otherwise("none"))


def near_text() -> Column:
    return F.concat("pre_text", F.lit(" "), "concurrent_text")


def spoken_events(contexts: DataFrame, events: dict[str, str] = L.EVENTS_OF, not_now: str = L.NOT_NOW) -> DataFrame:
    """id, events: what commentary says is happening, in order of first words; a word counts if any place of it isn't conditional or past."""
    table = F.create_map(*(F.lit(x) for kv in events.items() for x in kv))
    rows = contexts.select("id", T.once(near_text()).alias("t")).select("id", "t", T.once(F.array_distinct(F.split("t", T.SPACE))).alias("w"))
    happening = F.filter("w", lambda w: w.isin(list(events)) & T.in_open_context(F.col("t"), w, not_now))
    return rows.select("id", F.array_distinct(F.transform(happening, lambda w: table[w])).alias("events"))


def named_in(messages: DataFrame, roster: DataFrame, aliases: DataFrame, keys: list[str], patterns: list[str] | None = None, least: int = 3, **resolving) -> DataFrame:
    """keys, name: the people that each message names, each once: with a form of address, or by a whole roster name of at least so many characters."""
    patterns = [T.TITLED, T.TITLED_SHORT] if patterns is None else patterns
    tokens = messages.select(*keys, F.explode(F.array_distinct(F.concat(*(T.titled(F.col("text"), p) for p in patterns)))).alias("token"))
    known = E.resolve(tokens, roster, aliases, **resolving).filter("name IS NOT NULL").select("token", "name")
    titled = tokens.join(known, "token").select(*keys, "name")
    bare = contained(messages, F.col("text"), roster.select(F.col("name").alias("_bare")).filter(F.length("name") >= least), "_bare", columns=keys)
    bare = bare.join(aliases.select(F.col("alias").alias("_bare"), "canonical"), "_bare", "left").select(*keys, F.coalesce("canonical", "_bare").alias("name"))
    return titled.unionByName(bare).distinct()


def spoken_names(contexts: DataFrame, roster: DataFrame, aliases: DataFrame, registry: DataFrame | None = None, pattern: str = T.TITLED_SPACED, **resolving) -> DataFrame:
    """id, name, place: people named in the commentary, by first appearance; none whose role isn't to play."""
    tokens = contexts.select("id", F.posexplode(T.titled(near_text(), pattern)).alias("place", "token"))
    known = E.resolve(tokens, roster, aliases, **resolving).filter("name IS NOT NULL").select("token", "name")
    rows = tokens.join(known, "token").groupBy("id", "name").agg(F.min("place").alias("place"))
    return rows if registry is None else E.players_only(rows, registry).select("id", "name", "place")


def ranked(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """The most frequent values of each key, ties by the value: key, value, n, rank."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(key, value, "n", "rank")


def mentions_and_events(
    messages: DataFrame, named: DataFrame, events: dict[str, str] = L.EVENTS_OF, cheer: str = L.CHEER, sure: list[str] = L.SURE_EVENTS, most: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(id, name, n, rank) and (id, event, n, rank) of messages (id, row, tight, text) and the people they name (id, row, name).

    From the tight window alone; where that has neither names nor events, from all messages.  An event word that is wished for doesn't count, nor do
    events that need proof with one mention.
    """
    table = F.create_map(*(F.lit(x) for kv in events.items() for x in kv))
    words = messages.select("id", "row", "tight", F.regexp_extract("text", cheer, 1).alias("_wish"), F.explode(T.reaction_tokens(F.col("text"))).alias("w"))
    found = words.filter(F.col("w").isin(list(events)) & (F.col("w") != F.col("_wish"))).select("id", "row", "tight", table[F.col("w")].alias("event"))
    people = named.join(messages.select("id", "row", "tight").distinct(), ["id", "row"]).select("id", "row", "tight", "name")
    near = people.filter("tight").select("id").unionByName(found.filter("tight").select("id")).distinct().withColumn("_near", F.lit(True))
    used = lambda df: df.join(near, "id", "left").filter(F.col("tight") | F.col("_near").isNull())
    players = used(people).groupBy("id", "name").agg(F.count("*").alias("n"))
    counts = used(found).groupBy("id", "event").agg(F.count("*").alias("n")).filter(~F.col("event").isin(sure) | (F.col("n") >= 2))
    return ranked(players, "id", "name", most), ranked(counts, "id", "event", most)


def primary(commentary: DataFrame, chat: DataFrame, peak: DataFrame, endings: list[str] = L.DISPLAY_ENDINGS) -> DataFrame:
    """id, name: the person a spike is about.  commentary: id, name, place; chat: id, name, n; peak: id, text.

    The first person of the commentary whom the chat names too; else the one whom most peak messages hold, the first of equal ones; without
    commentary, the one the chat names most.
    """
    bare = F.col("name")
    for e in reversed(endings):
        bare = F.when(F.endswith(F.col("name"), F.lit(e)), F.expr(f"left(name, length(name) - {len(e)})")).otherwise(bare)
    spoken = commentary.select("id", "name", "place").withColumn("_bare", bare)
    held = spoken.select("id", "name", "_bare").join(peak.select("id", "text"), "id").filter(F.contains(F.col("text"), F.col("_bare")) | F.contains(F.col("text"), F.col("name")))
    held = held.groupBy("id", "name").agg(F.count("*").alias("_held"))
    both = chat.select("id", "name", F.lit(True).alias("_both")).distinct()
    rows = spoken.join(held, ["id", "name"], "left").join(both, ["id", "name"], "left")
    order = F.struct(F.when(F.col("_both"), 0).otherwise(1).alias("a"), F.when(F.col("_both"), 0).otherwise(-F.coalesce("_held", F.lit(0))).alias("b"), F.col("place").alias("c"))
    first = rows.groupBy("id").agg(F.min_by("name", order).alias("_spoken"))
    said = chat.groupBy("id").agg(F.min_by("name", F.struct((-F.col("n")).alias("a"), F.col("name").alias("b"))).alias("_said"))
    return first.join(said, "id", "full").select("id", F.coalesce("_spoken", "_said").alias("name"))


def ordered_people(commentary: DataFrame, chat: DataFrame, spoken_weight: int = 99) -> DataFrame:
    """id, name, n, place (from 0): people of the commentary first, in order, with a weight of their own; then the chat's, by rank, each name once."""
    a = commentary.select("id", "name", F.lit(spoken_weight).cast("long").alias("n"), F.struct(F.lit(0).alias("s"), F.col("place").cast("int").alias("p")).alias("o"))
    b = chat.select("id", "name", "n", F.struct(F.lit(1).alias("s"), F.col("rank").cast("int").alias("p")).alias("o"))
    rows = a.unionByName(b).groupBy("id", "name").agg(F.min_by("n", "o").alias("n"), F.min("o").alias("o"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("o")) - 1).drop("o")


def subject(players: Column, event: Column) -> Column:
    return F.when(players.isNotNull() & event.isNotNull(), P.fill(P.SUBJECT_BOTH, player=players, event=event)).when(players.isNotNull(), P.fill(P.SUBJECT_PLAYER, player=players)).when(event.isNotNull(), P.fill(P.SUBJECT_EVENT, event=event))


def snippet(text: Column, limit: int, ends: list[str]) -> Column:
    """The beginning of a text; dots where it doesn't end like a sentence."""
    cut = F.regexp_replace(F.left(text, F.lit(limit)), rf"{T.SPACE}\z", "")
    whole = F.lit(False)
    for e in ends:
        whole = whole | F.endswith(cut, F.lit(e))
    return F.when((cut != "") & ~whole, F.concat(cut, F.lit("..."))).otherwise(cut)


# What sentences end in.
SENTENCE_ENDS = ["다", "요", "죠", ".", "。"]


def narrative(rows: DataFrame) -> DataFrame:
    """id, cause, reaction, interpretation, short.

    rows: id, pre_text, concurrent_text, evidence, first and second (the two people named first), main (the person the spike is about), event, profile (an array of
    kind and n, by count) and n (messages).  Any of the texts and names may be null.
    """
    has = F.col("evidence") != "none"
    best = F.when(T.has_text(F.col("pre_text")), T.strip(F.col("pre_text"))).otherwise(T.strip(F.col("concurrent_text")))
    pair = F.when(F.col("second").isNotNull(), P.fill(P.PAIR, first=F.col("first"), second=F.col("second")))
    one = F.coalesce(pair, F.col("main"), F.col("first"))
    kind = F.get("profile", F.lit(0))["kind"]
    rows = rows.select("id", "n", "evidence", "profile", T.once(best).alias("best"), T.once(subject(one, F.col("event"))).alias("subject"), kind.alias("kind"))
    label = F.when(F.col("evidence").isin("pre_spike", "both"), P.CAUSE_BEFORE).otherwise(P.CAUSE_DURING)
    cut = snippet(F.col("best"), 90, SENTENCE_ENDS)
    about, kind, n = F.col("subject"), F.col("kind"), F.col("n")
    cause = (
        F.when(has & about.isNotNull(), P.fill(P.CAUSE_BOTH, label=label, snippet=cut, subject=about))
        .when(has, P.fill(P.CAUSE_SPOKEN, label=label, snippet=cut))
        .when(about.isNotNull(), P.fill(P.CAUSE_CHAT, subject=about))
        .otherwise(P.CAUSE_NONE)
    )
    shown = F.array_join(F.transform(F.slice("profile", 1, 3), lambda x: F.concat(x["kind"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    reaction = F.when(F.size("profile") > 0, P.fill(P.REACTION, n=n, profile=shown)).otherwise(P.fill(P.REACTION_NONE, n=n))
    read = (
        F.when(has & about.isNotNull() & kind.isNotNull(), P.fill(P.READ_BOTH, subject=about, reaction=kind))
        .when(has & kind.isNotNull(), P.fill(P.READ_SPOKEN, reaction=kind, n=n))
        .when(has, P.READ_SPOKEN_ONLY)
        .when(about.isNotNull() & kind.isNotNull(), P.fill(P.READ_CHAT, subject=about, reaction=kind))
        .otherwise(P.READ_NONE)
    )
    text = F.when(F.length("best") > 35, F.concat(F.left("best", F.lit(35)), F.lit("..."))).otherwise(F.col("best"))
    short = F.when(about.isNotNull() & kind.isNotNull(), P.fill(P.SHORT_BOTH, subject=about, reaction=kind)).when(about.isNotNull(), about).when(F.col("best") != "", text).otherwise(P.SHORT_NONE)
    return rows.select("id", cause.alias("cause"), reaction.alias("reaction"), read.alias("interpretation"), short.alias("short"))


def buzz_summary(rows: DataFrame) -> DataFrame:
    """id, buzz, label, headline, narrative.

    rows: id, event_n and internal_n (messages of either layer), spoken (whether there is commentary), player, event (of the commentary, else of the chat), chat_event (whether the chat
    names any), mood (a level, see entities.mood), kind (of reaction) and person (a participant who is spoken of); any of the names may be null.
    """
    total = F.greatest(F.col("event_n") + F.col("internal_n"), F.lit(1))
    share = F.col("event_n") / total
    kind_of = E.buzz(share, F.col("chat_event") | F.col("spoken"), 1 - share, F.col("person").isNotNull())
    rows = rows.withColumn("buzz", T.once(kind_of))
    player, event, person, kind = (F.col(c) for c in ("player", "event", "person", "kind"))
    headline = F.coalesce(subject(player, event), F.when(F.col("spoken"), P.HEADLINE_SPOKEN).otherwise(P.HEADLINE_NONE))
    mood = F.create_map(*(F.lit(x) for kv in P.MOODS.items() for x in kv))[F.col("mood")]
    ga = lambda w: T.particle(w, "가", "이")
    felt = (
        F.when(mood.isNotNull() & kind.isNotNull(), P.fill(P.FELT_BOTH, mood=mood, reaction=kind, ro=T.particle(kind, "로", "으로")))
        .when(mood.isNotNull(), P.fill(P.FELT_SPOKEN, mood=mood))
        .when(kind.isNotNull(), P.fill(P.FELT_CHAT, reaction=kind, ro=T.particle(kind, "로", "으로")))
        .otherwise(P.FELT_NONE)
    )
    rows = rows.withColumn("_felt", T.once(felt))
    felt = F.col("_felt")
    of_event = F.coalesce(
        P.fill(P.BUZZ_EVENT["both"], player=player, ga=ga(player), event=event, eul=T.particle(event, "를", "을"), felt=felt),
        P.fill(P.BUZZ_EVENT["player"], player=player, felt=felt),
        P.fill(P.BUZZ_EVENT["event"], event=event, felt=felt),
        P.fill(P.BUZZ_EVENT["none"], felt=felt),
    )
    of_person = F.coalesce(P.fill(P.BUZZ_PERSON["reaction"], person=person, ga=ga(person), reaction=kind), P.fill(P.BUZZ_PERSON["none"], person=person))
    of_both = F.coalesce(P.fill(P.BUZZ_MIXED["both"], player=player, event=event, person=person, felt=felt), P.fill(P.BUZZ_MIXED["player"], player=player, person=person), P.fill(P.BUZZ_MIXED["none"], person=person, felt=felt))
    general = F.coalesce(P.fill(P.BUZZ_GENERAL["reaction"], reaction=kind), F.lit(P.BUZZ_GENERAL["none"]))
    text = F.when(F.col("buzz") == "broadcast_event", of_event).when(F.col("buzz") == "participant_driven", of_person).when(F.col("buzz") == "mixed", of_both).otherwise(general)
    label = F.create_map(*(F.lit(x) for kv in P.BUZZ_LABEL.items() for x in kv))[F.col("buzz")]
    return rows.select("id", "buzz", label.alias("label"), headline.alias("headline"), text.alias("narrative"))


def enrich(
    spikes: DataFrame, messages: DataFrame, segments: DataFrame, roster: DataFrame, aliases: DataFrame, size: float, registry: DataFrame | None = None, present: DataFrame | None = None, words: dict | None = None, kept: stages.Stages | None = None
) -> dict[str, DataFrame]:
    """Everything that is known of spikes, as tables by id: context, events (spoken), people, mentions, chat_events, primary, reactions, narrative and buzz.

    messages: row, ts, text, layer (see entities.message_layer).  present: name, alias of participants who chat.  words: other word lists and patterns,
    by the names of L's and T's.  Each input is read once: the spikes, their commentary, the messages around them and the names in those are stage tables of `kept`
    (by default the session's own), and every result is derived from them.
    """
    keep = (kept or stages.of(spikes.sparkSession)).keep
    spikes = keep(spikes, "spikes")
    w = {"events": L.EVENTS_OF, "not_now": L.NOT_NOW, "cheer": L.CHEER, "sure": L.SURE_EVENTS, "reactions": L.REACTIONS | L.REACTION_WORDS, "excited": L.EXCITED, "tense": L.TENSE, "patterns": None, "spaced": T.TITLED_SPACED, "resolving": {}} | (words or {})
    contexts = keep(context(spikes, segments, size), "context")
    tight = F.col("ts").between(F.greatest(F.lit(0.0), F.col("anchor") - 10), F.col("anchor") + 5)
    spans = spikes.withColumn("low", F.greatest(F.lit(0.0), F.least(F.col("ws") - 30, F.col("anchor") - 10))).withColumn("high", F.greatest("we", F.col("anchor") + 5))
    around = interval_join(messages, spans, size).withColumn("tight", tight).withColumn("peak", F.col("ts").between(F.col("ws"), F.col("we")))
    around = around.withColumn("near", (F.col("ts") >= F.greatest(F.lit(0.0), F.col("ws") - 30)) & (F.col("ts") <= F.col("we")))
    around = keep(around.select("id", "row", "tight", "peak", "near", "layer", "text"), "around")
    spoken_of = around.filter(F.col("layer").isin("event", "mixed") & (F.col("tight") | F.col("near"))).select("id", "row", "tight", "text")
    named = named_in(spoken_of, roster, aliases, ["id", "row"], w["patterns"], **w["resolving"])
    if registry is not None:
        named = E.players_only(named, registry).select("id", "row", "name")
    named = keep(named, "named")
    mentions, chat_events = mentions_and_events(spoken_of, named, w["events"], w["cheer"], w["sure"])
    spoken = spoken_names(contexts, roster, aliases, registry, w["spaced"], **w["resolving"])
    spoken = keep(spoken, "spoken")
    mentions, chat_events = keep(mentions, "mentions"), keep(chat_events, "events")
    people = ordered_people(spoken, mentions)
    main = primary(spoken, mentions, around.filter("peak").select("id", "text"))
    peak = around.filter("peak")
    reactions = E.reaction_counts(peak.filter(F.col("layer").isin("event", "mixed")), "id", reactions=w["reactions"], more={}).withColumnRenamed("reaction", "kind")
    profile = reactions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind"))).alias("p"))
    profile = profile.select("id", F.transform("p", lambda x: F.struct(x["kind"].alias("kind"), (-x["o"]).alias("n"))).alias("profile"))
    events = spoken_events(contexts, w["events"], w["not_now"])
    counts = peak.groupBy("id").agg(F.count_if(F.col("layer").isin("event", "mixed")).alias("event_n"), F.count_if(F.col("layer").isin("internal", "mixed")).alias("internal_n"))
    top = people.groupBy("id").agg(F.max(F.when(F.col("place") == 0, F.col("name"))).alias("first"), F.max(F.when(F.col("place") == 1, F.col("name"))).alias("second"))
    base = contexts.join(top, "id", "left").join(main.withColumnRenamed("name", "main"), "id", "left").join(chat_events.filter("rank = 1").select("id", F.col("event").alias("said")), "id", "left")
    base = base.join(profile, "id", "left").join(counts, "id", "left").join(events, "id", "left")
    kind = T.once(F.coalesce("profile", F.array().cast("array<struct<kind:string,n:bigint>>")))
    base = base.withColumn("profile", kind).withColumn("event_n", F.coalesce("event_n", F.lit(0).cast("long"))).withColumn("internal_n", F.coalesce("internal_n", F.lit(0).cast("long")))
    story = narrative(base.withColumn("event", F.col("said")).withColumn("n", F.col("event_n")))
    person = F.lit(None).cast("string")
    if present is not None:
        named_first = people.join(present.select("name").distinct(), "name").groupBy("id").agg(F.min_by("name", "place").alias("_named"))
        held = contained(peak.filter(F.col("layer").isin("internal", "mixed")), F.col("text"), present.select("name", "alias"), "alias", columns=["id"]).groupBy("id").agg(F.min("name").alias("_held"))
        base = base.join(named_first, "id", "left").join(held, "id", "left")
        person = F.coalesce("_named", "_held")
    summary = buzz_summary(
        base.select(
            "id", "event_n", "internal_n", (F.col("evidence") != "none").alias("spoken"), F.coalesce("main", "first").alias("player"), F.coalesce(F.get("events", F.lit(0)), F.col("said")).alias("event"), F.col("said").isNotNull().alias("chat_event"),
            E.mood(near_text(), w["excited"], w["tense"]).alias("mood"), F.get("profile", F.lit(0))["kind"].alias("kind"), person.alias("person"),
        )
    )
    return {"context": contexts, "events": events, "people": people, "mentions": mentions, "chat_events": chat_events, "primary": main, "reactions": reactions, "narrative": story, "buzz": summary}


def bare_name(name: Column) -> Column:
    """Without a form of address."""
    return F.replace(F.replace(name, F.lit(" 프로"), F.lit("")), F.lit(" 선수"), F.lit(""))


def search_terms(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, term: what messages about a person hold, the bare name or an alias of the person."""
    own = names.select("name").distinct()
    known = aliases.select(F.col("canonical").alias("name"), F.col("alias").alias("term"))
    return own.select("name", bare_name(F.col("name")).alias("term")).unionByName(known.join(own, "name", "left_semi")).distinct()


def told_of(messages: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, ts, row, text: the messages (row, ts, text) that hold a search term of a person, each once for the person."""
    found = contained(messages.select("row", "ts", "text"), F.col("text"), search_terms(names, aliases), "term")
    return found.dropDuplicates(["name", "row"]).select("name", "ts", "row", "text")


def toned(messages: DataFrame, newcomer: list[str] = L.NEWCOMER, praise: list[str] = L.PRAISE, lasting: list[str] = L.LASTING) -> DataFrame:
    """messages (name, ts, row, text) with newcomer, praise and lasting: whether a word of the list is there; lasting ones come after three quarters of
    the time of the person's last message."""
    last = messages.groupBy("name").agg(F.max("ts").alias("_last"))
    low = F.col("_low")
    rows = messages.join(last, "name").withColumn("_low", T.once(F.lower("text")))
    stays = (F.col("ts") > 0.75 * F.col("_last")) & T.contains_any(low, lasting)
    return rows.select("name", "ts", "row", "text", T.contains_any(low, newcomer).alias("newcomer"), T.contains_any(low, praise).alias("praise"), stays.alias("lasting"))


def tone(messages: DataFrame, newcomer: list[str] = L.NEWCOMER, praise: list[str] = L.PRAISE, lasting: list[str] = L.LASTING) -> DataFrame:
    """name, newcomer_n, praise_n, lasting_n, said (the first lasting message) of messages (name, ts, row, text) about people: see told_of."""
    rows = toned(messages, newcomer, praise, lasting)
    return rows.groupBy("name").agg(
        F.count_if("newcomer").alias("newcomer_n"), F.count_if("praise").alias("praise_n"), F.count_if("lasting").alias("lasting_n"), F.min_by("text", F.when(F.col("lasting"), F.struct("ts", "row"))).alias("said")
    )


def first_texts(rows: DataFrame, keys: list[str], most: Column | int, order: str) -> DataFrame:
    """keys, texts: the texts of each key's first rows, in order; no more than `most` of them are gathered."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("texts"))


def tone_samples(messages: DataFrame, newcomer: list[str] = L.NEWCOMER, praise: list[str] = L.PRAISE, lasting: list[str] = L.LASTING) -> DataFrame:
    """name, newcomer_said, praise_said, lasting_said: the first three, three and two messages of each tone."""
    kinds = ("newcomer", "praise", "lasting")
    rows = toned(messages, newcomer, praise, lasting).withColumn("kind", F.explode(F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in kinds)))))
    most = F.when(F.col("kind") == "lasting", 2).otherwise(3)
    found = first_texts(rows.withColumn("_o", F.struct("ts", "row")).filter("kind IS NOT NULL"), ["name", "kind"], 3, "_o")
    found = found.withColumn("texts", F.slice("texts", 1, most))
    none = F.array().cast("array<string>")
    own = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("texts"))), none).alias(f"{k}_said") for k in kinds]
    return found.groupBy("name").agg(*own)


def chat_samples(links: DataFrame, messages: DataFrame, most: int = 6) -> DataFrame:
    """name, samples: different messages about a person from a minute before each spike to its end, spike by spike.

    links: name, rank, ws, we; messages: name, ts, row, text (see told_of).  Texts of three characters or fewer don't count.
    """
    rows = messages.join(links.select("name", "rank", "ws", "we"), "name").filter(F.col("ts").between(F.greatest(F.lit(0.0), F.col("ws") - 60), F.col("we")))
    rows = rows.withColumn("_t", T.strip(F.col("text"))).filter(F.length("_t") > 3)
    once = rows.groupBy("name", "_t").agg(F.min(F.struct("rank", "row")).alias("_o"), F.min_by("text", F.struct("rank", "row")).alias("text"))
    return first_texts(once, ["name"], most, "_o").withColumnRenamed("texts", "samples")


def spikes_of(named: DataFrame, spikes: DataFrame, size: float) -> DataFrame:
    """name, rank: every spike (rank, ws, we) in which a person is named.  named: name, ts."""
    return interval_join(named.select("name", "ts"), spikes.select("rank", "ws", "we"), size, "ws", "we").select("name", "rank").distinct()


def spike_ranks(named: DataFrame, spikes: DataFrame, size: float, most: int = 4) -> DataFrame:
    """name, ranks: the first of spikes_of, in order."""
    rows = spikes_of(named, spikes, size)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("rank"))).filter(F.col("_r") <= most)
    return first.groupBy("name").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))


def discovery(people: DataFrame) -> DataFrame:
    """name, interpretation, action of people (name, mentions, clusters, label, ranks, newcomer_n, praise_n, lasting_n, said)."""
    several = F.size("ranks") >= 2
    read = (
        F.when((F.col("lasting_n") > 0) & several, P.fill(P.LASTING, mentions=F.col("mentions"), said=F.left("said", F.lit(25))))
        .when(several & (F.col("clusters") >= 2), P.fill(P.SPREAD, clusters=F.col("clusters")))
        .otherwise(P.fill(P.FIRST_LOOK, mentions=F.col("mentions"), sentiment=F.col("label")))
    )
    bare = bare_name(F.col("name"))
    link = E.linked(F.col("ranks"))
    act = (
        F.when(F.col("label").isin("감탄·대박", "놀람·흥분") | (F.col("praise_n") >= 3), P.fill(P.ACTION_SKILL, linked=link, name=bare))
        .when(F.col("newcomer_n") >= 2, P.fill(P.ACTION_FOUND, linked=link))
        .when(F.col("label") == "응원·격려", P.fill(P.ACTION_CHEER, linked=link))
        .otherwise(P.fill(P.ACTION_ELSE, linked=link))
    )
    return people.select("name", read.alias("interpretation"), act.alias("action"))


def discovery_context(links: DataFrame) -> DataFrame:
    """name, rank, line of links (name, rank, anchor, pre_text, concurrent_text, event): what is known of each of a person's spikes."""
    best = F.when(T.has_text(F.col("pre_text")), T.strip(F.col("pre_text"))).otherwise(T.strip(F.coalesce("concurrent_text", F.lit(""))))
    rows = links.withColumn("_best", T.once(best)).withColumn("_time", T.long_clock(F.col("anchor").cast("string")))
    parts = {"rank": F.col("rank"), "time": F.col("_time")}
    more = F.coalesce(P.fill(P.FOUND_SPOKEN_EVENT, event=F.col("event")), F.lit(""))
    line = (
        F.when(F.col("_best") != "", F.concat(P.fill(P.FOUND_SPOKEN, snippet=snippet(F.col("_best"), 80, ["다", "요", ".", "。"]), **parts), more))
        .when(F.col("event").isNotNull(), P.fill(P.FOUND_EVENT, name=F.col("name"), event=F.col("event"), **parts))
        .otherwise(P.fill(P.FOUND_CHAT, name=F.col("name"), **parts))
    )
    return rows.select("name", "rank", line.alias("line"))


def discovery_cards(people: DataFrame, context: DataFrame, samples: DataFrame, said: DataFrame) -> DataFrame:
    """name, context (lines on the first three spikes), samples, reaction, newcomer_said, praise_said, lasting_said, interpretation and action.

    people: what discovery wants, and positive, per_event and top of people_metrics; context: name, rank, line (see discovery_context); samples: see
    chat_samples; said: see tone_samples.  What a person has none of is an empty array.
    """
    none = F.array().cast("array<string>")
    lines = context.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("context"))  # three at most
    kinds = F.when(F.size("top") > 0, F.array_join(F.slice("top", 1, 3), "  ·  ")).otherwise("—")
    values = {"mentions": F.col("mentions"), "clusters": F.col("clusters"), "share": F.floor(F.col("positive") * 100).cast("long"), "rate": F.format_string("%.1f", "per_event"), "kinds": kinds}
    rows = people.select("name", P.fill(P.FOUND_REACTION, **values).alias("reaction")).join(discovery(people), "name").join(lines, "name", "left").join(samples, "name", "left").join(said, "name", "left")
    some = [F.coalesce(c, none).alias(c) for c in ("context", "samples", "newcomer_said", "praise_said", "lasting_said")]
    return rows.select("name", *some, "reaction", "interpretation", "action")


def people_metrics(messages: DataFrame, named: DataFrame, size: float, gap: float = 60.0, before: float = 10.0, after: float = 30.0, reactions: dict[str, str] = L.REACTIONS) -> DataFrame:
    """name, mentions, clusters, reactions, good, bad, tense, top, dominant, label, per_event, per_mention, positive of people.

    messages: ts, author, text; named: row, name and ts, or else messages have a row to find it by.  per_event has one decimal, per_mention and the positive share have two, rounded half up.  Reactions are those of the messages around each cluster of mentions, each message once for a person; words that only count in a spike's profile don't.
    """
    from .chat import attributed, session_clusters

    times = (named if "ts" in named.columns else named.join(messages.select("row", "ts"), "row")).select("name", "ts", "row")
    clusters = session_clusters(times, "name", gap)
    own = times.groupBy("name").agg(F.count("*").alias("mentions")).join(clusters.groupBy("name").agg(F.count("*").alias("clusters")), "name")
    around = attributed(clusters.select("name", "anchor"), messages.select("ts", "author", "text"), "name", size, before, after)
    found = E.reactions_of_people(E.reaction_counts(around, "name", reactions=reactions, more={}))
    rows = own.join(found, "name", "left")
    rows = rows.select("name", "mentions", "clusters", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("reactions", "good", "bad", "tense")), F.coalesce("top", F.array().cast("array<string>")).alias("top"), "dominant")
    rows = rows.withColumn("label", E.sentiment(F.col("dominant"), F.col("reactions"), F.col("good"), F.col("bad"), F.col("tense")))
    return rows.withColumn("per_event", rounded("reactions", "clusters", 1)).withColumn("per_mention", rounded("reactions", "mentions", 2)).withColumn("positive", rounded("good", "reactions", 2))


def rounded(part: str, whole: str, digits: int) -> Column:
    """part / whole with some decimals, half up, 0 of nothing; in whole numbers up to the last step."""
    up = (F.lit(2 * 10**digits) * F.col(part) + F.col(whole)) / F.nullif(2 * F.col(whole), F.lit(0))
    return F.coalesce(F.floor(up) / 10**digits, F.lit(0.0))


def words_in_spikes(rows: DataFrame, events: dict[str, str] = L.EVENTS_OF, words: int = 15, happened: int = 10) -> DataFrame:
    """kind (event or word), word, n: the most frequent of either over spikes' messages (id, text); a message in two spikes counts twice."""
    table = F.create_map(*(F.lit(x) for kv in events.items() for x in kv))
    found = rows.select(F.explode(T.reaction_tokens(F.col("text"))).alias("w")).select(F.when(F.col("w").isin(list(events)), "event").otherwise("word").alias("kind"), F.coalesce(table[F.col("w")], F.col("w")).alias("word"))
    counts = found.groupBy("kind", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "word")
    ranked_ = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(words, happened))
    return ranked_.filter(F.col("_r") <= F.when(F.col("kind") == "event", happened).otherwise(words)).drop("_r")
