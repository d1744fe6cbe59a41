"""Messages and the people they speak of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from .. import phrases as P
from .. import stages
from ..functions import text as T
from .terms import contained, holders


def message_layer(text: Column, logistics: list[str] = L.LOGISTICS, broadcast: list[str] = L.BROADCAST, reactions: list[str] | None = None) -> Column:
    """event, internal or mixed."""
    known = F.array(*(F.lit(x) for x in (reactions or list(L.REACTIONS))))
    lit = lambda words: F.array(*(F.lit(w) for w in words))
    said = F.split(T.strip(text), T.SPACE)
    tokens = T.reaction_tokens(text)
    return (
        F.when(~T.has_text(text), "mixed")
        .when(text.rlike(r"@\S") | text.rlike(r"[가-힣]{2,5}(프로님?|선수님?|형님?|님)\s*.{0,30}[?？]"), "internal")
        .when(F.arrays_overlap(said, lit(logistics)) & ~F.arrays_overlap(said, lit(broadcast)), "internal")
        .when(F.arrays_overlap(said, lit(broadcast)), "event")
        .when((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.array_contains(known, t)), "event")
        .otherwise("mixed")
    )


def reaction_of(token: Column, reactions: dict[str, str] = L.REACTIONS) -> Column:
    table = F.create_map(*(F.lit(x) for kv in reactions.items() for x in kv))
    return table[token]


def reaction_counts(df: DataFrame, *keys: str, reactions: dict[str, str] = L.REACTIONS, more: dict[str, str] = L.REACTION_WORDS) -> DataFrame:
    """keys, reaction, n, by count: the kinds of reactions over all messages.  more: words that count beside the reactions."""
    rows = df.select(*keys, F.explode_outer(T.reaction_tokens(F.col("text"))).alias("t"))
    rows = rows.select(*keys, reaction_of(F.col("t"), reactions | more).alias("reaction")).filter("reaction IS NOT NULL")
    return rows.groupBy(*keys, "reaction").agg(F.count("*").alias("n"))


def canonical_names(roster: DataFrame, aliases: DataFrame, forms: list[str] = L.TITLE_FORMS) -> DataFrame:
    """name, canonical: what an alias says of the name or, in this order, of one of its forms; else the name."""
    names = roster.select("name").distinct()
    shapes = names.select("name", F.posexplode(F.array(*(F.concat("name", F.lit(f)) for f in ["", *forms]))).alias("at", "alias"))
    known = shapes.join(aliases.select("alias", "canonical"), "alias").groupBy("name").agg(F.min_by("canonical", "at").alias("canonical"))
    return names.join(known, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def given_names(names: DataFrame) -> DataFrame:
    """given, name, canonical, n: the last two and three characters of longer names, digits at the end apart; n names share them."""
    bare = F.regexp_replace("name", "[0-9]+$", "")
    rows = names.select("name", "canonical", bare.alias("_b"), F.explode(F.array(F.lit(2), F.lit(3))).alias("_k")).filter(F.length("_b") > F.col("_k"))
    return rows.select(F.right("_b", F.col("_k")).alias("given"), "name", "canonical").withColumn("n", F.count("*").over(Window.partitionBy("given")))


def resolve(tokens: DataFrame, roster: DataFrame, aliases: DataFrame, suffixes: list[str] = L.SUFFIXES, forms: list[str] = L.TITLE_FORMS, base_forms: list[str] = L.BASE_FORMS, least: float | None = None) -> DataFrame:
    """token, name, level for each distinct token of two characters or more; null if nothing fits.

    1 alias, 2 roster, 3 alias without a form of address (or with another one), 4 roster without one, 5 the only roster name that ends with what is left,
    6 the only one that ends with the token, 7, with a least similarity, the most similar roster name: see resolve_fuzzy.  Names come as
    their alias says.  With an empty roster, aliases of level 1 alone count.  All levels are keys of one join.
    """
    t = tokens.select(T.strip(F.col("token")).alias("token")).filter(F.length("token") >= 2).distinct()
    bare = T.strip_suffix(F.col("token"), suffixes)
    t = t.withColumn("base", F.when((bare != F.col("token")) & (F.length(bare) >= 2), bare))
    alias = aliases.select(F.lit("alias").alias("kind"), F.col("alias").alias("key"), F.col("canonical").alias("name"))
    key = lambda level, kind, c: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), c.alias("key"))
    token, base = F.col("token"), F.col("base")
    if roster.isEmpty():
        lookup, keys = alias, [key(1, "alias", token)]
    else:
        names = canonical_names(roster, aliases, forms)
        given = given_names(names).filter("n = 1")
        lookup = alias.unionByName(names.select(F.lit("name").alias("kind"), F.col("name").alias("key"), F.col("canonical").alias("name")))
        lookup = lookup.unionByName(given.select(F.lit("given").alias("kind"), F.col("given").alias("key"), F.col("canonical").alias("name")))
        shapes = [key(3, "alias", F.concat(base, F.lit(f))) for f in ["", *base_forms]]
        keys = [key(1, "alias", token), key(2, "name", token), *shapes, key(4, "name", base), key(5, "given", base), key(6, "given", token)]
    wanted = t.select("token", F.posexplode(F.array(*keys)).alias("at", "k")).select("token", "at", "k.level", "k.kind", "k.key")
    best = wanted.join(lookup, ["kind", "key"]).groupBy("token").agg(F.min(F.struct("at", "level", "name")).alias("m"))
    out = t.join(best, "token", "left").select("token", "base", F.col("m.name").alias("name"), F.col("m.level").alias("level"))
    if least is not None and not roster.isEmpty():
        rest = out.filter("name IS NULL").select("token", F.coalesce("base", "token").alias("target"))
        close = resolve_fuzzy(rest.select(F.col("target").alias("token")), roster, least).withColumnRenamed("token", "target").withColumnRenamed("name", "_close")
        close = rest.join(close, "target").join(names.withColumnRenamed("name", "_close"), "_close").select("token", F.col("canonical").alias("_name"))
        out = out.join(close, "token", "left").select("token", "base", F.coalesce("name", "_name").alias("name"), F.when(F.col("name").isNull() & F.col("_name").isNotNull(), 7).otherwise(F.col("level")).alias("level"))
    return out.select("token", "name", "level")


#: Names with more ways to leave out characters than this are found by their lengths and first character alone.
MOST_KEYS = 300


def fuzzy_keys(least: float, slack: int, roster: bool):
    """Of text: the keys under which a similar partner has one in common, as mapInArrow.

    A ratio r of matching blocks over lengths a and b needs a common subsequence of at least m = r * (a + b) / 2 characters, so both have some m characters
    in order alike: each text is listed under all its ways to leave out characters down to m, for every length that a partner may have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations
        from math import ceil, comb

        for batch in batches:
            texts, keys = [], []
            for text, size in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), strict=True):
                found = set()
                for other in range(size - slack, size + slack + 1):
                    # The roster's lengths count without digits at the end, the ratio with them.
                    a, b = (other, size) if roster else (size, other)
                    if other < 1:
                        continue
                    tail = len(text) - size if roster else 0
                    m = ceil(least * (size + other + tail) / 2 - 1e-9)
                    longest = max(size, other) + tail
                    if tail or m < 1 or comb(longest, min(m, longest)) > MOST_KEYS:
                        found.add(f"{text[0]}|{a}|{b}")
                    elif m <= min(size, other):
                        found.update(f"{text[0]}|{a}|{b}|{''.join(c)}" for c in combinations(text, m))
                    if not roster:  # names with digits at the end, or too many ways, stand under the lengths alone
                        found.add(f"{text[0]}|{a}|{b}")
                texts += [text] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(keys, pa.string())], names=["text", "key"])

    return run


def resolve_fuzzy(tokens: DataFrame, roster: DataFrame, least: float = 0.85, slack: int = 0) -> DataFrame:
    """token, name: the most similar roster name of the same first character and, within `slack`, the same length, by matching blocks.

    Candidates meet in an index of what is left when characters are left out (see fuzzy_keys); of those, the characters that both have, whatever their order,
    bound the similarity before it is computed, on distinct tokens in Arrow batches.  Digits at the end of a name don't count for its length.  Of equally similar
    names, the last in order.
    """
    stages.prepare(tokens.sparkSession)
    bare = F.length(F.regexp_replace("text", "[0-9]+$", "")) if not slack else F.length("text")
    a = tokens.select(F.col("token").alias("text")).filter(F.length("token") > 0).distinct().withColumn("size", F.length("text"))
    b = roster.select(F.col("name").alias("text")).filter(F.length("name") > 0).distinct().withColumn("size", bare)
    keyed = lambda rows, own: rows.mapInArrow(fuzzy_keys(least, slack, own), "text string, key string")
    pairs = keyed(a, False).withColumnRenamed("text", "token").join(keyed(b, True).withColumnRenamed("text", "name"), "key").select("token", "name").distinct()

    @F.pandas_udf("double")
    def ratio(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for p, q in x:
            out, matcher = [], SequenceMatcher(None)
            for s, t in zip(p, q, strict=True):
                matcher.set_seqs(t, s)
                out.append(matcher.ratio() if matcher.quick_ratio() >= least else 0.0)
            yield pd.Series(out, dtype="float64")

    rows = pairs.withColumn("r", ratio("token", "name")).filter(F.col("r") >= least)
    return rows.groupBy("token").agg(F.max_by("name", F.struct("r", "name")).alias("name"))


def corrected(tokens: DataFrame, roster: DataFrame, least: float = 0.75) -> DataFrame:
    """token, name: a roster name as it is, else the most similar one of nearly the same length, else the token."""
    known = roster.select(F.col("name").alias("token")).distinct()
    rest = tokens.select("token").distinct().join(known, "token", "left_anti").filter(F.length("token") >= 2)
    found = resolve_fuzzy(rest, roster, least, 1)
    return tokens.select("token").distinct().join(found, "token", "left").select("token", F.coalesce("name", "token").alias("name"))


def plausible(name: Column, roster: list[str] = [], endings: list[str] = L.NO_NAME_ENDINGS, others: list[str] = L.NO_NAMES) -> Column:  # noqa: B006
    """Whether a word may be a person's name, by its ending; a roster name always is."""
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.endswith(name, F.lit(e))
    return F.coalesce((F.length(name) >= 2) & (name.isin(list(roster)) | (~ends & ~name.isin(list(others)))), F.lit(False))


def official(df: DataFrame, roster: DataFrame, column: str = "name", endings: list[str] = L.DISPLAY_ENDINGS) -> DataFrame:
    """Rows whose name, without the first ending that fits, is on the roster; all rows where the roster is empty."""
    if roster.isEmpty():
        return df
    bare = F.col(column)
    for e in reversed(endings):
        bare = F.when(F.endswith(F.col(column), F.lit(e)), F.expr(f"left(`{column}`, length(`{column}`) - {len(e)})")).otherwise(bare)
    return df.withColumn("_bare", bare).join(roster.select(F.col("name").alias("_bare")).distinct(), "_bare", "left_semi").drop("_bare")


def players_only(df: DataFrame, registry: DataFrame, column: str = "name", roles: list[str] = L.NOT_PLAYERS) -> DataFrame:
    """Rows without the people whose role in the registry (name, role) isn't to play."""
    others = registry.filter(F.col("role").isin(roles)).select(F.col("name").alias(column))
    return df.join(others, column, "left_anti")


def disambiguate(candidates: DataFrame, key: str) -> DataFrame:
    """key, name: 4 if resolved nearby, 2 for each bare and 1 for each full mention; accepted from 2 points, 2 ahead.  candidates: key, name, resolved, bare, full."""
    score = F.when(F.col("resolved"), 4).otherwise(0) + 2 * F.col("bare") + F.col("full")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "name")
    rows = candidates.withColumn("score", score).withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0)))
    return rows.filter("_r = 1 AND score >= 2 AND score - _next >= 2").select(key, "name")


def occurrences(text: Column, word: Column) -> Column:
    """How often a word stands in a text, without overlaps."""
    return F.coalesce(((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.nullif(F.length(word), F.lit(0))).cast("long"), F.lit(0))


def disambiguate_in(tokens: DataFrame, candidates: DataFrame, texts: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """key, token, name: which roster name an ambiguous token means where it stands, by what else is said there.

    tokens: key, token; candidates: see candidates_of; texts: key, text; resolved: key, name of people who are already known there.
    """
    rows = tokens.select(key, "token").distinct().join(candidates, "token").join(texts.select(key, "text"), key)
    rows = rows.join(resolved.select(key, "name", F.lit(True).alias("_known")).distinct(), [key, "name"], "left")
    full = F.when(F.col("name") != F.col("official"), occurrences(F.col("text"), F.col("name"))).otherwise(0)
    rows = rows.select(F.struct(key, "token").alias("_k"), "name", F.col("_known").isNotNull().alias("resolved"), occurrences(F.col("text"), F.col("official")).alias("bare"), full.alias("full"))
    return disambiguate(rows, "_k").select(f"_k.{key}", "_k.token", "name")


def mentions(messages: DataFrame, roster: DataFrame, least: int = 3) -> DataFrame:
    """row, name: whole roster names, of at least so many characters, found as substrings."""
    names = roster.select("name").filter(F.length("name") >= least)
    return contained(messages, F.col("text"), names, "name", columns=["row"]).select("row", "name").distinct()


def mention_counts(messages: DataFrame, roster: DataFrame, least: int = 3) -> DataFrame:
    """name, n: how many messages hold each roster name, of at least so many characters, as a substring; who is in none is left out."""
    return holders(messages, F.col("text"), roster.filter(F.length("name") >= least), "name")


def active_participants(authors: DataFrame, patterns: DataFrame) -> DataFrame:
    """Participants one of whose patterns an author's name contains, whatever the case.  patterns: name, pattern."""
    a = authors.select(F.lower("author").alias("author")).distinct()
    p = patterns.select("name", F.lower("pattern").alias("pattern")).filter(F.length("pattern") > 0)
    return contained(a, F.col("author"), p, "pattern", columns=[]).select("name").distinct()


def candidates_of(tokens: DataFrame, roster: DataFrame, aliases: DataFrame, suffixes: list[str] = L.SUFFIXES, forms: list[str] = L.TITLE_FORMS) -> DataFrame:
    """token, official, name: all roster names that a token without its form of address may end, where there are several."""
    bare = T.strip_suffix(F.col("token"), suffixes)
    t = tokens.select("token").distinct().withColumn("given", F.when(F.length(bare) >= 2, bare).otherwise(F.col("token")))
    return t.join(given_names(canonical_names(roster, aliases, forms)).filter("n > 1"), "given").select("token", F.col("name").alias("official"), F.col("canonical").alias("name"))


def opportunity(metrics: DataFrame, least_clusters: int = 2, keys: str | list[str] = ()) -> DataFrame:
    """name, raw, best: the score is 100 * raw / best, of each video where keys tell them apart.  metrics: name, reactions, clusters, positive (a share)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    raw = metrics.filter(F.col("clusters") >= least_clusters).withColumn("raw", F.col("reactions") / F.col("clusters") * (0.4 + 0.6 * F.col("positive")))
    best = raw.groupBy(*keys).agg(F.max("raw").alias("best"))  # one row, or one for each video
    return raw.join(best, keys) if keys else raw.crossJoin(F.broadcast(best))


def marketing(per_mention: Column, positive: Column, spikes: Column, mentions_: Column) -> Column:
    return per_mention * (0.4 + 0.6 * positive) * (1 + 0.2 * F.least(spikes, F.lit(3))) / F.log2(mentions_ + 2)


def out_of_best(df: DataFrame, raw: str, score: str) -> DataFrame:
    """score: hundredths of the largest raw value, rounded half up; 0 where that isn't above 0."""
    best = df.agg(F.max(raw).alias("_best"))  # one row
    share = F.when(F.col("_best") > 0, F.floor(F.col(raw) / F.col("_best") * 100 + 0.5)).otherwise(0)
    return df.crossJoin(F.broadcast(best)).withColumn(score, share.cast("long")).drop("_best")


def sentiment(dominant: Column, reactions: Column, good: Column, bad: Column, tense: Column) -> Column:
    """A label by the kind of reaction that dominates, else by the balance of good, bad and tense ones."""
    of = F.create_map(*(F.lit(x) for kv in P.SENTIMENT_OF.items() for x in kv))[dominant]
    rest = F.when((reactions > 0) & (good * 10 >= reactions * 6), P.SENTIMENT_GOOD).when((tense > good) & (tense > bad), P.SENTIMENT_TENSE).otherwise(P.SENTIMENT_MIXED)
    return F.coalesce(of, rest)


def reactions_of_people(counts: DataFrame, key: str = "name") -> DataFrame:
    """key, reactions, good, bad, tense, top (the five most frequent kinds as kind(n)), dominant, of counts(key, reaction, n)."""
    some = lambda kinds: F.sum(F.when(F.col("reaction").isin(kinds), F.col("n")).otherwise(0))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "reaction")))  # a few kinds for each key
    rows = counts.groupBy(key).agg(F.sum("n").alias("reactions"), some(L.GOOD_REACTIONS).alias("good"), some(L.BAD_REACTIONS).alias("bad"), some(L.TENSE_REACTIONS).alias("tense"), ordered.alias("_k"))
    shown = F.transform(F.slice("_k", 1, 5), lambda x: F.concat(x["reaction"], F.lit("("), (-x["o"]).cast("string"), F.lit(")")))
    return rows.select(key, "reactions", "good", "bad", "tense", shown.alias("top"), F.get("_k", F.lit(0))["reaction"].alias("dominant"))


def reasons(mentions_low: Column, rate_high: Column, rate: Column, positive: Column, ranks: Column) -> Column:
    """Why a person is proposed.  ranks: an array of spike ranks."""
    listed = F.array_join(F.transform(F.slice(ranks, 1, 2), lambda r: F.concat(F.lit("#"), r.cast("string"), F.lit("위"))), ", ")
    parts = F.array_compact(
        F.array(
            F.when(mentions_low, P.REASON_FEW),
            F.when(rate_high, P.fill(P.REASON_MUCH, rate=F.format_string("%.2f", rate))),
            F.when(positive >= 0.55, P.fill(P.REASON_GOOD, share=F.floor(positive * 100).cast("long"))),
            F.when(F.size(ranks) > 0, P.fill(P.REASON_SPIKES, ranks=listed)),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "  ·  ")).otherwise(P.REASON_NONE)


def linked(ranks: Column) -> Column:
    return F.when(F.size(ranks) > 0, P.fill(P.LINKED, rank=F.get(ranks, F.lit(0)))).otherwise("")


def suggestion(label: Column, ranks: Column) -> Column:
    out = P.fill(P.SUGGEST_ELSE, linked=linked(ranks))
    for k, template in P.SUGGEST.items():
        out = F.when(label == k, P.fill(template, linked=linked(ranks))).otherwise(out)
    return out


def evidence_mark(has_commentary: Column, evidence: Column) -> Column:
    return F.when(has_commentary & evidence.isin("both", "pre_spike"), "◎").when(has_commentary, "○").otherwise("△")


def rank_label(rank: Column) -> Column:
    return F.when(rank <= 3, F.concat(F.lit("★"), rank.cast("string"))).when(rank <= 6, "권장").otherwise("참고")


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values of an array; chat.upper_medians takes a column's."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def mood(text: Column, excited: list[str], tense: list[str]) -> Column:
    """A level by the number of different words."""
    hits = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    e = hits(excited)
    return F.when(e >= 3, "strong").when(e >= 2, "surprised").when(e >= 1, "attentive").when(hits(tense) >= 1, "tense")


def buzz(event_share: Column, evidence: Column, internal_share: Column, present: Column) -> Column:
    a, b = (event_share >= 0.4) & evidence, (internal_share >= 0.3) & present
    return F.when(a & b, "mixed").when(a, "broadcast_event").when(b, "participant_driven").otherwise("general")
