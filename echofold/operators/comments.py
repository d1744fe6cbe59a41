"""Comment analytics: statistics, keywords, labels, rankings, themes and rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import phrases as P
from .. import stages
from ..functions import text as T


def clean_comments(df: DataFrame, **options: bool) -> DataFrame:
    """df with a cleaned text, without rows whose text is blank."""
    return df.withColumn("text", T.clean_text(F.col("text"), **options)).filter("text <> ''")


def comment_stats(df: DataFrame) -> DataFrame:
    """One row; zeros for an empty table."""
    size = F.length("text")
    zero = lambda c, kind="double": F.coalesce(c, F.lit(0)).cast(kind)
    return df.agg(
        F.count_if(~F.col("is_reply")).alias("total_top_level"),
        F.count_if(F.col("is_reply")).alias("total_replies"),
        F.count("*").alias("total_all"),
        F.count_distinct("author").alias("unique_authors"),
        zero(F.avg(size)).alias("avg_length"),
        zero(F.median(size)).alias("median_length"),
        zero(F.avg("like_count")).alias("avg_likes"),
        zero(F.sum("like_count"), "long").alias("total_likes"),
        zero(F.max("like_count"), "long").alias("max_likes"),
    )


def kept_tokens(df: DataFrame, stop: list[str], *keep: str) -> DataFrame:
    """tokens: an array without stopwords and numbers."""
    return df.select(*keep, T.once(T.without_stopwords(T.tokens(F.col("text")), stop)).alias("tokens"))


def phrase_counts(df: DataFrame, stop: list[str], *sizes: int) -> DataFrame:
    """type, phrase, n: words (size 1) and pairs of neighbours once stopwords are gone (size 2), from one pass over the texts."""
    found = {1: ("unigram", lambda t: t), 2: ("bigram", T.bigrams)}
    rows = kept_tokens(df, stop)
    typed = lambda name: lambda p: F.struct(F.lit(name).alias("type"), p.alias("phrase"))
    both = F.concat(*(F.transform(make(F.col("tokens")), typed(name)) for name, make in (found[k] for k in sizes or (1, 2))))
    return rows.select(F.explode_outer(both).alias("p")).select("p.*").filter("phrase IS NOT NULL").groupBy("type", "phrase").agg(F.count("*").alias("n"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_phrases(df: DataFrame, stop: list[str], size: int = 1, n: int = 100) -> DataFrame:
    return top(phrase_counts(df, stop, size).select("phrase", "n"), n, F.desc("n"), F.asc("phrase"))


def top_of_both(df: DataFrame, stop: list[str], words: int, pairs: int) -> DataFrame:
    """type, phrase, n: the most frequent words and pairs, from one pass over the texts."""
    return most_of_both(phrase_counts(df, stop), words, pairs)


def most_of_both(counts: DataFrame, words: int, pairs: int) -> DataFrame:
    """The same of phrase_counts; a group limit takes few rows from each partition."""
    w = Window.partitionBy("type").orderBy(F.desc("n"), "phrase")
    ranked = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(words, pairs))
    return ranked.filter(F.col("_r") <= F.when(F.col("type") == "bigram", pairs).otherwise(words)).drop("_r")


def keyword_union(df: DataFrame, stop: list[str], n: int = 100) -> DataFrame:
    """The keyword table: words and pairs by count."""
    return top_of_both(df, stop, n, n).select("phrase", "n", "type").orderBy(F.desc("n"), "type", "phrase")


def label_rows(df: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """comment_id and its labels."""
    return df.select("comment_id", T.once(F.lower("text")).alias("low")).select("comment_id", T.labels(F.col("low"), lexicon).alias("labels"))


def label_counts(df: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """label, n, by count."""
    return label_rows(df, lexicon).select(F.explode_outer("labels").alias("label")).filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def audience_profile(df: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """Counts and shares by label; the dominant one is the first of the largest in the lexicon's order."""
    return profile_of(label_counts(df, lexicon), df.agg(F.greatest(F.count("*"), F.lit(1)).alias("total")), lexicon)


def profile_of(counts: DataFrame, total: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """The same of label_counts and one row with the total."""
    at = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(lexicon)) for x in pair))
    counts = counts.crossJoin(F.broadcast(total))  # one row
    first = Window.orderBy(F.desc("n"), at[F.col("label")])  # a row for each label of the lexicon
    return counts.select("label", "n", (F.col("n") / F.col("total")).alias("share"), (F.row_number().over(first) == 1).alias("dominant"))


def top_liked(df: DataFrame, n: int = 20) -> DataFrame:
    return top(df.filter("like_count > 0").select("comment_id", "author", "like_count", "is_reply"), n, F.desc("like_count"), F.asc("comment_id"))


def top_authors(df: DataFrame, n: int = 30) -> DataFrame:
    """Comments, likes and characters of the authors with most comments; the mean length is total_length / comment_count."""
    rows = df.groupBy("author").agg(F.count("comment_id").alias("comment_count"), F.sum("like_count").alias("total_likes"), F.sum(F.length("text").cast("long")).alias("total_length"))
    return top(rows, n, F.desc("comment_count"), F.asc("author"))


def entity_candidates(df: DataFrame, stop: list[str], n: int = 50, least: int = 3) -> DataFrame:
    """Capitalised words; the least count applies after the top n."""
    words = df.select(F.explode_outer(capitalised(F.col("text"), stop)).alias("word"))
    return entities_of(words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n")), n, least)


def capitalised(text: Column, stop: list[str]) -> Column:
    return F.filter(F.split(text, T.NOT_WORD), lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(stop))


def entities_of(counts: DataFrame, n: int = 50, least: int = 3) -> DataFrame:
    return top(counts, n, F.desc("n"), F.asc("word")).filter(F.col("n") >= least)


def top_topics(df: DataFrame, stop: list[str], least: int = 3, n: int = 25) -> DataFrame:
    """The most frequent pairs, and words that no such pair has."""
    return topics_of(phrase_counts(df, stop), least, n)


def topics_of(counts: DataFrame, least: int = 3, n: int = 25) -> DataFrame:
    rows = most_of_both(counts, 30, 20).filter(F.col("n") >= least).withColumn("type", F.when(F.col("type") == "bigram", "phrase").otherwise("word"))
    inside = rows.select(F.explode(F.when(F.col("type") == "phrase", F.split("phrase", " "))).alias("_w")).distinct()
    left = rows.join(inside, (F.col("type") == "word") & (F.col("phrase") == F.col("_w")), "left_anti")
    return top(left.select("phrase", "n", "type"), n, F.desc("n"), F.asc("type"), F.asc("phrase"))


def lift_themes(df: DataFrame, stop: list[str], liked: int = 10, n: int = 10) -> DataFrame:
    """Words that the most liked comments use at least 1.5 times as often as the keyword table; whole-number products instead of ratios."""
    top_rows = top(df.filter("like_count > 0"), liked, F.desc("like_count"), F.asc("comment_id"))
    return themes_of(top_phrases(df, stop, 1, 100), top_rows, stop, n)


def themes_of(keywords: DataFrame, top_rows: DataFrame, stop: list[str], n: int = 10) -> DataFrame:
    """The same of the keyword table and the most liked comments."""
    total = keywords.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total_kw"))
    words = kept_tokens(top_rows, stop).select(F.explode_outer("tokens").alias("phrase")).filter(F.length("phrase") > 2)
    counts = words.groupBy("phrase").agg(F.count("*").alias("he"))
    all_he = words.agg(F.greatest(F.count("*"), F.lit(1)).alias("total_he"))
    common = top(counts, 30, F.desc("he"), F.asc("phrase")).join(keywords, "phrase", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_he))  # one row each
    lifted = (F.col("he") >= 2) & (F.col("n").isNull() | (2 * F.col("he") * F.col("total_kw") >= 3 * F.col("n") * F.col("total_he")))
    return top(common.filter(lifted).select("phrase", "he", F.coalesce("n", F.lit(0)).cast("long").alias("n")), n, F.desc("he"), F.asc("phrase"))


def tagged_counts(df: DataFrame, stop: list[str], lexicon: dict[str, list[str]]) -> DataFrame:
    """kind, phrase, n from one pass over the texts: name (capitalised words) and label."""
    lists = {"name": capitalised(F.col("text"), stop), "label": T.labels(F.col("_low"), lexicon)}
    empty = F.array().cast("array<string>")  # of a null text
    tag = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("phrase"))
    tagged = F.concat(*(F.transform(F.coalesce(words, empty), tag(kind)) for kind, words in lists.items()))
    return df.select("text", T.once(F.lower("text")).alias("_low")).select(F.explode(tagged).alias("p")).select("p.*").groupBy("kind", "phrase").agg(F.count("*").alias("n"))


@dataclass
class Analysis:
    """What the parts of a comment report share, as stage tables: the counts of words and pairs, those of names and labels, the most liked comments; and the
    totals.  The rest is derived from them."""

    phrases: DataFrame
    tags: DataFrame
    liked: DataFrame
    totals: DataFrame
    stop: list[str]
    lexicon: dict[str, list[str]]

    @classmethod
    def of(cls, df: DataFrame, stop: list[str], lexicon: dict[str, list[str]], liked: int = 10, kept: stages.Stages | None = None) -> Analysis:
        """Reads df three times, each word by word once: for words and pairs (one pass of its own is faster than one with all), for names and labels, and for the
        few most liked, with the totals observed on the way."""
        keep, seen = (kept or stages.of(df.sparkSession)).keep, Observation("totals")
        sums = [F.count("*").alias("total_all"), F.count_if("is_reply").alias("total_replies"), F.sum(F.col("like_count").cast("long")).alias("total_likes")]
        rows = df.select("comment_id", "like_count", "is_reply", "text").observe(seen, *sums).filter("like_count > 0").select("comment_id", "like_count", "text")
        most = keep(top(rows, liked, F.desc("like_count"), F.asc("comment_id")), "liked")
        totals = df.sparkSession.createDataFrame([tuple(seen.get[k] or 0 for k in ("total_all", "total_replies", "total_likes"))], "total_all long, total_replies long, total_likes long")
        return cls(keep(phrase_counts(df, stop), "phrases"), keep(tagged_counts(df, stop, lexicon), "tags"), most, totals, stop, lexicon)

    def of_kind(self, kind: str, name: str = "phrase") -> DataFrame:
        return self.tags.filter(F.col("kind") == kind).select(F.col("phrase").alias(name), "n")

    def topics(self) -> DataFrame:
        return topics_of(self.phrases)

    def entities(self) -> DataFrame:
        return entities_of(self.of_kind("name", "word"))

    def themes(self) -> DataFrame:
        return themes_of(top(self.phrases.filter("type = 'unigram'").select("phrase", "n"), 100, F.desc("n"), F.asc("phrase")), self.liked, self.stop)

    def sums(self) -> DataFrame:
        """One row: total_all, total_replies, total_likes."""
        return self.totals

    def profile(self) -> DataFrame:
        return profile_of(self.of_kind("label", "label"), self.sums().select(F.greatest("total_all", F.lit(1)).alias("total")), self.lexicon)

    def parts(self) -> tuple[DataFrame, ...]:
        """What recommendation_rules and facts_of want."""
        return self.sums(), self.topics(), self.entities(), self.themes(), self.profile()

    def facts(self) -> DataFrame:
        return facts_of(*self.parts())


def recommendation_rules(sums: DataFrame, topics: DataFrame, entities: DataFrame, themes: DataFrame, profile: DataFrame) -> DataFrame:
    """rule, fires: the rule table over one row of statistics (see Analysis.sums)."""
    facts = (
        sums.crossJoin(topics.agg(F.count("*").alias("n_topics")))
        .crossJoin(entities.agg(F.count("*").alias("n_entities")))
        .crossJoin(themes.agg(F.count("*").alias("n_themes")))
        .crossJoin(profile.agg(F.max(F.when(F.col("dominant"), F.col("label"))).alias("dominant")))
    )  # one row each
    rules = {
        "topics": F.col("n_topics") > 0,
        "entities": F.col("n_entities") > 0,
        "themes": F.col("n_themes") > 0,
        "mood": F.coalesce(F.col("dominant").isin("cheering_support", "surprise_excitement", "criticism", "positive"), F.lit(False)),
        "debate": F.col("total_replies") * 5 > F.greatest("total_all", F.lit(1)) * 2,
        "low_likes": (F.col("total_likes") < F.col("total_all")) & (F.col("total_all") > 50),
        "recap": F.col("n_topics") >= 5,
        "clips": (F.col("n_topics") > 0) | (F.col("n_themes") > 0),
    }
    return facts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("fires")) for k, v in rules.items()))).alias("r")).select("r.*")


def at_least_liked(df: DataFrame, least: int) -> DataFrame:
    return df.filter(F.col("like_count") >= least)


def notable(entities: DataFrame, n: int = 20) -> DataFrame:
    """The first names of entity_candidates."""
    return top(entities, n, F.desc("n"), F.asc("word"))


def highlight_signals(liked: DataFrame, n: int = 10) -> DataFrame:
    """comment_id, author, preview, likes and a note of the most liked."""
    return top(liked, n, F.desc("like_count"), F.asc("comment_id")).select("comment_id", "author", F.left("text", F.lit(120)).alias("preview"), F.col("like_count").alias("likes"), F.lit(P.SIGNAL_NOTE).alias("note"))


def facts(df: DataFrame, topics: DataFrame, entities: DataFrame, themes: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: the statistics, and the phrases, names, themes and dominant label that rules look at, in order.  Analysis.facts has the same from shared tables."""
    return facts_of(comment_stats(df), topics, entities, themes, profile)


def facts_of(sums: DataFrame, topics: DataFrame, entities: DataFrame, themes: DataFrame, profile: DataFrame) -> DataFrame:
    ordered = lambda name, *order: F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("_x")))), lambda x: x["_x"])
    return (
        sums.crossJoin(topics.agg(ordered("phrase", (-F.col("n")).alias("a"), F.col("type").alias("b")).alias("topics")))
        .crossJoin(notable(entities).agg(ordered("word", (-F.col("n")).alias("a")).alias("entities")))
        .crossJoin(themes.agg(ordered("phrase", (-F.col("he")).alias("a")).alias("themes")))
        .crossJoin(profile.agg(F.max(F.when(F.col("dominant"), F.col("label"))).alias("mood")))
    )  # one row each, of bounded lists


def recommendations(stats: DataFrame) -> DataFrame:
    """place, text: what the rules say of one row of facts; a single line where there is no comment."""
    some = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    clips = F.when(F.size("themes") > 0, F.col("themes")).otherwise(F.col("topics"))
    share = F.format_string("%.0f%%", 100.0 * F.col("total_replies") / F.greatest("total_all", F.lit(1)))
    lines = [
        F.when(F.size("topics") > 0, P.fill(P.RECOMMEND["topics"], topics=some("topics", 3))),
        F.when(F.size("entities") > 0, P.fill(P.RECOMMEND["entities"], names=some("entities", 4))),
        F.when(F.size("themes") > 0, P.fill(P.RECOMMEND["themes"], themes=some("themes", 4))),
        F.create_map(*(F.lit(x) for kv in P.RECOMMEND_MOOD.items() for x in kv))[F.col("mood")],
        F.when(F.col("total_replies") * 5 > F.greatest("total_all", F.lit(1)) * 2, P.fill(P.RECOMMEND["debate"], share=share)),
        F.when((F.col("total_likes") < F.col("total_all")) & (F.col("total_all") > 50), F.lit(P.RECOMMEND["low_likes"])),
        F.when(F.size("topics") >= 5, F.lit(P.RECOMMEND["recap"])),
        F.when(F.size(clips) > 0, P.fill(P.RECOMMEND["clips"], topics=some(clips, 3))),
    ]
    said = F.when(F.col("total_all") == 0, F.array(F.lit(P.RECOMMEND["empty"]))).otherwise(F.array_compact(F.array(*lines)))
    return stats.select(F.posexplode(said).alias("place", "text"))


def marketing_angles(stats: DataFrame) -> DataFrame:
    """place, text: angles by topic, name and mood; none where there is no comment."""
    lines = [
        F.when(F.size("topics") > 0, P.fill(P.ANGLES["topic"], topic=F.initcap(F.get("topics", F.lit(0))))),
        F.when(F.size("entities") > 0, P.fill(P.ANGLES["name"], name=F.get("entities", F.lit(0)))),
        F.when(F.col("mood").isin("cheering_support", "positive"), F.lit(P.ANGLES["goodwill"])),
        F.when(F.col("mood") == "surprise_excitement", F.lit(P.ANGLES["excitement"])),
        F.lit(P.ANGLES["copy"]),
    ]
    return stats.filter("total_all > 0").select(F.posexplode(F.array_compact(F.array(*lines))).alias("place", "text"))
