"""Messages and comments to segments: by time, by signals, by words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import stages
from .chat import cell, interval_join, level_of


def point_in_interval(points: DataFrame, segments: DataFrame, size: float | None = None) -> DataFrame:
    """row, seq: the first segment in input order whose closed interval holds the point.  segments: seq, start, end."""
    rows = interval_join(points.select("row", "ts"), segments.select("seq", "start", "end"), size, "start", "end")
    return rows.groupBy("row").agg(F.min("seq").alias("seq"))


def nearest(points: DataFrame, segments: DataFrame, within: float = 30.0) -> DataFrame:
    """row, seq, dist: the segment whose middle is nearest, up to a distance; the first of equal ones.

    By buckets as wide as the distance: a middle that near lies in the point's bucket or a neighbour.
    """
    mid = segments.select("seq", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    there = mid.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("mid") / within) + d)))
    rows = points.select("row", "ts", F.floor(F.col("ts") / within).alias("_b")).join(there, "_b").withColumn("dist", F.abs(F.col("mid") - F.col("ts"))).filter(F.col("dist") <= within)
    best = rows.groupBy("row").agg(F.min(F.struct("dist", "seq")).alias("m"))
    return best.select("row", "m.seq", "m.dist")


def match_by_time(points: DataFrame, segments: DataFrame, size: float | None = None, within: float = 30.0, medium: float = 15.0, before: float = 10.0, after: float = 20.0) -> DataFrame:
    """row, segment, low, high, confidence: in a segment, else near one, else a span of its own around the point.

    One join finds both: a segment reaches as far as its span or what is near its middle.
    """
    mid = (F.col("start") + F.col("end")) / 2
    reach = segments.select("seq", "start", "end", F.least("start", mid - within).alias("_from"), F.greatest("end", mid + within).alias("_to"))
    span = F.struct("seq", "start", "end")
    dist = F.abs(mid - F.col("ts"))
    met = interval_join(points.select("row", "ts"), reach, size, "_from", "_to")
    met = met.groupBy("row").agg(
        F.min(F.when(F.col("ts").between(F.col("start"), F.col("end")), span)).alias("hit"),
        F.min(F.when(dist <= within, F.struct(dist.alias("dist"), span.alias("s")))).alias("near"),
    )
    rows = points.select("row", "ts").join(met, "row", "left")
    found = F.coalesce("hit", "near.s")
    return rows.select(
        "row",
        F.when(found.isNotNull(), F.format_string("seg_%04d", found["seq"])).otherwise(F.format_string("lc_ts_%06d", F.floor("ts").cast("long"))).alias("segment"),
        F.coalesce(found["start"], F.greatest(F.lit(0.0), F.col("ts") - before)).alias("low"),
        F.coalesce(found["end"], F.col("ts") + after).alias("high"),
        F.when(F.col("hit").isNotNull(), "high").when(F.col("near.dist") <= medium, "medium").when(F.col("near").isNotNull(), "low").otherwise("high").alias("confidence"),
    )


def overlaps(segments: DataFrame, spans: DataFrame, size: float | None = None) -> DataFrame:
    """Segments that overlap closed spans (id, low, high); both may be of any lengths.

    Two that overlap meet in a cell of the longer one's level (see interval_join), where either touches two cells at most; a pair counts in the first
    cell that both touch.  Each side stands at its own level and at the longer ones of the other side.
    """
    a = segments.filter(F.col("start") <= F.col("end")).withColumn("_la", level_of(F.col("start"), F.col("end")))
    b = spans.filter(F.col("low") <= F.col("high")).withColumn("_lb", level_of(F.col("low"), F.col("high")))

    def cells(rows: DataFrame, own: str, other: DataFrame, level: str, low: str, high: str, first: str) -> DataFrame:
        levels = other.agg(F.collect_set(level).alias("_ls"))  # one row
        wanted = F.array_distinct(F.concat(F.array(own), F.filter("_ls", lambda x: x > F.col(own))))
        out = rows.crossJoin(F.broadcast(levels)).withColumn("_l", F.explode(wanted)).drop("_ls").withColumn(first, cell(F.col(low), F.col("_l")))
        return out.withColumn("_b", F.explode(F.sequence(F.col(first), cell(F.col(high), F.col("_l")))))

    rows = cells(a, "_la", b, "_lb", "start", "end", "_first_a").join(cells(b, "_lb", a, "_la", "low", "high", "_first_b"), ["_l", "_b"])
    rows = rows.filter((F.col("end") >= F.col("low")) & (F.col("start") <= F.col("high")) & (F.col("_l") == F.greatest("_la", "_lb")) & (F.col("_b") == F.greatest("_first_a", "_first_b")))
    return rows.drop("_l", "_b", "_la", "_lb", "_first_a", "_first_b")


def signal_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, seq, score, confidence, signals: the best partner by the weight of common signals.  left: id, signals; right: seq, signals.

    Rows with equal signals have the same partner, so only different sets meet, through an inverted index.
    """
    weight = F.when(F.col("s").startswith("player:"), 3).when(F.col("s").startswith("hole:"), 4).otherwise(2)
    own = F.sort_array(F.array_distinct("signals"))
    left = left.select("id", own.alias("set")).filter(F.size("set") > 0)
    right = right.select("seq", own.alias("set")).filter(F.size("set") > 0).groupBy("set").agg(F.min("seq").alias("seq"))
    a = left.select("set").distinct().select("set", F.explode("set").alias("s"))
    b = right.select("seq", F.explode("set").alias("s"))
    scores = a.join(b, "s").groupBy("set", "seq").agg(F.sum(weight).alias("score"), F.sort_array(F.collect_set("s")).alias("signals"))
    best = scores.groupBy("set").agg(F.max(F.struct("score", (-F.col("seq")).alias("first"), "signals")).alias("m"))
    out = left.join(best, "set").select("id", (-F.col("m.first")).alias("seq"), F.col("m.score").alias("score"), F.col("m.signals").alias("signals"))
    return out.withColumn("confidence", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 3, "medium").otherwise("low"))


def word_candidates(left: DataFrame, right: DataFrame, players: list[str] = [], least_hundredths: int = 7) -> DataFrame:  # noqa: B006
    """id, seq, n, m, named: pairs that may reach the similarity, and all with a common word that holds a player's name.

    left: id, n, words and right: seq, m, words as word_order gives them, rarest first.  With n and m words, a similarity of t needs at least
    a = t / (1 + t) * (n + m) common ones, so the two share a word among their first n - a + 1 and m - a + 1: only these meet.  What is common of them, and
    what may still follow the last of them on the shorter side, bounds the rest.
    """
    t = least_hundredths
    need = F.ceil(F.lit(t) * (F.col("n") + F.col("m")) / (100 + t)).cast("int")
    held = [F.contains(F.col("w"), F.lit(p)) for p in players]
    named = F.lit(False)
    for h in held:
        named = named | h
    # Words that no right set has come first: they take places and meet nothing.
    a = left.select("id", "n", (F.col("n") - F.size("words")).alias("_z"), F.posexplode("words").alias("_at", "w")).select("id", "n", (F.col("_at") + F.col("_z")).alias("i"), "w")
    b = right.select("seq", "m", F.posexplode("words").alias("j", "w"))
    first = lambda place, size: (F.col(place) <= F.col(size) - F.ceil(F.lit(t) * F.col(size) / 100)) | named
    early = (F.col("i") <= F.col("n") - F.col("need")) & (F.col("j") <= F.col("m") - F.col("need"))
    met = a.filter(first("i", "n")).join(b.filter(first("j", "m")), "w").withColumn("need", need).filter(early | named)
    many = F.count_if(early)
    rest = F.least(F.col("n") - F.max(F.when(early, F.col("i"))) - 1, F.col("m") - F.max(F.when(early, F.col("j"))) - 1)
    flags = [F.max(h.cast("int")) for h in held]
    pairs = met.groupBy("id", "seq", "n", "m", "need").agg(many.alias("_many"), rest.alias("_rest"), sum(flags[1:], flags[0]).alias("named") if flags else F.max(F.lit(0)).alias("named"))
    return pairs.filter((F.col("named") > 0) | (F.col("_many") + F.col("_rest") >= F.col("need"))).select("id", "seq", "n", "m", "named")


def word_order(left: DataFrame, right: DataFrame, kept: stages.Stages) -> tuple[DataFrame, DataFrame]:
    """(id, n, words) and (seq, m, words) as stage tables: sizes of the sets, and those words that any right set has, the rarest there first."""
    b = right.select("seq", F.size("words").alias("m"), F.explode("words").alias("w"))
    often = kept.keep(b.groupBy("w").agg(F.count("*").alias("often")), "word-order")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("often", "w"))), lambda x: x["w"]).alias("words")
    b = kept.keep(b.join(often, "w").groupBy("seq", "m").agg(in_order), "right-words")
    a = left.select("id", F.size("words").alias("n"), F.explode("words").alias("w")).join(often, "w").groupBy("id", "n").agg(in_order)
    return kept.keep(a, "left-words"), b


def word_counts(left: DataFrame, right: DataFrame, players: list[str] = []) -> DataFrame:  # noqa: B006
    """id, seq, n, m, common, named of all pairs with a common word, through an inverted index.  left, right: as word_order gives them."""
    held = [F.contains(F.col("w"), F.lit(p)).cast("int").alias(f"_p{i}") for i, p in enumerate(players)]
    b = right.select("seq", "m", F.explode("words").alias("w")).select("seq", "m", "w", *held)
    named = [F.max(f"_p{i}") for i in range(len(players))]
    pairs = left.select("id", "n", F.explode("words").alias("w")).join(b, "w").groupBy("id", "seq")
    return pairs.agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").cast("int").alias("common"), sum(named[1:], named[0]).alias("named") if named else F.lit(0).alias("named"))


def _winners(rows: DataFrame, bonus_hundredths: int, least_hundredths: int) -> DataFrame:
    """id, seq, common, either, named: the best of rows (id, seq, n, m, common, named) that come to the least score; of equal ones the first."""
    rows = rows.withColumn("either", F.col("n") + F.col("m") - F.col("common")).withColumn("j", F.col("common") / F.col("either") + F.col("named") * (bonus_hundredths / 100))
    enough = F.col("common") * 100 + F.col("named") * bonus_hundredths * F.col("either") >= F.col("either") * least_hundredths
    best = rows.filter(enough).groupBy("id").agg(F.max(F.struct("j", (-F.col("seq")).alias("o"), "common", "either", "named")).alias("x"))
    return best.select("id", (-F.col("x.o")).alias("seq"), "x.common", "x.either", "x.named")


def _overlapping(won: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """won with overlap: the first six common words."""
    overlap = F.slice(F.sort_array(F.array_intersect("words", "_other")), 1, 6).alias("overlap")
    return won.join(a.select("id", "words"), "id").join(b.select("seq", F.col("words").alias("_other")), "seq").select("id", "seq", "common", "either", "named", overlap)


def _likely(a: DataFrame, b: DataFrame, players: list[str], bonus_hundredths: int, least_hundredths: int) -> DataFrame:
    """The winners among word_candidates, each compared on its whole sets."""
    pairs = word_candidates(a, b, players, least_hundredths)
    other = b.select("seq", F.col("words").alias("_other"))
    common = F.size(F.array_intersect("words", "_other")).alias("common")
    return _winners(pairs.join(a.select("id", "words"), "id").join(other, "seq").select("id", "seq", "n", "m", "named", common), bonus_hundredths, least_hundredths)


def word_match(left: DataFrame, right: DataFrame, players: list[str] = [], bonus_hundredths: int = 6, least_hundredths: int = 7, kept: stages.Stages | None = None) -> DataFrame:  # noqa: B006
    """id, seq, common, either, named, overlap: the best partner by Jaccard similarity of word sets and a bonus for each player whose name a common
    word holds, where both come to the least score; of equal ones the first.

    left: id, words; right: seq, words; ids and words are unique.  overlap: the first six common words, found for the winners alone.  Candidates
    come from word_candidates; each is then compared on its whole sets.
    """
    a, b = word_order(left, right, kept or stages.of(left.sparkSession))
    return _overlapping(_likely(a, b, players, bonus_hundredths, least_hundredths), a, b)


def best_word_match(left: DataFrame, right: DataFrame, players: list[str] = [], bonus_hundredths: int = 6, kept: stages.Stages | None = None) -> DataFrame:  # noqa: B006
    """As word_match, whatever the score: the best partner of every row that has a word in common with any.

    Where scores may be low hardly a word can be left out of the prefixes, so all pairs with a common word are counted.
    """
    a, b = word_order(left, right, kept or stages.of(left.sparkSession))
    return _overlapping(_winners(word_counts(a, b, players), bonus_hundredths, 0), a, b)


def word_confidence(matches: DataFrame, least_hundredths: int = 7, bonus_hundredths: int = 6) -> DataFrame:
    """id, seq, confidence, signals of those at the least score; words never count for more than low."""
    enough = F.col("common") * 100 + F.col("named") * bonus_hundredths * F.col("either") >= F.col("either") * least_hundredths
    return matches.filter(enough).select("id", "seq", F.lit("low").alias("confidence"), F.transform("overlap", lambda w: F.concat(F.lit("overlap:"), w)).alias("signals"))


def coalesce_matches(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first pass where it is medium or better, else whichever has the better rank, the first if equal.  Both: id, seq, confidence."""
    rank = lambda c: F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).when(F.col(c) == "low", 1).otherwise(0)
    rows = first.select("id", F.col("seq").alias("s1"), F.col("confidence").alias("c1")).join(second.select("id", F.col("seq").alias("s2"), F.col("confidence").alias("c2")), "id", "full")
    use_first = (rank("c1") >= 2) | (rank("c1") >= rank("c2"))
    return rows.select("id", F.when(use_first, F.col("s1")).otherwise(F.col("s2")).alias("seq"), F.when(use_first, F.col("c1")).otherwise(F.col("c2")).alias("confidence"))
