"""Text expressions.  Patterns are those whose JVM matches equal the stated classes for every script."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as a text cleaner sees it, which neither \s nor its Unicode form matches in full.
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]+"
#: One character that isn't white space.
NOT_SPACE = r"[^\s\u001c-\u001f\u0085\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
DIGITS = r"^\p{Nd}+$"
# What is decoded, in this order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("<br>", " "), ("<br/>", " ")]


@F.pandas_udf(StringType())
def compose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC."""
    import unicodedata

    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All HTML entities."""
    import html

    for s in texts:
        yield s.map(lambda t: None if t is None else html.unescape(t))


def once(value: Column) -> Column:
    """A generator of one row, so that what stands above refers to the result and doesn't compute it again.

    Outer generators stand in general where an array is costly: an inner one gets a filter that computes the array once more.
    """
    return F.explode_outer(F.array(value))


def strip(text: Column) -> Column:
    """Without the white space around it."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")


def has_text(text: Column) -> Column:
    """Neither null nor blank, whatever white space a blank one is made of."""
    return F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def decode_entities(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean_text(text: Column, urls: bool = True, mentions: bool = False, normalize: bool = True) -> Column:
    """Entities decoded, composed, without URLs (and mentions), white space collapsed.  Null counts as empty."""
    text = decode_entities(F.coalesce(text, F.lit("")))
    if normalize:
        text = compose(text)
    if urls:
        text = F.regexp_replace(text, r"https?://[^\s\u001c-\u001f\u0085\p{Z}]+|www\.[^\s\u001c-\u001f\u0085\p{Z}]+", " ")
    if mentions:
        text = F.regexp_replace(text, r"@[\p{L}\p{N}_]+", " ")
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """Lower-case words of at least two characters; one is enough with Hangul syllables."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: (F.length(t) >= 2) | t.rlike("[가-힣]"))


def without_stopwords(words: Column, stop: Iterable[str]) -> Column:
    listed = list(stop)
    return F.filter(words, lambda t: ~t.isin(listed) & ~t.rlike(DIGITS))


def content_words(text: Column, stop: Iterable[str]) -> Column:
    """A set: at least two characters, no numbers, no stopwords."""
    return F.array_distinct(without_stopwords(F.filter(F.split(F.lower(text), NOT_WORD), lambda t: F.length(t) >= 2), stop))


def bigrams(words: Column) -> Column:
    """Neighbours in an array of words."""
    n = F.size(words)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))


def contains_any(lowered: Column, needles: Iterable[str]) -> Column:
    """Substring tests, case by case; JVM-side and short-circuiting."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(lowered, F.lit(n.lower()))
    return out


def labels(lowered: Column, lexicon: dict[str, list[str]]) -> Column:
    """All labels one of whose substrings occurs, in the lexicon's order."""
    return F.array_compact(F.array(*(F.when(contains_any(lowered, words), F.lit(label)) for label, words in lexicon.items())))


def normalize_informal(text: Column) -> Column:
    # Longest first.
    for a, b in (("않됬", "안됐"), ("됬", "됐"), ("겟", "겠")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def emotion_hundredths(text: Column) -> Column:
    """1 to 5 in hundredths: laughter, tears, exclamation marks, double semicolons and length."""
    kk = F.regexp_count(text, F.lit("ㅋ"))
    tears = F.regexp_count(text, F.lit("[ㅠㅜ]"))
    marks = F.regexp_count(text, F.lit("!"))
    semicolons = F.regexp_count(text, F.lit(";;"))
    score = (
        F.lit(100)
        + F.when(kk > 1, F.least((kk - 1) * 25, F.lit(200))).otherwise(0)
        + F.least(tears * 35, F.lit(150))
        + F.least(marks * 20, F.lit(100))
        + F.least(semicolons * 50, F.lit(100))
        + F.when(F.length(text) > 100, 50).otherwise(0)
    )
    return F.greatest(F.lit(100), F.least(score, F.lit(500)))


def caption(text: Column, limit: int = 45) -> Column:
    """The first sentence of at least four characters, or the whole, cut to the limit."""
    squeezed = F.trim(F.regexp_replace(F.regexp_replace(text, "ㅋ{2,}", "ㅋ"), "[ㅠㅜ]{2,}", "ㅠ"), F.lit(" \t\n\r\x0b\x0c"))
    sentence = F.trim(F.regexp_extract(squeezed, r"(?s)^.*?[.!?；;。…]+", 0), F.lit(" \t\n\r\x0b\x0c"))
    chosen = F.when(F.length(sentence) >= 4, sentence).otherwise(squeezed)
    cut = F.when(F.length(chosen) > limit, F.concat(F.rtrim(F.left(chosen, F.lit(limit)), F.lit(" \t\n\r\x0b\x0c")), F.lit("…"))).otherwise(chosen)
    return F.when(cut == "", F.left(text, F.lit(limit))).otherwise(cut)


def clock(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS below an hour."""
    s = seconds.cast("long")
    h, m, r = (s - s % 3600) / 3600, (s % 3600 - s % 60) / 60, s % 60
    return F.when(s >= 3600, F.format_string("%02d:%02d:%02d", h.cast("long"), m.cast("long"), r)).otherwise(F.format_string("%02d:%02d", m.cast("long"), r))


def minutes_clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", ((s - s % 60) / 60).cast("long"), s % 60)


def long_clock(value: Column) -> Column:
    """H:MM:SS of a number given as text; --:-- for what is none."""
    number = value.try_cast("double")
    s = F.when(~F.isnan(number) & (F.abs(number) < 1e15), number.cast("long"))
    text = F.format_string("%d:%02d:%02d", ((s - s % 3600) / 3600).cast("long"), ((s % 3600 - s % 60) / 60).cast("long"), s % 60)
    return F.when(s.isNull(), "--:--").otherwise(text)


def seconds(milliseconds: Column) -> Column:
    return F.round(milliseconds / 1000.0, 3)


def valid_seconds(value: Column) -> Column:
    """A number of seconds given as text; null for blank, unreadable and negative ones."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (number >= 0), number)


def or_dash(value: Column, fallback: str = "—") -> Column:
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(fallback))


def pretty(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def preview(text: Column, limit: int) -> Column:
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(limit)), rf"{SPACE}\z", ""), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def wrapped(text: Column, width: int = 55) -> Column:
    """Lines of whole words; a word that is longer than a line leaves the line before it as it is, even an empty one."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def add(a: Column, w: Column) -> Column:
        full = F.length(a["now"]) + F.length(w) + 1 > width
        longer = F.when(a["now"] == "", w).otherwise(F.concat(a["now"], F.lit(" "), w))
        return F.struct(F.when(full, F.concat(a["lines"], F.array(a["now"]))).otherwise(a["lines"]).alias("lines"), F.when(full, w).otherwise(longer).alias("now"))

    return F.aggregate(words, start, add, lambda a: F.when(a["now"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["now"]))))


def srt_clock(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    s = ((ms - ms % 1000) / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", ((s - s % 3600) / 3600).cast("long"), ((s % 3600 - s % 60) / 60).cast("long"), s % 60, ms % 1000)


def vtt_seconds(text: Column) -> Column:
    """HH:MM:SS.mmm."""
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double")


def particle(word: Column, after_vowel: str, after_consonant: str) -> Column:
    """The Korean particle that follows a word, by its last syllable's final consonant."""
    code = F.ascii(F.right(word, F.lit(1)))
    closed = code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 > 0)
    return F.when(closed, after_consonant).otherwise(after_vowel)


def strip_suffix(name: Column, suffixes: Iterable[str]) -> Column:
    """Without a form of address, the longest first, unless nothing would be left."""
    bare = F.regexp_replace(name, "(" + "|".join(suffixes) + ")$", "")
    return F.when(F.length(bare) > 0, bare).otherwise(name)


# A name and a form of address; with white space between as in captions; a surname alone, of one syllable.
TITLED = r"([가-힣]{2,5})(프로님|선수님|형님|프로|선수|형|햄|님|코치|감독)"
TITLED_SPACED = r"([가-힣]{2,5})\s*(프로님|선수님|형님|프로|선수|형|님|코치|감독)"
TITLED_SHORT = r"([가-힣]{1})(프로님|선수님|프로|선수)"


def titled(text: Column, pattern: str = TITLED) -> Column:
    """Names with their form of address, without white space between, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.regexp_replace(t, r"\s", ""))


def is_noise(text: Column) -> Column:
    """Blank, of three characters at most, or laughter or tears alone."""
    t = strip(text)
    return (F.length(t) <= 3) | t.rlike("^(ㅋ+|ㅎ+|[ㅠㅜ]+)$")


def in_open_context(text: Column, token: Column, closed: str, before: int = 30, after: int = 40) -> Column:
    """Whether the token occurs anywhere in text without the closed pattern around it."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(token) + 1)), lambda i: F.substring(text, i, F.length(token)) == token)
    around = lambda i: F.substring(text, F.greatest(F.lit(1), i - before), i - 1 + after - F.greatest(F.lit(0), i - 1 - before))
    return F.exists(places, lambda i: ~around(i).rlike(closed))


def reaction_tokens(text: Column) -> Column:
    """Words as canonical reactions: runs of laughter and tears are one label each; filler and single characters go."""

    def label(w: Column) -> Column:
        return (
            F.when(w.rlike("^ㅋ+$"), "웃음(ㅋ)")
            .when(w.rlike("^ㅎ+$"), "웃음(ㅎ)")
            .when(w.rlike("^[ㅠㅜ]+$"), "안타까움(ㅠ)")
            .when(w.rlike("^(ㅇ+|ㅏ+|ㅓ+|아+|어+)$") | (F.length(w) < 2), None)
            .otherwise(w)
        )

    return F.array_compact(F.transform(F.split(strip(text), SPACE), label))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)


def signals(text: Column, players: list[str], events: list[str]) -> Column:
    """player:, hole: and event: signals of a text."""
    low = F.lower(text)
    named = F.filter(F.array(*(F.when(F.contains(low, F.lit(p.lower())), F.lit("player:" + p)) for p in players)), lambda x: x.isNotNull()) if players else F.array().cast("array<string>")
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(e.lower())), F.lit("event:" + e.lower())) for e in events)))
    holes = F.concat(*(F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in (r"(\d{1,2})\s*번\s*홀", r"hole\s*(\d{1,2})", r"#(\d{1,2})", r"(\d{1,2})(?:st|nd|rd|th)\s+hole")))
    return F.array_distinct(F.concat(named, F.transform(holes, lambda h: F.concat(F.lit("hole:"), h)), found))


def signal_score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.when(x.startswith("player:"), 3).when(x.startswith("hole:"), 4).when(x.startswith("event:"), 2).otherwise(0))


def video_id(url: Column) -> Column:
    """The id in a watch, short or embed address, or the bare id; null otherwise."""
    # The address forms, in this order.
    forms = [r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"youtube\.com/(?:live|shorts|embed)/([A-Za-z0-9_-]{11})", r"^\s*([A-Za-z0-9_-]{11})\s*$"]
    return F.coalesce(*(F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in forms))
