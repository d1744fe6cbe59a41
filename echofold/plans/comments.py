"""Queries of comment analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..operators import comments as C
from .tables import comments, quoted, sql_labels, table, turns, with_views

STOP = L.STOPWORDS
LEX = L.SAMPLE_SENTIMENT
SPLIT = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')"
TOKENS = rf"list_filter({SPLIT}, lambda t: (length(t) >= 2 OR regexp_matches(t, '[가-힣]')) AND t <> '')"
KEPT = rf"list_filter({TOKENS}, lambda t: t NOT IN ({quoted(STOP)}) AND NOT regexp_full_match(t, '\p{{Nd}}+'))"
WORDS = f"words AS (SELECT comment_id, like_count, {KEPT} AS w FROM comments)"
UNI = "uni AS (SELECT t AS phrase, count(*) AS n FROM (SELECT unnest(w) AS t FROM words) GROUP BY 1)"
BI = "bi AS (SELECT p AS phrase, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM words WHERE len(w) >= 2) GROUP BY 1)"
LABELS = f"tagged AS (SELECT comment_id, {sql_labels(LEX, 'lower(text)')} AS labels FROM comments)"
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
TOPICS = f"""topics AS (SELECT * FROM (
  SELECT * FROM (SELECT phrase, n, 'phrase' AS type FROM bi ORDER BY n DESC, phrase LIMIT 20) WHERE n >= 3
  UNION ALL SELECT * FROM (SELECT phrase, n, 'word' AS type FROM uni ORDER BY n DESC, phrase LIMIT 30) WHERE n >= 3 AND phrase NOT IN (SELECT unnest(string_split(phrase, ' ')) FROM (SELECT phrase, n FROM bi ORDER BY n DESC, phrase LIMIT 20) WHERE n >= 3)
) ORDER BY n DESC, type, phrase LIMIT 25)"""
ENTITIES = rf"""entities AS (SELECT * FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) AS word FROM comments)
  WHERE lower(word) NOT IN ({quoted(STOP)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 50) WHERE n >= 3)"""
THEMES = """kw AS (SELECT phrase, n FROM uni ORDER BY n DESC, phrase LIMIT 100),
he AS (SELECT t AS phrase FROM (SELECT unnest(w) AS t FROM (SELECT * FROM words WHERE like_count > 0 ORDER BY like_count DESC, comment_id LIMIT 10)) WHERE length(t) > 2),
themes AS (SELECT phrase, he, coalesce(n, 0) AS n FROM (SELECT phrase, count(*) AS he FROM he GROUP BY 1 ORDER BY he DESC, phrase LIMIT 30) LEFT JOIN kw USING (phrase)
  WHERE he >= 2 AND (n IS NULL OR 2 * he * (SELECT sum(n) FROM kw) >= 3 * n * (SELECT count(*) FROM he)) ORDER BY he DESC, phrase LIMIT 10)"""
PROFILE = f"""counts AS (SELECT l AS label, count(*) AS n FROM (SELECT unnest(labels) AS l FROM tagged) GROUP BY 1),
profile AS (SELECT label, n, n / (SELECT count(*) FROM comments) AS share, row_number() OVER (ORDER BY n DESC, list_position([{quoted(LEX)}], label)) = 1 AS dominant FROM counts)"""


def clean_text(spark, sf):
    return C.clean_comments(comments(spark, sf), mentions=True).select("comment_id", "text")


def html_page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.clean_text(F.col("html"))).cast("long").alias("n"), F.md5(T.clean_text(F.col("html"))).alias("digest"))


def tokens_per_doc(spark, sf):
    rows = comments(spark, sf).select("comment_id", T.once(T.tokens(F.col("text"))).alias("t"))
    return rows.select("comment_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda x: x.rlike(T.DIGITS))).cast("long").alias("n_digits"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def top_keywords(spark, sf):
    return C.top_phrases(comments(spark, sf), STOP)


def top_bigrams(spark, sf):
    return C.top_phrases(comments(spark, sf), STOP, 2)


def keyword_union(spark, sf):
    return C.keyword_union(comments(spark, sf), STOP)


def comment_stats(spark, sf):
    return C.comment_stats(comments(spark, sf))


def sentiment_counts(spark, sf):
    return C.label_counts(comments(spark, sf), LEX)


def sentiment_labels(spark, sf):
    return C.label_rows(comments(spark, sf), LEX).select("comment_id", F.array_join("labels", "|").alias("labels"))


def audience_profile(spark, sf):
    return C.audience_profile(comments(spark, sf), LEX)


def top_liked(spark, sf):
    return C.top_liked(comments(spark, sf))


def top_authors(spark, sf):
    return C.top_authors(comments(spark, sf))


def entity_candidates(spark, sf):
    return C.entity_candidates(comments(spark, sf), STOP)


def top_topics(spark, sf):
    return C.top_topics(comments(spark, sf), STOP)


def lift_themes(spark, sf):
    return C.lift_themes(comments(spark, sf), STOP)


def recommendation_rules(spark, sf):
    return C.recommendation_rules(*C.Analysis.of(comments(spark, sf), STOP, LEX).parts())


def word_jaccard_neighbors(spark, sf):
    """Each turn's word set against the one before; the ratio as two whole numbers."""
    from pyspark.sql import Window

    words = F.array_distinct(F.filter(F.split(F.lower(F.col("text")), r"\s+"), lambda x: x != ""))
    rows = turns(spark, sf).select("conv_id", "row", T.once(words).alias("w"))
    rows = rows.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("row"))).filter("before IS NOT NULL")
    return rows.select("conv_id", "row", F.size(F.array_intersect("w", "before")).cast("long").alias("common"), F.size(F.array_union("w", "before")).cast("long").alias("either"))


ENTITY_SQL = "replace(replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '<br>', ' '), '<br/>', ' ')"
CLEAN_SQL = rf"trim(regexp_replace({{}}regexp_replace(nfc_normalize({ENTITY_SQL}), 'https?://[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|www\.[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'){{}}, '{SPACES}', ' ', 'g'))"


def clean_sql(column: str, mentions: bool) -> str:
    body = CLEAN_SQL.replace("{}regexp_replace(nfc", "@A@regexp_replace(nfc").replace("'g'){}, '", "'g')@B@, '")
    body = body.replace("{}", column).replace("{{", "{").replace("}}", "}")
    return body.replace("@A@", "regexp_replace(" if mentions else "").replace("@B@", r", '@[\p{L}\p{N}_]+', ' ', 'g')" if mentions else "")


QUERIES = {
    "clean_text": (clean_text, with_views(f"SELECT comment_id, text FROM (SELECT comment_id, {clean_sql('text', True)} AS text FROM comments) WHERE text <> ''", "comments")),
    "html_page_text": (html_page_text, f"SELECT page_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT page_id, {clean_sql('html', False)} AS t FROM pages)"),
    "tokens_per_doc": (tokens_per_doc, with_views(rf"SELECT comment_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_filter(t, lambda x: regexp_full_match(x, '\p{{Nd}}+'))) AS BIGINT) AS n_digits, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT comment_id, {TOKENS} AS t FROM comments)", "comments")),
    "top_keywords": (top_keywords, with_views(f"+{WORDS}, {UNI} SELECT phrase, n FROM uni ORDER BY n DESC, phrase LIMIT 100", "comments")),
    "top_bigrams": (top_bigrams, with_views(f"+{WORDS}, {BI} SELECT phrase, n FROM bi ORDER BY n DESC, phrase LIMIT 100", "comments")),
    "keyword_union": (keyword_union, with_views(f"+{WORDS}, {UNI}, {BI} SELECT * FROM (SELECT phrase, n, 'unigram' AS type FROM uni ORDER BY n DESC, phrase LIMIT 100) UNION ALL SELECT * FROM (SELECT phrase, n, 'bigram' AS type FROM bi ORDER BY n DESC, phrase LIMIT 100)", "comments")),
    "comment_stats": (
        comment_stats,
        with_views("SELECT count(*) FILTER (NOT is_reply) AS total_top_level, count(*) FILTER (is_reply) AS total_replies, count(*) AS total_all, count(DISTINCT author) AS unique_authors, avg(length(text)) AS avg_length, median(length(text)) AS median_length, avg(like_count) AS avg_likes, CAST(sum(like_count) AS BIGINT) AS total_likes, max(like_count) AS max_likes FROM comments", "comments"),
    ),
    "sentiment_counts": (sentiment_counts, with_views(f"+{LABELS}, {PROFILE} SELECT label, n FROM counts", "comments")),
    "sentiment_labels": (sentiment_labels, with_views(f"+{LABELS} SELECT comment_id, array_to_string(labels, '|') AS labels FROM tagged", "comments")),
    "audience_profile": (audience_profile, with_views(f"+{LABELS}, {PROFILE} SELECT * FROM profile", "comments")),
    "top_liked": (top_liked, with_views("SELECT comment_id, author, like_count, is_reply FROM comments WHERE like_count > 0 ORDER BY like_count DESC, comment_id LIMIT 20", "comments")),
    "top_authors": (top_authors, with_views("SELECT author, count(*) AS comment_count, CAST(sum(like_count) AS BIGINT) AS total_likes, CAST(sum(length(text)) AS BIGINT) AS total_length FROM comments GROUP BY author ORDER BY comment_count DESC, author LIMIT 30", "comments")),
    "entity_candidates": (entity_candidates, with_views(f"+{ENTITIES} SELECT word, n FROM entities", "comments")),
    "top_topics": (top_topics, with_views(f"+{WORDS}, {UNI}, {BI}, {TOPICS} SELECT phrase, n, type FROM topics", "comments")),
    "lift_themes": (lift_themes, with_views(f"+{WORDS}, {UNI}, {THEMES} SELECT phrase, he, CAST(n AS BIGINT) AS n FROM themes", "comments")),
    "recommendation_rules": (
        recommendation_rules,
        with_views(
            f"""+{WORDS}, {UNI}, {BI}, {TOPICS}, {ENTITIES}, {THEMES}, {LABELS}, {PROFILE},
f AS (SELECT (SELECT count(*) FROM topics) AS t, (SELECT count(*) FROM entities) AS e, (SELECT count(*) FROM themes) AS h, (SELECT label FROM profile WHERE dominant) AS d, count(*) AS a, count(*) FILTER (is_reply) AS r, sum(like_count) AS k FROM comments)
SELECT 'topics' AS rule, t > 0 AS fires FROM f UNION ALL SELECT 'entities', e > 0 FROM f UNION ALL SELECT 'themes', h > 0 FROM f UNION ALL SELECT 'mood', coalesce(d IN ('cheering_support', 'surprise_excitement', 'criticism', 'positive'), false) FROM f
UNION ALL SELECT 'debate', r * 5 > a * 2 FROM f UNION ALL SELECT 'low_likes', k < a AND a > 50 FROM f UNION ALL SELECT 'recap', t >= 5 FROM f UNION ALL SELECT 'clips', t > 0 OR h > 0 FROM f""",
            "comments",
        ),
    ),
    "word_jaccard_neighbors": (
        word_jaccard_neighbors,
        with_views(r"""+w AS (SELECT conv_id, row, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM turns),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY row) AS b FROM w)
SELECT conv_id, row, CAST(len(list_intersect(w, b)) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(w, b))) AS BIGINT) AS either FROM p WHERE b IS NOT NULL""", "turns"),
    ),
}
