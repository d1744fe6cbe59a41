"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions alone.

1. Test items become windows of 13 words (shorter items: one window).
2. One pass over the corpus counts the test terms; a window's two rarest terms are its pivots, and a window with a term that the corpus
   lacks is gone.
3. A second pass stores the postings of all pivot terms (term, doc_id, position, the words around), sorted by term; a frequent term is dealt out
   by document to as many places as its count asks for.
4. A window's start follows from a posting and the pivot's offset.  The starts of its rarest pivot are intersected with those of
   the second: where both agree, the words around are compared one by one, which makes an exact match; where they differ by less than a
   window, it is a proximity match.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

WINDOW = 13
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORDS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a term that stand together; more are dealt out by document.
TOGETHER = 100_000


def words(text: Column) -> Column:
    """Words of a text once A-Z are lower-cased; none of null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), NOT_WORDS), "")


def once(value: Column) -> Column:
    """A generator of one row: what stands above refers to its result.  A plain column would be copied into every filter and lambda that uses it."""
    return F.explode_outer(F.array(value))


def small(df: DataFrame, *columns: str) -> bool:
    """Whether a stored table fits the broadcast limit, by its measured content."""
    size = [F.octet_length(F.col(c).cast("string")) for c in columns]
    total = df.select(F.coalesce(F.sum(sum(size[1:], size[0]) + 16), F.lit(0)).alias("n")).first().n
    return total <= shared.BROADCAST_BYTES


def side(df: DataFrame, *columns: str) -> DataFrame:
    """df, to be broadcast if its measured size allows."""
    return F.broadcast(df) if small(df, *columns) else df


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, wid, key, words, len of all windows of items(item_id, text)."""
    w = items.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    w = w.select("item_id", "w", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    w = w.select("item_id", F.slice("w", F.col("at"), F.col("len")).alias("words"), "len")
    return w.withColumn("key", F.array_join("words", " ")).withColumn("wid", F.xxhash64("key"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """term, salt, doc_id, pos (from 0), around (the words from pos - reach to pos + reach) and lead (how many of them stand before pos)."""
    w = docs.filter("doc_id IS NOT NULL").select("doc_id", once(words(F.col("text"))).alias("w"))
    rows = w.select("doc_id", "w", F.posexplode_outer("w").alias("pos", "term")).join(side(terms, "term"), "term")
    lead = F.least(F.col("pos"), F.lit(reach))
    return rows.select("term", "salt", "doc_id", "pos", F.slice("w", F.col("pos") - lead + 1, lead + reach + 1).alias("around"), lead.alias("lead"))


def build_index(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The stored index of docs(doc_id, text) for terms(term, n), n of which may be missing or null."""
    salt = F.greatest(F.lit(1), F.ceil(F.col("n") / TOGETHER)) if "n" in terms.columns else F.lit(1)
    rows = postings(docs, terms.select("term", F.coalesce(salt, F.lit(1)).cast("int").alias("salt")), reach)
    return shared.store(rows.repartition("term", F.pmod("doc_id", F.col("salt"))).sortWithinPartitions("term", "doc_id", "pos").drop("salt"), "postings")


def starts(index: DataFrame, pivots: DataFrame, n: int) -> DataFrame:
    """Where windows would start by their n-th rarest pivot: the offset-adjusted posting lists."""
    own = pivots.filter(F.col("rank") == n).select("wid", "term", "offset", "words", "len")
    rows = index.join(side(own, "wid", "term", "offset", "words"), "term")
    return rows.withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")


def phrases(index: DataFrame, pivots: DataFrame) -> DataFrame:
    """doc_id, start, len, wid, key of every exact occurrence of a window."""
    first = starts(index, pivots, 1).select("doc_id", "start", "wid", "words", "len", F.expr("slice(around, lead - offset + 1, len)").alias("there"))
    second = starts(index, pivots, 2).select("doc_id", "start", "wid")
    both = first.join(second, ["doc_id", "start", "wid"], "left_semi")
    return both.filter("there = words").select("doc_id", "start", "len", "wid", F.array_join("words", " ").alias("key")).distinct()


def proximity(index: DataFrame, pivots: DataFrame, size: int) -> DataFrame:
    """doc_id, wid, key of windows whose two rarest words stand less than `size` places from where they would relative to each other.

    A posting meets the others of its stretch of `size` places and of the two beside it.
    """
    at = F.floor(F.col("start") / size)
    first = starts(index, pivots, 1).select("doc_id", "wid", F.array_join("words", " ").alias("key"), at.alias("at"), F.col("start").alias("a")).distinct()
    near = F.explode(F.array(at - 1, at, at + 1))
    second = starts(index, pivots, 2).select(F.col("doc_id").alias("_d"), F.col("wid").alias("_w"), near.alias("_at"), F.col("start").alias("b")).distinct()
    there = (F.col("doc_id") == F.col("_d")) & (F.col("wid") == F.col("_w")) & (F.col("at") == F.col("_at")) & (F.abs(F.col("a") - F.col("b")) < size)
    return first.join(second, there, "left_semi").select("doc_id", "wid", "key").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every row of docs(doc_id, text, ...), held against items(item_id, text, ...).

    A word is hit if it lies in any occurrence of a window of an item.  n_near counts the items with a window that the document holds or has
    near: see proximity().  A null or empty text has no words; such items have no windows, and
    items without item_id are left out.  Rows of docs without doc_id come out without hits.  Repeated rows count as one document and
    come out as often as they came in.  Of different texts with one doc_id, that with the smallest hash is searched for all; n_words is each row's own.
    Other columns are left out.
    """
    spark = docs.sparkSession
    everything = shared.store(item_windows(items.select("item_id", "text"), size), "windows")
    owners = everything.select("item_id", "wid", "key").distinct()
    windows = everything.select("wid", "key", "words", "len").dropDuplicates(["key"])
    terms = windows.select("wid", "key", "words", "len", F.posexplode("words").alias("offset", "term"))
    vocabulary = shared.store(terms.select("term").distinct(), "terms")
    known, _ = shared.one_text(docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    counts = known.select(F.explode_outer(words(F.col("text"))).alias("term")).join(side(vocabulary, "term"), "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = shared.store(counts, "term-counts")
    by_rarity = Window.partitionBy("key").orderBy("n", "term", "offset")
    ranked = terms.groupBy("wid", "key", "words", "len", "term").agg(F.min("offset").alias("offset")).join(side(counts, "term"), "term", "left")
    ranked = ranked.withColumn("lacks", F.max(F.col("n").isNull()).over(Window.partitionBy("key"))).filter("NOT lacks")
    ranked = ranked.withColumn("rank", F.row_number().over(by_rarity)).withColumn("terms", F.count("*").over(Window.partitionBy("key")))
    # A window of one term repeated has that one as both pivots.
    twice = F.when(F.col("terms") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array("rank"))
    pivots = ranked.filter("rank <= 2").withColumn("rank", F.explode(twice)).select("wid", "key", "words", "len", "term", "offset", "rank", "n")
    pivots = shared.store(pivots, "pivots")
    index = build_index(known, shared.store(pivots.groupBy("term").agg(F.max("n").alias("n")), "pivot-terms"), size - 1)
    hits = shared.store(phrases(index, pivots), "hits")
    near = hits.select("doc_id", "wid", "key").unionByName(proximity(index, pivots, size)).distinct()

    spots = hits.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spots = spots.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    n_hit = spots.groupBy("doc_id").agg(F.sum("new").cast("long").alias("n_hit"))
    named = hits.select("doc_id", "wid", "key").distinct().join(side(owners, "item_id", "key"), ["wid", "key"])
    named = named.groupBy("doc_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    named = named.select("doc_id", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"))
    n_near = near.join(side(owners, "item_id", "key"), ["wid", "key"]).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_near"))
    found = n_near.join(n_hit.join(named, "doc_id"), "doc_id", "left").withColumnRenamed("doc_id", "_doc")
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), NOT_WORDS_ANY_CASE), "")).cast("long")
    out = docs.select("doc_id", n_words.alias("n_words")).join(found, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "n_near": F.coalesce("n_near", F.lit(0).cast("long"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


ORACLE = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, l.len, i, array_to_string(list_slice(w, i, i + l.len - 1), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT len FROM bw) l WHERE i + l.len - 1 <= len(w)
), hit AS (
  SELECT DISTINCT doc_id, i, dw.len, k FROM dw WHERE k IN (SELECT k FROM bw)
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM hit) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit JOIN bw USING (k) GROUP BY doc_id
), po AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d
), bt AS (
  SELECT k, term, min(o) AS o FROM (SELECT k, unnest(string_split(k, ' ')) AS term, unnest(range(0, len(string_split(k, ' ')))) AS o FROM (SELECT DISTINCT k FROM bw)) GROUP BY k, term
), tc AS (
  SELECT term, count(*) AS n FROM po WHERE term IN (SELECT term FROM bt) GROUP BY term
), pv AS (
  SELECT k, term, o, row_number() OVER (PARTITION BY k ORDER BY n, term, o) AS r, count(*) OVER (PARTITION BY k) AS many
  FROM bt JOIN tc USING (term) WHERE k NOT IN (SELECT k FROM bt WHERE term NOT IN (SELECT term FROM tc))
), st AS (
  SELECT DISTINCT doc_id, k, r, many, pos - o AS at FROM pv JOIN po USING (term) WHERE r <= 2 AND pos >= o
), nw AS (
  SELECT doc_id, k FROM hit UNION SELECT a.doc_id, a.k FROM st a JOIN st b ON a.doc_id = b.doc_id AND a.k = b.k AND a.r = 1 AND b.r = least(2, b.many) AND abs(a.at - b.at) < 13
), nn AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nw JOIN bw USING (k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
