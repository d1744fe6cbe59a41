"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with the same shingles form one class, represented by its smallest doc_id.  Representatives meet in the buckets of MinHash bands;
each bucket is known by its smallest member, its leader, and all representatives with a leader form one unit of work.  Within a unit
MinHash values are compared a few at a time.  After n values with s matches the posterior of the similarity under a uniform prior is
Beta(s + 1, n - s + 1); a pair whose probability of reaching the threshold falls below the tolerance is dropped.  The rest are
verified on their shingle sets.  Large units are dealt out in pairs of blocks, by number and by size, so no task holds a unit and no row is a pair: a task
returns, for each representative, how many documents it is linked to, and the root of what it is connected with.  Shingles are 64-bit
hashes of the 64-bit hashes of their words (see winnow.word_hashes).

A pair at the threshold meets in no bucket with probability (1 - 0.8 ** 5) ** 40 < 2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared, winnow
from .components import connected_components
from .decontaminate import side

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
#: MinHash values that are compared between two looks at the posterior.
STEP = 20
TOLERANCE = 1e-9
#: Representatives of a unit in one block, and the bytes of their texts.
BLOCK, BLOCK_BYTES = 1024, 16 << 20


@lru_cache(maxsize=1)
def multipliers(n: int) -> np.ndarray:
    return winnow.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(winnow.BASE_2)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another, and how many each has.

    Words are runs of digits, letters a-z in either case, and characters beyond ASCII.  A text of fewer words, but not none, is one shingle.
    """
    w = winnow.Words(texts, winnow.FOLDED_WORDS)
    prefix = winnow.Prefix(w.values(), winnow.BASE_1)
    count = w.last - w.first
    many = np.where(count == 0, 0, np.maximum(1, count - size + 1))
    text = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w.first, many)
    hashes = prefix.spans(start, np.minimum(start + size, np.repeat(w.last, many)))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (rows) of each text that has shingles (columns)."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    if not len(starts):
        return np.zeros((n, 0), np.uint64)
    return np.stack([np.minimum.reduceat(hashes * m, starts) for m in multipliers(n)])


def sketch(rows: DataFrame, size: int = SHINGLE, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """doc_id, set_a, set_b (two hashes of the shingle set; null without words), bytes and bands of rows(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in repeats.slices(b)):
            hashes, counts = shingle_sets(repeats.utf8(part.column("text")), size)
            has = counts > 0
            starts = (np.cumsum(counts) - counts)[has]
            sums = [np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)]
            for out, seed in zip(sums, (winnow.BASE_1, winnow.BASE_2), strict=True):
                if len(starts):
                    out[has] = winnow.mix(np.add.reduceat(winnow.mix(hashes ^ np.uint64(seed)), starts) + counts[has].astype(np.uint64))
            sig = signatures(hashes, counts, bands * per_band)
            keys = np.zeros((bands, sig.shape[1]), np.uint64)
            for b in range(bands):
                keys[b] = b + 1  # keys of different bands are different
                for r in range(per_band):
                    keys[b] = winnow.mix(keys[b] * np.uint64(31) + sig[b * per_band + r])
            texts = pc.binary_length(part.column("text")).cast(pa.int64())
            offsets = np.concatenate(([0], np.cumsum(np.where(has, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x.view(np.int64), mask=~has) for x in sums), texts, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.T.ravel().view(np.int64)))],
                names=["doc_id", "set_a", "set_b", "bytes", "bands"],
            )

    return rows.mapInArrow(run, "doc_id long, set_a long, set_b long, bytes long, bands array<long>")


def needed_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n values that keep P(similarity >= threshold) at the tolerance or above."""
    total = 0.0
    for s in range(n + 1):
        total += comb(n + 1, s) * threshold**s * (1 - threshold) ** (n + 1 - s)
        if total >= tolerance:
            return s
    return n + 1


def leaders(reps: DataFrame) -> DataFrame:
    """rep, leader: the smallest member of each bucket with several that rep is in.  reps: rep, bands.

    An aggregate, combined before its shuffle, and a join that Spark can split: a bucket may hold a third of all representatives.
    """
    rows = reps.select("rep", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    return rows.join(shared.store(buckets, "buckets"), "key").select("rep", "leader").distinct()


def links(units: DataFrame, size: int, threshold: float, tolerance: float, n_hashes: int) -> DataFrame:
    """rep, n_links (documents), root for the representatives with links.  units: leader, i, j (blocks), block, rep, copies, lower, text."""
    needed = [(n, needed_matches(n, threshold, tolerance)) for n in range(STEP, n_hashes + 1, STEP)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in repeats.whole_groups(frames, "leader", "i", "j"):
            cuts = repeats.group_cuts(df, "leader", "i", "j")
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    out = unit(df.iloc[a:b].drop_duplicates("rep"))
                    if len(out):
                        yield out

    def unit(df: pd.DataFrame) -> pd.DataFrame:
        first = df["block"].to_numpy() == df["i"].iloc[0]
        rows = np.flatnonzero(first)
        columns = rows if df["i"].iloc[0] == df["j"].iloc[0] else np.flatnonzero(~first)
        n = len(df)
        hashes, counts = shingle_sets([t.encode() for t in df["text"]], size)
        starts = np.cumsum(counts) - counts
        sig = signatures(hashes, counts, n_hashes)
        keep = rows[:, None] < columns[None, :] if rows is columns else np.ones((len(rows), len(columns)), bool)
        # Pairs with a smaller leader in common belong to that leader's unit.
        of_row, of_column = np.full(n, -1), np.full(n, -1)
        of_row[rows], of_column[columns] = np.arange(len(rows)), np.arange(len(columns))
        size_of = [len(x) for x in df["lower"]]
        lower, member = np.concatenate(df["lower"].tolist()).astype(np.int64), np.repeat(np.arange(n), size_of)
        order = np.argsort(lower, kind="stable")
        for group in np.split(member[order], np.flatnonzero(np.diff(lower[order])) + 1):
            x, y = of_row[group], of_column[group]
            if len(group) > 1 and len(x := x[x >= 0]) and len(y := y[y >= 0]):
                keep[np.ix_(x, y)] = False
        x, y = np.nonzero(keep)
        x, y = rows[x], columns[y]
        matches = np.zeros(len(x), np.int32)
        done = 0
        for upto, least in needed:
            for k in range(done, upto):
                matches += sig[k, x] == sig[k, y]
            alive = matches >= least
            x, y, matches, done = x[alive], y[alive], matches[alive], upto
            if not len(x):
                break
        copies, degree, root = df["copies"].to_numpy(), np.zeros(n, np.int64), list(range(n))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        vocabulary, places = np.unique(hashes, return_inverse=True)
        mine = np.zeros(len(vocabulary), bool)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        ends = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
        for a, b in zip(ends, ends[1:], strict=False):
            if a == b:
                continue
            k, others = int(x[a]), y[a:b]
            own = places[starts[k] : starts[k] + counts[k]]
            mine[own] = True
            size_of = counts[others]
            index = np.repeat(starts[others] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
            common = np.add.reduceat(mine[places[index]].astype(np.int64), np.cumsum(size_of) - size_of)
            mine[own] = False
            # common / union >= threshold, in whole numbers of 1/1000
            close = others[common * 1000 >= round(threshold * 1000) * (counts[k] + size_of - common)]
            if len(close):
                degree[k] += copies[close].sum()
                degree[close] += copies[k]
                for o in close.tolist():
                    a1, b1 = find(k), find(o)
                    if a1 != b1:
                        root[max(a1, b1)] = min(a1, b1)
        reps = df["rep"].to_numpy()
        linked = np.flatnonzero(degree)
        return pd.DataFrame({"rep": reps[linked], "n_links": degree[linked], "root": reps[[find(int(k)) for k in linked]]})

    return units.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "rep").mapInPandas(run, "rep long, n_links long, root long")


def join(df: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, class_id, n_links of every row of df(doc_id, text, ...).

    Two documents are linked if the Jaccard similarity of their shingle sets is at least the threshold; n_links counts all other documents linked to
    one.  class_id is the smallest doc_id of those that links connect.  Texts without words (null and empty ones too) have no shingles and
    are linked to nothing.  Rows without doc_id are left out; repeated rows count as one document and come out as often as they came in.  Of different
    texts with one doc_id, that with the smallest hash counts for all.  Other columns are left out.
    """
    spark = df.sparkSession
    shared.prepare(spark)
    given = repeats.clean(df).select("doc_id", "text")
    rows, several = shared.one_text(given)
    sketches = shared.store(sketch(rows, size, bands, per_band), "sketches")
    has = sketches.filter("set_a IS NOT NULL")
    # Stored, so that both sides of the join come by shuffles of their own: one with a hot class can then be split.
    classes = has.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    classes = shared.store(classes, "classes")
    member = shared.store(has.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "rep", "copies"), "members")
    own = member.filter("doc_id = rep").select("rep", "copies").dropDuplicates(["rep"])
    reps = own.join(has.select(F.col("doc_id").alias("rep"), "bytes", "bands").dropDuplicates(["rep"]), "rep")
    led = shared.store(leaders(reps.select("rep", "bands")), "leaders")
    # By number and by size, of which the representatives of a unit have a share at most.
    size_of = led.join(reps.select("rep", "bytes"), "rep").groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
    size_of = side(shared.store(size_of, "unit-sizes"), "leader", "blocks")
    mine = led.groupBy("rep").agg(F.collect_list("leader").alias("leaders")).join(own, "rep")
    # A unit's blocks: each member goes to the pairs (i, j), i <= j, that its block is in.
    members = mine.select("rep", "copies", "leaders", F.explode("leaders").alias("leader")).join(size_of, "leader")
    members = members.withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    members = members.withColumn("lower", F.filter("leaders", lambda x: x < F.col("leader")))
    members = shared.store(members, "unit-members")
    # Where what the members take is small by its measured size, the texts stay where they are.
    members = side(members, "rep", "leaders", "lower", "leader")
    units = rows.join(members, rows["doc_id"] == members["rep"]).select("leader", "block", "rep", "copies", "lower", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    units = units.select("leader", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "copies", "lower", "text")
    found = shared.store(links(units, size, threshold, tolerance, bands * per_band), "links")
    degree = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    component = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = degree.join(component, degree["rep"] == component["node"], "left").select(F.col("rep").alias("_r"), "links", "label")
    known = shared.store(known, "known")
    out = member.join(known, member["rep"] == known["_r"], "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = out.unionByName(sketches.filter("set_a IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    return given.select("doc_id").join(out.dropDuplicates(["doc_id"]), "doc_id") if several else out


# Every pair of documents with a common shingle, then the closure of the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE common * 10 >= 8 * (p.size + q.size - common)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links FROM d
"""
