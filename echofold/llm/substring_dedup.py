"""Exact removal of passages of words that stand in an earlier document, with a log-structured fingerprint index.

The index holds one row for each group of window hashes seen so far (see winnow), with the first document that has it, in sorted
immutable runs.  A new batch of documents is merge-joined with the runs: a group that any of them holds is settled, as are
later copies within the batch; equality is that of the 128-bit digests of the words themselves.  What is new becomes a run of its own.  Where groups share
an anchor and differ further out, their words are fetched and compared one by one.  If there are more than FANOUT runs when a batch comes, they are first
merged into one.  Batches come in ascending order of doc_id, so what is settled for a batch stays so.  An index can outlive a call: its runs are
named tables, and a later call adds its documents to them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, shared, winnow

#: Words of a repeated passage, and of the part that anchors it.
WINDOW, CORE = 50, 25
#: Runs that may stand side by side before they are merged.
FANOUT = 2
#: More than FANOUT + 1, so that batches meet merged runs too.
BATCHES = 4
KEY = ["anchor", "variant", "digest"]


def solve_exactly(window: int) -> repeats.Solver:
    """Word for word: windows at the same offset from the anchor with the same words."""

    def solve(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        least: dict[tuple[int, bytes], int] = {}
        content = []
        for offset, doc, _, piece in group:
            words = piece.split(b" ")
            keys = [(i - offset, b" ".join(words[i : i + window])) for i in range(len(words) - window + 1)]
            content.append(keys)
            for k in keys:
                if least.setdefault(k, doc) > doc:
                    least[k] = doc
        for k, (_, doc, start, _) in enumerate(group):
            found = [i for i, key in enumerate(content[k]) if least[key] < doc]
            at = 0
            while at < len(found):  # neighbours as one run
                end = at + 1
                while end < len(found) and found[end] == found[end - 1] + 1:
                    end += 1
                yield k, start + found[at], end - at
                at = end

    return solve


class FingerprintIndex:
    """Sorted runs of window-group hashes, as bucketed tables in the shared folder: merge-joins with them need no shuffle on their side."""

    def __init__(self, spark: SparkSession, unit: repeats.WordRuns, fanout: int = FANOUT, runs: Iterable[str] = ()):
        self.spark, self.unit, self.fanout = spark, unit, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = list(runs)  # those of an index that was kept reopen it

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that the last aggregation has dealt out by KEY already, so each bucket is one file."""
        path = shared.shared_path(self.spark, "run")
        name = "echofold_" + path.rpartition("-")[2]
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", shared.CODEC).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        shared.drop_stored(self.spark, self.spark.table(name))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _rows(self, name: str) -> DataFrame:
        """A run's files without their buckets: joins by other columns, or with hot keys, are dealt out anew."""
        table = self.spark.table(name)
        return self.spark.read.schema(table.schema).parquet(table.inputFiles()[0].rpartition("/")[0]) if table.inputFiles() else table

    def add(self, rows: DataFrame) -> DataFrame:
        """Index a batch (doc_id, text), whose doc_ids are all larger than those before; its settled groups and the repeats of its new groups, stored.

        Columns: KEY, doc_id, place, later (also in a smaller doc_id; else one more place in the group's first document), and the runs of windows
        that index_rows has settled (kind REMOVED).
        """
        if len(self.runs) > self.fanout:
            self.compact()
        index = shared.store(repeats.index_rows(rows, self.unit), "substring-rows")
        fresh = index.filter(F.col("kind") == repeats.INDEX).drop("kind")
        # Numbers alone, so that the aggregate hashes; any place in the first document will do.
        firsts = fresh.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"), F.count("*").alias("n"))
        known = F.lit(False)
        for i, r in enumerate(self.runs):
            seen = self.spark.table(r).filter("NOT known").select(*KEY, F.lit(True).alias(f"_seen{i}"))
            firsts = firsts.join(seen.hint("merge"), KEY, "left")
            known = known | F.col(f"_seen{i}").isNotNull()
        batch = self._write(firsts.select(*KEY, "doc_id", "place", "n", known.alias("known")))
        self.runs.append(batch)
        several = self._rows(batch).filter("known OR n > 1").select(*KEY, F.col("doc_id").alias("_doc"), F.col("place").alias("_place"), "known")
        met = fresh.join(several, KEY)
        later = F.col("known") | (F.col("doc_id") > F.col("_doc"))
        met = met.withColumn("later", later).filter("later OR place <> _place")
        settled = shared.store(met.select(*KEY, "doc_id", "place", "later"), "substring-settled")
        self.settled = settled if self.settled is None else self.settled.unionByName(settled)
        gone = repeats.removed(index)
        self.gone = gone if self.gone is None else self.gone.unionByName(gone)

    #: Of the batches added since open_groups() was last asked: settled groups, and runs of windows settled in their slices.
    settled: DataFrame | None = None
    gone: DataFrame | None = None

    def open_groups(self, above: int) -> DataFrame:
        """anchor, hot, doc_id, place of first occurrences that share an anchor with another group, where one is of a doc_id above the given one."""
        rows = None
        for r in self.runs:
            t = self._rows(r).filter("NOT known").select(*KEY, "doc_id", "place")
            rows = t if rows is None else rows.unionByName(t)
        anchors = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        # One document alone can't remove its own words.
        anchors = anchors.filter((F.col("n") > 1) & (F.col("a") < F.col("b")) & (F.col("b") > above))
        anchors = shared.store(anchors.select("anchor", (F.col("n") > self.unit.limit).alias("hot")), "substring-anchors")
        repeats_of = self.settled.filter("NOT later").select("anchor", "doc_id", "place")
        return rows.select("anchor", "doc_id", "place").unionByName(repeats_of).join(anchors, "anchor").select("anchor", "hot", "doc_id", "place")

    def compact(self) -> None:
        """One run for all: the first place of each group of windows."""
        rows = None
        for r in self.runs:
            t = self._rows(r).filter("NOT known").drop("known")
            rows = t if rows is None else rows.unionByName(t)
        first = rows.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"), F.sum("n").alias("n"))
        merged = self._write(first.select(*KEY, "doc_id", "place", "n", F.lit(False).alias("known")))
        for r in self.runs:
            self._drop(r)
        self.runs = [merged]

    def drop(self) -> None:
        for r in self.runs:
            self._drop(r)
        self.runs = []


def id_ranges(df: DataFrame, n: int) -> list[tuple[int, int]]:
    """n ranges of doc_id with about as many rows each."""
    at = df.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("q"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if at.a is None:
        return []
    edges = sorted({at.a - 1, *(at.q or []), at.b})
    return list(zip(edges, edges[1:], strict=False))


def dedup(df: DataFrame, window: int = WINDOW, core: int = CORE, batches: int = BATCHES, keep: tuple[str, ...] = (), unit: repeats.WordRuns | None = None, as_it_was: bool = False, index: FingerprintIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by single spaces), words [^ x20 x09-x0D]+, and the columns named in
    keep, of df(doc_id, text, ...): without the words covered by a window that also starts in a document with a smaller doc_id.

    With as_it_was, kept is the text itself where nothing is removed, white space included.

    With an index, made with the same window and core, the documents are added to it and it is kept; the caller drops it.  All doc_ids must be
    larger than those it holds, whose documents are given as earlier(doc_id, text, ...).

    Windows are judged on the input.  A null text has no words; shorter texts than the window keep all.  Rows without doc_id are
    left out; repeated rows count as one document and come out as often as they came in.  Columns that aren't named are left out;
    those named must not be called doc_id, text, n_words, n_removed or kept.  Texts that share a doc_id are judged one by one; what they have in
    common stays, as no doc_id is smaller.
    """
    if clash := {"n_words", "n_removed", "kept", "doc_id", "text"} & set(keep):
        raise ValueError(f"keep can't name {sorted(clash)}")
    spark = df.sparkSession
    shared.prepare(spark)
    source = repeats.clean(df)
    rows = source.select("doc_id", "text")
    unit = index.unit if index else unit or repeats.WordRuns(window, core)
    given = index
    index = given or FingerprintIndex(spark, unit)
    # The same projection for both joins with the texts, so that one shuffle serves both.
    whole = source.select("doc_id", "text", *keep)
    texts = whole if earlier is None else whole.select("doc_id", "text").unionByName(repeats.clean(earlier).select("doc_id", "text"))
    index.settled = index.gone = None
    ranges = id_ranges(rows, batches)
    for low, high in ranges:
        index.add(rows.filter((F.col("doc_id") > low) & (F.col("doc_id") <= high)))
    if ranges:
        found = repeats.pieces(index.open_groups(ranges[0][0]), texts, unit)
        spans = index.gone.unionByName(repeats.whole(index.settled.filter("later"))).unionByName(repeats.solved(found, unit, solve_exactly(window)))
    else:
        spans = spark.createDataFrame([], repeats.SPANS)
    if not given:
        index.drop()
    found = repeats.by_document(spans)
    schema = ", ".join(["doc_id long", *(f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_removed long, kept string"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in frames for x in repeats.slices(b)):
            w = winnow.Words(repeats.utf8(batch.column("text")))
            marks = repeats.mark_of(w.texts).tolist()
            size, removed, kept = [], [], []
            for k, row in enumerate(zip(batch.column("_mark"), batch.column("_first"), batch.column("_n"), strict=True)):
                total = int(w.last[k] - w.first[k])
                gone = repeats.gone(total, marks[k], row, window)
                if gone is None:
                    gone = np.zeros(total, bool)
                size.append(total)
                removed.append(int(gone.sum()))
                kept.append(w.texts[k] if as_it_was and not removed[-1] else w.kept(k, ~gone))
            out = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in keep), *out], names=["doc_id", *keep, "n_words", "n_removed", "kept"])

    return whole.join(found, "doc_id", "left").mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
r AS (SELECT DISTINCT doc_id, i FROM s JOIN f USING (k) WHERE first < doc_id),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM r) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
