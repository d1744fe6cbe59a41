"""Exact removal of repeated byte strings, by suffix sorting.

Groups of windows (see repeats) meet by anchor.  mark streams over sorted rows and settles the later occurrences of a whole group by the 128-bit
digest of its bytes; it holds one anchor's first occurrences at most.  What is left of an anchor is a handful of strings that agree around it and differ
further out.  They are split by the content that neighbouring windows have in common; strings that share such a content are sorted
together by their suffixes (see suffix_array).  Equal windows are then neighbours, and the earliest of them stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared
from .suffix_array import suffix_array

#: Bytes of a repeated string, and of the part that anchors it.
WINDOW, CORE = 100, 40
#: How often the windows of an anchor are halved before strings are sorted together.
HALVINGS = 3


def solver(window: int, halvings: int = HALVINGS) -> repeats.Solver:
    def solve(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        low = min(-o for o, _, _, _ in group)
        high = max(len(p) - window - o for o, _, _, p in group)
        yield from split(group, range(len(group)), low, high, halvings)

    def split(group, members, low: int, high: int, left: int) -> Iterator[tuple[int, int, int]]:
        """Windows that start at low..high, counted from the anchor.  They all hold the bytes from high to low + window."""
        if left and high - low >= 8:
            mid = (low + high) // 2
            halves = ((low, mid), (mid + 1, high))
        else:
            halves = ((low, high),)
        for a, b in halves:
            common: dict[bytes, list[int]] = {}
            for k in members:
                o, _, _, piece = group[k]
                if max(a, -o) <= min(b, len(piece) - window - o):
                    common.setdefault(piece[b + o : a + o + window], []).append(k)
            for same in common.values():
                if len(same) > 1:
                    if left and b - a >= 8:
                        yield from split(group, same, a, b, left - 1)
                    else:
                        yield from sort_together(group, same, a, b)

    def sort_together(group, members, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        # Equal strings stand for their first occurrence; all windows of the others repeat it.
        firsts: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for k in members:
            o, doc, start, piece = group[k]
            p, q = max(a, -o), min(b, len(piece) - window - o)
            firsts.setdefault((p, piece[p + o : q + o + window]), []).append((doc, start + p + o, k))
        text: list[int] = []
        owner: list[tuple[int, int, int]] = []
        places: list[int] = []
        for (_, piece), where in firsts.items():
            least = min(where)
            n = len(piece) - window + 1
            yield from ((k, at, n) for doc, at, k in where if (doc, at) > least[:2])
            owner += [(least[0], least[1] + i, least[2]) for i in range(n)]
            places += range(len(text), len(text) + n)
            text += [x + 2 for x in piece]
            text.append(1)
        if len(firsts) < 2:
            return
        whole = bytes(max(0, x - 2) for x in text)
        text.append(0)
        index = dict(zip(places, owner, strict=True))
        order = [s for s in suffix_array(text) if s in index]
        run = [order[0]]
        for s, t in zip(order, order[1:], strict=False):
            if whole[s : s + window] == whole[t : t + window]:
                run.append(t)
                continue
            if len(run) > 1:
                yield from later(run, index)
            run = [t]
        if len(run) > 1:
            yield from later(run, index)

    def later(run: list[int], index: dict) -> Iterator[tuple[int, int, int]]:
        where = [index[s] for s in run]
        least = min(where)[:2]
        yield from ((k, at, 1) for doc, at, k in where if (doc, at) > least)

    return solve


def mark(index: DataFrame, unit: repeats.Bytes) -> DataFrame:
    """SETTLED and open (OPEN, HOT) rows of INDEX rows, and REMOVED rows as they are; the rest needs no more.

    The rows are never stored before: they are the largest table of all.  REMOVED ones, few by now, pass through, spread by document and place.
    """

    def settled(a: dict[str, np.ndarray], hot: bool, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What is known of rows sorted by KEY, doc_id and place; of the others, those that stay open if last."""
        n = len(a["anchor"])
        new_anchor = np.ones(n, bool)
        new_anchor[1:] = a["anchor"][1:] != a["anchor"][:-1]
        new_variant = new_anchor.copy()
        new_variant[1:] |= (a["variant"][1:] != a["variant"][:-1]) | (a["digest"][1:] != a["digest"][:-1])
        first = np.maximum.accumulate(np.where(new_variant, np.arange(n), 0))
        later = repeats.later_than(a["doc_id"], a["place"], first, unit.within)
        frame = pd.DataFrame(a)
        gone = frame[later].assign(kind=repeats.SETTLED)
        if not last:
            return gone, frame[~later]
        group = np.cumsum(new_anchor) - 1
        variants = np.bincount(group, new_variant)[group]
        opened = ~later & (variants > 1)
        kind = np.where(variants > unit.limit, repeats.HOT, repeats.OPEN)
        if hot:
            opened |= ~later & (group == 0)
            kind = np.where(group == 0, repeats.HOT, kind)
        return gone, frame.assign(kind=kind)[opened]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, hot = None, False
        for df in frames:
            passed = df["kind"] == repeats.REMOVED
            if passed.any():
                yield df[passed]
                df = df[~passed]
            if held is not None:
                df = pd.concat([held, df], ignore_index=True)
            if not len(df):
                continue
            a = {c: df[c].to_numpy(np.int64) for c in repeats.COLUMNS}
            cut = int(np.searchsorted(a["anchor"], a["anchor"][-1]))
            if cut:
                yield from settled({c: x[:cut] for c, x in a.items()}, hot, True)
                hot = False
            held = df.iloc[cut:]
            if len(held) > unit.held_rows:
                gone, held = settled({c: x[cut:] for c, x in a.items()}, False, False)
                yield gone
                variants = held["variant"].to_numpy()
                if len(np.unique(variants)) > unit.limit:
                    hot, tail = True, variants == variants[-1]
                    yield held[~tail].assign(kind=repeats.HOT)
                    held = held[tail]
        if held is not None and len(held):
            yield from settled({c: held[c].to_numpy(np.int64) for c in repeats.COLUMNS}, hot, True)

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in run(frames):
            if len(df):
                yield df.assign(kind=df["kind"].astype(np.int32))[repeats.COLUMNS]

    key = F.when(F.col("kind") == repeats.REMOVED, F.xxhash64("doc_id", "place")).otherwise(F.xxhash64("anchor"))
    return index.repartition(key).sortWithinPartitions("anchor", "variant", "digest", "doc_id", "place").mapInPandas(typed, repeats.ROWS)


def dedup(df: DataFrame, window: int = WINDOW, core: int = CORE, unit: repeats.Bytes | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of df(doc_id, text, ...): without the bytes covered by a string of
    `window` bytes that also starts earlier (in a smaller doc_id, or before in the same document).

    Strings are judged on the input; overlaps count.  A null text is an empty one; texts shorter than the window keep all.  Rows
    without doc_id are left out; fully repeated rows count as one document and come out as often as they came in.  Different texts of
    one doc_id stand one after another, in the order of 15 bits of their CRC-32.  Other columns are left out.
    """
    spark = df.sparkSession
    shared.prepare(spark)
    rows = repeats.clean(df).select("doc_id", "text")
    unit = unit or repeats.Bytes(window, core)
    marks = shared.store(mark(repeats.index_rows(rows, unit), unit), "suffix-marks", "zstd")
    open_kinds = F.col("kind").isin(repeats.OPEN, repeats.HOT)
    wanted = marks.filter(open_kinds).select("anchor", (F.col("kind") == repeats.HOT).alias("hot"), "doc_id", "place")
    opened = repeats.pieces(wanted, rows, unit)
    spans = repeats.removed(marks).unionByName(repeats.whole(marks.filter(F.col("kind") == repeats.SETTLED))).unionByName(repeats.solved(opened, unit, solver(window)))
    found = repeats.by_document(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in repeats.slices(b)):
            size, removed, runs, kept = [], [], [], []
            texts = repeats.utf8(batch.column("text"))
            for raw, mark, *row in zip(texts, repeats.mark_of(texts).tolist(), batch.column("_mark"), batch.column("_first"), batch.column("_n"), strict=True):
                size.append(len(raw))
                gone = repeats.gone(len(raw), mark, row, window)
                if gone is None:
                    removed.append(0)
                    runs.append(0)
                    kept.append(raw)
                    continue
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(found, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(1, octet_length(h) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, hex(h[i:i]) AS x, CASE WHEN i + 99 <= octet_length(h) THEN md5_number(h[i:i + 99]) END AS k FROM b),
m AS (SELECT doc_id, i, x, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM s),
c AS (SELECT doc_id, i, x, coalesce(i - max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 100, false) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
