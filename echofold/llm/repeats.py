"""Repeated windows over all documents: the Spark side of the exact substring operators.

1. index_rows: every document's groups of windows (see winnow), narrow.  Equal groups of one slice of texts are collapsed at once, so a
   passage in a third of all documents leaves a row for each slice, not for each document; what is settled there never moves again.
2. The operators find the first occurrence of each group and the anchors that have several (their own modules).
3. pieces: the content of those groups, cut from the documents.
4. solved: pieces meet by anchor and are compared exactly by the operator's own method.  An anchor with more than LIMIT variants
   is narrowed first: its windows are cut into parts by their place around the anchor, and each part goes by the content that all its
   windows share.  Equal parts are settled by comparing their content, the others go on until they are few; so the same method
   decides at every size and no task holds a hot anchor.

Rows are (kind, anchor, variant, digest, doc_id, place); variant and digest are the 128 bits of the group's content.
place = 15 bits of the text's CRC-32 << 48 | first window << 16 | windows << 8 | the anchor's offset.  The CRC keeps texts apart that share a
doc_id.  Of REMOVED rows, runs of windows that index_rows has settled, variant is the number of windows.  SETTLED rows are whole groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, winnow

INDEX, REMOVED, OPEN, HOT, SETTLED = 0, 1, 2, 3, 4
#: Variants of one anchor that may meet in one task.
LIMIT = 256
#: Into how many parts the windows of a hot anchor are cut at a time.
PARTS = 4
#: Rows of one anchor that a streaming pass holds before it settles those it can.
HELD_ROWS = 100_000
ROWS = "kind int, anchor long, variant long, digest long, doc_id long, place long"
COLUMNS = ["kind", "anchor", "variant", "digest", "doc_id", "place"]
FIRST = (1 << 32) - 1


class Bytes:
    """Windows of bytes.  An occurrence counts if it starts earlier: in a smaller doc_id, or before in the same document."""

    within = True
    empty = b""

    def __init__(self, window: int, core: int, limit: int = LIMIT, held_rows: int = HELD_ROWS):
        self.window, self.core, self.limit, self.held_rows = window, core, limit, held_rows

    def groups(self, texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
        table = winnow.byte_values(7)
        whole = b"".join(texts)
        raw = np.frombuffer(whole, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        for g in winnow.all_groups(lambda a, b: table[raw[a:b]], np.concatenate(([0], ends[:-1])), ends, self.window, self.core):
            a = g["at"].tolist()
            b = (g["at"] + g["n"] + self.window - 1).tolist()
            yield g | {"digest": winnow.digests(whole[i:j] for i, j in zip(a, b, strict=True))}

    def pieces(self, text: bytes, first: list[int], n: list[int]) -> list[bytes]:
        return [text[a : a + k + self.window - 1] for a, k in zip(first, n, strict=True)]

    def symbols(self, piece: bytes) -> bytes:
        return piece

    def piece(self, symbols: bytes) -> bytes:
        return symbols


class WordRuns:
    """Windows of words.  An occurrence counts if it is in a document with a smaller doc_id."""

    within = False

    def __init__(self, window: int, core: int, limit: int = LIMIT, held_rows: int = HELD_ROWS):
        self.window, self.core, self.limit, self.held_rows = window, core, limit, held_rows

    def groups(self, texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
        w = winnow.Words(texts)
        for g in winnow.all_groups(w.values(), w.first, w.last, self.window, self.core):
            yield g | {"digest": winnow.digests(w.content(g["at"], g["at"] + g["n"] + self.window - 1))}

    def pieces(self, text: bytes, first: list[int], n: list[int]) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[a : a + k + self.window - 1]) for a, k in zip(first, n, strict=True)]

    def symbols(self, piece: bytes) -> list[bytes]:
        return piece.split(b" ")

    def piece(self, symbols: list[bytes]) -> bytes:
        return b" ".join(symbols)


Unit = Bytes | WordRuns


#: Bytes of text that a worker takes at once.
SLICE_BYTES = 1 << 19


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `limit` bytes of text."""
    size = pc.binary_length(batch.column(column)).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def mark_of(texts: list[bytes]) -> np.ndarray:
    """15 bits that tell texts of one doc_id apart."""
    return np.fromiter((crc32(t) & 0x7FFF for t in texts), np.int64, len(texts))


def first_of(place):
    """The first window of a place, an array or a column."""
    return F.shiftright(place, 16).bitwiseAND(FIRST) if isinstance(place, Column) else place >> 16 & FIRST


def index_rows(rows: DataFrame, unit: Unit) -> DataFrame:
    """INDEX rows of rows(doc_id, text), one for each slice and group, and REMOVED rows of what each slice settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            docs = part.column("doc_id").to_numpy()
            texts = utf8(part.column("text"))
            marks = mark_of(texts)
            for g in unit.groups(texts):
                doc = docs[g["text"]]
                place = marks[g["text"]] << 48 | g["first"] << 16 | g["n"] << 8 | g["offset"]
                variant, digest = g["digest"].T
                order = np.lexsort((place, doc, digest, variant, g["anchor"]))
                anchor, variant, digest, doc, place = g["anchor"][order], variant[order], digest[order], doc[order], place[order]
                same = np.zeros(len(order), bool)
                same[1:] = (anchor[1:] == anchor[:-1]) & (variant[1:] == variant[:-1]) & (digest[1:] == digest[:-1])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = later_than(doc, place, first, unit.within)
                gone_doc, gone_place, gone_n = joined(doc[later], place[later])
                zero = np.zeros(len(gone_doc), np.int64)
                columns = [
                    np.repeat(np.array([INDEX, REMOVED], np.int32), [int((~later).sum()), len(gone_doc)]),
                    *(np.concatenate((x[~later], y)) for x, y in ((anchor, zero), (variant, gone_n), (digest, zero), (doc, gone_doc), (place, gone_place))),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=COLUMNS)

    return rows.mapInArrow(run, ROWS)


def joined(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups that follow one another in a text as one run: doc, place and number of windows."""
    place = np.asarray(place, np.int64)
    order = np.lexsort((place, doc))
    doc, start, end = doc[order], place[order] >> 16, (place[order] >> 16) + (place[order] >> 8 & 255)
    if not len(doc):
        return doc, place, place
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != end[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at] << 16, end[last] - start[at]


def later_than(doc: np.ndarray, place: np.ndarray, first: np.ndarray, within: bool) -> np.ndarray:
    """Rows whose occurrence isn't the first: first gives the row of the first one."""
    later = doc > doc[first]
    return later | ((doc == doc[first]) & (place > place[first])) if within else later


def whole_groups(frames: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Frames sorted by keys, cut anew so that no key is in two of them."""
    held = None
    for df in frames:
        if held is not None:
            df = pd.concat([held, df], ignore_index=True)
        if len(df):
            same = np.logical_and.reduce([df[k].to_numpy() == df[k].iloc[-1] for k in keys])
            cut = len(df) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield df.iloc[:cut]
            held = df.iloc[cut:]
    if held is not None and len(held):
        yield held


def group_cuts(df: pd.DataFrame, *keys: str) -> list[int]:
    """Where each group of a frame sorted by keys begins, and the end."""
    new = np.zeros(len(df), bool)
    for k in keys:
        x = df[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return [0, *np.flatnonzero(new).tolist(), len(df)]


#: Gets (anchor's offset, doc_id, first window, content) of an anchor's groups; gives (row, first, n) of windows that aren't first.
Solver = Callable[[list[tuple[int, int, int, bytes]]], Iterator[tuple[int, int, int]]]
SPANS = "doc_id long, mark long, first long, n long"


def removed(index: DataFrame) -> DataFrame:
    """doc_id, mark, first, n of REMOVED rows."""
    return index.filter(F.col("kind") == REMOVED).select("doc_id", F.shiftright("place", 48).alias("mark"), first_of(F.col("place")).alias("first"), F.col("variant").alias("n"))


def whole(later: DataFrame) -> DataFrame:
    """doc_id, mark, first, n of whole groups (doc_id, place)."""
    return later.select("doc_id", F.shiftright("place", 48).alias("mark"), first_of(F.col("place")).alias("first"), F.shiftright("place", 8).bitwiseAND(255).alias("n"))


def pieces(wanted: DataFrame, rows: DataFrame, unit: Unit) -> DataFrame:
    """anchor, hot, doc_id, mark, first, off (the anchor's offset) and piece, stored, of wanted(anchor, hot, doc_id, place): the groups' content, from rows(doc_id, text)."""
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot", "place")).alias("w"))
    wanted = wanted.select("doc_id", *(F.col(f"w.{c}").alias(c) for c in ("anchor", "hot", "place")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            texts = utf8(part.column("text"))
            found: list[bytes] = []
            keep = []
            for text, mark, places in zip(texts, mark_of(texts).tolist(), part.column("place"), strict=True):
                place = places.values.to_numpy()
                own = place >> 48 == mark
                keep.append(own)
                found += unit.pieces(text, first_of(place[own]).tolist(), (place[own] >> 8 & 255).tolist())
            own = np.concatenate(keep)
            anchor, hot, place = (part.column(c).flatten().to_numpy(zero_copy_only=False)[own] for c in ("anchor", "hot", "place"))
            doc = np.repeat(part.column("doc_id").to_numpy(), pc.list_value_length(part.column("place")).to_numpy())[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(hot, pa.bool_()), pa.array(doc), pa.array(place >> 48), pa.array(first_of(place)), pa.array((place & 255).astype(np.int32)), pa.array(found, pa.binary())],
                names=["anchor", "hot", "doc_id", "mark", "first", "off", "piece"],
            )

    schema = "anchor long, hot boolean, doc_id long, mark long, first long, off int, piece binary"
    return shared.store(rows.join(wanted, "doc_id").select("doc_id", "text", "anchor", "hot", "place").mapInArrow(cut, schema), "pieces")


def solved(found: DataFrame, unit: Unit, solve: Solver) -> DataFrame:
    """doc_id, mark, first, n: runs of windows of pieces() that also occur earlier."""
    cool = found.filter("NOT hot").select(F.col("anchor").alias("key"), "doc_id", "mark", "first", "off", "piece")
    out, more = narrowed(found.filter("hot").drop("hot"), unit)
    cool = cool if more is None else cool.unionByName(more)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in whole_groups(frames, "key"):
            docs, starts, offsets, content, marks = (df[c].tolist() for c in ("doc_id", "first", "off", "piece", "mark"))
            cuts = group_cuts(df, "key")
            gone: list[tuple[int, int, int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                # The mark orders texts that share a doc_id.
                group = list(zip(offsets[a:b], docs[a:b], (m << 32 | s for m, s in zip(marks[a:b], starts[a:b], strict=True)), content[a:b], strict=True))
                gone += [(docs[a + k], s >> 32, s & FIRST, n) for k, s, n in solve(group)]
            if gone:
                yield pd.DataFrame(gone, columns=["doc_id", "mark", "first", "n"])

    met = cool.repartition(F.xxhash64("key")).sortWithinPartitions("key", "doc_id", "mark", "first").mapInPandas(settle, SPANS)
    return met if out is None else met.unionByName(out)


def narrowed(hot: DataFrame, unit: Unit) -> tuple[DataFrame | None, DataFrame | None]:
    """Of anchors with more than LIMIT variants: what is settled on the way, and pieces whose keys have few enough."""
    if hot.isEmpty():
        return None, None
    window = unit.window
    span = window - unit.core

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = []
            for key, low, high, doc, mark, first, off, piece in df.itertuples(index=False):
                symbols = unit.symbols(piece)
                step = -((low - high - 1) // PARTS)
                for a in range(low, high + 1, step):
                    b = min(high, a + step - 1)
                    p, q = max(a, -off), min(b, len(symbols) - window - off)
                    if p <= q:
                        common = winnow.digests([b"%d %d " % (key, a) + unit.piece(symbols[b + off : a + off + window])])[0, 0]
                        found.append((int(common), a, b, doc, mark, first + p + off, -p, unit.piece(symbols[p + off : q + off + window])))
            if found:
                yield pd.DataFrame(found, columns=list(df.columns))

    schema = "key long, low int, high int, doc_id long, mark long, first long, off int, piece binary"
    level = hot.select(F.col("anchor").alias("key"), F.lit(-span).alias("low"), F.lit(0).alias("high"), "doc_id", "mark", "first", "off", "piece")
    hot_columns, out, cool = level.columns, None, None
    where = ["doc_id", "mark", "first"] if unit.within else ["doc_id"]
    while True:
        level = shared.store(level.mapInPandas(cut, schema), "parts")
        # Equal content at the same place around the anchor: all windows of the later ones are settled.
        same = ["key", "off", "piece"]
        least = shared.store(level.groupBy(*same).agg(F.min(F.struct(*where)).alias("least")), "parts")
        judged = shared.store(level.join(least, same).withColumn("later", F.struct(*where) > F.col("least")).drop("least"), "parts")
        size = F.octet_length("piece") if unit.within else F.size(F.split(F.col("piece").cast("string"), " "))
        later = judged.filter("later").select("doc_id", "mark", "first", (size - window + 1).cast("long").alias("n"))
        out = later if out is None else out.unionByName(later)
        count = shared.store(least.groupBy("key").agg(F.count("*").alias("variants")).filter("variants > 1"), "parts")
        level = judged.filter("NOT later").drop("later").join(count, "key")
        few = level.filter(F.col("variants") <= unit.limit).select("key", "doc_id", "mark", "first", "off", "piece")
        cool = few if cool is None else cool.unionByName(few)
        if count.filter(F.col("variants") > unit.limit).isEmpty():
            return out, cool
        level = level.filter(F.col("variants") > unit.limit).drop("variants").select(*hot_columns)


def by_document(found: DataFrame) -> DataFrame:
    """doc_id with its spans; a document's spans are at most as many as its windows."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "first", "n")).alias("s"))
    return spans.select("doc_id", *(F.col(f"s.{c}").alias(f"_{c}") for c in ("mark", "first", "n")))


def gone(size: int, mark: int, row: tuple[pa.Scalar, pa.Scalar, pa.Scalar], window: int) -> np.ndarray | None:
    """Which of a text's symbols its spans (_mark, _first, _n) cover; None if it has none."""
    if not row[0].is_valid:
        return None
    marks, first, n = (x.values.to_numpy() for x in row)
    own = marks == mark
    return winnow.covered(first[own], first[own] + n[own] + window - 1, size)


def clean(df: DataFrame) -> DataFrame:
    """Rows with a doc_id, a null text as an empty one."""
    return df.filter("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
