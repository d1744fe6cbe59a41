"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Documents become pieces: only a document longer than a sequence is cut, and but for its first piece, which takes what is left over, its pieces fill
sequences of their own.  All other pieces are packed by rounds.  A round range-sorts the pieces that have no place yet and the gaps of the open sequences
together by size, equal ones in the order of a hash, so that a size that a third of all rows have is spread over many partitions.  Every partition sweeps
through its range from small to large: a gap takes the largest piece before it that nothing took, and more while they fit, which are its best fits
there.  What is left over is known by its rank in the partition; from the partitions' counts alone (a few rows for each) the ranks of gaps without a
piece are matched with ranks of pieces in the nearest range below.  Gaps are updated, and the next round begins.  When a round places few
pieces, as many empty sequences are opened as the tokens without a place need; once the pieces left are no more than one partition holds, a last
task packs them into new sequences.  Pieces beyond half a sequence go first, then all others.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats, shared
from .bpe import _byte_symbols as byte_symbols

CAPACITY = 2048
#: Rows of a sweep's partition.
PART_ROWS = 1 << 17
#: Entries of a worker's table of units, and the longest unit that it keeps.
TABLE_UNITS, UNIT_CHARS = 400_000, 40
#: Characters of a text that are handled at once, if it can be cut there.
SLICE_CHARS = 1 << 20
#: A round that places fewer than this share of the pieces without a place opens sequences.
FEW = 0.05

#: Pieces that the vocabulary's pre-tokenizer never joins: it starts anew before a space or line feed that follows anything but white space, after a run of
#: Latin letters before any other ASCII character, and after a single line feed.
UNITS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?![^\x00-\x7f])|\n(?=[!-~])|[ \n]*[^ \n]+|[ \n]+")
LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: White space that engines don't agree on, or which may stand in runs with spaces; then only cuts between a visible ASCII character and a space hold.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


class Units(dict):
    """Ids of units as little-endian unsigned 32-bit integers; a unit that isn't there is encoded, a full table starts anew.

    One run of letters is one piece of the vocabulary's pre-tokenizer: it goes to tiktoken's merging by ranks, which are the ids, all else to the tokenizers library.
    """

    def __init__(self, library, ranks: dict[bytes, int]):
        import tiktoken

        self.library = library
        self.single = tiktoken.Encoding("units", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, unit: str) -> bytes:
        if len(unit) <= UNIT_CHARS and LETTERS.fullmatch(unit):
            ids = self.single(unit.encode())
        else:
            ids = self.library.encode(unit, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= TABLE_UNITS:
                self.clear()
            self[unit] = out
        return out


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, a unit at a time: most units of a text were met before."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if any(t.lstrip or t.rstrip or t.normalized or t.single_word or not t.content.isascii() or re.search(r"\s", t.content) for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens that look beyond themselves")
        if self.library.normalizer is not None or type(self.library.pre_tokenizer).__name__ != "ByteLevel" or self.library.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path} isn't a byte-level vocabulary without a normalizer and prefix spaces")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(set(made)) or model["dropout"] is not None or model.get("ignore_merges"):
            raise ValueError(f"the ids of {path} aren't in the order of its merges")
        spelling = {s: b for b, s in enumerate(byte_symbols())}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.units = Units(self.library, {bytes(spelling[c] for c in token): i for token, i in vocab.items() if token not in special})

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE_CHARS:
            cut = SAFE.search(text, at + SLICE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        known = self.units.__getitem__
        return b"".join([b"".join(map(known, SAFE.split(part) if ODD_SPACE.search(part) else UNITS.findall(part))) for part in self._slices(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in repeats.slices(b, 1 << 20)):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder(path).ids(text.as_py()) + tail
                size = len(ids) // 4
                start, stop, piece = 0, (size - 1) % capacity + 1, 0
                while start < size:
                    own = ids[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(own), own if with_ids else None))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])

    return run


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """item, doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every row of documents(doc_id, text), as a stored table.

    A null text is an empty one and has the end id alone.  item tells rows apart, whatever their doc_id.
    """
    shared.prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    cut = rows.mapInArrow(_pieces(path, capacity, end, with_ids), kinds)
    return shared.store(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")


#: What a sweep leaves: pieces with a place, pieces and gaps without one, gaps that took something; and for each of these a row that sums it up.
PLACED, PIECE, GAP, CHANGED, SUMMARY = 0, 1, 2, 3, 10
SWEPT = "kind int, part int, rank long, id long, size long, bin long"


def sweep(sizes: list[int], gaps: list[bool], ids: list[int]) -> tuple[list[tuple], list[int], list[int], list[tuple]]:
    """Of rows sorted by size, pieces before gaps: (piece, bin) pairs, places of pieces left over from the largest on, places of gaps without
    a piece from the smallest on, (bin, rest) of the others."""
    held: list[int] = []
    placed, empty, changed = [], [], []
    for i, gap in enumerate(gaps):
        if not gap:
            held.append(i)
        elif held:
            rest = sizes[i]
            while held and sizes[held[-1]] <= rest:
                j = held.pop()
                rest -= sizes[j]
                placed.append((j, ids[i]))
            changed.append((ids[i], rest))
        else:
            empty.append(i)
    # Where a range is wide, gaps that took something may take more of it.
    again = bool(held)
    while again:
        again, kept = False, []
        sorted_held = [sizes[j] for j in held]
        for b, rest in sorted(changed, key=lambda x: x[1]):
            while held and (at := bisect.bisect_right(sorted_held, rest)):
                rest -= sorted_held.pop(at - 1)
                placed.append((held.pop(at - 1), b))
                again = True
            kept.append((b, rest))
        changed = kept
        again = again and bool(held)
    return placed, held[::-1], empty, changed


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    part = table.column("part")[0].as_py()
    sizes, gaps, ids = (table.column(c).to_pylist() for c in ("size", "gap", "id"))
    placed, left, empty, changed = sweep(sizes, gaps, ids)
    rows = [(PLACED, 0, ids[j], sizes[j], b) for j, b in placed]
    rows += [(PIECE, r, ids[j], sizes[j], None) for r, j in enumerate(left)]
    rows += [(GAP, r, ids[j], sizes[j], None) for r, j in enumerate(empty)]
    rows += [(CHANGED, 0, b, rest, None) for b, rest in changed if rest]
    # rank: how many; size: the largest piece or the smallest gap.
    rows.append((SUMMARY + PLACED, len(placed), 0, 0, None))
    rows.append((SUMMARY + PIECE, len(left), 0, max((sizes[j] for j in left), default=0), None))
    rows.append((SUMMARY + GAP, len(empty), 0, min((sizes[j] for j in empty), default=0), None))
    rows.append((SUMMARY + CHANGED, sum(rest > 0 for _, rest in changed), 0, 0, None))
    for at in range(0, len(rows), 1 << 15):
        kind, rank, own, size, bins = zip(*rows[at : at + (1 << 15)], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array([part] * len(kind), pa.int32()), *(pa.array(x, pa.int64()) for x in (rank, own, size, bins))], names=["kind", "part", "rank", "id", "size", "bin"]
        )


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Numbers of sequences, from 0, of pieces in descending order: each goes where it leaves least room."""
    out, rooms, of_room = [], [], {}
    opened = 0
    for size in sizes:
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            number = of_room[room].pop()
            if not of_room[room]:
                rooms.pop(at)
        else:
            room, number, opened = capacity, opened, opened + 1
        out.append(number)
        if room > size:
            if not of_room.setdefault(room - size, []):
                bisect.insort(rooms, room - size)
            of_room[room - size].append(number)
    return out


def _finish(capacity: int, opened: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((s, i) for b in batches for s, i in zip(b.column("size").to_pylist(), b.column("id").to_pylist(), strict=True)), reverse=True)
        bins = [-opened - 1 - n for n in best_fit([s for s, _ in rows], capacity)]
        yield pa.RecordBatch.from_arrays([pa.array([i for _, i in rows], pa.int64()), pa.array(bins, pa.int64())], names=["id", "bin"])

    return run


@dataclass
class Span:
    """Pieces of one partition by their ranks, and the gaps of another that take `per` of them each."""

    piece_part: int
    piece_from: int
    pieces: int
    gap_part: int
    gap_from: int
    gaps: int
    per: int


def match(left: dict[int, tuple[int, int]], empty: dict[int, tuple[int, int]]) -> list[Span]:
    """left: of each partition how many pieces have no place and the largest of them; empty: how many gaps, and the smallest.  Gaps take pieces of the
    nearest range below, from the largest on; as many as fit whichever they are."""
    out, open_parts = [], []
    for part in sorted(left.keys() | empty.keys()):
        gaps, smallest = empty.get(part, (0, 0))
        at = 0
        while at < gaps and open_parts:
            below, done, number, largest = open_parts[-1]
            per = max(1, smallest // largest)
            take = min(gaps - at, -(-number // per))
            n = min(number, take * per)
            out.append(Span(below, done, n, part, at, take, per))
            at += take
            if n == number:
                open_parts.pop()
            else:
                open_parts[-1] = (below, done + n, number - n, largest)
        number, largest = left.get(part, (0, 0))
        if number:
            open_parts.append((part, 0, number, largest))
    return out


def _files(df: DataFrame) -> DataFrame:
    """No more partitions than the cluster runs at a few goes: rounds write little, and a file for each range would be mostly files."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)


def _round(rows: DataFrame, n: int, part_rows: int) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """rows(id, size, gap): the places found (id, bin), the pieces and gaps that are left as rows, and numbers of them."""
    spark = rows.sparkSession
    by = ("size", "gap", "salt")
    dealt = rows.withColumn("salt", F.xxhash64("id")).repartitionByRange(max(1, -(-n // part_rows)), *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    swept = shared.store(_files(dealt.mapInArrow(_sweep, SWEPT)), "swept")
    counts = [(r.kind - SUMMARY, r) for r in swept.filter(F.col("kind") >= SUMMARY).collect()]  # four rows for each partition
    spans = match({r.part: (r.rank, r.size) for k, r in counts if k == PIECE and r.rank}, {r.part: (r.rank, r.size) for k, r in counts if k == GAP and r.rank})
    of = lambda *kinds: sum(r.rank for k, r in counts if k in kinds)
    told = {"placed": of(PLACED), "left": of(PIECE), "gaps": of(GAP, CHANGED)}
    places = swept.filter(F.col("kind") == PLACED).select("id", "bin")
    open_rows = swept.filter(F.col("kind").isin(PIECE, GAP))
    changed = swept.filter(F.col("kind") == CHANGED).select("id", "size", F.lit(True).alias("gap"))
    if not spans:
        return places, open_rows.select("id", "size", (F.col("kind") == GAP).alias("gap")).unionByName(changed), told
    # One row for each partition and side: bounded by the partitions, whatever they hold.
    known, key = [], 0
    for s in spans:
        known.append((PIECE, s.piece_part, s.piece_from, s.piece_from + s.pieces, s.per, key))
        known.append((GAP, s.gap_part, s.gap_from, s.gap_from + s.gaps, 1, key))
        key += s.gaps
    ranks = F.broadcast(spark.createDataFrame(known, "_kind int, _part int, _from long, _to long, per long, base long"))
    on = (F.col("kind") == F.col("_kind")) & (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    keyed = open_rows.join(ranks, on, "left").withColumn("key", F.col("base") + F.floor((F.col("rank") - F.col("_from")) / F.col("per")))
    # A gap and the pieces that it takes, as many as fit into a sequence at most.
    is_gap = F.col("kind") == GAP
    met = keyed.filter("key IS NOT NULL").groupBy("key").agg(
        F.max(F.when(is_gap, F.col("id"))).alias("bin"), F.sum(F.when(is_gap, F.col("size")).otherwise(-F.col("size"))).alias("rest"), F.collect_list(F.when(~is_gap, F.col("id"))).alias("ids")
    )
    met = shared.store(_files(met.select("bin", "rest", "ids")), "met")
    more = sum(s.pieces for s in spans)
    told = told | {"placed": told["placed"] + more, "left": told["left"] - more}
    taken = met.select(F.explode("ids").alias("id"), "bin")
    rest = met.filter("rest > 0").select(F.col("bin").alias("id"), F.col("rest").alias("size"), F.lit(True).alias("gap"))
    unmet = keyed.filter("key IS NULL").select("id", "size", is_gap.alias("gap"))
    return places.unionByName(taken), unmet.unionByName(changed).unionByName(rest), told


#: Numbers of sequences that are opened empty start below this, those that a piece opens above.
OPENED = 1 << 62


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """item, sequence_id of a stored table items(item, length): whole items in sequences of at most capacity; lengths are 1 to capacity.

    item must be unique and from 0 to 2^62.  An item that fills a sequence has its own number as sequence_id; other sequences have negative ones.
    """
    spark = items.sparkSession
    rows = items.select(F.col("item").alias("id"), F.col("length").alias("size"))
    # Two pieces beyond half a sequence never share one.
    large = rows.filter(F.col("size") > capacity // 2).withColumn("bin", F.when(F.col("size") == capacity, F.col("id")).otherwise(-1 - F.col("id")))
    gaps = large.filter(F.col("size") < capacity).select(F.col("bin").alias("id"), (F.lit(capacity) - F.col("size")).alias("size"), F.lit(True).alias("gap"))
    small = F.col("length") <= capacity // 2
    counts = items.agg(F.count_if(small).alias("left"), F.count_if(~small & (F.col("length") < capacity)).alias("gaps")).first()
    found, opened, left, n_gaps = [large.select("id", "bin")], 0, counts.left, counts.gaps
    rows = rows.filter(F.col("size") <= capacity // 2).withColumn("gap", F.lit(False)).unionByName(gaps)
    place = left  # nothing to open before the first round, if there are gaps
    while left:
        if not n_gaps or place <= FEW * left:
            pieces_left = rows.filter("NOT gap").select("id", "size")
            if left <= part_rows:
                found.append(shared.store(pieces_left.coalesce(1).mapInArrow(_finish(capacity, OPENED + opened), "id long, bin long"), "last"))
                break
            new = -(-pieces_left.agg(F.sum("size")).first()[0] // capacity)
            rows = rows.unionByName(spark.range(-OPENED - opened - new, -OPENED - opened).select("id", F.lit(capacity).cast("long").alias("size"), F.lit(True).alias("gap")))
            opened, n_gaps = opened + new, n_gaps + new
        places, rows, told = _round(rows, left + n_gaps, part_rows)
        found.append(places)
        place, n_gaps, left = told["placed"], told["gaps"], told["left"]
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias("item"), F.col("bin").alias("sequence_id"))


def packed(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset of the pieces of every row of documents(doc_id, text, ...).

    Null and empty texts are a piece of the end id alone.  Texts are whole, whatever their length.  Repeated rows and rows that share a doc_id, null too, are
    packed each for itself; other columns, whatever their names, are left out.  An empty table gives an empty result.
    """
    cut = pieces(documents, path, capacity, end, with_ids)
    places = pack(cut.select("item", "length"), capacity, part_rows)
    # At most capacity rows share a sequence.
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(places, "item").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit integers) of the whole sequences of packed(with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
