"""Caption cues to sentence segments.

The folds are sequential within a video and independent between videos.  A video's rows reach one task in order, in Arrow batches, and a fold carries a few
values from row to row, never the video: a cue or an open segment, whatever the number of cues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import stages

#: Seconds and characters of a segment, and the similarity of a repeated cue.
LONGEST, MOST_CHARS, SAME = 9.0, 140, 0.8
#: Rows that a fold hands on at once.
BATCH_ROWS = 8192


class Fold:
    """What is carried along a video: each row may settle some result rows, the end the rest."""

    def __init__(self, video: Any):
        self.video = video

    def add(self, row: dict[str, Any]) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def folded(rows: DataFrame, order: list[str], make: Callable[[Any], Fold], schema: StructType) -> DataFrame:
    """The result rows of a fold over each video's rows in order.  A null video is one of its own."""
    stages.prepare(rows.sparkSession)
    wanted = to_arrow_schema(schema)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), wanted, strict=True)], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, out = None, []
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if fold is None or fold.video != row["video"]:
                    out += fold.end() if fold else []
                    fold = make(row["video"])
                out += fold.add(row)
                if len(out) >= BATCH_ROWS:
                    yield batch_of(out)
                    out = []
        out += fold.end() if fold else []
        if out:
            yield batch_of(out)

    return rows.repartition("video").sortWithinPartitions("video", *order).mapInArrow(run, schema)


class Collapse(Fold):
    def __init__(self, video: Any, slack: float):
        super().__init__(video)
        self.slack, self.kept = slack, None

    def add(self, row: dict[str, Any]) -> list[tuple]:
        if self.kept and row["start"] < self.kept["end"] - self.slack:
            if len(row["text"]) > len(self.kept["text"]):
                self.kept = row
            return []
        settled, self.kept = self.end(), row
        return settled

    def end(self) -> list[tuple]:
        return [tuple(self.kept.values())] if self.kept else []


def collapse(cues: DataFrame, slack: float = 0.02) -> DataFrame:
    """Of cues that overlap the last one kept, the longer text stays.  video, seq, start, end, text."""
    rows = cues.select("video", "seq", "start", "end", "text")
    return folded(rows, ["seq"], lambda video: Collapse(video, slack), rows.schema)


def similarity(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


class Sentences(Fold):
    def __init__(self, video: Any, longest: float, most: int, same: float):
        super().__init__(video)
        self.longest, self.most, self.same = longest, most, same
        self.n, self.texts, self.chars, self.start, self.stop, self.before = 0, [], 0, 0.0, 0.0, None

    def add(self, row: dict[str, Any]) -> list[tuple]:
        text, settled = row["text"], []
        if self.before is not None and similarity(text, self.before) >= self.same:
            return []
        self.before = text
        if self.texts and (row["end"] - self.start > self.longest or self.chars + len(text) > self.most):
            settled = self.end()
        if not self.texts:
            self.start = row["start"]
        self.texts.append(text)
        self.chars += len(text) + 1
        self.stop = row["end"]
        if text.rstrip()[-1:] in {".", "?", "!"}:
            settled += self.end()
            self.before = None
        return settled

    def end(self) -> list[tuple]:
        if not self.texts:
            return []
        self.n += 1
        out = (self.video, f"seg_{self.n:04d}", self.n, round(self.start, 3), round(self.stop, 3), " ".join(self.texts))
        self.texts, self.chars = [], 0
        return [out]


def sentences(cues: DataFrame, longest: float = LONGEST, most: int = MOST_CHARS, same: float = SAME) -> DataFrame:
    """video, id, seq, start, end, text: cues joined until a sentence ends, or the next would make the segment too long."""
    rows = cues.select("video", "seq", "start", "end", "text")
    schema = StructType.fromDDL("video string, id string, seq int, start double, end double, text string")
    return folded(rows, ["seq"], lambda video: Sentences(video, longest, most, same), schema)


class Thin(Fold):
    def __init__(self, video: Any, least: float):
        super().__init__(video)
        self.least, self.last = least, -1.0

    def add(self, row: dict[str, Any]) -> list[tuple]:
        if row["time"] > self.last + self.least:
            self.last = row["time"]
            return [tuple(row.values())]
        return []


def thin_words(words: DataFrame, least: float = 0.001) -> DataFrame:
    """Words later than the last one kept by more than a millisecond; of those at one time the first in order."""
    rows = words.select("video", "time", "word")
    return folded(rows, ["time", "word"], lambda video: Thin(video, least), rows.schema)


def assign_words(segments: DataFrame, words: DataFrame, size: float = 10.0) -> DataFrame:
    """segments with words: those that begin in [start, end), by buckets of time."""
    at = lambda c: F.floor(F.col(c) / size)
    spans = segments.select("video", "id", "start", "end", F.explode(F.sequence(at("start"), at("end"))).alias("_b"))
    rows = spans.join(words.withColumn("_b", at("time")), ["video", "_b"]).filter((F.col("time") >= F.col("start")) & (F.col("time") < F.col("end")))
    own = rows.groupBy("video", "id").agg(F.sort_array(F.collect_list(F.struct("time", "word"))).alias("words"))
    return segments.join(own, ["video", "id"], "left")


def srt(cues: DataFrame) -> DataFrame:
    """video, seq, block: numbered subtitle blocks."""
    from pyspark.sql import Window

    from ..functions.text import srt_clock

    n = F.row_number().over(Window.partitionBy("video").orderBy("seq"))
    rows = cues.withColumn("n", n)
    return rows.select("video", "seq", F.concat_ws("\n", F.col("n").cast("string"), F.concat(srt_clock(F.col("start")), F.lit(" --> "), srt_clock(F.col("end"))), "text").alias("block"))
