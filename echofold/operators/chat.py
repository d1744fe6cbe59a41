"""Time-stamped chat: windows, spikes, sessions, display times.

Tables have ts (seconds, double) and, for ties, row (the input order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def relevant(chat: DataFrame, kinds: list[str]) -> DataFrame:
    """Messages of some kinds with a time and a text that isn't blank."""
    return chat.filter(F.col("kind").isin(kinds) & F.col("ts").isNotNull() & T.has_text(F.col("text")))


def totals(chat: DataFrame) -> DataFrame:
    """One row: messages, texts (of kind text), chatters (authors with a name) and last (the time of the last message, 0 without any).  A kind that is null or
    empty counts as text."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("text"))
    named = F.when(F.length(F.col("author").cast("string")) > 0, F.col("author"))
    return chat.agg(F.count("*").alias("messages"), F.count_if(kind == "text").alias("texts"), F.count_distinct(named).alias("chatters"), F.coalesce(F.max("ts"), F.lit(0.0)).alias("last"))


def listed(keys: str | list[str] | tuple[str, ...]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def density(chat: DataFrame, width: float = 120.0, keys: str | list[str] = ()) -> DataFrame:
    """keys, bucket, n: messages in each bucket of time that has any.  keys: what tells videos apart, here and below; without them all is one."""
    return chat.groupBy(*listed(keys), F.floor(F.col("ts") / width).alias("bucket")).agg(F.count("*").alias("n"))


def windows_of(ts, width: float, step: float):
    """Numbers of the sliding windows [k * step, k * step + width) that hold ts; both count from the first message."""
    last = F.floor(ts / step)
    return F.sequence(F.greatest(F.lit(0), F.floor((ts - width) / step) + 1), last)


def from_start(chat: DataFrame, keys: list[str]) -> DataFrame:
    """chat with _d: seconds since the first message of its video."""
    start = chat.groupBy(*keys).agg(F.min("ts").alias("_t0"))  # one row, or one for each video
    rows = chat.join(start, keys) if keys else chat.crossJoin(F.broadcast(start))
    return rows.withColumn("_d", F.col("ts") - F.col("_t0")).drop("_t0")


def spike_candidates(chat: DataFrame, width: float = 60.0, step: float = 10.0, least: int = 3, keys: str | list[str] = ()) -> DataFrame:
    """keys, k, n, weight of every sliding window with enough messages, counted from the first message of each video.  One hash aggregate over messages x
    width / step; a video's start is one row."""
    keys = listed(keys)
    rows = from_start(chat.select(*keys, "ts", "weight"), keys)
    return rows.select(*keys, F.explode(windows_of(F.col("_d"), width, step)).alias("k"), "weight").groupBy(*keys, "k").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).filter(F.col("n") >= least)


def window_messages(chat: DataFrame, width: float, step: float, least: int = 3, n: int = 5, keys: str | list[str] = ()) -> DataFrame:
    """keys, k, rank, row: the heaviest messages of each window that has enough; the others never reach a window's task."""
    keys = listed(keys)
    rows = from_start(chat.select(*keys, "row", "ts", "weight"), keys).select(*keys, F.explode(windows_of(F.col("_d"), width, step)).alias("k"), "row", "ts", "weight")
    full = rows.groupBy(*keys, "k").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "k").orderBy(F.desc("weight"), "ts", "row"))).filter(F.col("rank") <= n)
    return ranked.join(full, [*keys, "k"], "left_semi").select(*keys, "k", "rank", "row")


def select_spikes(candidates: DataFrame, width: float, step: float, n: int = 20, keys: str | list[str] = ()) -> DataFrame:
    """keys, k, n, weight, rank: greedily by weight in each video, skipping windows whose middles are closer than half a width to one that is kept.

    A kept window rules out at most width / step on either side, so the n best survive among the first n * (2 * width / step + 1) candidates of a video; only
    those are folded, whatever the size of the table.
    """
    keys = listed(keys)
    need = n * (2 * int(width / step) + 1)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("weight"), "k")
        first = candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= need).drop("_r")
    else:
        first = candidates.orderBy(F.desc("weight"), "k").limit(need)
    rows = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "k", "n", "weight"))).alias("c"))
    far = lambda x, kept: F.forall(kept, lambda y: F.abs(x["k"] - y["k"]) * step >= width / 2)
    kind = "array<struct<o:{0},k:bigint,n:bigint,weight:{0}>>".format(candidates.schema["weight"].dataType.simpleString())
    fold = F.aggregate("c", F.array().cast(kind), lambda kept, x: F.when((F.size(kept) < n) & far(x, kept), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select(*keys, F.posexplode(fold).alias("i", "s")).select(*keys, "s.k", "s.n", "s.weight", (F.col("i") + 1).alias("rank"))


def spans_of(selected: DataFrame, width: float, step: float, keys: str | list[str] = ()) -> DataFrame:
    """keys, id (the rank), ws, we, anchor of select_spikes, in seconds from the first message of each video."""
    s = selected.select(*listed(keys), F.col("rank").alias("id"), (F.col("k") * step).alias("ws"))
    return s.select(*listed(keys), "id", "ws", (F.col("ws") + width).alias("we"), (F.col("ws") + width / 2).alias("anchor"))


def level_of(low: Column, high: Column) -> Column:
    """The power of two that a closed span is no longer than: cut into cells of that length, it touches two at most."""
    return F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**-20)))), F.lit(-20)).cast("int")


def cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def interval_join(points: DataFrame, spans: DataFrame, size: float | None = None, low: str = "low", high: str = "high", ts: str = "ts", keys: str | list[str] = ()) -> DataFrame:
    """Points within closed spans of the same keys: an equi-join on cells of time, so neither side need be small.

    Where all spans are about `size` long, cells are.  Without a size, spans may be of any lengths in one table: a span stands in the two cells at most that it
    touches at its own level, however long it is, and a point is looked up once for each level that any span has.
    """
    keys = listed(keys)
    if size is not None:
        at = lambda c: F.floor(F.col(c) / size)
        there = spans.withColumn("_b", F.explode(F.sequence(at(low), at(high))))
        return points.withColumn("_b", at(ts)).join(there, [*keys, "_b"]).filter(F.col(ts).between(F.col(low), F.col(high))).drop("_b")
    leveled = spans.filter(F.col(low) <= F.col(high)).withColumn("_l", level_of(F.col(low), F.col(high)))
    levels = leveled.agg(F.collect_set("_l").alias("_ls"))  # one row, an array of a few dozen numbers at most
    there = leveled.withColumn("_b", F.explode(F.sequence(cell(F.col(low), F.col("_l")), cell(F.col(high), F.col("_l")))))
    asked = points.crossJoin(F.broadcast(levels)).withColumn("_l", F.explode("_ls")).drop("_ls").withColumn("_b", cell(F.col(ts), F.col("_l")))
    return asked.join(there, [*keys, "_l", "_b"]).filter(F.col(ts).between(F.col(low), F.col(high))).drop("_l", "_b")


def window_rollup(spikes: DataFrame, chat: DataFrame, size: float, keys: str | list[str] = ()) -> DataFrame:
    """Messages shortly before, around and in each spike, from one join on its widest window.  spikes: keys, id, ws, we, anchor."""
    wide = spikes.withColumn("low", F.col("ws") - 30).withColumn("high", F.greatest("we", F.col("anchor") + 5))
    rows = interval_join(chat, wide, size, keys=keys)
    return rows.groupBy(*listed(keys), "id").agg(
        F.count_if(F.col("ts").between(F.col("ws"), F.col("we"))).alias("peak"),
        F.count_if((F.col("ts") >= F.col("ws") - 30) & (F.col("ts") < F.col("ws"))).alias("buildup"),
        F.count_if(F.col("ts").between(F.col("anchor") - 10, F.col("anchor") + 5)).alias("tight"),
    )


#: Rows of a key from which its sessions are found slice by slice.
HOT_ROWS = 1_000_000


def any_hot(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether a key has more rows than one task should order: a count for each key, of which none or a few stay."""
    return not rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).limit(1).isEmpty()


def sessions(rows: DataFrame, key: str | list[str], gap: float = 60.0, slice_s: float = 3600.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Chains of a key's rows whose neighbours are at most `gap` apart: adds session (from 0) and _at (the place in the session, from 0).

    One window over each key's rows while no key is hot; else see sliced_sessions.
    """
    keys = listed(key)
    if hot_rows < 1 << 62 and any_hot(rows, keys, hot_rows):
        return sliced_sessions(rows, keys, gap, slice_s)
    w = Window.partitionBy(*keys).orderBy("ts", "row")
    new = F.when(F.col("ts") - F.lag("ts").over(w) > gap, 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "session").orderBy("ts", "row")) - 1)


def sliced_sessions(rows: DataFrame, key: str | list[str], gap: float = 60.0, slice_s: float = 3600.0) -> DataFrame:
    """The same, a key's rows ordered slice by slice of time, so that one that has a third of all rows is many groups; what a slice adds to the numbers of
    sessions and to places is carried over from a row for each slice."""
    keys = listed(key)
    rows = rows.withColumn("_slice", F.floor(F.col("ts") / slice_s))
    own = Window.partitionBy(*keys, "_slice").orderBy("ts", "row")
    # In a slice: _part counts the chains that begin behind its first row.
    begins = F.when(F.col("ts") - F.lag("ts").over(own) > gap, 1).otherwise(0)
    rows = rows.withColumn("_new", begins).withColumn("_part", F.sum("_new").over(own)).drop("_new")
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_slice", "_part").orderBy("ts", "row")) - 1)
    chain = rows.groupBy(*keys, "_slice", "_part").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count("*").alias("_n"))
    # A row for each slice: its first chain goes on with the last one of the slice before if that ends near enough.
    slices = chain.groupBy(*keys, "_slice").agg(F.count("*").alias("_chains"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_slice")
    slices = slices.withColumn("_joins", F.coalesce((F.col("_first") - F.lag("_last").over(w) <= gap).cast("long"), F.lit(0)))
    start = F.coalesce(F.sum("_chains").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_joins").over(w)
    chain = chain.join(slices.select(*keys, "_slice", "_chains", start.alias("_start")), [*keys, "_slice"]).withColumn("session", F.col("_start") + F.col("_part"))
    # Only the first and last chain of a slice may share a session with another slice's.
    edge = (F.col("_part") == 0) | (F.col("_part") == F.col("_chains") - 1)
    before = Window.partitionBy(*keys, "session").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = chain.filter(edge).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    chain = edges.unionByName(chain.filter(~edge).withColumn("_before", F.lit(0).cast("long")))
    placed = rows.join(chain.select(*keys, "_slice", "_part", "session", "_before"), [*keys, "_slice", "_part"])
    return placed.withColumn("_at", F.col("_i") + F.col("_before")).drop("_slice", "_part", "_i", "_before")


def session_clusters(rows: DataFrame, key: str | list[str], gap: float = 60.0, slice_s: float = 3600.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """key, session, n, first, last, anchor: the anchor is the element at n div 2."""
    keys, rows = listed(key), rows.select(*listed(key), "ts", "row")
    sums = [F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")]
    if any_hot(rows, keys, hot_rows):
        rows = sliced_sessions(rows, keys, gap, max(slice_s, 10 * gap))
        out = rows.groupBy(*keys, "session").agg(*sums)
        middle = rows.join(out.select(*keys, "session", F.floor(F.col("n") / 2).alias("_at")), [*keys, "session", "_at"]).select(*keys, "session", F.col("ts").alias("anchor"))
        return out.join(middle, [*keys, "session"]).select(*keys, "session", "n", "first", "last", "anchor")
    rows = sessions(rows, keys, gap, hot_rows=1 << 62).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "session")))
    anchor = F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2), F.col("ts"))).alias("anchor")
    return rows.groupBy(*keys, "session").agg(*sums, anchor)


def attributed(clusters: DataFrame, chat: DataFrame, key: str, size: float, before: float = 10.0, after: float = 30.0) -> DataFrame:
    """Messages around each cluster's anchor, each once for a key."""
    spans = clusters.select(key, F.greatest(F.lit(0.0), F.col("anchor") - before).alias("low"), (F.col("anchor") + after).alias("high"))
    return interval_join(chat, spans, size).dropDuplicates([key, "ts", "author", "text"])


def late_flags(rows: DataFrame, key: str | list[str]) -> DataFrame:
    """late: after three quarters of the time of the key's last row, which is found by an aggregate."""
    last = rows.groupBy(*listed(key)).agg(F.max("ts").alias("_last"))
    return rows.join(last, listed(key)).withColumn("late", F.col("ts") > 0.75 * F.col("_last")).drop("_last")


def display_offsets(rows: DataFrame, key: str, start: str, interval: float, duration: float) -> DataFrame:
    """When each message of a clip appears: evenly if there are too many, else no sooner than an interval after the one before."""
    w = Window.partitionBy(key).orderBy("ts", "row")
    i = F.row_number().over(w) - 1
    n = F.count("*").over(Window.partitionBy(key))
    base = F.col("ts") - F.col(start)
    chained = F.max(base - i * interval).over(w.rowsBetween(Window.unboundedPreceding, 0)) + i * interval
    even = i * (duration / n)
    return rows.withColumn("at", F.when(n * interval > duration, even).otherwise(F.least(chained, F.lit(duration - 0.1))))


def visible_phases(rows: DataFrame, key: str, phases: int, most: int = 8) -> DataFrame:
    """key, phase, shown: the last `most` rows of the first ceil((phase + 1) / phases * n).  Only rows that are shown are gathered."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_at", F.row_number().over(w.orderBy("ts", "row"))).withColumn("_n", F.count("*").over(w))
    out = placed.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    last = -F.floor(-(F.col("phase") + 1) * F.col("_n") / phases)
    out = out.filter((F.col("_at") <= last) & (F.col("_at") > last - most))
    return out.groupBy(key, "phase").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "row"))), lambda x: x["row"]).alias("shown"))


def informative(rows: DataFrame) -> DataFrame:
    """Messages that say something: see text.is_noise."""
    return rows.filter(T.has_text(F.col("text")) & ~T.is_noise(F.col("text")))


def recent_distinct(rows: DataFrame, key: str, last: int = 60, n: int = 5) -> DataFrame:
    """Of the last rows of each key: the newest of each text, at most n, in order."""
    w = Window.partitionBy(key)
    recent = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("row")))).filter(F.col("_r") <= last)
    newest = recent.groupBy(key, "text").agg(F.max("row").alias("row"))
    return newest.withColumn("_r", F.row_number().over(w.orderBy(F.desc("row")))).filter(F.col("_r") <= n).drop("_r")


def first_distinct(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n different texts of each key."""
    first = rows.groupBy(key, "text").agg(F.min("row").alias("row"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("row"))).filter(F.col("rank") <= n)


def in_time_order(rows: DataFrame) -> DataFrame:
    """By time, rows without one last, ties by input order."""
    return rows.orderBy(F.asc_nulls_last("ts"), "row")


def running_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, many, upto, total: how often each value occurs, and how many rows have it or a smaller one."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("many"))
    w = Window.partitionBy(key)
    return counts.withColumn("upto", F.sum("many").over(w.orderBy(value))).withColumn("total", F.sum("many").over(w))


def upper_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, upper_median: the element at n div 2 of the sorted values, no mean of two; from counts, so no group is gathered."""
    reached = running_counts(rows, key, value).filter(F.col("upto") > F.floor(F.col("total") / 2))
    return reached.groupBy(key).agg(F.min(value).alias("upper_median"))


def compared(rows: DataFrame, value: str) -> DataFrame:
    """rows with low (at or below the upper median) and above_mean."""
    one = rows.select(F.lit(1).alias("_g"), value)
    stats = upper_medians(one, "_g", value).join(one.groupBy("_g").agg(F.avg(value).alias("_mean")), "_g")
    return rows.crossJoin(F.broadcast(stats)).select(*rows.columns, (F.col(value) <= F.col("upper_median")).alias("low"), (F.col(value) > F.col("_mean")).alias("above_mean"))  # one row
