"""Writers.  Arrays become pipe-joined strings in flat files and stay arrays in JSON."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import stages
from ..functions import text as T
from . import files
from .onefile import write_lines


def flat(df: DataFrame) -> DataFrame:
    """df with string arrays joined by pipes and without other nested columns."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, ArrayType):
            if isinstance(f.dataType.elementType, StringType):
                out.append(F.array_join(f.name, "|").alias(f.name))
        elif f.dataType.typeName() not in ("struct", "map"):
            out.append(F.col(f.name))
    return df.select(*out)


#: Marks a file as UTF-8 for programs that ask for it.
BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """A folder of CSV parts, each with its header; with bom, the header of each part begins with the mark."""
    rows = flat(df)
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_line(columns: list[str]) -> str:
    """A header as CSV."""
    import csv
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns)
    return out.getvalue()


def write_csv_file(df: DataFrame, path: str, bom: bool = False) -> dict[str, int]:
    """One CSV file in the table's order, quoted where needed, with its header once and the mark before it; without rows the header alone.  Gives counts."""
    rows = flat(df)
    head = (BOM if bom else "") + csv_line(rows.columns)
    options = {"escape": '"', "quote": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return write_lines(rows.select(F.to_csv(F.struct(*rows.columns), options).alias("value")), path, header=head, empty=head)


def write_json_file(df: DataFrame, path: str) -> dict[str, int]:
    """One JSON array in the table's order, an object a line; nulls stay.  Gives counts."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    return write_lines(rows, path, header="[\n", separator=",\n", footer="\n]\n", empty="[]\n")


# The columns of normalized chat, in order, and what they say of their source.
CHAT_COLUMNS = [
    "timestamp_seconds",
    "timestamp_text",
    "author",
    "text",
    "message_type",
    "likes",
    "superchat_amount",
    "message_id",
    "author_channel_id",
    "timestamp_usecs",
    "video_id",
    "video_url",
    "source",
    "source_type",
]
CHAT_SOURCE, CHAT_SOURCE_TYPE = "live_chat_replay", "live_chat"


def normalized_chat(events: DataFrame, video: str, url: str = "") -> DataFrame:
    """CHAT_COLUMNS of the events of a replay (see files.observed_replay), by time, events without one last, ties in the order of the lines."""
    own = {
        "timestamp_seconds": F.col("ts"), "timestamp_text": F.coalesce(T.clock(F.col("ts")), F.lit("")), "message_type": F.col("kind"), "likes": F.lit(0), "superchat_amount": F.col("amount"), "author_channel_id": F.col("channel"),
        "timestamp_usecs": F.col("usecs"), "video_id": F.lit(video), "video_url": F.lit(url), "source": F.lit(CHAT_SOURCE), "source_type": F.lit(CHAT_SOURCE_TYPE),
    }
    return events.orderBy(F.asc_nulls_last("ts"), "row").select(*(own.get(c, F.col(c)).alias(c) for c in CHAT_COLUMNS))


def raw_chat(events: DataFrame) -> DataFrame:
    """The events as the replay has them, in the order of the lines."""
    return events.orderBy("row").select(
        F.col("renderer").alias("renderer_type"), F.col("kind").alias("message_type"), "message_id", F.col("offset_ms").alias("video_offset_ms"), F.col("usecs").alias("timestamp_usecs"), F.col("author").alias("author_name"),
        F.col("channel").alias("author_channel_id"), F.col("text").alias("message_text"), F.col("amount").alias("superchat_amount"),
    )


def extraction_log(result: dict[str, str], lines: dict[str, int] | None, kinds: dict[str, int], records: int) -> str:
    """What came of an extraction, as text: what is known of it, line by line, then the counts."""
    out = ["live chat extraction", "=" * 60, "", *(f"{k + ':':<17}{v}" for k, v in result.items())]
    if lines is not None:
        out += ["", "parse statistics:", f"  lines_read:       {lines['lines']}", f"  lines_skipped:    {lines['blank'] + lines['other']}", f"  lines_error:      {lines['bad']}", f"  events_extracted: {sum(kinds.values())}", f"  events_by_type:   {kinds}"]
    return "\n".join([*out, "", f"normalized records: {records}"]) + "\n"


def write_chat(lines: DataFrame, folder: str, result: dict[str, str], video: str, url: str = "", kept: stages.Stages | None = None) -> dict[str, str]:
    """The four files of an extracted chat: raw and normalized JSON, normalized CSV, and the log; without events the log alone.

    lines(value) of a replay are read once: the events are a stage table, the statistics of the lines are observed as it is written, and the log's
    number of records is what the commit of the CSV counted.  Gives what was written where.
    """
    events, seen = files.observed_replay(lines)
    events = (kept or stages.of(lines.sparkSession)).keep(events, "replay")
    kinds = {r.kind: r.n for r in files.renderer_counts(events).orderBy("kind").collect()}
    written, records = {}, 0
    if kinds:
        rows = normalized_chat(events, video, url)
        written = {name: f"{folder}/{file}" for name, file in (("raw_json", "live_chat_raw.json"), ("normalized_csv", "live_chat_normalized.csv"), ("normalized_json", "live_chat_normalized.json"))}
        write_json_file(raw_chat(events), written["raw_json"])
        records = write_csv_file(rows, written["normalized_csv"])["lines"]
        write_json_file(rows, written["normalized_json"])
    written["log"] = f"{folder}/live_chat_extract.log"
    write_file(lines.sparkSession, extraction_log({**result, "video_id": video, "video_url": url}, seen.get, kinds, records), written["log"])
    return written


def write_file(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file."""
    write_lines(spark.createDataFrame([(text,)], "value string"), path, footer="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 20) -> str:
    """A report of small tables; each is cut to `most` rows, in its own order, for reading."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        parts += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |" for row in df.limit(most).collect()]
    return "\n".join(parts) + "\n"


def table(columns: list[str], rows: list[tuple]) -> list[str]:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def analysis_report(video: str, stats: DataFrame, keywords: DataFrame, entities: DataFrame, labels: DataFrame, liked: DataFrame, themes: DataFrame, advice: DataFrame, angles: DataFrame, generated: str = "") -> str:
    """The analysis of comments as Markdown.  Every table is short by its operator; they are read in their own order."""
    s = stats.first()
    total = max(s.total_all, 1)
    parts = ["# Comment analysis", "", f"**Video:** `{video}`  ", f"**Generated:** {generated}", "", "## Statistics", ""]
    shown = [("Top-level comments", f"{s.total_top_level:,}"), ("Replies", f"{s.total_replies:,}"), ("All", f"{s.total_all:,}"), ("Authors", f"{s.unique_authors:,}"), ("Mean length", f"{s.avg_length:.1f}"), ("Median length", f"{s.median_length:.1f}"), ("Mean likes", f"{s.avg_likes:.2f}"), ("Likes", f"{s.total_likes:,}"), ("Most likes", f"{s.max_likes:,}")]
    parts += table(["Metric", "Value"], shown)
    found = keywords.collect()
    for name, kind, n in (("Words", "unigram", 20), ("Pairs", "bigram", 15)):
        parts += ["", f"## {name}", "", *table(["Phrase", "Count"], [(r.phrase, r.n) for r in found if r.type == kind][:n])]
    if names := [r.word for r in entities.limit(20).collect()]:
        parts += ["", "## Names", "", ", ".join(f"`{n}`" for n in names)]
    parts += ["", "## Reactions", "", *table(["Label", "Comments", "Share"], [(r.label.replace("_", " ").title(), r.n, f"{r.n / total * 100:.1f}%") for r in labels.collect()])]
    parts += ["", "## Most liked", ""]
    for i, r in enumerate(liked.limit(10).collect(), 1):
        text = r.text if len(r.text) <= 200 else r.text[:200].rstrip() + "…"
        parts += [f"**{i}. [{r.like_count} likes]** *{r.author}*", "", "> " + text.replace("\n", " "), ""]
    if words := [r.phrase for r in themes.collect()]:
        parts += ["## Themes of the most liked", "", *(f"- `{w}`" for w in words), ""]
    parts += ["## Recommendations", "", *(x for i, r in enumerate(advice.orderBy("place").collect(), 1) for x in (f"**{i}.** " + textwrap.fill(r.text, 90), ""))]
    parts += ["## Angles", "", *(f"- {r.text}" for r in angles.orderBy("place").collect())]
    return "\n".join(parts) + "\n"


def bars(df: DataFrame, label: str, value: str, most: int = 10, width: int = 30) -> str:
    """Lines for a terminal: rank, label, value and a bar, in the table's own order."""
    return "\n".join(f"{i:>3}. {str(r[label]):<18} {r[value]:>6}  {'█' * min(int(r[value]), width)}" for i, r in enumerate(df.limit(most).collect(), 1))


def summary(package: dict[str, DataFrame]) -> str:
    """A package in a few lines for a terminal."""
    m = package["meta"].first()
    records = package["highlight_comments"]
    lines = ["=" * 60, f"comments {m.comments}, messages {m.messages}, segments {m.segments}, spikes {m.spikes}, shorts by {'spikes' if m.spike_mode else 'concepts'}", ""]
    lines.append(bars(records.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"), "category", "n", 9, 20))
    lines += ["", *(f"{i}. [{r.likes} likes] [{r.category}] {r.priority:.1f}  " + r.text[:55].replace("\n", " ") for i, r in enumerate(records.limit(5).collect(), 1))]
    lines += ["", *(f"- {r.title[:50]}  ~{r.seconds} s" for r in package["shorts_sequences"].collect())]
    return "\n".join(lines) + "\n"


def brief(package: dict[str, DataFrame]) -> str:
    """The shorts of a package as Markdown."""
    parts = ["# Shorts", ""]
    for r in package["shorts_sequences"].collect():
        parts += [f"## {r.title}", "", r.description, "", f"> {r.hook.text}", "", f"{r.seconds} s · {r.call}", ""]
    return "\n".join(parts)


def write_package(package: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Every table of a package as JSON, and those with flat columns as CSV besides; empty tables leave empty folders.  Gives what was written where."""
    written = {}
    for name, df in package.items():
        write_json(df, f"{folder}/{name}.json")
        written[name] = f"{folder}/{name}.json"
        if name in ("highlight_comments", "highlight_moments", "spike_moments"):
            write_csv(df, f"{folder}/{name}.csv")
            written[f"{name}_csv"] = f"{folder}/{name}.csv"
    spark = package["meta"].sparkSession
    for name, text in (("shorts_script.md", brief(package)), ("summary.txt", summary(package))):
        write_text(spark.createDataFrame([(text,)], "value string"), "value", f"{folder}/{name}")
        written[name] = f"{folder}/{name}"
    return written


def guide(segments: DataFrame, title: str) -> DataFrame:
    """line, in order: the segments of a video as a Markdown list with their times."""
    line = F.concat(F.lit("- **"), T.minutes_clock(F.col("start")), F.lit("–"), T.minutes_clock(F.col("end")), F.lit("** "), F.col("text"))
    head = segments.sparkSession.createDataFrame([(-2, f"# {title}"), (-1, "")], "seq int, line string")
    return head.unionByName(segments.select(F.col("seq").cast("int").alias("seq"), line.alias("line"))).orderBy("seq").select("line")
