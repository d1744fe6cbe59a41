import csv
import json
import os

from pyspark.sql import functions as F

from echofold import lexicons as L
from echofold import phrases as P
from echofold.operators import highlights as H
from echofold.operators import package as G
from echofold.sources import files, onefile, plan_files, sinks


def test_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "a" / "lines.txt")
    df = spark.range(0, 500, 1, 7).orderBy(F.desc("id")).select(F.concat(F.lit("é"), "id").alias("value"))
    assert onefile.write_lines(df, path, header="H\n")["lines"] == 500
    want = "H\n" + "\n".join(f"é{i}" for i in range(499, -1, -1)) + "\n"
    assert open(path, encoding="utf-8").read() == want and os.listdir(tmp_path / "a") == ["lines.txt"]
    # Several partitions, some of them empty, null values, and a file that is there already.
    parts = spark.range(0, 40, 1, 8).select(F.when(F.col("id") % 10 < 3, F.col("id").cast("string")).alias("value"))
    counts = onefile.write_lines(parts, path, separator="|", footer="")
    assert open(path).read() == "|".join(str(i) for i in range(40) if i % 10 < 3) and counts["lines"] == 12 and counts["parts"] > 1


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b array<string>")
    assert sinks.write_csv_file(empty, str(tmp_path / "e.csv"), bom=True)["lines"] == 0
    sinks.write_json_file(empty, str(tmp_path / "e.json"))
    assert open(tmp_path / "e.csv", encoding="utf-8").read() == "\ufeffa,b\n" and json.load(open(tmp_path / "e.json")) == []


ODD = ['a,"b"\nc', " lead", "trail ", "", None, "é\r\nx", "=1", "\\", "'", "plain"]


def test_csv_and_json_keep_every_text(spark, tmp_path):
    df = spark.createDataFrame([(i, t, [t or "x", "y"], i / 4) for i, t in enumerate(ODD)], "id int, text string, tags array<string>, share double").repartition(3).orderBy("id")
    sinks.write_csv_file(df, str(tmp_path / "t.csv"), bom=True)
    raw = open(tmp_path / "t.csv", encoding="utf-8", newline="").read()
    assert raw.startswith("\ufeff") and raw.count("\ufeff") == 1
    rows = list(csv.DictReader(open(tmp_path / "t.csv", encoding="utf-8-sig", newline="")))
    assert [r["text"] for r in rows] == [t or "" for t in ODD] and rows[0]["tags"] == 'a,"b"\nc|y' and rows[1]["share"] == "0.25"
    sinks.write_json_file(df, str(tmp_path / "t.json"))
    assert [(r["text"], r["tags"]) for r in json.load(open(tmp_path / "t.json", encoding="utf-8"))] == [(t, [t or "x", "y"]) for t in ODD]


def replay(n):
    item = lambda i: {"liveChatTextMessageRenderer": {"id": f"m{i}", "message": {"runs": [{"text": f"hello, {i}"}]}, "authorName": {"simpleText": f"a{i % 2}"}}}
    lines = [json.dumps({"replayChatItemAction": {"actions": [{"addChatItemAction": {"item": item(i)}}], **({"videoOffsetTimeMsec": str((n - i) * 1000)} if i % 3 else {})}}) for i in range(n)]
    return lines + ["", "  ", "{broken", '{"other": 1}']


def test_statistics_come_with_the_scan(spark):
    lines = spark.createDataFrame([(x,) for x in replay(20)], "value string").repartition(3)
    events, seen = files.observed_replay(lines)
    assert events.count() == 20 and len(events.columns) == 11
    events.write.format("noop").mode("overwrite").save()
    assert seen.get == files.line_statistics(lines).first().asDict() == {"lines": 24, "blank": 2, "bad": 1, "other": 1}


def test_chat_files(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in replay(9)], "value string")
    written = sinks.write_chat(lines, str(tmp_path / "c"), {"status": "success"}, "v", "u")
    rows = list(csv.DictReader(open(written["normalized_csv"], encoding="utf-8", newline="")))
    times = [r["timestamp_seconds"] for r in rows]
    assert list(rows[0]) == sinks.CHAT_COLUMNS and times == sorted(times[:6], key=float) + [""] * 3 and [r["message_id"] for r in rows[6:]] == ["m0", "m3", "m6"]
    assert [r["message_id"] for r in json.load(open(written["raw_json"]))] == [f"m{i}" for i in range(9)]
    assert json.load(open(written["normalized_json"]))[0]["source_type"] == "live_chat"
    log = open(written["log"]).read()
    assert "lines_read:       13" in log and "normalized records: 9" in log and "{'text': 9}" in log
    alone = sinks.write_chat(lines.filter("value = ''"), str(tmp_path / "d"), {"status": "no_live_chat"}, "v")
    assert list(alone) == ["log"] and "normalized records: 0" in open(alone["log"]).read()


RECORD = "comment_id long, text string, author string, likes long, category string, priority double, emotion long, players array<string>, caption string, segment string, low double, high double, confidence string, manual boolean, signals array<string>, source_type string"


def test_plan_files(spark, tmp_path):
    cats = ["dramatic", "funny", "analytical", "supportive"]
    rows = [(i, f"text {i} 역전" if i % 4 == 0 else f"text {i}", f"a{i}", i, cats[i % 4], 90.0 - 3 * i, 1, ["Kim"] if i % 2 else [], f"cap {i}", "seg_1" if i % 3 else None, 1.0, 2.0, "high", i % 3 == 0, ["event:ob"], "comment") for i in range(12)]
    df = spark.createDataFrame(rows, RECORD)
    plan = G.master_plan(df, ["Kim", "Lee"])
    written = plan_files.write_plan(plan, df, ["Kim", "Lee"], str(tmp_path / "p"), "v1", "T")
    doc = json.load(open(written["plan_json"], encoding="utf-8"))
    assert doc["meta"]["total_comments_used"] == 12 and [a["act_id"] for a in doc["acts"]] == list(L.ACTS) and sum(a["comment_count"] for a in doc["acts"]) == 12
    turning = doc["acts"][2]
    assert turning["anchor_comment"]["comment_id"] == 0 and turning["anchor_comment"]["role"] == "anchor" and turning["category_distribution"] == {"dramatic": 3}
    assert [r["player"] for r in doc["player_arcs"]] == ["Kim"] and doc["player_arcs"][0]["comment_count"] == 6 and doc["key_event_keywords"] == ["ob"]
    assert [p["comment_id"] for p in doc["turning_points"]] == [r.comment_id for r in H.turning_points(df).collect()] and len(doc["title_suggestions"]) == len(P.TITLES)
    text = open(written["plan_script"], encoding="utf-8").read()
    assert text.startswith(P.SCRIPT["title"]) and "### ⭐ 전환점" in text and "> text 0 역전" in text and text.count("### ") == 6


def test_plan_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], RECORD)
    written = plan_files.write_plan(G.master_plan(df, []), df, [], str(tmp_path / "n"))
    doc = json.load(open(written["plan_json"], encoding="utf-8"))
    assert doc["acts"] == doc["player_arcs"] == doc["turning_points"] == doc["title_suggestions"] == [] and doc["opening_hook"] is doc["closing_note"] is None
    assert doc["meta"]["note"] == P.PLAN_EMPTY and P.SCRIPT["acts"] not in open(written["plan_script"], encoding="utf-8").read()
