import json

from echofold.operators import subtitles
from echofold.sources import files, sinks


def test_comments(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿comment_id,author,text,like_count,is_reply\n1,a,"two\nlines, ""q""",x,Yes\n2,b,  ,3,no\n3,,plain,7,\n', encoding="utf-8")
    got = files.read_comments(spark, str(tmp_path / "c.csv")).orderBy("comment_id").collect()
    assert [(r.comment_id, r.text, r.like_count, r.is_reply) for r in got] == [("1", 'two\nlines, "q"', 0, True), ("3", "plain", 7, False)]
    assert files.read_comments(spark, str(tmp_path / "none.csv")).collect() == []


def test_chat(spark, tmp_path):
    (tmp_path / "l.csv").write_text("time_seconds,message,author\n5,hi,a\nx,lost,b\n-1,lost,c\n7.5, ,d\n8,yes,\n", encoding="utf-8")
    got = files.read_chat(spark, str(tmp_path / "l.csv")).orderBy("row").collect()
    assert [(r.comment_id, r.ts, r.text, r.author) for r in got] == [("lc_0", 5.0, "hi", "a"), ("lc_1", 8.0, "yes", "unknown")]
    assert files.read_chat(spark, str(tmp_path / "l.csv"), missing_time_as_zero=True).count() == 3


def test_segments(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"start": 1, "end": 2.5, "text": "a", "words": [{"word": "w", "time": 1.5}]}, {"id": "own"}]), encoding="utf-8")
    got = files.read_segments(spark, str(tmp_path / "s.json")).orderBy("seq").collect()
    assert [(r.id, r.start, r.end, r.text) for r in got] == [("seg_0001", 1.0, 2.5, "a"), ("own", 0.0, 0.0, "")]
    assert got[0].words[0].word == "w"


def event(renderer, ms="1500", **body):
    return json.dumps({"replayChatItemAction": {"videoOffsetTimeMsec": ms, "actions": [{"addChatItemAction": {"item": {renderer: body}}}]}})


def test_replay(spark, tmp_path):
    text = {"runs": [{"text": "go "}, {"emoji": {"shortcuts": [":x:"]}}, {"emoji": {"emojiId": "E1"}}, {"emoji": {}}]}
    lines = [
        event("liveChatTextMessageRenderer", id="1", message=text, authorName={"simpleText": "kim"}),
        event("liveChatPaidMessageRenderer", id="2", message={"runs": [{"text": "$"}]}, purchaseAmountText={"simpleText": "₩1,000"}),
        event("liveChatMembershipItemRenderer", id="3", headerSubtext={"runs": [{"text": "welcome"}]}),
        event("liveChatViewerEngagementMessageRenderer", id="4"),
        "",
        "{not json",
        json.dumps({"other": 1}),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = files.read_replay(spark, str(tmp_path / "r.jsonl")).orderBy("message_id").collect()
    assert [(r.message_id, r.kind, r.ts, r.text, r.amount) for r in got] == [("1", "text", 1.5, "go :x:[E1][emoji]", ""), ("2", "superchat", 1.5, "$", "₩1,000"), ("3", "membership", 1.5, "welcome", "")]
    s = files.replay_statistics(spark, str(tmp_path / "r.jsonl")).first()
    assert (s.bad, s.other) == (1, 1)


VTT = """WEBVTT

00:00:01.000 --> 00:00:03.000
old line
hello<00:00:01.500><c> big</c><00:00:02.000><c> world</c>

00:00:03.000 --> 00:00:03.010
flash

2
00:00:04.000 --> 00:00:06.500 align:start
it &amp; that
"""


def test_captions(spark, tmp_path):
    (tmp_path / "v.vtt").write_text(VTT.replace("\n", "\r\n"), encoding="utf-8", newline="")
    cues = files.read_captions(spark, str(tmp_path / "v.vtt"))
    assert [(r.start, r.end, r.text) for r in cues.orderBy("seq").collect()] == [(1.0, 3.0, "hello big world"), (4.0, 6.5, "it & that")]
    words = files.caption_words(cues).orderBy("time").collect()
    assert [(r.time, r.word) for r in words] == [(1.0, "hello"), (1.5, "big"), (2.0, "world"), (4.0, "it &amp; that")]
    assert subtitles.srt(cues).orderBy("seq").first().block.startswith("1\n00:00:01,000 --> 00:00:03,000\nhello")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x|y")], "id int, tags array<string>, t string")
    sinks.write_csv(df, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().tags == "a|b"
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().tags == ["a", "b"]
    assert "x\\|y" in sinks.markdown("R", {"t": df})
