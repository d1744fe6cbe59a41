"""Stories, people and packages on small cases in their own language, with the real word lists."""

import json
import random

import pytest
from pyspark.sql import functions as F

from echofold import lexicons as L
from echofold import phrases as P
from echofold.functions import text as T
from echofold.operators import chat as K
from echofold.operators import comments as C
from echofold.operators import enrich as N
from echofold.operators import entities as E
from echofold.operators import highlights as H
from echofold.operators import package as G
from echofold.operators.terms import contained
from echofold.sources import files, sinks

ROSTER = ["공태현", "송한백", "최민욱", "유민욱", "김준형", "이준형", "하기원2"]
ALIASES = {"최민욱프로": "최민욱 프로", "하기원": "하기원 프로", "공프로": "공태현"}


def names(spark):
    return spark.createDataFrame([(n,) for n in ROSTER], "name string"), spark.createDataFrame(list(ALIASES.items()), "alias string, canonical string")


def test_names_by_level(spark):
    roster, aliases = names(spark)
    tokens = ["최민욱프로", "공태현", "공프로", "공태현선수", "한백형", "한백", "민욱프로", "유영희선수", "최민욱", "기원햄", "공태한선수", "하기원형님"]
    out = E.resolve(spark.createDataFrame([(t,) for t in tokens], "token string"), roster, aliases, least=0.85)
    got = {r.token: (r.name, r.level) for r in out.collect()}
    assert got["최민욱프로"] == ("최민욱 프로", 1) and got["공태현"] == ("공태현", 2) and got["공프로"] == ("공태현", 1) and got["공태현선수"] == ("공태현", 4)
    assert got["한백형"] == ("송한백", 5) and got["한백"] == ("송한백", 6) and got["민욱프로"] == (None, None) and got["유영희선수"] == (None, None)
    assert got["최민욱"] == ("최민욱 프로", 2) and got["기원햄"] == ("하기원2", 5) and got["공태한선수"] == (None, None) and got["하기원형님"] == ("하기원 프로", 3)
    # Without a roster, aliases alone.
    alone = {r.token: r.name for r in E.resolve(out.select("token"), roster.limit(0), aliases).collect()}
    assert alone["최민욱프로"] == "최민욱 프로" and alone["공태현"] is None and alone["하기원형님"] is None


def test_ambiguous_names_by_what_is_said(spark):
    roster, aliases = names(spark)
    tokens = spark.createDataFrame([(1, "민욱프로"), (2, "민욱프로"), (3, "한백형")], "id int, token string")
    texts = spark.createDataFrame([(1, "최민욱이고요 최민욱 선수가"), (2, "최민욱 유민욱"), (3, "송한백 송한백")], "id int, text string")
    known = spark.createDataFrame([(1, "최민욱 프로")], "id int, name string")
    out = E.disambiguate_in(tokens, E.candidates_of(tokens, roster, aliases), texts, known, "id")
    assert [(r.id, r.name) for r in out.collect()] == [(1, "최민욱 프로")]


def test_titled_names_and_noise(spark):
    row = spark.createDataFrame([("공태현선수 굿 송한백 프로님", "ㅋㅋㅋㅋㅋ", "나이스 샷")], "a string, b string, c string")
    r = row.select(T.titled(F.col("a")).alias("a"), T.titled(F.col("a"), T.TITLED_SPACED).alias("s"), T.is_noise(F.col("b")).alias("b"), T.is_noise(F.col("c")).alias("c"), T.wrapped(F.lit("a" * 60 + " b c")).alias("w")).first()
    assert r.a == ["공태현선수", "프로님"] and r.s == ["공태현선수", "송한백프로님"] and r.b and not r.c and r.w == ["", "a" * 60, "b c"]


def test_mentions_and_events(spark):
    said = [(1, 1, True, "공태현선수 이글 대박"), (1, 2, True, "우승 화이팅 공태현 선수"), (1, 3, False, "송한백 버디"), (2, 4, False, "한백형 버디 우승"), (2, 5, False, "버디"), (3, 6, True, "홀인원"), (4, 7, True, "홀인원 홀인원")]
    messages = spark.createDataFrame(said, "id long, row long, tight boolean, text string")
    named = N.named_in(messages, *names(spark), ["id", "row"])
    players, events = N.mentions_and_events(messages, named)
    assert sorted((r.id, r.name, r.n) for r in players.collect()) == [(1, "공태현", 2), (2, "송한백", 1)]
    # The wished-for win and single claims of rare events don't count; the wide window serves where the tight one is empty.
    assert sorted((r.id, r.event, r.n) for r in events.collect()) == [(1, "이글", 1), (2, "버디", 2), (4, "홀인원", 2)]


def test_spoken_events_that_are_not_now(spark):
    rows = [(1, "이글 나왔습니다 대단한 샷", ""), (2, "1라운드 이글 두 개 잡았잖아요", ""), (3, "우승 해야 된다", "그리고 이제 드디어 경기가 모두 끝나면서 이 선수가 마침내 결국 우승 확정입니다"), (4, "", "")]
    out = N.spoken_events(spark.createDataFrame(rows, "id long, pre_text string, concurrent_text string"))
    assert {r.id: r.events for r in out.collect()} == {1: ["이글", "샷"], 2: [], 3: ["우승"], 4: []}


def test_primary_person(spark):
    spoken = spark.createDataFrame([(1, "가", 0), (1, "나", 1), (2, "가", 0), (2, "나 프로", 1), (3, "가", 0), (3, "나", 1)], "id long, name string, place int")
    chat = spark.createDataFrame([(1, "나", 1), (4, "다", 2), (4, "라", 5)], "id long, name string, n long")
    peak = spark.createDataFrame([(2, "나 잘한다"), (1, "가 가 가")], "id long, text string")
    assert {r.id: r.name for r in N.primary(spoken, chat, peak).collect()} == {1: "나", 2: "나 프로", 3: "가", 4: "라"}


def test_narratives(spark):
    kind = "id long, pre_text string, concurrent_text string, evidence string, first string, second string, main string, event string, profile array<struct<kind:string,n:long>>, n long"
    rows = [(1, "멋진 샷이 나왔습니다", "", "pre_spike", "공태현", None, "공태현", "이글", [("감탄·대박", 7), ("웃음·재미", 2)], 30), (2, "", "", "none", "가", "나", "가", None, [("감탄·대박", 1)], 4), (3, "", "", "none", None, None, None, None, [], 2), (4, "", "그냥 이야기", "concurrent", None, None, None, None, [], 2)]
    got = {r.id: r for r in N.narrative(spark.createDataFrame(rows, kind)).collect()}
    assert got[1].cause == "[스파이크 직전 해설] 「멋진 샷이 나왔습니다」\n→ 채팅 기반 보완: 공태현의 이글" and got[1].short == "공태현의 이글 → 감탄·대박"
    assert got[1].reaction == "30개 메시지 / 반응 유형: 감탄·대박(7), 웃음·재미(2)"
    assert got[2].cause.startswith("가·나 관련 장면") and got[3].cause == P.CAUSE_NONE and got[3].short == "반응 구간"
    assert got[4].cause == "[스파이크 중 해설] 「그냥 이야기...」" and got[4].interpretation == P.READ_SPOKEN_ONLY and got[4].short == "그냥 이야기"


def test_buzz(spark):
    kind = "id long, event_n long, internal_n long, spoken boolean, player string, event string, chat_event boolean, mood string, kind string, person string"
    rows = [(1, 8, 2, True, "공태현", "이글", True, "strong", "감탄·대박", None), (2, 1, 9, False, None, None, False, None, None, "문서형"), (3, 5, 5, True, "가", None, False, None, None, "문서형"), (4, 0, 0, False, None, None, False, None, None, None)]
    got = {r.id: r for r in N.buzz_summary(spark.createDataFrame(rows, kind)).collect()}
    assert got[1].buzz == "broadcast_event" and got[1].headline == "공태현의 이글"
    assert got[1].narrative == "공태현이 인상적인 이글을 기록하며, 해설진은 강한 탄성과 흥분을 표했고, 시청자들도 감탄·대박으로 즉각 반응했습니다."
    assert got[2].buzz == "participant_driven" and got[3].buzz == "mixed" and got[4].buzz == "general" and got[4].headline == "채팅 밀집 구간"


def test_people_metrics_by_brute_force(spark):
    rnd = random.Random(6)
    words = ["대박", "역시", "ㅋㅋ", "ㅠㅠ", "진짜", "굿", "와아"]
    kinds = {"대박": "감탄·대박", "역시": "기대 충족", "ㅋㅋ": "웃음·재미", "ㅠㅠ": "안타까움·슬픔", "진짜": "강조·감탄"}
    rows = [(i, round(rnd.uniform(0, 900), 1), rnd.choice("ab"), " ".join(rnd.choices(words, k=3))) for i in range(120)]
    named = [(i, rnd.choice(["가", "나"])) for i in rnd.sample(range(120), 25)]
    out = N.people_metrics(spark.createDataFrame(rows, "row long, ts double, author string, text string"), spark.createDataFrame(named, "row long, name string"), 30.0)
    got = {r.name: (r.mentions, r.clusters, r.reactions, r.good, r.bad) for r in out.collect()}
    time = {i: ts for i, ts, *_ in rows}
    for name in ("가", "나"):
        clusters = []
        for ts in sorted(time[i] for i, n in named if n == name):
            if clusters and ts - clusters[-1][-1] <= 60:
                clusters[-1].append(ts)
            else:
                clusters.append([ts])
        around = {(ts, a, t) for c in clusters for _, ts, a, t in rows if max(0.0, c[len(c) // 2] - 10) <= ts <= c[len(c) // 2] + 30}
        found = [kinds[w] for _, _, t in around for w in t.split() if w in kinds]
        good, bad = sum(k in L.GOOD_REACTIONS for k in found), sum(k in L.BAD_REACTIONS for k in found)
        assert got[name] == (sum(n == name for _, n in named), len(clusters), len(found), good, bad)


def test_context_of_every_spike(spark):
    links = spark.createDataFrame([("김민", i, i + 1, 60.0 * i, None, f"말 {i}" if i % 2 else "", None) for i in range(6)], "name string, place int, rank int, anchor double, pre_text string, concurrent_text string, event string")
    lines = {r.rank: r.line for r in N.discovery_context(links).collect()}
    assert sorted(lines) == [1, 2, 3, 4, 5, 6] and all((f"말 {i}" in lines[i + 1]) == bool(i % 2) for i in range(6))
    named = spark.createDataFrame([("김민", 10.0 * i) for i in range(6)] + [("김민", 51.0), ("이글", 500.0)], "name string, ts double")
    spikes = spark.createDataFrame([(i + 1, 10.0 * i, 10.0 * i + 2) for i in range(6)], "rank int, ws double, we double")
    assert sorted((r.name, r["rank"]) for r in N.spikes_of(named, spikes, 60.0).collect()) == [("김민", i) for i in range(1, 7)]
    assert [r.ranks for r in N.spike_ranks(named, spikes, 60.0).collect()] == [[1, 2, 3, 4]]


def test_notes_and_labels(spark):
    row = spark.range(1)
    players = F.array(F.lit("가"), F.lit("나"))
    none = F.array().cast("array<string>")
    got = row.select(
        H.editor_notes(F.lit(12), players, F.lit("funny"), F.lit(450)).alias("a"), H.editor_notes(F.lit(1), none, F.lit("other"), F.lit(100)).alias("b"), E.evidence_mark(F.lit(True), F.lit("both")).alias("m"), E.rank_label(F.lit(5)).alias("r"),
        E.sentiment(F.lit("감탄·대박"), F.lit(9), F.lit(1), F.lit(1), F.lit(1)).alias("s"), E.sentiment(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("t"), E.suggestion(F.lit("긍정적"), F.array(F.lit(3))).alias("u"),
    ).first()
    assert got.a.startswith("좋아요 12개 — 공감도 높음. 가, 나 관련") and got.a.endswith(P.NOTE_STRONG) and got.b == P.NOTE_PLAIN
    assert (got.m, got.r, got.s, got.t) == ("◎", "권장", "감탄·대박", "복합적") and "(스파이크 #3 연계)" in got.u


def test_roles_and_rosters(spark):
    people = spark.createDataFrame([("공태현 프로",), ("문서형",), ("누구",)], "name string")
    roster = spark.createDataFrame([("공태현",), ("문서형",)], "name string")
    registry = spark.createDataFrame([("문서형", "channel_participant"), ("공태현 프로", "professional_player")], "name string, role string")
    assert sorted(r.name for r in E.official(people, roster).collect()) == ["공태현 프로", "문서형"]
    assert E.official(people, roster.limit(0)).count() == 3
    assert sorted(r.name for r in E.players_only(people, registry).collect()) == ["공태현 프로", "누구"]
    assert contained(people, F.col("name"), roster.limit(0).withColumnRenamed("name", "_n"), "_n").count() == 0


RECORD = "comment_id long, text string, author string, likes long, category string, priority double, emotion long, players array<string>, caption string, segment string, low double, high double, confidence string, manual boolean, signals array<string>, source_type string"


def records(spark, signals=("event:이글",)):
    rows = [(1, "a", "x", 9, "funny", 90.0, 300, ["가"], "a", "seg_0001", 0.0, 30.0, "high", False, list(signals), "live_chat"), (2, "b", "y", 5, "dramatic", 80.0, 200, ["나"], "b", "", None, None, "none", True, ["event:이글", "hole:3"], "comment"), (3, "c", "z", 1, "analytical", 40.0, 100, ["나"], "c", "seg_0002", 40.0, 70.0, "medium", False, ["event:버디"], "comment"), (4, "d", "z", 1, "analytical", 30.0, 100, [], "d", "seg_0003", 45.0, 75.0, "low", False, [], "comment")]
    return spark.createDataFrame(rows, RECORD)


def test_packages(spark, tmp_path):
    r = records(spark)
    s = {x.concept: x for x in G.concept_sequences(r, ["가", "나"]).collect()}
    assert s["analytical"].title == "시청자가 본 나 — 분석 관전 모음" and s["top_reactions"].seconds == 4 + 15 * 4 + 3 and "clutch" not in s
    assert [c.segment for c in s["top_reactions"].clips] == ["seg_0001", "seg_0002"]  # the third overlaps the second by more than half
    assert s["funniest"].overlays[0].low is None and s["funniest"].overlays[0].high == 30.0  # a start at 0 counts as missing
    assert [x.event for x in G.event_words(r).collect()] == ["이글", "버디"]
    titles = [x.title for x in G.titles(r, ["가"]).orderBy("place").collect()]
    assert titles[0] == "가 vs 상대방 — 시청자가 기억하는 진짜 승부" and titles[3] == "댓글 4개가 선택한 이글 순간 BEST 모음"
    spikes = spark.createDataFrame([(1, 0.0, 60.0, 30.0, 5, 7.0)], "id long, ws double, we double, anchor double, n long, weight double")
    talk = spark.createDataFrame([(1.0, 0, "첫", "kim", 2, 2), (61.0, 1, "late", "lee", 0, 1), (5.0, 2, "대박", "lee", 9, 9)], "ts double, row long, text string, author string, likes long, weight long")
    segments = spark.createDataFrame([("seg_0001", 0.0, 30.0)], "segment string, start double, end double")
    package = G.build_package(r, segments, spikes, talk, ["가", "나"], 60.0)
    assert "concept" in package["shorts_sequences"].columns and not package["meta"].first().spike_mode
    package = G.build_package(records(spark, ["live_chat_timestamp_direct"]), segments, spikes, talk, ["가", "나"], 60.0)
    x = package["shorts_sequences"].first()
    assert x.title == "라이브 반응 피크 #1 — 0:30" and [m.text for m in x.messages] == ["첫", "대박"] and x.hook.text == "대박" and x.seconds == 22
    assert [m.segment for m in package["highlight_moments"].collect()] == ["seg_0001", "seg_0002", "seg_0003"]
    written = sinks.write_package(package, str(tmp_path / "p"))
    assert spark.read.json(written["plan_title_suggestions"]).count() == 5
    assert "spikes 1" in sinks.summary(package) and "라이브 반응 피크" in sinks.brief(package)


def test_empty_packages(spark):
    r = records(spark).limit(0)
    plan = G.master_plan(r, ["가"])
    assert {k: v.count() for k, v in plan.items()} == {k: int(k == "meta") for k in plan} and plan["meta"].first().note == P.PLAN_EMPTY
    assert G.concept_sequences(r, []).count() == 0 and G.titles(r, []).count() == 0 and H.moments(r).count() == 0
    assert G.report_mode(None) == "comments" and G.report_mode(r) == "comments" and G.report_mode(records(spark)) == "combined"


def test_render_reports(spark):
    slots = [("v", i, "" if i < 2 else "seg", 5.0, 9.0, i == 2, "low" if i == 3 else "high") for i in range(6)] + [("w", 1, "", None, None, False, "none")]
    out = {r.video: r for r in G.render_report(spark.createDataFrame(slots, "video string, place int, segment string, low double, high double, manual boolean, confidence string"), "video").collect()}
    assert (out["v"].rendered, out["v"].skipped, out["v"].status) == (2, 4, "ok") and out["v"].note.endswith(" 외 1건") and out["w"].status == "placeholder_only"


def test_recommendations_of_nothing(spark):
    c = spark.createDataFrame([], "comment_id long, author string, text string, like_count long, is_reply boolean")
    lists = ("phrase string, n long, type string", "word string, n long", "phrase string, he long, n long", "label string, n long, share double, dominant boolean")
    facts = C.facts(c, *(spark.createDataFrame([], x) for x in lists))
    assert [r.text for r in C.recommendations(facts).collect()] == ["No comments found — nothing to analyze."] and C.marketing_angles(facts).collect() == []


def test_medians_and_order(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)] + [("b", 7)], "k string, v long")
    assert {r.k: r.upper_median for r in K.upper_medians(df, "k", "v").collect()} == {"a": 3, "b": 7}
    rows = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, None)], "row long, ts double")
    assert [r.row for r in K.in_time_order(rows).collect()] == [3, 2, 1, 4]


def test_blank_texts_go(spark, tmp_path):
    (tmp_path / "c.csv").write_text('comment_id,author,text,like_count\n1,a,"\n",1\n2,a,"\t　",1\n3,a,x,1\n', encoding="utf-8")
    assert [r.comment_id for r in files.read_comments(spark, str(tmp_path / "c.csv")).collect()] == ["3"]
    assert K.relevant(spark.createDataFrame([("text", 1.0, "\n\t"), ("text", 1.0, "x")], "kind string, ts double, text string"), ["text"]).count() == 1


def test_small_files(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"youtube_url": " u ", "download_video": False}))
    assert files.read_config(spark, str(tmp_path / "config.json")) == files.Config("u", False)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_config(spark, str(tmp_path / "bad.json"))
    (tmp_path / "s.csv").write_text("anchor_time,window_start,window_end,message_count,weighted_score\n5,0,10,3.0,4\n50,x,60,9,8.5\n")
    assert [(r.id, r.anchor, r.ws, r.n) for r in files.read_spikes(spark, str(tmp_path / "s.csv")).collect()] == [(1, 50.0, 0.0, 9), (2, 5.0, 0.0, 3)]
    (tmp_path / "k.csv").write_text("phrase,count,type\na,3,unigram\na b,,bigram\n")
    assert [tuple(r) for r in files.read_keywords(spark, str(tmp_path / "k.csv")).collect()] == [("a", 3, "unigram"), ("a b", 0, "bigram")]
    (tmp_path / "lesson_v").mkdir()
    (tmp_path / "lesson_v" / "segments.json").write_text('[{"start": 1, "end": 2, "text": "t"}]')
    assert files.segments_of(spark, str(tmp_path), "v").count() == 1 and files.segments_of(spark, str(tmp_path), "other").count() == files.segments_of(spark, str(tmp_path), "—").count() == 0


def test_rosters_are_kept(spark, tmp_path):
    path, calls = str(tmp_path / "roster"), []

    def fetch(*found):
        def run():
            calls.append(found)
            if not found:
                raise OSError("no network")
            return found

        return run

    get = lambda f, now: sorted(r.name for r in files.cached_roster(spark, path, f, now=now).collect())
    day = 86400.0
    assert get(fetch(), 0.0) == [] and get(fetch("b", "a"), 0.0) == ["a", "b"] and get(fetch("c"), 3 * day) == ["a", "b"]
    assert get(fetch(), 9 * day) == ["a", "b"] and get(fetch("c"), 9 * day) == ["c"] and len(calls) == 4


def test_reports(spark, tmp_path):
    c = spark.createDataFrame([(i, f"u{i % 3}", "great shot Tiger wins again" if i % 2 else "bad | line\nbreak", i, i % 4 == 0) for i in range(12)], "comment_id long, author string, text string, like_count long, is_reply boolean")
    topics, entities, themes, profile = C.top_topics(c, L.STOPWORDS), C.entity_candidates(c, L.STOPWORDS), C.lift_themes(c, L.STOPWORDS), C.audience_profile(c, L.SENTIMENT)
    facts = C.facts(c, topics, entities, themes, profile)
    report = sinks.analysis_report("v", C.comment_stats(c), C.keyword_union(c, L.STOPWORDS), entities, C.label_counts(c, L.SENTIMENT), c.orderBy(F.desc("like_count")), themes, C.recommendations(facts), C.marketing_angles(facts))
    assert "| All | 12 |" in report and "`Tiger`" in report and "## Recommendations" in report and "Consider spotlight" in report
    sinks.write_csv(c, str(tmp_path / "bom"), bom=True)
    assert next((tmp_path / "bom").glob("part-*.csv")).read_text(encoding="utf-8").startswith("﻿comment_id")
    assert files.comment_totals(c).first().replies == 3
    lines = sinks.guide(spark.createDataFrame([(1, 0.0, 61.0, "go")], "seq int, start double, end double, text string"), "T").collect()
    assert [r.line for r in lines] == ["# T", "", "- **00:00–01:01** go"]
