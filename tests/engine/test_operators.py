import random

import pytest
from pyspark.sql import functions as F

from echofold.operators import chat as K
from echofold.operators import entities as E
from echofold.operators import highlights as H
from echofold.operators import matching as M
from echofold.operators import subtitles as S


def chat(spark, times, **more):
    return spark.createDataFrame([(i, float(t), 1, "a", "x") for i, t in enumerate(times)], "row long, ts double, weight long, author string, text string")


@pytest.mark.parametrize("seed", range(3))
def test_sliding_windows(spark, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.uniform(0, 500) for _ in range(120))
    want = {}
    for k in range(60):
        n = sum(times[0] + 10 * k <= t < times[0] + 10 * k + 60 for t in times)
        if n >= 3:
            want[k] = n
    assert {r.k: r.n for r in K.spike_candidates(chat(spark, times)).collect()} == want


def test_greedy_selection(spark):
    df = spark.createDataFrame([(1, 5, 40), (2, 5, 30), (4, 5, 20), (7, 5, 10)], "k long, n long, weight long")
    assert [r.k for r in K.select_spikes(df, 60, 10).orderBy("rank").collect()] == [1, 4, 7]


def test_sessions(spark):
    rows = chat(spark, [0, 60, 121, 150, 211.5])
    got = [(r.first, r.last, r.anchor) for r in K.session_clusters(rows, "author").orderBy("session").collect()]
    assert got == [(0, 60, 60), (121, 150, 150), (211.5, 211.5, 211.5)]


def test_match_by_time(spark):
    seg = spark.createDataFrame([(0, 0.0, 10.0), (1, 10.0, 20.0), (2, 100.0, 110.0)], "seq long, start double, end double")
    got = {r.ts: (r.segment, r.confidence, r.low, r.high) for r in M.match_by_time(chat(spark, [10, 33, 125, 130, 400]), seg, 10.0).join(chat(spark, [10, 33, 125, 130, 400]), "row").collect()}
    assert got[10] == ("seg_0000", "high", 0, 10)
    assert got[33][:2] == ("seg_0001", "low") and got[125][:2] == ("seg_0002", "low")
    assert got[400] == ("lc_ts_000400", "high", 390, 420)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, seed):
    rnd = random.Random(seed)
    a = [(i, x := rnd.uniform(0, 100), x + rnd.uniform(0, 30)) for i in range(20)]
    b = [(i, x := rnd.uniform(0, 100), x + rnd.uniform(0, 30)) for i in range(20)]
    got = M.overlaps(spark.createDataFrame(a, "seq long, start double, end double"), spark.createDataFrame(b, "id long, low double, high double"), 7.0)
    assert sorted((r.seq, r.id) for r in got.collect()) == sorted((i, j) for i, s, e in a for j, lo, hi in b if e >= lo and s <= hi)


def test_coalesced_matches(spark):
    kind = "id long, seq long, confidence string"
    a = spark.createDataFrame([(1, 10, "high"), (2, 10, "low"), (3, 10, "low")], kind)
    b = spark.createDataFrame([(1, 20, "high"), (2, 20, "low"), (3, 20, "medium"), (4, 20, "low")], kind)
    assert sorted((r.id, r.seq) for r in M.coalesce_matches(a, b).collect()) == [(1, 10), (2, 10), (3, 20), (4, 20)]


def test_categories(spark):
    long = "굿샷 " * 30
    df = spark.createDataFrame([(1, "대박 ㅋㅋ"), (2, "hello"), (3, long + ";; 하지만"), (4, long), (5, "안되겟다")], "comment_id long, text string")
    got = {r.comment_id: r.categories for r in H.classify(df).collect()}
    assert got[1] == ["funny", "clutch_hype"] and got[2] == ["representative"] and got[3] == ["analytical"] and got[4] == ["clutch_hype"] and got[5] == ["critical"]


def test_priorities(spark):
    rows = spark.createDataFrame([(1, "x", 10, "funny"), (2, "x", 20, "dramatic")], "comment_id long, text string, likes long, category string")
    got = {r.comment_id: r.priority for r in H.priority(rows, F.lit("high")).collect()}
    assert got == {1: 20 + 8 + 13 + 5, 2: 40 + 8 + 15 + 5}


def test_arcs(spark):
    rows = [("a", c) for c in ["critical"] * 2 + ["clutch_hype"] * 3] + [("b", "emotional")] + [("c", "analytical"), ("c", "funny")]
    got = {r.name: r.arc for r in H.sentiment_arc(spark.createDataFrame(rows, "name string, category string"), "name").collect()}
    assert got == {"a": "contested", "b": "positive", "c": "analytical_focus"}


def test_modes_take_the_first_seen(spark):
    rows = [("seg_0001", i, 1, 10 - i, c, 1, "low") for i, c in enumerate("baab")]
    m = H.moments(spark.createDataFrame(rows, "segment string, comment_id long, likes long, priority long, category string, emotion long, confidence string")).first()
    assert (m.category, m.n, m.top_comment, m.confidence) == ("b", 4, 0, "low")


def test_layers(spark):
    df = spark.createDataFrame([("@kim 안녕",), ("버디 나이스",), ("내일 예약",), ("ㅋㅋ ㅠㅠ",), ("  ",), ("아무 말",)], "t string")
    assert [r[0] for r in df.select(E.message_layer(F.col("t"))).collect()] == ["internal", "event", "internal", "event", "mixed", "mixed"]


def test_upper_median(spark):
    assert spark.range(1).select(E.upper_median(F.array(*(F.lit(x) for x in (4, 1, 3, 2))))).first()[0] == 3


def test_fuzzy_names(spark):
    names = spark.createDataFrame([("김철수민정",), ("박철수민정",)], "name string")
    tokens = spark.createDataFrame([("김철수민경",), ("김다다다다",)], "token string")
    assert [(r.token, r.name) for r in E.resolve_fuzzy(tokens, names, 0.75).collect()] == [("김철수민경", "김철수민정")]


def test_subtitles(spark):
    cues = [("v", 1, 0.0, 2.0, "one"), ("v", 2, 1.0, 3.0, "one two"), ("v", 3, 3.0, 5.0, "three."), ("v", 4, 5.0, 8.0, "four four"), ("v", 5, 8.0, 9.0, "four four"), ("v", 6, 9.0, 15.0, "five")]
    df = spark.createDataFrame(cues, "video string, seq int, start double, end double, text string")
    kept = S.collapse(df)
    assert [r.text for r in kept.orderBy("seq").collect()] == ["one two", "three.", "four four", "four four", "five"]
    got = [(r.id, r.start, r.end, r.text) for r in S.sentences(kept).orderBy("seq").collect()]
    assert got == [("seg_0001", 1.0, 5.0, "one two three."), ("seg_0002", 5.0, 8.0, "four four"), ("seg_0003", 9.0, 15.0, "five")]
    words = spark.createDataFrame([("v", 1.5, "a"), ("v", 5.0, "b"), ("v", 5.0005, "c")], "video string, time double, word string")
    with_words = {r.id: r.words for r in S.assign_words(S.sentences(kept), S.thin_words(words)).collect()}
    assert [w.word for w in with_words["seg_0001"]] == ["a"] and [w.word for w in with_words["seg_0002"]] == ["b"] and with_words["seg_0003"] is None


def test_display_times(spark):
    rnd = random.Random(1)
    times = sorted(rnd.uniform(0, 20) for _ in range(10))
    df = chat(spark, times).withColumn("start", F.lit(0.0)).withColumn("id", F.lit(1))
    got = [r["at"] for r in K.display_offsets(df, "id", "start", 1.5, 20.0).orderBy("row").collect()]
    want, last = [], None
    for t in times:
        last = t if last is None else max(t, last + 1.5)
        want.append(min(last, 19.9))
    assert got == pytest.approx(want)
