import re

import pytest
from pyspark.sql import functions as F

from echofold.functions import text as T


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("t")).alias("x")).collect())]


def test_tokens(spark):
    assert values(spark, T.tokens, "A I'm 가 굿샷ㅋㅋ x1") == [["가", "굿샷ㅋㅋ", "x1"]]


def test_clean_text(spark):
    said = "&amp;lt;b<br>x @me  www.a.b　y https://z/q \x1c é "
    assert values(spark, lambda c: T.clean_text(c, mentions=True), said, None) == ["<b x y é", ""]


@pytest.mark.parametrize(
    ("text", "score"),
    [("ㅋ", 100), ("ㅋㅋㅋㅋㅋ!", 220), ("ㅠㅠ 아쉽다", 170), ("왜;;;; 이래", 200), ("a" * 101 + "!" * 8, 250)],
)
def test_emotion(spark, text, score):
    assert values(spark, T.emotion_hundredths, text) == [score]


def test_informal_spelling(spark):
    assert values(spark, T.normalize_informal, "않됬어", "안되겟다") == ["안됐어", "안되겠다"]


def test_reactions(spark):
    assert values(spark, T.reaction_tokens, "ㅋㅋㅋ ㅇㅇ 와 대박") == [["웃음(ㅋ)", "대박"]]


def test_caption(spark):
    assert values(spark, T.caption, "ㅋㅋㅋㅋ 좋다. 다음", "no", "x" * 60, "ab. " + "y" * 10) == ["ㅋ 좋다.", "no", "x" * 45 + "…", "ab. " + "y" * 10]


def test_particles(spark):
    assert values(spark, lambda c: T.particle(c, "가", "이"), "프로", "선수님", "abc") == ["가", "이", "가"]


def test_suffixes(spark):
    assert values(spark, lambda c: T.strip_suffix(c, ["프로님", "프로", "형", "님"]), "김프로님", "김프로", "형") == ["김", "김", "형"]


def test_signals(spark):
    got = values(spark, lambda c: T.signals(c, ["Kim"], ["ob", "버디"]), "kim 3번 홀 OB, hole 12 버디")[0]
    assert got == ["player:Kim", "hole:3", "hole:12", "event:ob", "event:버디"]
    assert values(spark, lambda c: T.signal_score(T.signals(c, ["Kim"], ["ob", "버디"])), "kim 3번 홀 OB, hole 12 버디") == [15]


def test_clocks(spark):
    df = spark.createDataFrame([(3725.0,)], "t double")
    got = df.select(T.clock(F.col("t")), T.minutes_clock(F.col("t")), T.srt_clock(F.col("t") + 0.25), T.clock(F.lit(65))).first()
    assert tuple(got) == ("01:02:05", "62:05", "01:02:05,250", "01:05")


def test_video_ids(spark):
    got = values(spark, T.video_id, "https://www.youtube.com/watch?v=abcdefghijk&t=3", "https://youtu.be/abcdefghijk", "https://youtube.com/live/abcdefghijk", " abcdefghijk ", "nothing here")
    assert got == ["abcdefghijk"] * 4 + [None]


def test_bigrams_skip_stopwords(spark):
    assert values(spark, lambda c: T.bigrams(T.without_stopwords(T.tokens(c), ["the"])), "one the two 3000 three", "one", "") == [["one two", "two three"], [], []]


def test_words_match_python(spark):
    texts = ["½ a² ㅋ x_1 ١٢ naïve-Straße", "一二 ３４ ​z"]
    got = values(spark, lambda c: F.split(c, T.NOT_WORD), *texts)
    assert [[w for w in g if w] for g in got] == [re.findall(r"\w+", t) for t in texts]
