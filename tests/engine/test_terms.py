import random

import pytest
from pyspark.sql import functions as F

from echofold import stages
from echofold.operators import enrich as N
from echofold.operators import terms as R


def found(spark, texts, terms, limit=R.AUTOMATON_BYTES):
    rows = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, number int")
    return sorted((r.row, r.number, r.term) for r in R.contained(rows.repartition(3), F.col("text"), asked, "term", limit).collect())


def brute(texts, terms):
    return sorted((i, j, x) for i, t in enumerate(texts) for j, x in enumerate(terms) if x and t and x in t)


def test_equals_a_test_of_every_pair(spark):
    rnd = random.Random(1)
    letters = ["a", "b", "c", "é", "김", "\U0001f600"]
    word = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, n)))
    texts = [word(30) for _ in range(120)] + ["", None, "abc" * 40_000]
    terms = [word(4) for _ in range(60)] + ["a", "a", "", None, "abcabcabcabca"]
    want = brute(texts, terms)
    assert found(spark, texts, terms) == want
    # Split by first characters, one automaton after the other.
    assert found(spark, texts, terms, limit=20) == want


def test_terms_with_a_long_common_beginning(spark):
    terms = [f"aaaaaaaaaaaa{i}" for i in range(30)] + ["b"]
    asked = spark.createDataFrame([(t,) for t in terms], "_term string")
    parts = R.ranges(asked, 50)
    assert parts[0][0] is not None and sum(1 for t in terms for a, b, k in parts if a <= t[:k] <= b) == len(terms)
    texts = ["xaaaaaaaaaaaaa12", "b", "aaaaaaaaaaaa3"]
    assert found(spark, texts, terms, limit=50) == brute(texts, terms)


def test_no_terms_and_no_texts(spark):
    assert found(spark, ["a"], []) == found(spark, ["a", None], ["", None]) == []
    rows = spark.createDataFrame([], "row int, text string")
    assert R.contained(rows, F.col("text"), spark.createDataFrame([("a",)], "term string"), "term").collect() == []


def test_what_a_worker_hands_on_is_bounded():
    """A text that holds many terms is repeated for each: never all of a batch at once."""
    import pyarrow as pa

    class Sent:
        value = [f"w{i:03}" for i in range(300)]

    text = " ".join(Sent.value) * 20
    batch = pa.RecordBatch.from_pydict({"row": list(range(50)), "text": [text] * 50, "_text": [text] * 50})
    sizes, pairs = [], set()
    for out in R._find(R.Terms(Sent))(iter([batch])):
        sizes.append(out.nbytes)
        pairs |= set(zip(out.column("row").to_pylist(), out.column("_term").to_pylist(), strict=True))
        assert out.num_rows <= 10_000 and out.schema.names == ["row", "text", "_term"]
    assert pairs == {(i, x) for i in range(50) for x in Sent.value}
    assert max(sizes) < 5 << 20 < sum(sizes)


def test_counts_every_message(spark):
    texts = ["the other", "the other", "other", None, "", "he", "then there"]
    rows = spark.createDataFrame([(1, t) for t in texts], "row int, text string").repartition(2)  # messages need no key of their own
    roster = spark.createDataFrame([(x,) for x in ("the", "the", "other", "he", "nobody", "", None)], "name string")
    from echofold.operators import entities as E

    assert sorted(tuple(r) for r in E.mention_counts(rows, roster).collect()) == [("other", 3), ("the", 4)]
    assert sorted(tuple(r) for r in E.mention_counts(rows, roster, 2).collect()) == [("he", 5), ("other", 3), ("the", 4)]
    asked = roster.select(F.col("name").alias("x"))
    assert sorted(tuple(r) for r in R.holders(rows, F.col("text"), asked, "x", limit=4).collect()) == [("he", 5), ("other", 3), ("the", 4)]


def test_messages_about_a_person(spark):
    names = spark.createDataFrame([("공태현 프로",), ("김민 선수",), ("공태현 프로",)], "name string")
    aliases = spark.createDataFrame([("공프로", "공태현 프로"), ("민프로", "누구")], "alias string, canonical string")
    messages = spark.createDataFrame([(1, 1.0, "공태현 공프로 대박"), (2, 2.0, "공프로 처음"), (3, 9.0, "김민 앞으로"), (4, 9.5, "민프로"), (5, 10.0, None)], "row int, ts double, text string")
    told = N.told_of(messages, names, aliases)
    assert sorted((r.name, r.row) for r in told.collect()) == [("공태현 프로", 1), ("공태현 프로", 2), ("김민 선수", 3)]
    tones = {r.name: (r.newcomer_n, r.praise_n, r.lasting_n, r.said) for r in N.tone(told).collect()}
    assert tones == {"공태현 프로": (1, 1, 0, None), "김민 선수": (0, 0, 1, "김민 앞으로")}
    said = {r.name: (r.newcomer_said, r.praise_said, r.lasting_said) for r in N.tone_samples(told).collect()}
    assert said == {"공태현 프로": (["공프로 처음"], ["공태현 공프로 대박"], []), "김민 선수": ([], [], ["김민 앞으로"])}
    links = spark.createDataFrame([("공태현 프로", 1, 61.5, 70.0), ("공태현 프로", 2, 0.0, 1.0)], "name string, rank int, ws double, we double")
    assert [r.samples for r in N.chat_samples(links, told).collect()] == [["공프로 처음", "공태현 공프로 대박"]]


def test_stage_tables_end_with_their_run(spark):
    with stages.Stages(spark) as kept:
        df = kept.keep(spark.range(5), "five")
        assert df.count() == 5 and len(df.inputFiles()) and len(kept.paths) == 1
        path = kept.paths[0]
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not kept.paths and not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)


@pytest.mark.parametrize("query", ["spike_narrative", "buzz_summary", "people_scores", "people_reasons", "discovery_cards", "recommendations", "recommendation_rules"])
def test_results_plan_no_base_table(spark, query):
    """What is shared is stored once: the result reads stage tables alone."""
    import os

    from echofold import catalog

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    files = catalog.queries()[query](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("echofold-stage-" in f for f in files)


def test_deletes_only_what_is_closed(spark):
    a, b = stages.Stages(spark), stages.Stages(spark)
    left = b.keep(spark.range(3), "left")
    a.keep(spark.range(3), "gone")
    a.close()
    assert left.count() == 3
    b.close()


def test_one_pass_counts_equal_the_parts(spark):
    from echofold import lexicons as L
    from echofold.operators import comments as C

    rnd = random.Random(5)
    words = ["Great", "match", "the", "great", "best", "Final", "123", "so", "sad"]
    rows = [(i, f"a{i % 3}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), rnd.randint(0, 9), i % 3 == 0) for i in range(60)] + [(60, "a", None, 3, False)]
    df = spark.createDataFrame(rows, "comment_id int, author string, text string, like_count int, is_reply boolean")
    lexicon = {"good": ["great", "best"], "bad": ["sad"]}
    a = C.Analysis.of(df, L.STOPWORDS, lexicon)
    alone = (C.comment_stats(df).select("total_all", "total_replies", "total_likes"), C.top_topics(df, L.STOPWORDS), C.entity_candidates(df, L.STOPWORDS), C.lift_themes(df, L.STOPWORDS), C.audience_profile(df, lexicon))
    for mine, other in zip(a.parts(), alone, strict=True):
        assert sorted(map(str, mine.collect())) == sorted(map(str, other.collect()))
    nothing = C.Analysis.of(df.limit(0), L.STOPWORDS, lexicon)
    assert [tuple(r) for r in nothing.sums().collect()] == [(0, 0, 0)] and nothing.topics().count() == 0
