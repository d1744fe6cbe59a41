import random

from echofold import stages
from echofold.operators import matching as M


def sides(rnd, n, m):
    """Few frequent words, many rare ones; some sets within others, some empty."""
    words = [f"w{i}" for i in range(60)] + ["xplay1", "play2y"]
    draw = lambda most: sorted({words[min(int(rnd.expovariate(0.08)), 61)] for _ in range(rnd.randint(0, most))})
    left, right = {i: draw(40) for i in range(n)}, {j: draw(12) for j in range(m)}
    left[0], right[0], right[1] = right[2], [], right[2]
    return left, right


def best(left, right, players, bonus, least):
    out = {}
    for i, a in left.items():
        found = []
        for j, b in right.items():
            common = sorted(set(a) & set(b))
            if common:
                either, named = len(set(a) | set(b)), sum(any(p in w for w in common) for p in players)
                if common and len(common) * 100 + named * bonus * either >= either * least:
                    found.append((-(len(common) / either + named * (bonus / 100)), j, len(common), either, named, common[:6]))
        if found:
            out[i] = min(found)[1:]
    return out


def test_winners_equal_a_comparison_of_all_pairs(spark):
    rnd = random.Random(3)
    for least, players in ((7, ["play1", "play2"]), (30, []), (60, ["play1"])):
        left, right = sides(rnd, 80, 40)
        a = spark.createDataFrame(list(left.items()), "id int, words array<string>").repartition(3)
        b = spark.createDataFrame(list(right.items()), "seq int, words array<string>")
        got = {r.id: (r.seq, r.common, r.either, r.named, r.overlap) for r in M.word_match(a, b, players, 6, least).collect()}
        assert got == best(left, right, players, 6, least)


def test_the_best_of_low_scores(spark):
    rnd = random.Random(5)
    for players in (["play1", "play2"], []):
        left, right = sides(rnd, 80, 40)
        left[1] = [f"long{i}" for i in range(400)] + ["w1"]  # a score below a hundredth
        a = spark.createDataFrame(list(left.items()), "id int, words array<string>").repartition(3)
        b = spark.createDataFrame(list(right.items()), "seq int, words array<string>")
        got = {r.id: (r.seq, r.common, r.either, r.named, r.overlap) for r in M.best_word_match(a, b, players).collect()}
        assert got == best(left, right, players, 6, 0) and 1 in got


def test_jaccard_match_leaves_out_no_comment(spark, tmp_path):
    from echofold import catalog

    texts = ["zebra lion", "zebra " + " ".join(f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "fghklm"), "nothing", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zebra lion"), (2, "tiger")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: (r.seq, r.common, r.overlap) for r in catalog.queries()["jaccard_match"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 2, "lion,zebra"), 1: (1, 1, "zebra")}


def test_candidates_are_few_and_hold_every_pair_that_counts(spark):
    rnd = random.Random(4)
    left, right = sides(rnd, 120, 60)
    a = spark.createDataFrame(list(left.items()), "id int, words array<string>")
    b = spark.createDataFrame(list(right.items()), "seq int, words array<string>")
    found = {(r.id, r.seq) for r in M.word_candidates(*M.word_order(a, b, stages.of(spark)), [], 50).collect()}
    similar = {(i, j) for i, x in left.items() for j, y in right.items() if x and y and 2 * len(set(x) & set(y)) >= len(set(x) | set(y))}
    touching = sum(bool(set(x) & set(y)) for x in left.values() for y in right.values())
    assert similar <= found and len(found) < touching / 4


def test_empty_sides(spark):
    a = spark.createDataFrame([], "id int, words array<string>")
    b = spark.createDataFrame([(1, ["x"])], "seq int, words array<string>")
    assert M.word_match(a, b).collect() == []
    assert M.word_match(b.toDF("id", "words"), a.toDF("seq", "words")).collect() == []
