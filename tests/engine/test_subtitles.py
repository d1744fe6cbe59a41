import random

from pyspark.sql import functions as F

from echofold.operators import subtitles as S

CUES = "video string, seq int, start double, end double, text string"


def collapse(rows, slack=0.02):
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        if kept and r[2] < kept[-1][3] - slack:
            if len(r[4]) > len(kept[-1][4]):
                kept[-1] = r
        else:
            kept.append(r)
    return kept


def sentences(rows, longest, most, same):
    out, open_, before = [], [], None

    def flush():
        if open_:
            out.append((f"seg_{len(out) + 1:04d}", round(open_[0][2], 3), round(open_[-1][3], 3), " ".join(c[4] for c in open_)))
            open_.clear()

    for r in sorted(rows, key=lambda r: r[1]):
        if before is not None and S.similarity(r[4], before) >= same:
            continue
        before = r[4]
        if open_ and (r[3] - open_[0][2] > longest or sum(len(c[4]) + 1 for c in open_) + len(r[4]) > most):
            flush()
        open_.append(r)
        if r[4].rstrip()[-1:] in (".", "?", "!"):
            flush()
            before = None
    flush()
    return out


def cues(rnd, video, n):
    at, out = 0.0, []
    for i in range(n):
        at += rnd.choice([0.0, 0.01, 0.5, 2.0, 12.0])
        out.append((video, i, round(at, 3), round(at + rnd.choice([0.1, 1.0, 3.0]), 3), " ".join(rnd.choice(["so", "well", "go.", "now", "really?"]) for _ in range(rnd.randint(1, 6)))))
    return out


def test_folds_equal_lists(spark):
    rnd = random.Random(1)
    videos = {v: cues(rnd, v, n) for v, n in (("a", 120), ("b", 1), ("c", 40), (None, 15))}
    rows = [r for rows in videos.values() for r in rows]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, CUES).repartition(4)
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    kept = sorted((tuple(r) for r in S.collapse(df).collect()), key=key)
    assert kept == sorted((r for own in videos.values() for r in collapse(own)), key=key)
    got = {}
    for r in S.sentences(df, 6.0, 60, 0.8).orderBy("video", "seq").collect():
        got.setdefault(r.video, []).append((r.id, r.start, r.end, r.text))
    assert got == {v: sentences(own, 6.0, 60, 0.8) for v, own in videos.items()}


def test_a_long_video_in_bounded_memory(spark):
    """A million cues of one video: a fold holds a cue at a time, and hands on its results as it goes."""
    n = 1_000_000
    at = F.col("id").cast("double")
    rows = spark.range(0, n, 1, 4).select(F.lit("v").alias("video"), F.col("id").cast("int").alias("seq"), at.alias("start"), (at + F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.5)).alias("end"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("w"), "id")).otherwise("x").alias("text"))
    kept = S.collapse(rows).agg(F.count("*").alias("n"), F.sum("seq").alias("s")).first()
    assert (kept.n, kept.s) == (n // 2, sum(range(0, n, 2)))
    words = rows.select("video", (F.col("start") / 2000).alias("time"), F.col("text").alias("word"))
    assert S.thin_words(words).count() == sum(1 for _ in thinned(i / 2000 for i in range(n)))


def thinned(times):
    last = -1.0
    for t in times:
        if t > last + 0.001:
            last = t
            yield t


def test_no_cues(spark):
    empty = spark.createDataFrame([], CUES)
    assert S.collapse(empty).count() == S.sentences(empty).count() == S.thin_words(spark.createDataFrame([], "video string, time double, word string")).count() == 0
