import random

import pytest

from echofold.operators import chat as K
from echofold.operators import matching as M

SPANS = "id int, low double, high double"


def mixed(rnd, n):
    lengths = [0.0, 1e-9, 1.0, 7.3, 64.0, 3600.0, 30 * 86400.0]
    return [(i, low, low + rnd.choice(lengths)) for i in range(n) for low in [rnd.choice([rnd.uniform(-100, 5000), float(rnd.randint(0, 128)), 64.0])]]


def test_points_in_spans_of_any_lengths(spark):
    rnd = random.Random(1)
    spans = mixed(rnd, 120) + [(999, 5.0, 4.0)]  # one that ends before it begins
    points = [(i, rnd.choice([rnd.uniform(-100, 9000), float(rnd.randint(0, 200))])) for i in range(200)]
    a = spark.createDataFrame([*points, (500, None)], "row int, ts double").repartition(3)
    got = sorted((r.row, r.id) for r in K.interval_join(a, spark.createDataFrame(spans, SPANS)).collect())
    assert got == sorted((p, i) for p, ts in points for i, low, high in spans if low <= ts <= high)


def test_spans_of_any_lengths_against_each_other(spark):
    rnd = random.Random(2)
    a, b = mixed(rnd, 90), mixed(rnd, 70)
    rows = M.overlaps(spark.createDataFrame(a, "seq int, start double, end double"), spark.createDataFrame(b, SPANS))
    assert sorted((r.seq, r.id) for r in rows.collect()) == sorted((i, j) for i, s, e in a for j, low, high in b if e >= low and s <= high)


def test_a_long_span_stands_in_two_cells(spark):
    spans = spark.createDataFrame([(1, 0.5, 30 * 86400.5), (2, 10.0, 11.0)], SPANS)
    there = spans.withColumn("l", K.level_of(spans["low"], spans["high"])).selectExpr("id", "floor(high / pow(2, l)) - floor(low / pow(2, l)) + 1 AS n")
    assert all(r.n <= 2 for r in there.collect())
    empty = spark.createDataFrame([], "ts double")
    assert K.interval_join(empty, spans).count() == 0
    assert K.interval_join(spark.createDataFrame([(1.0,)], "ts double"), spans.limit(0)).count() == 0


def brute_sessions(rows, gap):
    out = {}
    for key in {k for k, *_ in rows}:
        last, session = None, 0
        for ts, row in sorted((t, r) for k, t, r in rows if k == key):
            session += last is not None and ts - last > gap
            last = ts
            out.setdefault((key, session), []).append((ts, row))
    return out


@pytest.mark.parametrize("slice_s", [1.0, 10.0, 1e6])
def test_sessions_across_slices(spark, slice_s):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([rnd.uniform(0, 400), float(rnd.randint(0, 60) * 10)]), i) for i in range(150)] + [(f"k{i % 4}", rnd.uniform(0, 300), 1000 + i) for i in range(60)] + [("one", 5.0, 5000)]
    df = spark.createDataFrame(rows, "key string, ts double, row int").repartition(3)
    want = brute_sessions(rows, 10)
    got = {}
    for r in K.sliced_sessions(df, "key", 10.0, slice_s).collect():
        got[(r.key, r.session), r._at] = (r.ts, r.row)
    assert got == {(k, i): x for k, members in want.items() for i, x in enumerate(members)}
    assert sorted(map(str, K.sessions(df, "key", 10.0).select("key", "session", "_at", "row").collect())) == sorted(map(str, K.sessions(df, "key", 10.0, slice_s, 100).select("key", "session", "_at", "row").collect()))


def test_clusters_of_many_videos(spark):
    rnd = random.Random(4)
    rows = [(i % 2, f"a{i % 3}", rnd.uniform(0, 900), i) for i in range(200)]
    df = spark.createDataFrame(rows, "video int, author string, ts double, row int")
    want = brute_sessions([((v, a), t, r) for v, a, t, r in rows], 20)
    for hot_rows in (1 << 30, 10):
        got = {((r.video, r.author), r.session): (r.n, r.first, r.last, r.anchor) for r in K.session_clusters(df, ["video", "author"], 20.0, 1.0, hot_rows).collect()}
        assert got == {k: (len(m), m[0][0], m[-1][0], m[len(m) // 2][0]) for k, m in want.items()}


def test_spikes_of_many_videos_equal_those_of_each_alone(spark):
    rnd = random.Random(5)
    rows = [(v, rnd.choice([100 * v + 50, 400 * v, 900]) + rnd.uniform(0, 90) + 7 * v, i, rnd.randint(1, 5)) for v in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "video int, ts double, row int, weight int")
    both = K.select_spikes(K.spike_candidates(df, keys="video"), 60.0, 10.0, 5, keys="video")
    tops = K.window_messages(df, 60.0, 10.0, keys="video")
    for v in range(3):
        own = df.filter(df["video"] == v)
        assert sorted(both.filter(f"video = {v}").drop("video").collect()) == sorted(K.select_spikes(K.spike_candidates(own), 60.0, 10.0, 5).collect())
        assert sorted(tops.filter(f"video = {v}").drop("video").collect()) == sorted(K.window_messages(own, 60.0, 10.0).collect())
