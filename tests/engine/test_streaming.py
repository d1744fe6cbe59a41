from pyspark.sql import functions as F

from echofold.streaming import chat


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, "a" if i % 2 else "b") for i in range(0, 50, 2)] + [(99, "2024-01-01 01:00:00", 1, "a")]
    spark.createDataFrame(rows, "message_id int, t string, weight int, author string").select("message_id", F.to_timestamp("t").alias("time"), "weight", "author").write.parquet(str(tmp_path / "in"))
    found = {}
    for name, op in {"spikes": chat.spike_counts, "sessions": lambda s: chat.mention_sessions(s, "author"), "density": chat.density, "distinct": chat.distinct_messages}.items():
        stream = spark.readStream.schema("message_id int, time timestamp, weight int, author string").parquet(str(tmp_path / "in"))
        found[name] = 0

        def sink(df, _, name=name):
            found[name] += df.count()

        chat.each_batch(op(stream), sink, str(tmp_path / name)).awaitTermination(120)
    assert found["distinct"] == 26 and found["spikes"] > 0 and found["sessions"] == 1 and found["density"] == 1


def test_spikes_of_a_replayed_stream_are_those_of_the_batch(spark, tmp_path):
    import random

    from echofold.operators import chat as K

    rnd, day = random.Random(1), 86400  # a whole number of steps: windows begin at the same times
    rows = [(v, 0.0, 1) for v in ("a", "b")] + [(v, round(rnd.choice([30, 200, 210, 400]) * (1 + (v == "b")) + rnd.uniform(0, 60), 3), rnd.randint(1, 4)) for v in ("a", "b") for _ in range(80)]
    rnd.shuffle(rows)
    for i in range(4):  # batches in no order of time: late messages revise what was selected
        part = spark.createDataFrame(rows[i::4], "video string, ts double, weight int").select("video", F.timestamp_micros(((F.col("ts") + day) * 1e6).cast("long")).alias("time"), "weight")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video string, time timestamp, weight int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = chat.spike_selection(stream, delay="1 hour").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.foreachBatch(lambda df, _: seen.extend(df.collect())).start().awaitTermination(240)
    last = {v: max(r.revision for r in seen if r.video == v) for v in ("a", "b")}
    got = sorted((r.video, r.rank, r.k - day // 10, r.n, r.weight) for r in seen if r.revision == last[r.video])
    batch = spark.createDataFrame(rows, "video string, ts double, weight int")
    want = K.select_spikes(K.spike_candidates(batch, keys="video"), 60.0, 10.0, keys="video")
    assert got == sorted((r.video, r["rank"], r.k, r.n, float(r.weight)) for r in want.collect()) and min(last.values()) > 1
    assert len({r.revision for r in seen}) > 1
