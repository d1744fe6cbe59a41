"""Chat queries on small tables of their own, by brute force."""

import random
from datetime import datetime, timedelta

from echofold import catalog


def test_reactions_of_every_user(spark, tmp_path):
    rnd = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rnd.choice([0, 1, 20000, 20010, 50000]) + rnd.randrange(0, 90)), rnd.choice([3, 20, 21, 40, 900]), rnd.choice(["click", "view"]), 1.0) for i in range(150)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    first = min(r[1] for r in rows)
    chat = [((ts - first).total_seconds(), i, user, f"{kind} {user % 7}") for i, ts, user, kind, _ in rows]
    want = {}
    for name in {user for _, _, user, _ in chat}:
        clusters = []
        for ts in sorted(ts for ts, _, user, _ in chat if user == name):
            if clusters and ts - clusters[-1][-1] <= 3600:
                clusters[-1].append(ts)
            else:
                clusters.append([ts])
        anchors = [c[len(c) // 2] for c in clusters]
        want[name] = len({(ts, user, text) for ts, _, user, text in chat for a in anchors if max(0.0, a - 10) <= ts <= a + 30})
    assert set(want) == {3, 20, 21, 40, 900}
    assert {r.name: r.n for r in catalog.queries()["cluster_reactions"](spark, str(tmp_path)).collect()} == want


def test_first_texts_are_compared_whole(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["", " ", "\n　"]) + f"the same opening {rnd.randrange(9)}\nand more" + rnd.choice(["", "\t", "\x85 "])) for c in range(3) for t in (0, 1, 1500)]
    rows += [(9, 0, "user", None), (9, 1, "user", " ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for role in ("user", "assistant"):
        seen = []
        for c, t, _, text in sorted((r for r in rows if r[2] == role), key=lambda r: r[:2]):
            text = (text or "").strip()
            if text not in seen and len(seen) < 5:
                seen.append(text)
                want.add((role, len(seen), text, c, t))
    assert len(want) > 6
    assert {(r.author, r.rank, r.text, r.conv_id, r.turn) for r in catalog.queries()["first_distinct"](spark, str(tmp_path)).collect()} == want
