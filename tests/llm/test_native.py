"""License scan and decontamination against plain Python."""

import hashlib
import random
import re

from echofold.llm import decontaminate as D
from echofold.llm import licenses

SCHEMA = "doc_id long, text string, n_hit int, license string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def plan_is_native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_decontaminate(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("alpha Beta gamma the of É x1 zz".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 13, 20, 30])))) for i in range(12)] + [(90, "same same same same"), (91, ""), (92, None), (None, "left out"), (93, items_text := "the of the of the of the of the of the of the of")]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(2)]
        if d % 2:
            parts.insert(1, rnd.choice(items[:12])[1].upper().replace(" ", "\n"))
        docs.append((d, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "same " * 9), (103, items_text), (104, "!!! ??"), (0, docs[0][1])]
    docs = [(d, t) for d, t in docs]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA).repartition(3)
    out = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert plan_is_native(out)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=repr)
    assert got == brute(docs, [x for x in items if x[0] is not None])
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_without_broadcast(spark, monkeypatch):
    from echofold.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    docs = [(1, "a b c d e f g h i j k l m n"), (2, "nothing")]
    items = [(7, "b c d e f g h i j k l m n")]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert D.decontaminate(docs, items).collect() == []
    assert [r.n_hit for r in D.decontaminate(one, items).collect()] == [0]
    assert licenses.scan(docs).collect() == []


def test_proximity(spark):
    words_of = lambda *rest: " ".join(rest)
    filler = [f"w{i}" for i in range(11)]
    item = words_of("red", *filler, "blue")
    docs = [(1, item), (2, words_of("blue", *filler, "x", "red")), (3, words_of("red", *["x"] * 30, *filler, "blue")), (4, words_of(*filler)), (5, words_of("red", "x", *filler, "x", "blue")), (6, words_of(*filler, "far " * 40, *filler))]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, item + " x")], "item_id long, text string"))
    got = {r.doc_id: (r.n_items, r.n_near) for r in out.collect()}
    # Blue and red are the rarest of the first window: 3 has them too far apart, but the second item's other window without its last word.
    assert got[1] == (2, 2) and got[5] == (0, 2) and got[3] == (0, 1) and got[4] == got[6] == (0, 0)


def test_texts_that_share_a_doc_id(spark):
    item = "a b c d e f g h i j k l m"
    docs = [(1, item), (1, "other words"), (1, item), (None, item), (None, "x"), (2, "p " + item)]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit) for r in out.collect()), key=repr)
    assert [x for x in got if x[0] != 1] == [(2, 14, 13), (None, 1, 0), (None, 13, 0)]
    assert len({h for d, _, h in got if d == 1}) == 1 and [n for d, n, _ in got if d == 1] == [13, 13, 2]


def test_licenses_of_edited_copies(spark):
    """Whole texts with a word changed here and there: found by the bands whenever eight tenths of the shingles are left."""
    rnd = random.Random(3)
    rows, want = [], set()
    for name, text in licenses.TEMPLATES:
        for k in range(30):
            w = text.split()
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(["changed", "other", "x"])
            copy = " ".join(["word"] * rnd.randint(0, 40) + w + ["tail"] * rnd.randint(0, 9))
            rows.append((len(rows), copy))
            for other, template in licenses.TEMPLATES:
                own, there = words(template), words(copy)
                have = {tuple(there[i : i + 5]) for i in range(max(1, len(there) - 4))}
                need = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}
                if len(have & need) * 10 >= len(need) * 8:
                    want.add((rows[-1][0], other))
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.license) for r in out.collect()} == want
    assert len({other for _, other in want}) == len(licenses.TEMPLATES) and len(want) < 2 * len(rows)


def test_licenses(spark):
    long = dict(licenses.TEMPLATES)["mit-grant"]
    edited = long.replace("charge", "cost", 1)
    rows = [(1, "Intro. Released under the MIT License. End"), (2, "released, under: the mit LICENSE"), (3, "released under the bsd license"), (4, "Here: " + edited), (5, None), (6, ""), (7, "word " * 3000 + long), (None, long), (7, "word " * 3000 + long), (8, long[:120])]
    out = licenses.scan(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(3))
    assert plan_is_native(out)
    got = {(r.doc_id, r.license) for r in out.collect()}
    assert got == {(1, "mit-line"), (2, "mit-line"), (4, "mit-grant"), (7, "mit-grant")}
