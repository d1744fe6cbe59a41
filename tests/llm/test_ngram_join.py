import os
import random
import re
from collections import Counter

import pytest

from echofold.llm.ngram_join import join, needed_matches

SCHEMA = "doc_id long, text string, class_id int, n_links string"


def shingles(text: str) -> frozenset:
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs: dict[int, str]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs.items()}
    links = Counter()
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in docs if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in docs}


def corpus(seed: int) -> dict[int, str]:
    rnd = random.Random(seed)
    words = "alpha Beta gamma delta été four 5 six seven eight nine ten".split()
    docs: dict[int, str] = {}
    for d in range(80):
        docs[d] = " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 150)))
    for d in range(80, 140):
        t = docs[rnd.choice([*range(d), *[3] * 40])].split(" ")
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = "new"
        docs[d] = rnd.choice([" ", ", ", "\n"]).join(t)
    return docs | {200: "", 201: "!!!", 202: "one two", 203: "One  two.", 204: "one two three"}


@pytest.mark.parametrize("block", [256, 4])
def test_matches_brute_force(spark, block):
    docs = corpus(256)
    rows = [(d, t if t else None, 1, "x") for d, t in docs.items()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in join(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()}
    want = brute(docs)
    assert {d: (want[d], got.get(d)) for d in want if want[d] != got.get(d)} == {}
    assert max(n for _, n in want.values()) > 10


def test_posterior_bound():
    assert needed_matches(200, 0.8, 1e-9) < 0.8 * 200
    assert needed_matches(20, 0.8, 1.0) >= 20


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f", 0, ""), (1, "a b c d e f", 0, ""), (None, "a b c d e f", 0, ""), (2, "A b c d e f", 0, ""), (3, None, 0, "")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_words_that_polynomial_hashes_confuse(spark):
    """Two long words with equal polynomials modulo 2 ** 64 are different words."""
    odd = lambda swap: "".join("ab"[(i.bit_count() + swap) % 2] for i in range(1024))
    rows = [(k, f"a b c d {odd(k)} e f g h", 0, "") for k in range(2)]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in join(spark.createDataFrame(rows, SCHEMA)).collect()) == [(0, 0, 0), (1, 1, 0)]


def test_texts_that_share_a_doc_id(spark):
    rows = [(1, "a b c d e f", 0, ""), (1, "u v w x y z", 0, ""), (2, "a b c d e f", 0, ""), (3, "u v w x y z", 0, "")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got in ([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0)], [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 1, 1)])


def test_recall_on_the_test_tables(spark):
    """Equal to brute force on every document of the smallest tables but one size."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    df = spark.read.parquet(path).select("doc_id", "text")
    docs = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in join(df).collect()}
    assert got == brute(docs)


def test_empty_table(spark):
    assert join(spark.createDataFrame([], SCHEMA)).collect() == []
