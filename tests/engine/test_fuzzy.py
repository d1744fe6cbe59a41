import random
import re
from difflib import SequenceMatcher

import pytest

from echofold.operators import entities as E


def brute(tokens, roster, least, slack):
    out = {}
    for t in set(tokens):
        best = None
        for n in set(roster):
            size = len(n) if slack else len(re.sub("[0-9]+$", "", n))
            if t and n and t[0] == n[0] and abs(len(t) - size) <= slack:
                r = SequenceMatcher(None, n, t).ratio()
                if r >= least and (best is None or (r, n) > best):
                    best = (r, n)
        if best:
            out[t] = best[1]
    return out


def misspelt(rnd, name):
    for _ in range(rnd.randint(0, 3)):
        at = rnd.randrange(len(name))
        name = rnd.choice([name[:at] + rnd.choice("abc") + name[at + 1 :], name[:at] + name[at + 1 :], name[:at] + rnd.choice("xyz") + name[at:]]) or "a"
    return name


@pytest.mark.parametrize(("least", "slack"), [(0.85, 0), (0.75, 1), (0.6, 1), (0.85, 2)])
def test_equals_all_pairs(spark, least, slack):
    rnd = random.Random(1)
    names = ["".join(rnd.choice("abcde김") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", "12", "7"]) for _ in range(150)]
    names += ["a" * 30, "b" * 29 + "c", "abcde" * 6, "".join(rnd.choice("abcd") for _ in range(24))]
    tokens = [misspelt(rnd, rnd.choice(names)) for _ in range(250)] + ["", "b" * 30, "abcde" * 5 + "abcd"]
    a = spark.createDataFrame([(t,) for t in tokens], "token string").repartition(3)
    b = spark.createDataFrame([(n,) for n in [*names, ""]], "name string")
    want = brute(tokens, names, least, slack)
    assert len(want) > 20
    got = {r.token: r.name for r in E.resolve_fuzzy(a, b, least, slack).collect()}
    assert got == want


def test_names_of_customers(spark):
    """Names that are long and much alike: candidates are few, and none that is similar is missed."""
    import os

    path = "/root/testdata/sf0.001/customer.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    rnd = random.Random(2)
    letters = lambda s: "".join("abcdefghij"[int(c)] if c.isdigit() else c for c in s)
    names = sorted({letters(r.c_name) for r in spark.read.parquet(path).select("c_name").limit(120).collect()})
    tokens = [misspelt(rnd, n) for n in names]
    got = {r.token: r.name for r in E.resolve_fuzzy(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == brute(tokens, names, 0.85, 0)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "token string")
    assert E.resolve_fuzzy(none, spark.createDataFrame([("a",)], "name string")).collect() == []
    assert E.resolve_fuzzy(spark.createDataFrame([("a",)], "token string"), none.toDF("name")).collect() == []
