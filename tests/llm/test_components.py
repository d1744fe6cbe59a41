import random

import pytest

from echofold.llm import shared
from echofold.llm.components import connected_components


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, rnd.randint(101, 140)) for _ in range(60)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(80)] + [(7, 7), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_sweep_takes_the_tables_of_its_own_call(spark):
    import threading

    beside = []
    with shared.own_tables() as own:
        mine = shared.store(spark.range(3), "mine")
        thread = threading.Thread(target=lambda: beside.append(shared.store(spark.range(4), "beside")))
        thread.start()
        thread.join()
        last = shared.store(mine.filter("id > 0"), "last")
        shared.sweep(spark, last, own)
        assert len(own) == 1
    assert beside[0].count() == 4 and last.count() == 2
    with pytest.raises(Exception, match="(?i)exist|not found"):
        mine.count()
