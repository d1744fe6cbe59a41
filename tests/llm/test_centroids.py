import hashlib

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from echofold.llm import centroids as C  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, id string, cluster string"


def brute(rows, k, rounds, dim, scale, seed="3"):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x * scale) < C.TOO_LARGE for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if members:
                centroids[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(x for _, x, m in found if m == n), total, sha[n]) for i, d, n in found), key=repr)


def got(spark, rows, k=5, rounds=4, dim=3, scale=8, parts=3):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(parts)
    out = C.digest(C.cluster(df.select("vec_id", "embedding").toDF("id", "vector"), k, rounds, dim, scale))
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in out.collect()), key=repr)


def test_trees_are_covers_and_assignments_exact():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, d, k = int(rng.integers(1, 300)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        x, c = rng.integers(-15, 15, (n, d)), rng.integers(-15, 15, (k, d))
        x[: n // 3] = x[0]  # one vector in a third of all rows
        tree, placed = C.cover_tree(x)
        assert sorted(placed.tolist()) == list(range(n)) and (tree.points == x[placed]).all()
        for i in range(len(tree.lo)):
            run, centre = tree.points[tree.lo[i] : tree.hi[i]], tree.points[tree.centre[i]]
            assert np.sqrt(((run - centre) ** 2).sum(1)).max() <= tree.radius[i] + 1e-6
            heads = tree.centre[tree.first[i] : tree.first[i] + tree.n[i]]
            apart = C.distances(tree.points[heads], tree.points[heads]) + np.eye(len(heads)) * 1e9
            assert not len(heads) or heads[0] == tree.centre[i] and apart.min() > tree.radius[i] / C.BASE - 1e-6
        settled, places, found = C.assign(tree, *C.centroid_tree(c))
        own = np.full(n, -1)
        for lo, hi, number in settled:
            own[lo:hi] = number
        own[places] = found
        assert own.tolist() == np.argmin(((tree.points[:, None] - c) ** 2).sum(2), 1).tolist()


def test_close_groups_are_settled_whole():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 10, (400, 8)) + 10_000 * g for g in range(4)])
    tree, _ = C.cover_tree(x)
    settled, places, _ = C.assign(tree, *C.centroid_tree(x[::400]))
    assert len(settled) < 60 and not len(places)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i % 90), [float(x) for x in rng.integers(-40, 40, 3) / 8 + 0.03]) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0, 1.0]) for i in range(70)]  # ties and equal vectors
    rows += [(None, [0.5, 0.25, 0.0]), (300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]), (304, [1.0, float("nan"), 2.0]), (305, [float("inf"), 0.0, 0.0]), (306, [-1e30, 0.0, 0.0]), (307, [-9e6, 0.0, 1.0])]
    assert got(spark, rows) == brute(rows, 5, 4, 3, 8)
    assert got(spark, rows, k=400, rounds=1) == brute(rows, 400, 1, 3, 8)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0])]
    assert got(spark, rows) == brute(rows, 5, 4, 3, 8)
    assert got(spark, []) == got(spark, [(1, [1.0])]) == got(spark, [(None, [1.0, 1.0, 1.0])]) == []


def test_what_travels_is_bounded(spark):
    with pytest.raises(ValueError):
        C.cluster(spark.createDataFrame([], "id long, vector array<double>"), k=1 << 20, dim=1 << 10)
