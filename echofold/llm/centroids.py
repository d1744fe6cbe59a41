"""Lloyd's clustering with two trees: a cover tree over vectors, a cover tree over each round's centroids.

Vectors are dealt in blocks.  Each block is one row of a stored table: its vectors in the order of a cover tree (every node a run of them, a centre
among them, a radius), built once.  In each round a block's tree meets the tree over the centroids: a pair of nodes is dropped when its least
possible distance is beyond the greatest possible distance of the vectors' nearest centroid so far; a node with one centroid left is settled whole, by
differences of running sums; what reaches the leaves is compared exactly.  A task returns a sum for each centroid and component, nothing for each vector.

Vectors and centroids are integers; only the bounds are floating-point, with a slack above their error, and a tie is never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Vectors of a block, and of a leaf at most (but for equal ones).
BLOCK = 1024
LEAF = 8
#: A node's children cover it by balls of its radius divided by this.
BASE = 1.5
#: Components from here on have squared distances that a 64-bit integer may not hold.
TOO_LARGE = 1 << 27
BLOCKS = "ids array<long>, points binary, nodes binary, radii binary"


@dataclass
class Tree:
    """points in tree order; a node is points[lo:hi] with points[centre] as its centre and children first ... first + n - 1."""

    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    first: np.ndarray
    n: np.ndarray
    radius: np.ndarray

    def reach(self) -> float:
        """No vector's norm is above this."""
        return float(np.sqrt((self.points.astype(np.float64) ** 2).sum(1).max())) if len(self.points) else 0.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """A cover tree and the order in which it holds the points.

    A node's first child keeps its centre (nesting), every vector lies within radius / BASE of its child's centre (covering) and the centres of children
    are farther apart than that (separation among siblings).  Levels at which nothing would divide are left out.
    """
    far = distances(points, points)
    order: list[np.ndarray] = []
    lo, hi, centre, first, n, radius = [0], [len(points)], [0], [0], [0], [0.0]
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, members = stack.pop()
        apart = far[members[0], members]
        radius[node] = float(apart.max())
        if len(members) <= leaf or radius[node] == 0:
            order.append(members)
            continue
        cover, left, parts = radius[node] / BASE, members, []
        while len(left):
            near = far[left[0], left] <= cover
            near[0] = True
            parts.append(left[near])
            left = left[~near]
        first[node], n[node] = len(lo), len(parts)
        at = lo[node]
        for part in parts:
            lo.append(at)
            centre.append(at)
            at += len(part)
            hi.append(at)
            first.append(0)
            n.append(0)
            radius.append(0.0)
        # Leaves append their members in the order of their runs: children are taken from the first to the last.
        stack += [(first[node] + i, parts[i]) for i in reversed(range(len(parts)))]
    placed = np.concatenate(order) if order else np.zeros(0, np.int64)
    as_ints = [np.array(x, np.int32) for x in (lo, hi, centre, first, n)]
    return Tree(points[placed], *as_ints, np.array(radius)), placed


def assign(vectors: Tree, centroids: Tree, numbers: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """The nearest centroid of every vector, the one with the smallest number if there are several.

    numbers: of the centroids, which differ, in tree order.  Returns the runs (lo, hi, number) that were settled whole, and places and numbers of the
    vectors that were compared one by one.
    """
    slack = 1e-6 * (1 + vectors.reach() + centroids.reach())
    x, c = vectors.points.astype(np.float64), centroids.points.astype(np.float64)
    settled: list[tuple[int, int, int]] = []
    open_q, open_r = [], []
    # Pairs of a vector node and a centroid node, a vector node's pairs side by side.
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        apart = np.sqrt(((x[vectors.centre[q]] - c[centroids.centre[r]]) ** 2).sum(1))
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        sizes = np.diff(starts, append=len(q))
        nearest = np.minimum.reduceat(apart, starts) + vectors.radius[q[starts]]
        keep = apart - vectors.radius[q] - centroids.radius[r] <= np.repeat(nearest, sizes) + slack
        q, r = q[keep], r[keep]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        sizes = np.diff(starts, append=len(q))
        nodes = q[starts]
        # A vector node meets smaller centroid nodes while one of them is wider than itself or it can't be divided; else its children do.
        divisible = centroids.n[r] > 0
        widest = np.maximum.reduceat(np.where(divisible, centroids.radius[r], -1.0), starts)
        by_r = (widest >= 0) & ((widest >= vectors.radius[nodes]) | (vectors.n[nodes] == 0))
        single = ~by_r & (sizes == 1) & (widest < 0)
        for node, i in zip(nodes[single].tolist(), starts[single].tolist(), strict=True):
            settled.append((int(vectors.lo[node]), int(vectors.hi[node]), int(numbers[centroids.lo[r[i]]])))
        exact = ~by_r & ~single & (vectors.n[nodes] == 0)
        at = np.repeat(exact, sizes)
        open_q.append(q[at])
        open_r.append(r[at])
        next_q, next_r = [], []
        at = np.repeat(by_r, sizes)
        if at.any():
            split = np.where(divisible[at], centroids.n[r[at]], 1)
            child = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
            next_q.append(np.repeat(q[at], split))
            next_r.append(np.where(np.repeat(divisible[at], split), np.repeat(centroids.first[r[at]], split) + child, np.repeat(r[at], split)))
        for i in np.flatnonzero(~by_r & ~single & ~exact).tolist():
            node, own = nodes[i], r[starts[i] : starts[i] + sizes[i]]
            next_q.append(np.repeat(vectors.first[node] + np.arange(vectors.n[node]), len(own)))
            next_r.append(np.tile(own, vectors.n[node]))
        q = np.concatenate(next_q).astype(np.int64) if next_q else np.zeros(0, np.int64)
        r = np.concatenate(next_r).astype(np.int64) if next_r else np.zeros(0, np.int64)
    places, found = _compare(vectors, centroids, numbers, np.concatenate(open_q), np.concatenate(open_r)) if open_q else (np.zeros(0, np.int64),) * 2
    return settled, places, found


def _compare(vectors: Tree, centroids: Tree, numbers: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves against single centroids, vector by vector in integers."""
    places, found = [], []
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(q)] if len(q) else [], strict=True):
        lo, hi = int(vectors.lo[q[s]]), int(vectors.hi[q[s]])
        own = centroids.lo[r[s:e]]
        own = own[np.argsort(numbers[own])]
        apart = vectors.points[lo:hi, None, :].astype(np.int64) - centroids.points[own].astype(np.int64)
        places.append(np.arange(lo, hi))
        found.append(numbers[own][np.argmin((apart * apart).sum(2), axis=1)])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(found)


def centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over the different centroids, each a leaf of its own, and their numbers: of equal ones the smallest."""
    different, first = np.unique(centroids, axis=0, return_index=True)
    tree, placed = cover_tree(different, leaf=1)
    return tree, first[placed]


def _build(dim: int, scale: int):
    def block(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        tree, placed = cover_tree(np.concatenate(rows))
        nodes = np.stack([tree.lo, tree.hi, tree.centre, tree.first, tree.n]).astype("<i4")
        return pa.RecordBatch.from_arrays(
            [pa.array([[ids[i] for i in placed]], pa.list_(pa.int64())), pa.array([tree.points.astype("<i4").tobytes()]), pa.array([nodes.tobytes()]), pa.array([tree.radius.astype("<f8").tobytes()])],
            names=["ids", "points", "nodes", "radii"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            whole = np.floor(values * scale).astype(np.int64)
            for at in range(0, len(whole), BLOCK):
                ids += batch.column("id")[at : at + BLOCK].to_pylist()
                rows.append(whole[at : at + BLOCK])
                if len(ids) >= BLOCK:
                    yield block(ids, rows)
                    ids, rows = [], []
        if ids:
            yield block(ids, rows)

    return build


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[list, Tree]]:
    for ids, points, nodes, radii in zip(*(batch.column(x) for x in ("ids", "points", "nodes", "radii")), strict=True):
        runs = np.frombuffer(nodes.as_py(), "<i4").reshape(5, -1)
        yield ids.as_py(), Tree(np.frombuffer(points.as_py(), "<i4").reshape(-1, dim), *runs, np.frombuffer(radii.as_py(), "<f8"))


def _sums(centroids: np.ndarray):
    """Of each task: number and component-wise sum of each centroid's vectors; component -1 is the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        tree, numbers = centroid_tree(centroids)
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, vectors in _blocks(batch, dim):
                settled, places, found = assign(vectors, tree, numbers)
                running = np.concatenate((np.zeros((1, dim), np.int64), np.cumsum(vectors.points.astype(np.int64), axis=0)))
                for lo, hi, number in settled:
                    total[number] += running[hi] - running[lo]
                    n[number] += hi - lo
                np.add.at(total, found, vectors.points[places].astype(np.int64))
                n += np.bincount(found, minlength=k)
        own = np.flatnonzero(n)
        values = np.concatenate((n[own, None], total[own]), axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dim + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dim), len(own)), pa.int32()), pa.array(values, pa.int64())], names=["cluster", "component", "value"])

    return run


def _members(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = centroid_tree(centroids)
        for batch in batches:
            for ids, vectors in _blocks(batch, centroids.shape[1]):
                settled, places, found = assign(vectors, tree, numbers)
                cluster = np.zeros(len(ids), np.int64)
                for lo, hi, number in settled:
                    cluster[lo:hi] = number
                cluster[places] = found
                apart = vectors.points.astype(np.int64) - centroids[cluster]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array((apart * apart).sum(1), pa.int64())], names=["id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    """members: id, cluster, distance of every vector that counts; centroids: the final ones by number."""

    members: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> Clustering:
    """vectors(id long, vector array of numbers) in k clusters, by rounds of Lloyd's method on the integers floor(scale * x).

    Vectors of another number of components, with a null or non-finite component, or with one whose integer is beyond 2^27 in size (its squared distance
    may not fit in 64 bits) don't count and have no row.  The centroids start as the vectors with the k smallest sha256 of "seed:id", of equal ids that
    with the smaller components first; without an id a vector is assigned like all others but starts no centroid.  Repeated rows count as often as they
    are there.  Fewer than k such vectors make fewer clusters, none an empty result.  What travels to the tasks is k * dim integers.
    """
    spark = vectors.sparkSession
    if k * dim * 8 > shared.BROADCAST_BYTES:
        raise ValueError("k * dim is beyond what may be sent to every task")
    shared.prepare(spark)
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < TOO_LARGE))
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).filter((F.size("vector") == dim) & sound)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = rows.filter("id IS NOT NULL").orderBy(key, "vector").select("vector").limit(k).collect()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    centroids = np.array([np.floor(np.array(r.vector) * scale) for r in start], np.int64).reshape(-1, dim)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], schema), centroids)
    blocks = shared.store(rows.mapInArrow(_build(dim, scale), BLOCKS), "vector-blocks")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(centroids), "cluster int, component int, value long").groupBy("cluster", "component").agg(F.sum("value").alias("value")).collect()
        total = np.zeros((len(centroids), dim + 1), np.int64)
        for r in sums:
            total[r.cluster, r.component + 1] = r.value
        full = total[:, 0] > 0
        centroids = centroids.copy()
        centroids[full] = total[full, 1:] // total[full, :1]
    return Clustering(blocks.mapInArrow(_members(centroids), schema), centroids)


def digest(found: Clustering) -> DataFrame:
    """Of every vector: vec_id, cluster, distance, the sums of distances over its cluster and over all, and the sha256 of its centroid's components."""
    members = shared.store(found.members, "vector-members")
    spark = members.sparkSession
    text = [(i, ",".join(map(str, c))) for i, c in enumerate(found.centroids.tolist())]
    spelled = spark.createDataFrame(text, "cluster int, components string")
    # One row for each centroid.
    sums = [(r.cluster, r.inertia) for r in members.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()]
    total = sum(x for _, x in sums)
    sums = spark.createDataFrame(sums, "cluster int, cluster_inertia long")
    known = spelled.join(sums, "cluster").select("cluster", "cluster_inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
    return members.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same in SQL, a round after the other."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dim} AND list_count(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) <= {k})",
    ]
    near = (
        "SELECT r, cluster, distance FROM (SELECT k.r, c.cluster, CAST(list_sum(list_transform(range(1, {d} + 1), lambda i: (k.v[i] - c.c[i]) * (k.v[i] - c.c[i]))) AS BIGINT) AS distance FROM kept k, c{i} c)"
        " QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1"
    )
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(d=dim, i=i)})")
        parts.append(
            f"s{i} AS (SELECT cluster, j, CAST(sum(k.v[j]) AS HUGEINT) AS total, count(*) AS n FROM a{i} JOIN kept k USING (r), range(1, {dim} + 1) AS t(j) GROUP BY cluster, j)"
        )
        moved = "(total - ((total % n) + n) % n) // n"
        parts.append(f"m{i} AS (SELECT cluster, list(CAST({moved} AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY cluster)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))")
    parts.append(f"a{rounds} AS MATERIALIZED ({near.format(d=dim, i=rounds)})")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
          CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (cluster)"""
