import random
import zlib

import numpy as np
import pytest

from echofold.llm import quality_crf, toxicity
from echofold.llm.shared import held_out

SCHEMA = "doc_id long, text string, score int, lang string"


def good_line(rnd):
    return " ".join(rnd.choice("the river moves under old bridges while people walk home slowly and talk".split()) for _ in range(rnd.randint(4, 14))).capitalize() + "."


def bad_line(rnd):
    return rnd.choice([lambda: "BUY NOW!! " * rnd.randint(2, 8), lambda: "x$$$ y%%% z&&& " * 3, lambda: "same " * 12, lambda: "a | b | c | d | e"])()


def quality_corpus(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = rnd.random() < 0.3
        k = rnd.randint(1, 8)
        texts.append("\n".join(bad_line(rnd) if bad and rnd.random() < 0.8 or bad and i == 0 else good_line(rnd) for i in range(k)))
        labels.append(0 if bad else 1)
    return texts, np.array(labels)


def test_quality_of_held_out_documents():
    texts, labels = quality_corpus(600, 1)
    chain = quality_crf.fit([t.encode() for t in texts], labels)
    held, truth = quality_corpus(300, 2)
    s = chain.scores([t.encode() for t in held])
    assert ((s >= 0.5) == truth).mean() > 0.95
    assert ((s >= 0) & (s <= 1)).all()


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(0)
    chain = quality_crf.Chain(np.zeros((quality_crf.WIDTH, 2)), rnd.normal(size=(2, 2)))
    text = np.array([0, 0, 0, 1, 2, 2])
    emit = rnd.normal(size=(6, 2))
    p, moved = chain.forward_backward(emit, text)
    want, moves = np.zeros((6, 2)), np.zeros((2, 2))
    for k in (0, 1, 2):
        at = np.flatnonzero(text == k)
        weights = {}
        for path in np.ndindex(*[2] * len(at)):
            weights[path] = np.exp(sum(emit[i, y] for i, y in zip(at, path, strict=True)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        for path, v in weights.items():
            for i, y in zip(at, path, strict=True):
                want[i, y] += v / z
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += v / z
    assert np.allclose(p, want) and np.allclose(moved, moves)


def toxic_corpus(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = good_line(rnd).split() + ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(5)]
        bad = rnd.random() < 0.15
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["zonk", "krelly", "krellish", "krellom"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_of_held_out_documents():
    texts, labels = toxic_corpus(2000, 1)
    positive = [t.encode() for t, y in zip(texts, labels, strict=True) if y][:150]
    classifier = toxicity.fit(positive, [t.encode() for t in texts], labels.mean())
    held, truth = toxic_corpus(600, 2)
    p = classifier.scores([t.encode() for t in held]) >= 0.7
    assert p[truth == 1].mean() > 0.95 and p[truth == 0].mean() < 0.02


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_tables(spark, kind):
    """Nulls, empty texts, repeated rows, clashing columns; labels of the held-out fold are never read."""
    texts, labels = quality_corpus(200, 3) if kind == "quality" else toxic_corpus(300, 3)
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)] + [(1000, None, 9, "x"), (1001, "", 9, "x"), (1002, " \n\n ", 9, "x"), (0, texts[0], 9, "x"), (None, "no id", 9, "x"), (1003, "long line " * 20000, 9, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fold = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    module = quality_crf if kind == "quality" else toxicity
    scores = []
    for wrong in (False, True):
        own = [(i, int(1 - y if wrong and fold[i] else y)) for i, y in enumerate(labels)] + [(None, 1), (5000, None)]
        model = module.train(docs, spark.createDataFrame(own, f"doc_id long, {kind} int"))
        got = sorted((str(r.doc_id), r.score) for r in module.score(docs, model).collect())
        assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
        scores.append(got)
    assert scores[0] == scores[1]
    marks = {r.doc_id: r.h for r in docs.filter("doc_id < 200").select("doc_id", held_out().alias("h")).collect()}
    assert all(marks[i] == fold[i] for i in range(200))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for module, label in ((quality_crf, "quality"), (toxicity, "toxic")):
        model = module.train(docs, spark.createDataFrame([], f"doc_id long, {label} int"))
        assert module.score(docs, model).collect() == []


def test_risk_and_its_gradient():
    """Against the estimator written out, and finite differences of the part that is followed."""
    rng = np.random.default_rng(2)
    xp, xu = rng.integers(0, 2, (30, 4)).astype(float), rng.integers(0, 2, (80, 4)).astype(float)

    def parts(v, prior):
        loss = lambda z: np.log1p(np.exp(-z))
        zp, zu = xp @ v[:-1] + v[-1], xu @ v[:-1] + v[-1]
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    seen = set()
    for prior in (0.05, 0.5, 0.95):
        for scale in (0.3, 3):
            v = rng.normal(0, scale, 5)
            positive, negative, gradient = toxicity.risk(v[:-1], float(v[-1]), xp, xu, prior)
            assert np.allclose([positive, negative], parts(v, prior))
            followed = (lambda u, q=prior: sum(parts(u, q))) if negative >= 0 else (lambda u, q=prior: -parts(u, q)[1])
            seen.add(negative >= 0)
            steps = np.eye(5) * 1e-6
            assert np.allclose(gradient, [(followed(v + e) - followed(v - e)) / 2e-6 for e in steps], atol=1e-5)
    assert seen == {True, False}


def test_document_quality_is_the_length_weighted_mean():
    texts = [b"short\na much longer line of words here\n", b"", b"one"]
    rng = np.random.default_rng(1)
    chain = quality_crf.Chain(rng.normal(0, 1, (quality_crf.WIDTH, 2)), rng.normal(0, 1, (2, 2)), (3.0, -1.0), 0.25)
    x, size, text = quality_crf.lines(texts)
    good = chain.marginals(x, text)[:, quality_crf.GOOD]
    first = (good[0] * size[0] + good[1] * size[1]) / (size[0] + size[1])
    want = [1 / (1 + np.exp(-(3 * first - 1))), 0.25, 1 / (1 + np.exp(-(3 * good[2] - 1)))]
    assert size.tolist() == [5, 32, 3] and np.allclose(chain.scores(texts), want)


def test_repeated_and_conflicting_training_rows(spark):
    from echofold.llm import training

    docs = spark.createDataFrame([(d, f"text {d}") for d in range(40)] * 2 + [(5, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)] + [(d, 1) for d in range(40)] + [(None, 1)], "doc_id long, quality int")
    sample = training.labelled(docs, labels, "quality", 100)
    assert set(sample["label"]) == {1}
    assert sorted(sample["doc_id"]) == sorted([*set(sample["doc_id"]), *([5] if 5 in set(sample["doc_id"]) else [])])
