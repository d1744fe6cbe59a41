import hashlib
import random

import pytest

from echofold.llm import repeats
from echofold.llm.suffix_array import suffix_array
from echofold.llm.suffix_dedup import dedup, digest

SCHEMA = "doc_id long, text string, kept int, n_bytes string"


def brute(docs: dict[int, bytes], window: int) -> dict[int, tuple]:
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for d in sorted(docs):
        raw = docs[d]
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if first.setdefault(w, (d, i)) != (d, i):
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed: int) -> dict[int, str]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    docs = {}
    for d in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 120)
            parts.insert(rnd.randint(0, len(parts)), p[a : a + rnd.randint(50, 250)])
        docs[d] = " ".join(parts)
    for d in range(60, 75):  # near and exact copies
        t = list(docs[rnd.randint(0, 59)])
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = "z"
        docs[d] = "".join(t)
    docs |= {75: "", 76: "x" * 500, 77: "x" * 150, 78: "ab" * 200, 79: "é" * 300}
    return docs


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rnd = random.Random(seed)
    for _ in range(50):
        t = [rnd.randint(1, rnd.choice([1, 2, 4, 30])) for _ in range(rnd.randint(0, 60))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("limits", [(4096, 100_000), (2, 3), (2, 100_000)])
def test_matches_brute_force(spark, limits):
    """Small limits: anchors with many variants and held rows go the long way."""
    docs = corpus(sum(limits))
    rows = [(d, t if t else None, 1, "x") for d, t in docs.items()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digest(dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), unit=repeats.Bytes(100, 40, *limits))).collect()}
    want = brute({d: t.encode() for d, t in docs.items()}, 100)
    assert {d for d in want if want[d] != got.get(d)} == set()
    assert sum(w[1] for w in want.values()) > 2000


def test_texts_that_share_a_doc_id(spark):
    rows = [(1, "q%03d" % 7 * 40, 0, ""), (1, "short", 0, ""), (2, "x" + "".join(map(str, range(100))), 0, ""), (2, "y" + "".join(map(str, range(100))), 0, "")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 5, 0), (1, 160, 156), (2, 191, 0), (2, 191, 190)]


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "q" * 120 + "r", 0, ""), (1, "q" * 120 + "r", 0, ""), (None, "q" * 300, 0, ""), (2, "short", 0, "")]
    got = sorted((r.doc_id, r.n_removed) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    # Only the document's own later windows repeat: the second to 21st of q.
    assert got == [(1, 119), (1, 119), (2, 0)]


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], SCHEMA)).collect() == []
