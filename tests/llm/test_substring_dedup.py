import hashlib
import random
import re

import pytest

from echofold.llm import repeats, winnow
from echofold.llm.substring_dedup import FingerprintIndex, dedup, digest

SCHEMA = "doc_id long, text string, kept int, n_words string"


def brute(docs: dict[int, str], window: int) -> dict[int, tuple]:
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in docs.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed: int) -> dict[int, str]:
    rnd = random.Random(seed)
    words = lambda n: [rnd.choice("a b c d é ab ba the of x\x0by q. \x1cz".split(" ")) for _ in range(n)]
    passages = [words(120) for _ in range(5)]
    docs = {}
    for d in range(70):
        parts = [words(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 3))]
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randint(0, 60)
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(passages)[a : a + rnd.randint(40, 120)])
        docs[d * 7 - 100] = rnd.choice([" ", "\n", "\t  "]).join(" ".join(p) for p in parts)
    ids = list(docs)
    for k in range(15):
        t = docs[rnd.choice(ids)].split(" ")
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = "z"
        docs[1000 + k] = " ".join(t)
    return docs | {2000: "", 2001: "same " * 300, 2002: "same " * 51, 2003: "one two", 2004: "same " * 49}


@pytest.mark.parametrize("limits", [(4096, 100_000), (2, 3)])
@pytest.mark.parametrize("batches", [1, 4])
def test_matches_brute_force(spark, limits, batches):
    docs = corpus(batches)
    rows = [(d, t if t else None, 1, "x") for d, t in docs.items()]
    got = dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), batches=batches, unit=repeats.WordRuns(50, 25, *limits))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digest(got).collect()}
    want = brute(docs, 50)
    assert {d for d in want if want[d] != got.get(d)} == set()
    assert sum(w[1] for w in want.values()) > 500


def thue_morse(n: int, swap: bool) -> str:
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    """Two long words with equal polynomials modulo 2 ** 64 are different words."""
    text = lambda swap: " ".join([*(f"x{i}" for i in range(30)), thue_morse(2048, swap), *(f"y{i}" for i in range(30))])
    rows = [(1, text(False), 0, ""), (2, text(True), 0, ""), (3, text(True), 0, "")]
    assert sorted((r.doc_id, r.n_removed) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0), (2, 0), (3, 61)]


def test_texts_that_share_a_doc_id(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, 0, ""), (2, "short", 0, ""), (2, "a few more words " + passage, 0, ""), (2, passage + " end", 0, ""), (3, "x " + passage, 0, "")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 60, 0), (2, 1, 0), (2, 61, 60), (2, 64, 60), (3, 61, 60)]


def test_names_that_clash(spark):
    with pytest.raises(ValueError):
        dedup(spark.createDataFrame([(1, "a", 0, "")], SCHEMA), keep=("n_words",))


def test_words_beyond_one_block(spark, monkeypatch):
    """Texts of more symbols than a block go in overlapping parts."""
    blocks = winnow.blocks
    monkeypatch.setattr(winnow, "blocks", lambda s, e, w, limit=0: blocks(s, e, w, 130))
    docs = corpus(3)
    unit = repeats.WordRuns(50, 25)
    groups = {d: [(g["first"].tolist(), g["n"].tolist()) for g in unit.groups([t.encode()])] for d, t in docs.items()}
    assert max(map(len, groups.values())) > 1
    for d, t in docs.items():
        seen = sorted(w for first, n in groups[d] for a, k in zip(first, n, strict=True) for w in range(a, a + k))
        assert seen == list(range(max(0, len(t.split()) - 49)))


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(map(str, range(60)))
    rows = [(1, text, 0, ""), (1, text, 0, ""), (None, text, 0, ""), (2, text + " end", 0, "")]
    got = sorted((r.doc_id, r.n_removed) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0), (1, 0), (2, 60)]


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_index_takes_later_documents(spark, monkeypatch):
    docs = corpus(5)
    ids = sorted(docs)
    frame = lambda part: spark.createDataFrame([(d, docs[d], 1, "x") for d in part], SCHEMA)
    compacted = []
    compact = FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (compacted.append(len(self.runs)), compact(self)))
    index = FingerprintIndex(spark, repeats.WordRuns(50, 25))
    got = digest(dedup(frame(ids[:40]), batches=3, index=index)).collect()
    assert not compacted and len(index.runs) == 3  # nothing is merged that no batch will meet
    index = FingerprintIndex(spark, repeats.WordRuns(50, 25), runs=index.runs)
    got += digest(dedup(frame(ids[40:]), batches=1, index=index, earlier=frame(ids[:40]))).collect()
    assert compacted == [3] and len(index.runs) == 2
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(docs, 50)
    index.drop()
