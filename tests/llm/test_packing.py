import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from echofold.llm import packing as P  # noqa: E402
from echofold.llm import shared  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, item string, size int, id string, length string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts(n=4000):
    rnd = random.Random(3)
    wide = [*"abc  \n\n\t'sdll12.,!<|>-\u00e9\u00c0\u00df\u00d7\u00f7\u00aa\u00b5\u4e2d\x1c\x85\xa0\u1680\u180e\u200b\u2003\u3000\u2028\r\x0b\ufeff\u0301\u0250\u0149\u01c5\U0001f600", "<|endoftext|>", "don't", " the", "  ", "\n"]
    narrow = [*"abz  \n.',1é", "'s", "<|endoftext|>", " word"]
    out = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 40))) for a in (wide, narrow) for _ in range(n // 2)]
    return out + ["", " ", "a" * 5000, "=" * 3000, "中文字符" * 900, "word " * 3000, " " * 3000, "é" * 300]


def test_ids_as_the_library_gives_them(library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    e = P.encoder(PATH)
    assert [np.frombuffer(e.ids(t), "<u4").tolist() for t in texts] == want


def test_tables_that_start_anew_and_long_texts_in_slices(library, monkeypatch):
    monkeypatch.setattr(P, "TABLE_UNITS", 5)
    monkeypatch.setattr(P, "SLICE_CHARS", 20)
    texts = odd_texts(400)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    e = P.Encoder(PATH)
    assert [np.frombuffer(e.ids(t), "<u4").tolist() for t in texts] == want and len(e.units) <= 5


def test_a_gap_takes_the_largest_that_fits():
    rnd = random.Random(4)
    for _ in range(200):
        rows = sorted((rnd.randint(1, 30), rnd.random() < 0.4) for _ in range(rnd.randint(0, 40)))
        sizes, gaps = [s for s, _ in rows], [g for _, g in rows]
        placed, left, empty, changed = P.sweep(sizes, gaps, list(range(len(rows))))
        rest = {b: sizes[b] - sum(sizes[j] for j, x in placed if x == b) for b in {b for _, b in placed}}
        assert dict(changed) == rest and all(r >= 0 for r in rest.values())
        assert sorted([j for j, _ in placed] + left + empty + list(rest)) == list(range(len(rows)))
        assert sorted(left, reverse=True) == left and not any(sizes[j] <= sizes[g] for j in left for g in empty)


def test_spans_hold_what_fits():
    rnd = random.Random(5)
    for _ in range(200):
        left = {p: (rnd.randint(1, 9), 10 * p + rnd.randint(5, 9)) for p in range(8) if rnd.random() < 0.6}
        empty = {p: (rnd.randint(1, 9), 10 * p + rnd.randint(1, 4) + 10) for p in range(8) if rnd.random() < 0.6}
        pieces, gaps = {}, {}
        for s in P.match(left, empty):
            assert s.piece_part < s.gap_part and s.per * left[s.piece_part][1] <= empty[s.gap_part][1] and s.gaps >= -(-s.pieces // s.per)
            pieces.setdefault(s.piece_part, []).extend(range(s.piece_from, s.piece_from + s.pieces))
            gaps.setdefault(s.gap_part, []).extend(range(s.gap_from, s.gap_from + s.gaps))
        for found, most in ((pieces, left), (gaps, empty)):
            assert all(sorted(r) == list(range(len(r))) and len(r) <= most[p][0] for p, r in found.items())
        # No gap stays empty while a piece of a range below has no place.
        assert not any(len(gaps.get(p, [])) < empty[p][0] and len(pieces.get(q, [])) < left[q][0] for p in empty for q in left if q < p)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["any", "equal", "small", "halves", "few"])
def test_packs_about_as_well_as_one_machine_would(spark, kind):
    rnd = random.Random(6)
    make = {"any": lambda: rnd.randint(1, 100), "equal": lambda: 35, "small": lambda: rnd.randint(1, 6), "halves": lambda: rnd.randint(40, 60), "few": lambda: rnd.choice([100, 1])}[kind]
    lengths = [make() for _ in range(3 if kind == "few" else 1500)]
    items = shared.store(spark.createDataFrame(list(enumerate(lengths)), "item long, length long"), "items")
    found = {r.item: r.sequence_id for r in P.pack(items, 100, part_rows=200).collect()}
    held = {}
    for i, n in enumerate(lengths):
        held[found[i]] = held.get(found[i], 0) + n
    assert max(held.values()) <= 100
    assert len(held) <= 1.05 * best_fit_decreasing(lengths, 100) + 1


def test_table_of_documents(spark, library):
    rnd = random.Random(8)
    texts = [rnd.choice(odd_texts(100)) for _ in range(150)] + ["word " * 900, None, "", "x y" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (3, "another"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, "a", 1, "b", "c") for i, t in rows], SCHEMA).repartition(3)
    cut = P.packed(df, PATH, 64, with_ids=True, part_rows=30)
    got = cut.collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 64 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 64)]):
            own = np.array(ids[start : first if piece == 0 else start + 64], "<u4").tobytes()
            want.append((i is not None, i or 0, piece, start, len(own) // 4, zlib.crc32(own), own))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    held = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == len(held.setdefault(r.sequence_id, b"")) // 4
        held[r.sequence_id] += bytes(r.ids)
    assert max(map(len, held.values())) <= 4 * 64
    stored = shared.store(cut, "packed")
    held = {}
    for r in stored.orderBy("offset").collect():
        held[r.sequence_id] = held.get(r.sequence_id, b"") + bytes(r.ids)
    assert {r.sequence_id: bytes(r.ids) for r in P.sequences(stored).collect()} == held


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_filters_on_large_dictionaries_of_stored_tables(spark):
    rows = spark.range(0, 60_000, 1, 1).selectExpr("id", "(id * 7919) % 2000 AS length")
    stored = shared.store(rows, "dictionary")
    assert stored.filter("length < 1500").count() == 45_000


def test_the_last_task_packs_as_one_machine_would():
    rnd = random.Random(9)
    for _ in range(50):
        sizes = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(0, 80))), reverse=True)
        numbers = P.best_fit(sizes, 60)
        held = {}
        for n, s in zip(numbers, sizes, strict=True):
            held[n] = held.get(n, 0) + s
        assert all(h <= 60 for h in held.values()) and sorted(held) == list(range(len(held))) and len(held) == best_fit_decreasing(sizes, 60)
