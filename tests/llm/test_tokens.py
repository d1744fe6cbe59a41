import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from echofold.llm import bpe, token_counts  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids int, n_tokens string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts() -> list[str]:
    rnd = random.Random(1)
    alphabet = list("abAB é\n\t'sdll12½!?\x1c\x85\xa0ΑΣσ中文ñİſ") + ["<|endoftext|>", "<|startoftext|>", "ñ", "̈"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    return texts + ["", " ", "a" * 5000, "thequickbrown" * 400, "!" * 3000 + "ab", "'ll'll've" * 200, "".join(rnd.choice("aeinstrh") for _ in range(20000)), "".join(rnd.choice("ab") for _ in range(3000))]


def test_texts_encode_as_the_library_does(library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = bpe.encode_texts(PATH, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert token_counts.count_texts(PATH, texts) == [len(x) for x in want]
    v = bpe.vocabulary(PATH)
    assert [v.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abenthio"), min_size=300, max_size=3000))
def test_trees_equal_the_library(library, text):
    v = bpe.vocabulary(PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    assert v.encode_long(text.encode()).tolist() == ids
    # Any two parts of a word join into its encoding.
    at = len(text) // 3
    assert v.join(v.encode_long(text[:at].encode(), False), v.encode_long(text[at:].encode())).tolist() == ids


def test_long_texts_in_pieces_equal_the_library(spark, library):
    rnd = random.Random(9)
    runs = [
        lambda: "".join(rnd.choice("abcdefghiklmnorstuvw") for _ in range(rnd.randint(1, 900))),
        lambda: "".join(rnd.choice("中文字符漢語學習") for _ in range(rnd.randint(1, 900))),
        lambda: "".join(rnd.choice("приветмСИ") for _ in range(rnd.randint(1, 500))),
        lambda: "".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 700))),
        lambda: rnd.choice("-=*#") * rnd.randint(1, 800),
        lambda: "".join(rnd.choice("😀e\u0301'²½ㅋ<|>") for _ in range(rnd.randint(1, 700))),  # no place to cut
        lambda: "<|endoftext|>" * rnd.randint(1, 3),
        lambda: "don't we'll 'remember'veryone they'redone ΟΔΟΣ " * rnd.randint(1, 9),
        lambda: " \n\x85 ",
    ]
    texts = ["".join(rnd.choice(runs)() for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    texts += ["abcdefgh" * 900, "中文字" * 2000, "7" * 3000, "=" * 3000, "e\u0301" * 2000, "<|endoftext|>" * 300, "a" * 514 + "<|endoftext|>" + "b" * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in bpe.encode(df, PATH, piece_chars=520).collect()}
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_ids_of_every_script_without_the_library_merging(library, monkeypatch):
    class Cutter:
        normalizer, pre_tokenizer = library.normalizer, library.pre_tokenizer

    texts = odd_texts() + ["Σίσυφος ΟΔΟΣ", "привет, МИР!", "中文字符" * 100, "a<|endoftext|><|startoftext|>b<|x", "İ́̈", "ㅋㅋㅋ 대박"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe.vocabulary(PATH), "_library", Cutter())
    bpe._id_table.cache_clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(PATH, texts)] == want


def test_table_of_documents(spark, library):
    texts = odd_texts()[-60:] + ["word " * 900, "x" * 1500 + " tail", None]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, "null id", 1, "x"), (None, "y" * 1500, 1, "x"), (900, texts[-2], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((d is not None, d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids, skip_special_tokens=False)) for d, t, *_ in rows for ids in [library.encode(t or "", add_special_tokens=False).ids])
    for pieces in (7, 1000, 1 << 16):  # long documents in pieces of a few characters too
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest(), r.decoded) for r in bpe.encode(df, PATH, piece_chars=pieces).collect())
        assert got == want
    counts = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts.token_counts(df, PATH, limit=500).collect())
    assert counts == sorted((d is not None, d or 0, n, len((t or "").encode()), n > 500) for d, t, *_ in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(empty, PATH).collect() == []
    assert token_counts.token_counts(empty, PATH).collect() == []


def test_counts_merge_words_of_every_script(library, monkeypatch):
    """The library may normalize and cut words, but not merge them."""

    class Cutter:
        normalizer, pre_tokenizer = library.normalizer, library.pre_tokenizer

    texts = odd_texts() + ["Σίσυφος ΟΔΟΣ", "привет, МИР!", "中文字符" * 100, "“quoted” — it’s 😀😀", "a<|endoftext|><|startoftext|>b<|x", "İ́̈", "ㅋㅋㅋ 대박"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe.vocabulary(PATH), "_library", Cutter())
    token_counts._count_table.cache_clear()
    assert token_counts.count_texts(PATH, texts) == want
