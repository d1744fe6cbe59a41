import os
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 7))) for _ in range(n)).capitalize() + "."


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    """Each stage on documents with one case for it."""
    rnd = random.Random(4)
    from echofold.llm.shared import documents

    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id = 3").first().text
    passage = words(rnd, 70)
    texts = {1: words(rnd, 300), 2: words(rnd, 200) + " " + passage, 3: words(rnd, 150) + "\n" + passage + "\n" + words(rnd, 90), 4: words(rnd, 80) + " " + item, 5: "BUY!! NOW!! " * 200, 6: words(rnd, 60), 8: None}
    texts[7] = texts[1].replace(" ", "  ", 3).rsplit(" ", 1)[0] + " end."
    schema = documents(spark, SF).schema
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert 5 not in kept["quality"] and {1, 2, 3, 4, 6, 7} <= kept["quality"].keys()
    assert 7 not in kept["near_duplicates"] and {1, 2, 3, 4, 6} <= kept["near_duplicates"].keys()
    assert kept["repeated_passages"][2] == texts[2] and passage not in kept["repeated_passages"][3]
    assert 4 not in kept["benchmark_passages"] and {1, 2, 3, 6} <= kept["benchmark_passages"].keys()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns[0] == "doc_id" and {r.doc_id for r in out.collect()} == kept["benchmark_passages"].keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
