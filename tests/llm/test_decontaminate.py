import random

import pytest
from brute import contamination

from mailmetrics.llm import decontaminate

RESULT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def tables(seed):
    r = random.Random(seed)

    def text(m):
        return " ".join(r.choice(["a", "b", "C", "ñ", "7"]) for _ in range(r.randrange(m)))

    docs = [(i, r.choice([None, "", text(60), text(8), "!!", text(30) + "x"])) for i in range(40)] + [(None, "a b"), (1, "a b")]
    items = [(i, r.choice([text(3), text(9), text(20), "", "?"])) for i in range(6)] + [(None, "a"), (3, "b b"), (3, None)]
    return docs, items


@pytest.mark.parametrize("n", [2, 5, 13])
def test_against_brute_force(spark, n):
    docs, items = tables(n)
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                           spark.createDataFrame(items, "item_id long, text string"), n)
    assert sorted([tuple(r) for r in got.select(*RESULT).collect()], key=str) == contamination(docs, items, n)


def test_several_blocks_of_test_texts(spark):
    docs, items = tables(9)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(d, i, 3, block_words=8)
    want = contamination(docs, items, 3)
    assert sorted([tuple(r) for r in got.select(*RESULT).collect()], key=str) == want
    clean = decontaminate.remove_contaminated(d, i, 3, block_words=8)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = decontaminate.find_contamination(docs, items)
    want = contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert sorted([tuple(r) for r in got.select(*RESULT).collect()], key=str) == want


def test_longest_match_goes_beyond_a_window(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words[3:30]) + " y"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.longest for r in decontaminate.find_contamination(docs, items).collect()}
    assert got == {1: 27, 2: 0}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contamination(docs, none).collect()] == [False]
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0
    assert decontaminate.remove_contaminated(docs.withColumn("spans", docs.text), none).columns == ["doc_id", "text", "spans"]
