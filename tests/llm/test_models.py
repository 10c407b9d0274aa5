import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailmetrics.llm import langid, queries, toxicity
from mailmetrics.llm.common import crc_mod

D = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = queries.QUERIES["op9_langid"](spark, D).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 200 < len(held) < 300
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_learns_from_its_rows_only(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("the house is there", "en"), ("der Hund und die Katze", "de"), ("das Haus ist dort", "de")] * 6)]
        + [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (None, "the dog is there", None), (103, "漢字かな", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert set(model.langs) == {"en", "de"}
    got = {r.doc_id: r for r in langid.predict(docs.withColumn("score", F.lit("x")), model, crc_mod("doc_id", 4) == 2).collect()}
    assert got[0].lang_pred == "en" and got[2].lang_pred == "de" and got[None].lang_pred == "en"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) and got[i].rejected for i in (100, 101, 102))
    assert got[103].rejected and got[103].lang_pred in ("en", "de")  # too far from every centroid
    kept = {r.doc_id for r in langid.keep_recognised(docs, model).collect()}
    assert kept == {*range(24), None}


def test_language_without_examples(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert [r.lang_pred for r in langid.predict(docs, model, F.lit(False)).collect()] == ["und"]
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0), F.lit(True)), F.lit(False)).count() == 0


def test_kmeans_separates():
    x = np.zeros((20, langid.DIMS), np.float32)
    x[:10, 0] = x[10:, 1] = 1
    c, least = langid.kmeans(x, 2)
    assert len(c) == 2 and np.allclose(least, 1)
    assert langid.counts(pa.array([None, "", "ab"], pa.string()))[:2].sum() == 0


def test_noisy_channel():
    model = toxicity.CharModel({t: 50 for w in ("^^idiot^", "^^moron^", "^^scum^", "^^clown^", "^^stupid^") for t in (w[i:i + 3] for i in range(len(w) - 2))})
    reader = toxicity.Reader(model)
    for seen, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("scuuum", "scum"), ("$tupid!!", "stupid"), ("i.d.i.o.t", "idiot"), ("c l o w n", "clown")):
        assert meant in reader.read(f"xx {seen} yy")[0]
    assert reader.read("")[0] == set() and reader.read("word, eux$$$ ###")[1] == 0


def test_noisy_channel_whole_lattice():
    words = ("^^idiot^", "^^moron^", "^^shit^", "^^ass^", "^^stupid^", "^^fool^", "^^you^", "^^are^", "^^a^")
    model = toxicity.CharModel({t: 50 for w in words for t in (w[i:i + 3] for i in range(len(w) - 2))})
    reader = toxicity.Reader(model)
    for seen, meant in (("1d107", "idiot"), ("5h17", "shit"), ("a55", "ass"), ("$" * 30 + "7up1d", "stupid"), ("a.s.s", "ass"), ("a s s", "ass"),
                        ("you are a s t u p i d", "stupid"), ("s t u p i d f o o l", "stupid"), ("s t u p i d f o o l", "fool")):
        assert meant in reader.read(f"xx {seen} yy")[0], seen
    for number in ("455", "$455", "2024", "+10", "10%"):
        assert reader.read(f"xx {number} yy") == reader.read("xx yy")
    # a language model that doesn't know the words: known ones are found in every part of a run
    reader = toxicity.Reader(toxicity.CharModel({}), {"stupid": 3.0, "fool": 2.0, "idio*": 2.0})
    assert reader.read("you are a 5 t u p 1 d f o o l yy")[0] == {"stupid", "fool"} and reader.read("y.o.u.i.d.i.o.t")[0] == {"idio*"}
    assert reader.read("i d i o")[0] == set()
    assert toxicity.CharModel({}).restore(toxicity.lattice("ab" * 100_000)) == "ab" * 100_000


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.QUERIES["op6_toxicity"](spark, d).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    wins = [(a > b) + 0.5 * (a == b) for a, y in held if y for b, z in held if not z]
    assert np.mean(wins) > 0.95


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    held = crc_mod("doc_id", 5) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels, ~held), toxicity.fit(docs, flipped, ~held)
    assert a.weights == b.weights and np.allclose(a.coef, b.coef)


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "abc def", "x"), (2, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, F.lit(True))
    assert len(toxicity.predict(docs, scorer, F.lit(False)).collect()) == 4
    scorer = toxicity.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert toxicity.predict(docs, scorer, F.lit(False)).agg(F.max("score")).first()[0] == 0


def test_nearest_centroid_by_brute_force(spark):
    """Language, cosine and rejection of every text, worked out one by one from the fitted centroids."""
    import re

    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    vocab = {"en": ["the", "of", "ship", "water", "thing"], "de": ["über", "schiff", "ung", "wasser", "und"]}
    rows = [(i, " ".join(r.choice(vocab[x]) for _ in range(r.randrange(1, 40))), x) for i in range(200) for x in [r.choice(["en", "de"])]]
    rows += [(300 + i, "####", "en") for i in range(60)] + [(400, "qq xx zz qq jj vv kk qq zz xx jj kk", "en")]  # letterless ones are not learned, one outlier
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert (model.least < 1 - 1e-6).all() and (model.least > 0.2).all()  # neither sets a distance of its own
    asked = [t for _, t, _ in rows[:80]] + ["", None, "12", "the", "Это совершенно другой язык, его не учили", "qxj " * 12, "zq xv jk"]
    lang, score, rejected = model.predict(pa.array(asked, pa.string()))
    for i, t in enumerate(asked):
        letters = len(re.findall(r"[^\W\d_]", t or ""))
        vector = langid.counts(pa.array([t], pa.string()))[0]
        vector = np.log1p(vector.astype(float)) * model.idf
        size = float(np.sqrt((vector ** 2).sum()))
        cosines = [sum(float(a) * float(b) for a, b in zip(vector[vector > 0] / size, c[vector > 0])) for c in model.vectors] if letters else [0.0]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert lang[i] == (model.langs[best] if letters else "und")
        assert abs(score[i] - (min(1, cosines[best]) if letters else 0)) < 1e-4
        assert rejected[i] == (not letters or score[i] < langid.REJECT * model.least[best] * min(1, letters / langid.SHORT))
    assert rejected[-3:-1].all() and not rejected[:80].any()
