"""The pipeline against brute force, stage by stage on each stage's own input."""

import corpus_pipeline
from brute import contamination, jaccard, passages, sha
from tokenizers import Tokenizer

from mailmetrics.llm import queries
from mailmetrics.llm.common import Scratch

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    tables = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.stage(stage(spark, docs, D), name)
        tables[name] = docs
    rows = {k: [(r.doc_id, r.text) for r in t.collect()] for k, t in tables.items() if k != "bpe"}
    assert all(t.columns == columns for k, t in tables.items() if k != "bpe")
    assert rows["language_id"] == rows["documents"]  # every one of these is prose
    assert {d for d, _ in rows["near_duplicates"]} == {c for _, c, _, _ in jaccard(rows["language_id"])}
    assert sorted((d, sha(" ".join((t or "").split()))) for d, t in rows["substring_dedup"]) == sorted((p[0], p[3]) for p in passages(rows["near_duplicates"], 50))
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert sorted(d for d, _ in rows["decontamination"]) == sorted(c[0] for c in contamination(rows["substring_dedup"], items) if not c[5])
    library = Tokenizer.from_file(queries.vocabulary_path())
    want = []
    for d, t in rows["decontamination"]:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert sorted(tuple(r) for r in tables["bpe"].collect()) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, D).collect()) == sorted(want)


def test_odd_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = docs.limit(5).selectExpr("cast(null as long) as doc_id", "text", "cast(null as string) as lang", "source", "cast(null as long) as n_chars")
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("runs", docs.source)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns[-1] == "runs"
    assert docs.count() > 0
