"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, html_extract, langid, licenses, near_duplicates, phrases, reply_trees, spelling, suffix_index, topk, toxicity
from .common import crc_mod, read_table, prepare

#: The vocabulary files of ``op8_bpe`` and ``op13_alignment`` (parameters of the operators).
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated_passages(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    return toxicity.predict(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out), held_out)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    return langid.predict(docs, langid.fit(docs, ~held_out), held_out)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return reply_trees.conversation_digests(rows.unionByName(reply_trees.sample_conversation(spark)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: prepared(query) for name, query in {
    "op1_tag_paths": op1_tag_paths,
    "op2_licenses": op2_licenses,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_topk": op4_topk,
    "op5_phrase_dedup": op5_phrase_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe": op8_bpe,
    "op9_langid": op9_langid,
    "op10_decontaminate": op10_decontaminate,
    "op11_reply_trees": op11_reply_trees,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}.items()}

#: DuckDB SQL where SQL can express the result.
ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.oracle_sql(),
    "op4_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from (select vec_id, min(v) as v from v where vec_id % 50 = 0 group by vec_id) q
  join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""",
    "op11_reply_trees": reply_trees.oracle_sql(),
}
