"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, quality_classifier, sentencepiece_codec, toxicity
from .common import table
from .id_store import documents_of, write_ids
from .license_scan import scan_licenses
from .mixing import mix
from .ngram_join import join
from .quality_rules import judge
from .quality_rules import sql as judge_sql
from .topk import top_k


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fitted(docs, table(spark, sf_dir, "labels")))


def op3_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH b AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix-7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM b GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM s0),
s2 AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM s3),
r AS (SELECT b.doc_id, b.size, s.source_size, s.target,
        coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size) ELSE 0 END AS whole
      FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source),
e AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, (epochs * size)::BIGINT AS taken, epochs::BIGINT AS epochs FROM e
"""


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, each_row=True)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(write_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


QUERIES = {"op4_sentencepiece": op4_sentencepiece, "op8_katz": op8_katz, "op6_chosen_path": op6_chosen_path, "op2_byte_cnn": op2_byte_cnn, "op3_counterfactual": op3_counterfactual, "op5_license_scan": op5_license_scan, "op1_divergence": op1_divergence, "op10_id_store": op10_id_store, "op7_mixing": op7_mixing, "op9_topk": op9_topk}
SQL = {"op1_divergence": judge_sql(), "op7_mixing": OP7_SQL, "op9_topk": OP9_SQL}
