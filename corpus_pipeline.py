"""A corpus pipeline of five stages, each one operator of keelson.llm.

A stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; `run`
writes each result to the shared folder and reads it again for the next. All but the last
return the columns of documents. Classifiers are fitted on the labelled documents of
sf_dir, within the bounds that their `fitted` functions document.

Defined cases: as the operators state them. Rows without an id cannot be told apart by
the join and mixing stages: the join keeps all of them if one stands for a class without an id, the
mix gives each with a word the most copies that any of them has; both treat a repeated id alike, and of rows equal
in id and text the join keeps one. Empty tables stay empty. Further columns stay as they are
in the first four stages, whatever their names; the last has its own four.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import mixing, ngram_join, quality_classifier, sentencepiece_codec, toxicity
from keelson.llm.common import WORD, cleared, fresh, remove, small_pieces, table, written
from keelson.llm.queries import tokenizer

#: Documents at or above the first and below the second score are rejected.
TOXIC, GOOD = 0.3, 0.7


def stage(f):
    """Whoever writes a stage's rows, run or a caller of its own, reads and writes texts in small pieces."""

    @functools.wraps(f)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_pieces(spark)
        return f(spark, docs, sf_dir)

    return wrapped


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model, TOXIC)


@stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = quality_classifier.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.reject_low(docs, network, GOOD)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    kept = of_each_class(ngram_join.join(docs))
    # Texts are dealt out once, and not while the stages before run: a scan holds a row group of them a task.
    chosen = lambda ids: docs.join(ids.select("kept").hint("merge"), docs["doc_id"].eqNullSafe(ids["kept"]), "left_semi")
    if not kept.where("n > 1").limit(1).count():
        return chosen(kept)
    key = fresh(docs, "text_key")
    repeated = chosen(kept.where("n > 1")).withColumn(key, F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", key]).drop(key)
    return chosen(kept.where("n = 1")).unionByName(repeated)


def of_each_class(joined: DataFrame) -> DataFrame:
    """kept, the smallest id of each class, and n, the rows that have this id; written, from ids alone."""
    rows = joined.groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("n"), F.bool_or(F.col("class_id").eqNullSafe(F.col("doc_id"))).alias("own"))
    return written(rows.where("own").select("kept", "n"), "join-kept")


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    own, times, copy = (fresh(docs, n) for n in ("mix_id", "epochs", "copy"))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(own)).agg(F.max("epochs").alias(times)).where(F.col(times) > 0)
    rows = docs.where(F.col("text").rlike(WORD)).join(taken, docs["doc_id"].eqNullSafe(taken[own]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[docs[c] for c in docs.columns])


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids of the whole text."""
    return sentencepiece_codec.encode_column(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model")).drop("text")


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_low_quality), ("n-gram Jaccard join", one_of_each), ("mixing sources to target weights", mixed), ("SentencePiece encoding", encoded)]
#: Fitted classifiers and hashes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder, and its input, go as soon
    as its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = cleared(lambda step=step, docs=docs: step(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        if before:
            remove(spark, before)
        before = docs.scratch_path
    return docs
