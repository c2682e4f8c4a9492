"""Mixing sources to target weights, by hash-random keys, per-source order and prefix sums.

Every document gets a random key (a digest of its id and the seed). Within each source the
documents stand in key order, split over key ranges ("buckets") of about `bucket_docs`
documents, so that one hot source is many tasks. Bucket sums are added up over the few
bucket rows, and a window inside each bucket finishes the prefix sum. The mix takes whole
epochs of a source while they fit its target, and then whole documents in key order up
to the cut; the document at the cut is in if at least half of it fits. Each source is
therefore within half a document of its target.

Defined cases: a null text has size 0 and is never taken; a null source is one source and
sorts last; null ids share one key; repeated rows are separate documents and equal keys
are ordered by id and size; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple = (5, 2, 1), max_epochs: int = 3, total_share: float = 1.0) -> DataFrame:
    """Per source its rank, size, number of documents and target.

    Sources in code point order (null last) weigh `weights` in turn and share total_share of
    all sizes. A target stops at max_epochs times its source's size; what is over is
    shared again by weight. With sources sorted by cap / weight, the common level at
    which the budget is used up has a closed form, so no loop is needed: for every source
    the level if all before it are capped; the largest of these levels is the one that
    holds.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("rank", F.row_number().over(by_name) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(total_share))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    each = each.withColumn("level", (total - before) / still)
    level = F.max("level").over(W.partitionBy())
    return each.select("source", "rank", "source_size", "n_docs", F.least("cap", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-7", bucket_docs: int = 1024, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs (copies taken)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key.alias("key")), "mix-sized")
    sources = written(targets(sized, weights, max_epochs), "mix-sources")
    # `sources` is one row a source; Spark broadcasts it only while its file is under the
    # session's broadcast threshold and otherwise joins by sort, splitting skewed sources.
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    buckets = F.greatest(F.lit(1.0), F.ceil(F.col("n_docs") / bucket_docs).cast("double"))
    rows = rows.withColumn("bucket", F.floor(share * buckets).cast("long"))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("base"))
    inside = W.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(starts, ["rank", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    extra = ((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest)).cast("long")
    epochs = F.when(F.col("size") > 0, whole + extra).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size")).alias("taken"), epochs.alias("epochs"))
