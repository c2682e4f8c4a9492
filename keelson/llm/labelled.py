"""A bounded, reproducible sample of labelled documents for fitting a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, mod: int = 4) -> tuple[DataFrame, dict[int, int]]:
    """id_, text_, y_ of at most per_class documents of each class, and the classes' counts.

    Taken from rows that are not held out (crc32 of the id as text, modulo mod, is not 2), in
    the order of a hash of the id. Rows without a label, id or text are skipped.
    """
    rows = labels.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("y_")).where(F.col("id_").isNotNull() & F.col("y_").isin(0, 1) & ~held_out("id_", mod))
    counts = dict(rows.groupBy("y_").count().collect())
    picked = [rows.where(F.col("y_") == y).orderBy(F.xxhash64("id_"), "id_").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids: a bound that does not grow with the data.
    ids = F.broadcast(picked[0].unionByName(picked[1]).dropDuplicates(["id_"]))
    own = docs.select(F.col("doc_id").alias("doc_id_"), F.col("text").alias("text_"))
    return own.join(ids, F.col("doc_id_") == F.col("id_")).where(F.col("text_").isNotNull()).select("id_", "text_", "y_"), counts


def weights_of(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that restore the classes' shares; their mean is 1."""
    weights = np.array([counts.get(int(v), 0) / max(1, (y == v).sum()) for v in y], np.float64)
    return weights / weights.mean() if len(y) else weights


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, mod: int = 4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the `sampled` documents; those over max_chars characters
    are left out of the fit only."""
    rows, counts = sampled(docs, labels, label, per_class, mod)
    got = rows.where(F.char_length("text_") <= max_chars).toPandas().drop_duplicates("id_").sort_values("id_")
    y = got["y_"].to_numpy(np.float64)
    return got["text_"].to_list(), y, weights_of(y, counts)
