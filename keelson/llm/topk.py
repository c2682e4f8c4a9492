"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merge.

Vectors are packed into tiles (binary blocks of rows). A query tile meets a shard of the
table in one cell of a grid: the grid's sides come from the row counts, so a cell holds a
bounded number of vectors whatever the table's size. In a cell each candidate tile is
one matrix product with the query tile, of which only the k best columns per query are
kept; the short lists of the cells are merged in two steps (by query id and salt, then by query id).

Products of whole numbers are exact in double precision below 2^53; a cell with larger
components is computed in Python integers.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes
no part, nor does a row without an id; vectors meet only vectors of their own
length; ties go to the smaller id; repeated ids are separate candidates, but a query never
meets a row with its own id; query rows of one id give one list of k, the best pairs of any of
them, in which rows equal in vector too count once or, with each_row, as often as there are;
fewer candidates than k give what there is; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

CELL = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of every usable vector."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    keep = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.when(keep & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("double"))).alias("x")).where("x is not null")


def packed(tile_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["x"].map(len)):
                for at in range(0, len(part), tile_rows):
                    cut = part.iloc[at : at + tile_rows]
                    yield pd.DataFrame({"dim": [int(dim)], "ids": [cut["id"].to_numpy(np.int64).tobytes()], "block": [np.vstack(cut["x"].to_list()).astype(np.float64).tobytes()]})

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row: highest score, then smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2**53:
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q], dtype=object).astype(np.int64)
    return (q @ c.T).astype(np.int64)


def cell(k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        tiles = [(d, np.frombuffer(i, np.int64), np.frombuffer(b, np.float64)) for d, i, b in zip(shard["dim"], shard["ids"], shard["block"], strict=True)]
        for dim, ids, block in zip(queries["dim"], queries["ids"], queries["block"], strict=True):
            qid, q = np.frombuffer(ids, np.int64), np.frombuffer(block, np.float64).reshape(-1, dim)
            lists: list[list] = [[] for _ in qid]
            for _, cid, c in (t for t in tiles if t[0] == dim):
                scores = product(q, c.reshape(-1, dim))
                for n, own in enumerate(qid):
                    other = cid != own
                    row, names = (scores[n], cid) if other.all() else (scores[n][other], cid[other])
                    at = best(row, names, k)
                    lists[n].append((names[at], row[at]))
            for own, parts in zip(qid, lists, strict=True):
                if parts:
                    names, row = (np.concatenate(x) for x in zip(*parts, strict=True))
                    at = best(row, names, k)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": names[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = 2048, cell_queries: int = 4096, cell_rows: int = 16384, salts: int = 16, each_row: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of every query id."""
    exact = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(vectors.where(is_query), id_col, vector_col, scale)
    asked = asked if each_row else asked.dropDuplicates(["id", "x"])
    blocks = written(exact.mapInPandas(packed(tile_rows), "dim int, ids binary, block binary").withColumn("shard", F.xxhash64("ids")), "topk-tiles")
    queries = written(asked.mapInPandas(packed(256), "dim int, ids binary, block binary").withColumn("part", F.xxhash64("ids")), "topk-queries")
    n_rows, n_queries = (x.agg(F.coalesce(F.sum(F.length("ids") / 8), F.lit(0))).first()[0] for x in (blocks, queries))
    across, down = max(1, math.ceil(n_queries / cell_queries)), max(1, math.ceil(n_rows / cell_rows))
    # Every query tile goes to each shard and every table tile to each query group: the grid
    # of the block product, an equi-join on its cells.
    left = queries.withColumn("g", F.pmod("part", F.lit(across)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = blocks.withColumn("s", F.pmod("shard", F.lit(down)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    cells = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(cell(k), CELL)

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    salted = merged(cells.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))), "query_id", "salt") if down > salts else cells
    return merged(salted, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
