"""Katz backoff: Good-Turing discounted counts with exactly normalised backoff weights.

A model of order n over words and a document end, with one class for unknown words:

    P1(w)     = d1(c(w)) c(w) / N             seen words; what is left over is the unknown's
    Pk(w | h) = dk(c(h w)) c(h w) / c(h)      seen n-grams of k words
              = a(h) Pk-1(w | h')             else; Pk-1(w | h') if h was never a history

h' is h without its first word; n - 1 starts stand before each document. a(h) divides the mass left
at h by the mass of Pk-1 over the words not seen after h, so each distribution sums to one.
dk(r) is Good-Turing's discount for counts up to 5. Where nothing would be left (all counts
over 5), seen probabilities are scaled by c / (c + 1).

A model is two tables in the shared folder, partitioned by order: `count` (n-grams and how often
they occur) and `weight` (histories, their backoff weights and totals). An n-gram is a 64-bit
hash; a row holds the sorted hashes of one hash range ("bucket") and their values, a few
million at most, so no n-gram or history is a row or task of its own, however common.
Scoring reads these tables alone: any table of documents can be scored with a stored model.

Nothing of the corpus is held in one place. Texts become blocks of about `block_tokens`
tokens, with local word numbers. To count, a block's distinct n-grams travel to the tasks of
their buckets, which add them up. For the weights, the first block to hold an n-gram adds its
lower-order probability to its history's sum in the same way, one order after the other.
To score, a block asks the buckets for the counts and weights of what it holds and evaluates
its tokens from the lowest order up, which is the recursion, each n-gram once. A document is not
cut, so a block is at least as large as its longest document.

Defined cases: a null text is empty and scores its end alone; null ids are training rows
(not held out); repeated rows count each time; with no training rows every token is
unknown and has probability 1; an empty table gives no rows; other columns are ignored,
whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, new_path, remove, tidy, write, written

TOP = 5
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def squeeze(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def stretch(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def stretch_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(stretch(data, "<u8"), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks_of(block_tokens: int):
    """Documents to blocks: (block, payload)."""
    schema = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, number = TaskContext.get().partitionId(), 0
        names: dict[bytes, int] = {}
        docs, held, sizes, ids, total = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            hashes = mixed(np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            body = {"docs": docs, "held": held, "sizes": np.array(sizes, np.int64), "ids": squeeze(place[np.concatenate(ids)] if ids else np.array([], np.uint32)), "vocab": squeeze_sorted(hashes[order])}
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | number], pa.int64()), pa.array([pickle.dumps(body)], pa.binary()), pa.array([total], pa.int64())], schema=schema)

        for batch in batches:
            for doc, text, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                n = len(words)
                ids.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint32, n))
                docs.append(doc)
                held.append(out)
                sizes.append(n)
                total += n + 1
                if total >= block_tokens:
                    yield closed()
                    number, names, docs, held, sizes, ids, total = number + 1, {}, [], [], [], [], 0
        if docs:
            yield closed()

    return run


@dataclass
class Level:
    """The distinct k-grams of a block, in the order of their hashes."""

    hashes: np.ndarray
    history: np.ndarray  # number of the first k - 1 words, among those of the level below
    lower: np.ndarray  # number of the last k - 1 words there
    at: np.ndarray  # the k-gram that ends at each token
    counts: np.ndarray  # in training documents
    starts: int  # the number of the k-gram of starts alone, which is a history only


class Block:
    """A block's tokens and their n-grams up to an order, of a model of order `top`."""

    def __init__(self, payload: bytes, order: int, top: int = 0):
        body = pickle.loads(payload)
        self.docs, self.held = body["docs"], np.array(body["held"], bool)
        ids, sizes = stretch(body["ids"], "<u4").astype(np.int64), body["sizes"] + 1
        vocab = stretch_sorted(body["vocab"])
        n = len(vocab)
        self.ends = np.cumsum(sizes)
        tokens = np.empty(int(self.ends[-1]), np.int64)
        inner = np.ones(len(tokens), bool)
        inner[self.ends - 1] = False
        tokens[inner], tokens[~inner] = ids, n
        train = np.repeat(~self.held, sizes)
        first = np.zeros(len(tokens), bool)
        first[0], first[self.ends[:-1]] = True, True
        # Words, end and start in order of their hashes.
        names = np.concatenate([vocab, mixed(np.array([END, START]))])
        order_of = np.argsort(names, kind="stable")
        place = np.empty_like(order_of)
        place[order_of] = np.arange(len(order_of))
        words, start, tokens = names[order_of], int(place[n + 1]), place[tokens]
        none = np.empty(0, np.int64)
        self.levels = [Level(words, none, none, tokens, np.bincount(tokens[train], minlength=len(words)).astype(np.uint32), start)]
        width = len(words)
        for k in range(2, order + 1):
            below = self.levels[-1]
            before = np.concatenate([[0], below.at[:-1]]).astype(np.int64)
            before[first] = below.starts
            key = before * width + tokens
            history_too = k < max(order, top)
            if history_too:
                key = np.append(key, below.starts * width + start)
            if k == 2:
                distinct, own = np.unique(key, return_inverse=True)
                lower = distinct % width
            else:
                distinct, where, own = np.unique(key, return_index=True, return_inverse=True)
                lower = below.at[np.minimum(where, len(tokens) - 1)]
            history, last = distinct // width, distinct % width
            hashes = mixed(below.hashes[history] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[last] + np.uint64(1)))
            del key, before, distinct, last
            by_hash = np.argsort(hashes)
            rank = np.empty(len(by_hash), np.int32)
            rank[by_hash] = np.arange(len(by_hash), dtype=np.int32)
            at = rank[own[: len(tokens)]]
            counts = np.bincount(at[train], minlength=len(hashes)).astype(np.uint32)
            self.levels.append(Level(hashes[by_hash], history[by_hash].astype(np.int32), lower[by_hash].astype(np.int32), at, counts, int(rank[own[-1]]) if history_too else -1))


def slices(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the hash ranges that are not empty."""
    cuts = np.searchsorted(hashes, [np.uint64(min((1 << 64) - 1, -(-(b << 64) // buckets))) for b in range(1, buckets)]) if buckets > 1 else np.array([], np.int64)
    ends = [0, *cuts.tolist(), len(hashes)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]


#: A request of a block, or with a negative block a row of a table, for a bucket.
ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("values", pa.binary())])
ASK_KINDS = "bucket int, block long, hashes binary, values binary"
#: A bucket's answer to a block about the n-grams of an order.
ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("order", pa.int32()), ("bucket", pa.int32()), ("values", pa.binary())])
ANSWER_KINDS = "block long, kind string, order int, bucket int, values binary"


def sent(block: int, hashes: np.ndarray, buckets: int, values) -> Iterator[pa.RecordBatch]:
    """Requests of a block, bucket by bucket; values(x, y): what goes with hashes x to y."""
    rows = [{"bucket": b, "block": block, "hashes": squeeze_sorted(hashes[x:y]), "values": values(x, y)} for b, x, y in slices(hashes, buckets)]
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=ASK)


def ask_counts(order: int, buckets: int):
    """Each block's n-grams of an order that occur in training, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Block(payload, order).levels[-1]
                seen = own.counts > 0
                hashes, counts = own.hashes[seen], own.counts[seen]
                yield from sent(block, hashes, buckets, lambda x, y, counts=counts: squeeze(counts[x:y]))

    return run


def ask_values(order: int, top: int, buckets: int):
    """Each block's n-grams of an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Block(payload, order, top).levels[-1]
                yield from sent(block, own.hashes, buckets, lambda x, y: b"")

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(first column, its rows), one after the other; the rows come sorted by it."""
    rows = (row for b in batches for i in range(len(b)) for row in [tuple(c[i].as_py() for c in b.columns)])
    yield from groupby(rows, key=lambda r: r[0])


COUNTED = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("values", pa.binary()), ("stats", pa.list_(pa.int64()))])
COUNTED_KINDS = "kind string, bucket int, block long, hashes binary, values binary, stats array<long>"


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the model's row; and for each block its totals, with a flag on the n-grams that it
    is the first to hold, for the sums of the weights."""
    for bucket, own in grouped(batches):
        rows = list(own)
        parts = [stretch_sorted(r[2]) for r in rows]
        sizes = np.cumsum([0, *map(len, parts)])
        distinct, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([stretch(r[3], "<u4") for r in rows]), len(distinct)).astype(np.uint64)
        owner = np.zeros(int(sizes[-1]), bool)
        owner[first] = True
        stats = [len(distinct), int(totals.sum()), *(int((totals == r).sum()) for r in range(1, TOP + 2))]
        yield pa.RecordBatch.from_pylist([{"kind": "table", "bucket": bucket, "block": -1, "hashes": squeeze_sorted(distinct), "values": squeeze(totals), "stats": stats}], schema=COUNTED)
        for r, a, b in zip(rows, sizes[:-1], sizes[1:], strict=True):
            told = pickle.dumps((squeeze(totals[inverse[a:b]]), squeeze(np.packbits(owner[a:b]))))
            yield pa.RecordBatch.from_pylist([{"kind": "answer", "bucket": bucket, "block": r[1], "hashes": None, "values": told, "stats": None}], schema=COUNTED)


def discounts(of: list[int]) -> np.ndarray:
    """d(0) .. d(TOP) by Good-Turing from n(1) .. n(TOP + 1); 1 where the counts don't allow one."""
    d = np.ones(TOP + 1)
    if of[0] and (TOP + 1) * of[TOP] < of[0]:
        common = (TOP + 1) * of[TOP] / of[0]
        for r in range(1, TOP + 1):
            if of[r - 1]:
                v = ((r + 1) * of[r] / (r * of[r - 1]) - common) / (1 - common)
                if 0 < v < 1:
                    d[r] = v
    if (d[1:] == 1).all() and of[0]:
        d[1] = 0.5
    return d


class Law:
    """What of the model is a handful of numbers: totals and, per order, discounts."""

    def __init__(self, stats: list[list[int]]):
        words = stats[0]
        self.order, self.n_types, self.n_tokens = len(stats), words[0], words[1]
        self.d = [discounts(s[2:]) for s in stats]
        lost = sum((1 - self.d[0][r]) * r * words[1 + r] for r in range(1, TOP + 1))
        self.scale = 1.0
        if self.n_tokens and lost / self.n_tokens < 1e-12:
            self.scale, lost = self.n_tokens / (self.n_tokens + 1), 0.0
        self.unknown = 1.0 if not self.n_tokens else (lost / self.n_tokens if self.scale == 1.0 else 1 / (self.n_tokens + 1))

    def kept(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(counts <= TOP, self.d[order - 1][np.minimum(counts, TOP).astype(np.int64)], 1.0) * counts.astype(np.float64)

    def lowest(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * self.kept(1, counts) / max(1, self.n_tokens), self.unknown)


def probabilities(law: Law, own: Block, counts: dict[int, np.ndarray], weights: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> np.ndarray:
    """P of each of the block's n-grams of an order. counts by order; weights (weight, total) of the
    histories by their order. Each order is that below it where its own n-gram is unseen: the
    recursion, from its end."""
    p = law.lowest(counts[1])
    for k in range(2, order + 1):
        level, seen = own.levels[k - 1], counts[k]
        weight, total = (x[level.history] for x in weights[k - 1])
        full = weight < 0
        scale = np.where(full, total / (total + 1), 1.0)
        backoff = np.where(total > 0, np.where(full, 1 / (total + 1) / np.maximum(np.abs(weight), 1e-300), weight), 1.0)
        p = np.where(seen > 0, scale * law.kept(k, seen) / np.maximum(1, total), backoff * p[level.lower])
    return p


def with_block(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, Block, dict]]:
    """(block, its tokens, {(kind, order): answers by bucket}) from rows sorted by block."""
    for block, rows in grouped(batches):
        body, told = None, {}
        for _, kind, k, bucket, values in rows:
            if kind == "block":
                body = values
            else:
                told.setdefault((kind, k), []).append((bucket, values))
        yield block, Block(body, order), {key: [v for _, v in sorted(own)] for key, own in told.items()}


def counted(own: Block, told: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and owner flags of the block's k-grams, from add_counts."""
    level = own.levels[k - 1]
    totals, owner = np.zeros(len(level.hashes), np.uint64), np.zeros(len(level.hashes), bool)
    seen = np.flatnonzero(level.counts > 0)
    if len(seen):
        both = [pickle.loads(v) for v in told["count", k]]
        parts = [stretch(t, "<u8") for t, _ in both]
        totals[seen] = np.concatenate(parts)
        owner[seen] = np.concatenate([np.unpackbits(stretch(f, "u1"), count=len(t)).astype(bool) for (_, f), t in zip(both, parts, strict=True)])
    return totals, owner


def looked_up(told: dict, kind: str, k: int, types: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    rows = [pickle.loads(v) for v in told[kind, k]]
    return tuple(np.concatenate([stretch(r[i], t) for r in rows]) for i, t in enumerate(types))


def ask_weights(law: Law, order: int, buckets: int):
    """For the histories of the n-grams of an order that a block owns: how many of them occur once to
    TOP times, their total, and their lower-order mass. Histories are n-grams of order - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own, told in with_block(batches, order):
            counts = {k: counted(own, told, k)[0] for k in range(1, order)}
            weights = {k: looked_up(told, "weight", k, ("<f8", "<u8")) for k in range(1, order - 1)}
            low = probabilities(law, own, counts, weights, order - 1)
            level = own.levels[-1]
            seen, owner = counted(own, told, order)
            use = np.flatnonzero(owner)
            history, held = np.unique(level.history[use], return_inverse=True)
            seen, n = seen[use], len(history)
            few = [np.bincount(held[seen == r], minlength=n).astype(np.uint32) for r in range(1, TOP + 1)]
            total = np.bincount(held, seen, n).astype(np.uint64)
            mass = np.bincount(held, low[level.lower[use]], n)
            hashes = own.levels[-2].hashes[history]
            yield from sent(block, hashes, buckets, lambda x, y: pickle.dumps([squeeze(a[x:y]) for a in (*few, total, mass)]))

    return run


def add_weights(d: np.ndarray):
    """Per history its backoff weight and total: the mass that is left over the lower mass that is not
    seen. A full history has the negative of the latter instead. d: the discounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in grouped(batches):
            rows = list(own)
            distinct, inverse = np.unique(np.concatenate([stretch_sorted(r[2]) for r in rows]), return_inverse=True)
            parts = [pickle.loads(r[3]) for r in rows]

            def total_of(i: int, kind: str) -> np.ndarray:
                return np.bincount(inverse, np.concatenate([stretch(p[i], kind) for p in parts]), len(distinct))  # noqa: B023

            total, low = total_of(TOP, "<u8"), total_of(TOP + 1, "<f8")
            lost = sum((1 - d[r]) * r * total_of(r - 1, "<u4") for r in range(1, TOP + 1))
            left, free = lost / total, np.maximum(1 - low, 1e-300)
            weight = np.where(left < 1e-9, -free, left / free)
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "block": -1, "hashes": squeeze_sorted(distinct), "values": pickle.dumps([squeeze(weight), squeeze(total.astype(np.uint64))])}], schema=ASK)

    return run


def answer(kind: str, order: int):
    """A table's bucket (a row with a negative block, which comes first) and the requests for it, to
    answers: counts, or weights and totals; 0 for what the table does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches):
            names, values = np.empty(0, np.uint64), None
            for _, block, hashes, data in rows:
                asked = stretch_sorted(hashes)
                if block < 0:
                    names = asked
                    values = [stretch(data, "<u8")] if kind == "count" else [stretch(x, t) for x, t in zip(pickle.loads(data), ("<f8", "<u8"), strict=True)]
                    continue
                at = np.minimum(np.searchsorted(names, asked), max(0, len(names) - 1))
                have = names[at] == asked if len(names) else np.zeros(len(asked), bool)
                held = values or [np.zeros(1, t) for t in (("<u8",) if kind == "count" else ("<f8", "<u8"))]
                told = [np.where(have, v[at], 0).astype(v.dtype) for v in held]
                yield pa.RecordBatch.from_pylist([{"block": block, "kind": kind, "order": order, "bucket": bucket, "values": pickle.dumps([squeeze(x) for x in told])}], schema=ANSWER)

    return run


def evaluate(law: Law):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, told in with_block(batches, law.order):
            counts = {k: looked_up(told, "count", k, ("<u8",))[0] for k in range(1, law.order + 1)}
            weights = {k: looked_up(told, "weight", k, ("<f8", "<u8")) for k in range(1, law.order)}
            each = np.log10(probabilities(law, own, counts, weights, law.order))
            starts, tokens, words = np.concatenate([[0], own.ends[:-1]]), own.levels[0].at, counts[1]
            score = np.add.reduceat(each[own.levels[-1].at], starts)
            plain = np.log10((words + np.uint64(1)).astype(np.float64) / (law.n_tokens + law.n_types + 1))
            base = np.add.reduceat(plain[tokens], starts)
            known = np.add.reduceat((words[tokens] > 0).astype(np.int64), starts)
            n = len(own.docs)
            yield pa.RecordBatch.from_arrays([pa.array(own.docs, pa.int64()), pa.array(own.held), pa.array(own.ends - starts), pa.array(known), pa.array([law.n_tokens] * n, pa.int64()), pa.array(base), pa.array(score)], schema=schema)

    return run


def blocked(docs: DataFrame, mod: int, at: int, block_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """The documents as a table of blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col, mod, at).alias("held_out"))
    return written(rows.mapInArrow(tidy(blocks_of(block_tokens)), "block long, payload binary, n_tokens long"), "katz-blocks")


def by_bucket(requests: DataFrame, buckets: int) -> DataFrame:
    """A few buckets a task, whatever their number and the session's number of partitions."""
    parts = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets / 4))
    return requests.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")


def by_block(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Every block with the answers that it got, about a block a task."""
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count())
    rows = blocks.select("block", F.lit("block").alias("kind"), F.lit(0).alias("order"), F.lit(0).alias("bucket"), F.col("payload").alias("values"))
    for own in answers:
        rows = rows.unionByName(own)
    return rows.repartition(parts, "block").sortWithinPartitions("block")


@dataclass
class Model:
    """A fitted model: the law's numbers and the folder of its two tables. `save` puts the numbers
    beside the tables, `load` finds both there."""

    path: str
    law: Law
    buckets: list[int]  # by order

    def table(self, spark: SparkSession, kind: str, order: int) -> DataFrame:
        """Counts or weights of an order; a model of no documents has none."""
        where = f"{self.path}/{kind}/order={order}/kind=table"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], ASK_KINDS)
        return spark.read.schema(ASK_KINDS).parquet(where)

    def save(self, spark: SparkSession) -> str:
        rows = spark.createDataFrame([(bytearray(pickle.dumps((self.law, self.buckets))),)], "model binary")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/law")
        return self.path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(path, *pickle.loads(bytes(spark.read.parquet(f"{path}/law").first()[0])))

    def look_up(self, blocks: DataFrame, kind: str, order: int) -> DataFrame:
        """The answers of one of the model's tables to the blocks."""
        buckets, top = self.buckets[order - 1], self.law.order
        asks = blocks.select("block", "payload").mapInArrow(tidy(ask_values(order, top, buckets)), ASK_KINDS)
        both = asks.unionByName(self.table(blocks.sparkSession, kind, order))
        return written(by_bucket(both, buckets).mapInArrow(tidy(answer(kind, order)), ANSWER_KINDS), f"katz-{kind}-{order}")

    def score_blocks(self, blocks: DataFrame) -> DataFrame:
        told = [self.look_up(blocks, "count", k) for k in range(1, self.law.order + 1)] + [self.look_up(blocks, "weight", k) for k in range(1, self.law.order)]
        return by_block(blocks, told).mapInArrow(tidy(evaluate(self.law)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def score(self, docs: DataFrame, mod: int = 7, at: int = 2, block_tokens: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """`score` of any documents, with the stored tables."""
        return self.score_blocks(blocked(docs, mod, at, block_tokens, id_col, text_col))


def fit_blocks(blocks: DataFrame, order: int, bucket_ngrams: int) -> Model:
    spark = blocks.sparkSession
    total = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = [max(64 if k == 1 else 192, math.ceil(total / bucket_ngrams)) for k in range(1, order + 1)]
    path, stats, told, scratch = new_path(spark, "katz-model"), [], [], []
    for k in range(1, order + 1):
        asked = by_bucket(blocks.select("block", "payload").mapInArrow(tidy(ask_counts(k, buckets[k - 1])), ASK_KINDS), buckets[k - 1])
        where = f"{path}/count/order={k}"
        write(asked.mapInArrow(tidy(add_counts), COUNTED_KINDS), where, ["kind"])
        scratch.append(where)
        rows = spark.read.schema(COUNTED_KINDS).parquet(where)
        sums = rows.where("kind = 'table'").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(TOP + 3)]).first()
        stats.append([int(x) for x in sums])
        told.append(rows.where("kind = 'answer'").select("block", F.lit("count").alias("kind"), F.lit(k).alias("order"), "bucket", "values"))
    model = Model(path, Law(stats), buckets)
    for k in range(2, order + 1):
        known = [model.look_up(blocks, "weight", j) for j in range(1, k - 1)]
        masses = by_block(blocks, [*told[:k], *known]).mapInArrow(tidy(ask_weights(model.law, k, buckets[k - 2])), ASK_KINDS)
        write(by_bucket(masses, buckets[k - 2]).mapInArrow(tidy(add_weights(model.law.d[k - 1])), ASK_KINDS), f"{path}/weight/order={k - 1}/kind=table")
        remove(spark, *[x.scratch_path for x in known])
    # What is left is the model: the rows of kind table, and the weights.
    remove(spark, *[f"{where}/kind=answer" for where in scratch])
    return model


def fitted(docs: DataFrame, order: int = 2, mod: int = 7, at: int = 2, block_tokens: int = 1_500_000, bucket_ngrams: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the documents whose crc32(id) modulo mod is not `at`."""
    blocks = blocked(docs, mod, at, block_tokens, id_col, text_col)
    model = fit_blocks(blocks, order, bucket_ngrams)
    remove(docs.sparkSession, blocks.scratch_path)
    return model


def score(docs: DataFrame, mod: int = 7, at: int = 2, block_tokens: int = 1_500_000, bucket_ngrams: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Learns from documents whose crc32(id) modulo mod is not `at`; scores all of them. Fitting and
    scoring share the blocks.
    """
    blocks = blocked(docs, mod, at, block_tokens, id_col, text_col)
    return fit_blocks(blocks, order, bucket_ngrams).score_blocks(blocks)
