"""Chosen-path similarity join of documents by Jaccard similarity of their word 5-grams.

1. Documents with the same set of shingles are copies: they form one class, known by a
   digest of the set, and are joined as one. Each class has a min-hash sketch of `t` places.
2. Chosen path. At a node of the recursion tree a hash of the node picks each sketch place with
   chance 1 / (similarity * t); a class goes to one child per picked place, named by its value
   there. Two sets at the similarity share a child with chance 1 - 1/e whatever the data.
   A node of one class ends; one of up to `leaf_limit` classes is a leaf; a larger one
   splits again, down to `depth`, so that sets that share only a common passage part.
   Runs differ in their picks; their number comes from the target recall.
3. Leaves are compared by brute force, large ones in blocks of at most `block` classes a side.
   A pair is compared only in the first leaf it shares, which both sides can tell from their
   leaf lists. Sketches rule out far pairs; the pairs left are decided by the exact
   Jaccard similarity of the whole shingle sets, a matrix product per cell. A cell returns a
   row a class (number of links, smallest linked class), never its pairs.
4. Linked classes are joined to components by min-label rounds.

Copies of one text are one class, and the rows of a node or class that holds more than a
thousandth of all are joined where they are; those of a component's label are dealt out.

Result per document: doc_id, class_id (the smallest doc_id of its component), n_copies
(documents with its set), n_links (other documents at the similarity or above).

Defined cases: words are runs of non-blank ASCII; a text of one to four words has one
shingle, all of them; null, empty and blank texts have none and are copies of each other; null
doc_ids are kept (class_id is the smallest id that is not null); repeated rows are copies;
a very long text is one set of shingles, whole; an empty table gives no rows; other columns are
ignored, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, remove, salted_join, tidy, written

PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], n: int, known: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [(t or b"").split() for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    flat = np.fromiter((known[w] for own in words for w in own), np.uint64, int(ends[-1]))
    powers = [np.uint64(pow(PRIME, n - i, 1 << 64)) for i in range(n)]
    size = max(0, len(flat) - n + 1)
    rolled = np.zeros(size, np.uint64)
    for i, p in enumerate(powers):
        rolled += flat[i : i + size] * p
    rolled = mixed(rolled)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = np.array([sum(int(w) * pow(PRIME, i + 11, 1 << 64) for i, w in enumerate(flat[a:b])) & MASK], np.uint64)
            out.append(mixed(short))
        else:
            out.append(np.array([], np.uint64))
    return out


def sketch(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.uint32(0xFFFFFFFF))
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(top), 4096):
        low = np.minimum(low, (factors[:, None] * top[None, at : at + 4096] + shifts[:, None]).min(axis=1))
    return low


def sketcher(n: int, t: int, held: int):
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(2024)
        factors = (rng.integers(0, 1 << 32, t, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
        shifts = rng.integers(0, 1 << 32, t, dtype=np.uint32)
        known = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = shingle_sets(batch.column(1).slice(at, 256).cast(pa.binary()).to_pylist(), n, known)
                if len(known) > held:
                    known.clear()
                keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
                rows = [sketch(s, factors, shifts).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], schema=schema)

    return run


def setter(n: int):
    """(cid, set) of each text."""
    schema = pa.schema([("cid", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = shingle_sets(batch.column(0).slice(at, 256).cast(pa.binary()).to_pylist(), n, known)
                if len(known) > 400_000:
                    known.clear()
                blobs = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(b).digest() for b in blobs], pa.binary()), pa.array(blobs, pa.binary())], schema=schema)

    return run


def chooser(t: int, chance: float, runs: int):
    """Children of nodes: rows (node or null, cid, sketch) to (node, cid)."""
    schema = pa.schema([("node", pa.int64()), ("cid", pa.binary())])
    limit = int(chance * (1 << 32))
    places = np.arange(1, t + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)

    def picks(node: int) -> np.ndarray:
        return np.flatnonzero((mixed(places ^ np.uint64(node)) >> np.uint64(32)) < np.uint64(limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [int(mixed(np.array([(r + 1) * PRIME & MASK], np.uint64))[0]) for r in range(runs)]
        chosen: dict[int, np.ndarray] = {}
        for batch in batches:
            out, names = [], []
            for node, cid, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(data, np.uint32).astype(np.uint64)
                for parent in roots if node is None else [node & MASK]:
                    at = chosen.get(parent)
                    if at is None:
                        if len(chosen) > 200_000:
                            chosen.clear()
                        at = chosen[parent] = picks(parent)
                    if len(at):
                        out.append(mixed((values[at] + np.uint64(1)) * np.uint64(PRIME) ^ mixed(places[at] + np.uint64(parent))))
                        names += [cid] * len(at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(names, pa.binary())], schema=schema)

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first `keys` columns; the rows come sorted by them."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(own)


def to_compare(leaf: int, blocks: tuple[int, int], rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """A mask of the pairs that are this cell's own: the first shared leaf is this one,
    and the blocks differ or the pair is in order. rows: (block, leaves)."""
    at = np.array([r[0] for r in rows])
    fresh = shared_counts([np.array([x for x in r[1] if x < leaf], np.int64) for r in rows]) == 0
    if blocks[0] == blocks[1]:
        return np.triu(fresh, 1), at
    return fresh & (at[:, None] == blocks[0]) & (at[None] == blocks[1]), at


def near(sketches: np.ndarray, least: int) -> np.ndarray:
    """Whether two sketches (rows of bytes) agree in at least that many places."""
    n = len(sketches)
    out = np.empty((n, n), bool)
    for a in range(0, n, 16):
        out[a : a + 16] = (sketches[a : a + 16, None] == sketches[None]).sum(axis=2, dtype=np.int16) >= least
    return out


CELL = [("leaf", pa.int64()), ("p", pa.int32()), ("q", pa.int32())]


def prefilter(least: int):
    """Members of a cell that have a pair to compare in it."""
    schema = pa.schema([*CELL, ("block", pa.int32()), ("cid", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for (leaf, p, q), rows in groups(batches, 3):
            mask, _ = to_compare(leaf, (p, q), [(r[3], r[5]) for r in rows])
            if mask.any():
                mask &= near(np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1), least)
            for i in np.flatnonzero(mask.any(axis=0) | mask.any(axis=1)):
                held.append({"leaf": leaf, "p": p, "q": q, "block": rows[i][3], "cid": rows[i][4]})
            if len(held) > 5000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of incidence columns, 4,096 at a time, of
    the members that two sets or more have."""
    flat, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, inverse = owner[keep], column[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for a in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        lo, hi = np.searchsorted(inverse, [a, a + width])
        block = np.zeros((len(sets), min(width, int(inverse[-1]) + 1 - a)), np.float32)
        block[owner[lo:hi], inverse[lo:hi] - a] = 1
        total += block @ block.T
    return total


def comparer(similarity: float):
    """Links of a cell: per class its number of linked documents and smallest linked class."""
    schema = pa.schema([("cid", pa.binary()), ("links", pa.int64()), ("label", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for (leaf, p, q), rows in groups(batches, 3):
            mask, _ = to_compare(leaf, (p, q), [(r[3], r[5]) for r in rows])
            if not mask.any():
                continue
            sets = [np.frombuffer(r[7], np.uint64) for r in rows]
            both = shared_counts(sets)
            sizes = np.array([len(s) for s in sets], np.float64)
            linked = mask & (both >= similarity * (sizes[:, None] + sizes[None] - both) - 1e-6)
            linked |= linked.T
            if not linked.any():
                continue
            links = linked @ np.array([r[6] for r in rows], np.float64)
            rank = np.argsort(np.argsort([r[4] for r in rows]))
            labels = rank.copy()
            while True:
                low = np.where(linked, labels[None], len(rows)).min(axis=1)
                low = np.minimum(labels, low)
                if (low == labels).all():
                    break
                labels = low
            by_rank = {int(k): r[4] for k, r in zip(rank, rows, strict=True)}
            for i in np.flatnonzero(links):
                held.append({"cid": rows[i][4], "links": int(links[i]), "label": by_rank[int(labels[i])]})
            if len(held) > 5000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the similarity has met with chance `recall`: the chance of one
    run is that of a branching process with a mean of one child reaching the depth."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def leaves_of(classes: DataFrame, similarity: float, t: int, recall: float, depth: int, leaf_limit: int) -> DataFrame:
    """(leaf, cid, size): every node at which the recursion stops with two classes or more."""
    choose = chooser(t, 1 / (similarity * t), runs_for(recall, depth))
    sketched = classes.where("sketch is not null").select("cid", "sketch")
    active = sketched.select(F.lit(None).cast("long").alias("node"), "cid", "sketch")
    done, kept = None, []
    for level in range(1, depth + 1):
        rows = written(active.mapInArrow(tidy(choose), "node long, cid binary"), f"join-level{level}")
        sizes = written(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), f"join-sizes{level}")
        alive = written(hot_join(rows, sizes, "node", "size", rows.count()).select("node", "cid", "size"), f"join-alive{level}")
        remove(classes.sparkSession, rows.scratch_path, sizes.scratch_path)
        kept.append(alive.scratch_path)
        ended = alive if level == depth else alive.where(F.col("size") <= leaf_limit)
        done = ended if done is None else done.unionByName(ended)
        if level < depth:
            active = alive.where(F.col("size") > leaf_limit).join(sketched, "cid").select("node", "cid", "sketch")
    out = done.select(F.col("node").alias("leaf"), "cid", "size")
    out.scratch_paths = kept
    return out


def components(edges: DataFrame) -> DataFrame:
    """(cid, component): the smallest cid each can reach, by rounds of taking the neighbours'
    smallest label and then that label's own label, until no label moves. Labels only fall
    and each round halves the way to the smallest, so there is an end. The rows of a label that
    many classes have are dealt over several tasks."""
    spark = edges.sparkSession
    both = written(edges.unionByName(edges.select(F.col("label").alias("cid"), F.col("cid").alias("label"))).where("cid <> label").distinct(), "join-edges")
    labels = written(both.groupBy("cid").agg(F.least("cid", F.min("label")).alias("component")), "join-labels")
    while True:
        near_by = salted_join(both, labels.withColumnRenamed("cid", "label"), "label", "cid").groupBy("cid").agg(F.min("component").alias("low"))
        step = labels.join(near_by, "cid").select("cid", F.least("component", "low").alias("next"), "component")
        jump = step.select(F.col("cid").alias("next"), F.col("next").alias("further"))
        new = written(salted_join(step, jump, "next", "cid").select("cid", F.least("next", "further").alias("component"), (F.least("next", "further") != F.col("component")).alias("moved")), "join-labels")
        remove(spark, labels.scratch_path)
        labels = new.select("cid", "component")
        labels.scratch_path = new.scratch_path
        if not new.where("moved").limit(1).count():
            remove(spark, both.scratch_path)
            return labels


def join(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, t: int = 128, recall: float = 0.999, depth: int = 3, leaf_limit: int = 64, block: int = 1024, held_words: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_copies, n_links per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = written(rows.mapInArrow(tidy(sketcher(shingle, t, held_words)), "doc_id long, cid binary, sketch binary"), "join-sketches")
    classes = written(sketched.groupBy("cid").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("min_id"), F.any_value("sketch").alias("sketch")), "join-classes")
    leaves = leaves_of(classes, similarity, t, recall, depth, leaf_limit)
    lists = leaves.groupBy("cid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    info = written(lists.join(classes, "cid").select("cid", "leaves", "n_docs", "min_id", "sketch"), "join-members")
    # Cells: a leaf of up to `block` classes is one; a larger one is cut into blocks, and each
    # pair of blocks is a cell.
    parts = F.ceil(F.col("size") / block).cast("int")
    own = leaves.distinct().withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("cid", "leaf"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = own.select("leaf", "cid", "block", other.alias("o")).select("leaf", F.least("block", "o").cast("int").alias("p"), F.greatest("block", "o").cast("int").alias("q"), "block", "cid")
    bytes_of = F.expr(f"unhex(concat_ws('', transform(sequence(1, {t}), i -> substring(hex(sketch), 8 * i - 7, 2))))")
    light = cells.join(info.select("cid", "leaves", bytes_of.alias("bytes")), "cid").select("leaf", "p", "q", "block", "cid", "leaves", "bytes")
    least = math.floor((similarity - 4.3 * math.sqrt(similarity * (1 - similarity) / t)) * t)
    dealt = light.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q")
    needed = written(dealt.mapInArrow(tidy(prefilter(least)), "leaf long, p int, q int, block int, cid binary"), "join-needed")
    # Whole sets only for classes with a pair to compare: their documents are read again.
    wanted = needed.select("cid").distinct().join(info.select("cid", "min_id"), "cid").select("min_id").distinct()
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("min_id"))).select("text")
    sets = texts.mapInArrow(tidy(setter(shingle)), "cid binary, shingles binary").groupBy("cid").agg(F.any_value("shingles").alias("shingles"))
    full = needed.join(info.select("cid", "leaves", "n_docs"), "cid").join(sets, "cid")
    full = full.select("leaf", "p", "q", "block", "cid", "leaves", "n_docs", "shingles").repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q")
    found = written(full.mapInArrow(tidy(comparer(similarity)), "cid binary, links long, label binary"), "join-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = components(found.select("cid", "label"))
    named = classes.select("cid", "n_docs", "min_id").join(links, "cid", "left").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("min_id").alias("class_id"))
    out = written(salted_join(named, smallest, "component", "cid").select("cid", "class_id", F.col("n_docs").alias("n_copies"), (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "join-classes-named")
    remove(docs.sparkSession, classes.scratch_path, found.scratch_path, labels.scratch_path, needed.scratch_path, info.scratch_path, *leaves.scratch_paths)
    return hot_join(sketched.select("doc_id", "cid"), out, "cid", "n_copies", sketched.count()).select("doc_id", "class_id", "n_copies", "n_links")
