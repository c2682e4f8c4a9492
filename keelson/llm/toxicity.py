"""Toxicity by a logistic model whose scores hold still when identity terms are swapped.

Features are words and word beginnings found in the labelled sample, in least_docs texts or more,
whose log-odds for the toxic class are over least_odds, and all identity terms. A model has at most
`most` of them, those that set the classes apart most; both are parameters of `fitted`. For every labelled text a counterfactual is made: its
identity terms replaced by others, or, where it has none, a neutral mention added. The fit
minimises log loss plus `penalty` times the squared change of the log-odds from text to
counterfactual, so that the mention of a group moves no score by itself.

Scoring reads each whole text once; a text's score depends on its set of features only. So does
the fit: the sample is bounded by rows, not by length. Its texts stay on the executors, which count
their features and then say which of the chosen ones each text has, so that what reaches
the driver does not grow with the texts.

Defined cases: a null or empty text scores as one without features; a very long one by its set
of features like any other; null ids are not
held out; repeated rows score alike; with no labelled rows (or one class only) the score is
that class's share, smoothed; an empty table gives no rows; other columns are ignored, whatever
their names, and `reject_toxic` keeps them. Ids are whole numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, remove, tidy, written
from .labelled import sampled, weights_of

#: Terms that name groups, swapped with each other.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees "
    "africans asians europeans americans arabs mexicans gays lesbians transgender disabled blind deaf elderly black white "
    "frauen juden muslime femmes juifs musulmans mujeres judíos musulmanes"
).split()
#: ASCII letters lowered, other ASCII to a space, the rest as it is.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BEGINNINGS = (4, 5, 6, 7)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def parts_of(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    import xxhash

    return [xxhash.xxh64_intdigest(p) for p in (word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n))]


class Parts(dict):
    """parts_of, remembered for up to `held` words."""

    def __init__(self, held: int):
        self.held = held

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.held:
            self.clear()
        own = self[word] = parts_of(word)
        return own


def features_of(words: list[bytes], known: Parts) -> np.ndarray:
    return np.unique(np.fromiter((p for w in set(words) for p in known[w]), np.uint64))


def counterfactual(words: list[bytes], n: int) -> list[bytes]:
    """Identity terms moved on to other ones; a mention added if there is none."""
    terms = [t.encode() for t in IDENTITY_TERMS]
    place = {t: i for i, t in enumerate(terms)}
    swapped = [terms[(place[w] + 1 + n) % len(terms)] if w in place else w for w in words]
    return swapped if swapped != words else [*words, terms[n % len(terms)]]


def columns(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones; names: the sorted features in use."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    keep = names[at] == flat
    return owner[keep], at[keep]


def identity_parts() -> np.ndarray:
    return np.array([parts_of(t.encode())[0] for t in IDENTITY_TERMS], np.uint64)


def prior_of(y: np.ndarray, w: np.ndarray) -> float:
    share = (np.sum(w * y) + 0.5) / (np.sum(w) + 1.0)
    return float(np.log(share / (1 - share)))


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, w: np.ndarray, penalty: float = 1.0, ridge: float = 0.01, steps: int = 400, rate: float = 0.05, least_docs: int = 4, most: int = 4000, least_odds: float = 2.0) -> Model:
        if len(set(y)) < 2:
            return cls({}, prior_of(y, w))
        known = Parts(100_000)
        seen = [features_of(words_of(t), known) for t in texts]
        own = y == 1
        n1, n0 = int(own.sum()), int((~own).sum())
        names, where = np.unique(np.concatenate(seen), return_inverse=True)
        toxic = np.repeat(own, [len(x) for x in seen])
        c1, c0 = (np.bincount(where[m], minlength=len(names)) for m in (toxic, ~toxic))
        odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        fit = np.flatnonzero((c1 + c0 >= least_docs) & (odds > least_odds))
        strong = names[fit[np.lexsort((names[fit], -odds[fit] * c1[fit]))[:most]]]
        index = np.unique(np.concatenate([strong, identity_parts()]))
        other = [features_of(counterfactual(words_of(t), i), known) for i, t in enumerate(texts)]
        return cls.solved(index, columns(seen, index), columns(other, index), y, w, penalty, ridge, steps, rate)

    @classmethod
    def solved(cls, index: np.ndarray, ones: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], y: np.ndarray, w: np.ndarray, penalty: float = 1.0, ridge: float = 0.01, steps: int = 400, rate: float = 0.05) -> Model:
        """ones, others: row and column numbers of the texts' and the counterfactuals' features in index."""
        (r, c), (r2, c2) = ones, others
        n, f = len(y), len(index)
        theta, b = np.zeros(f), prior_of(y, w)
        m, v = np.zeros(f + 1), np.zeros(f + 1)
        for step in range(1, steps + 1):
            z = b + np.bincount(r, theta[c], n)
            change = z - b - np.bincount(r2, theta[c2], n)
            loss = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            push = 2 * penalty * w * change / n
            g = np.bincount(c, (loss + push)[r], f) - np.bincount(c2, push[r2], f) + 2 * ridge * theta / n
            g = np.append(g, loss.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            theta, b = theta - move[:-1], b - move[-1]
        return cls({int(k): float(v) for k, v in zip(index, theta, strict=True) if abs(v) > 1e-6}, float(b))

    def score(self, text: str | None, known: dict | None = None) -> float:
        known = {} if known is None else known
        found: set[int] = set()
        for word in set(words_of(text)):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(p for p in parts_of(word) if p in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[p] for p in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scorer(packed: bytes, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = pickle.loads(packed), {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                scores.append(model.score(text, known))
                if len(known) > held:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y_, text_) to (y_, part): each feature of each text once."""
    known = Parts(100_000)
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = features_of(words_of(text), known).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array(own)], names=["y_", "part"])


def places(index: np.ndarray, numbers: dict):
    """(id_, text_) to (n, ones, others): the text's number and which of index it and its
    counterfactual have."""
    schema = pa.schema([("n", pa.int32()), ("ones", pa.list_(pa.int32())), ("others", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parts(100_000)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                ones, others = (columns([features_of(x, known)], index)[1].tolist() for x in (words, counterfactual(words, numbers[i])))
                rows.append({"n": numbers[i], "ones": ones, "others": others})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1500, penalty: float = 1.0, least_docs: int = 4, most: int = 4000, least_odds: float = 2.0) -> Model:
    """Model.fit on at most per_class documents of each class, whole and of any length."""
    rows, counts = sampled(docs, labels, "toxic", per_class)
    # One row an id: of repeated ids the text with the smallest hash.
    one = rows.groupBy("id_", "y_").agg(F.min(F.struct(F.xxhash64("text_").alias("h"), "text_")).alias("t")).select("id_", "y_", F.col("t.text_").alias("text_"))
    texts = written(one, "toxic-sample")
    got = sorted(tuple(r) for r in texts.select("id_", "y_").collect())
    y = np.array([v for _, v in got], np.float64)
    w = weights_of(y, counts)
    try:
        if len(set(y)) < 2:
            return Model({}, prior_of(y, w))
        n1, n0 = int(y.sum()), int((1 - y).sum())
        parts = texts.select("y_", "text_").mapInArrow(tidy(features), "y_ int, part long").groupBy("part").agg(F.sum("y_").alias("c1"), F.sum(1 - F.col("y_")).alias("c0"))
        odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
        fit = parts.where(F.col("c1") + F.col("c0") >= least_docs).withColumn("odds", odds).where(F.col("odds") > least_odds)
        # The sign bit turned: in the order of unsigned numbers.
        strong = fit.orderBy((F.col("odds") * F.col("c1")).desc(), F.col("part").bitwiseXOR(F.lit(-(1 << 63)))).limit(most).select("part").collect()
        index = np.unique(np.concatenate([np.array([r[0] for r in strong], np.int64).view(np.uint64), identity_parts()]))
        held = texts.select("id_", "text_").mapInArrow(tidy(places(index, {i: n for n, (i, _) in enumerate(got)})), "n int, ones array<int>, others array<int>").toPandas().sort_values("n")
    finally:
        remove(docs.sparkSession, texts.scratch_path)
    ones, others = ((np.repeat(held["n"].to_numpy(), held[k].map(len)), np.concatenate(held[k].to_list()).astype(np.int64)) for k in ("ones", "others"))
    return Model.solved(index, ones, others, y, w, penalty)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, held_words: int = 400_000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 at or above the threshold)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out("doc_id", 4).alias("held_out"))
    scored = rows.mapInArrow(tidy(scorer(pickle.dumps(model), held_words)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, held_words: int = 400_000) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    packed, at = pickle.dumps(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pickle.loads(packed), {}
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                keep.append(own.score(text, known) < threshold)
                if len(known) > held_words:
                    known.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
