"""Quality of whole texts by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has
a fixed descriptor (its class and a short code); learned filters of eight bytes, moved by
four, run over every chunk; their rectified outputs are max-pooled and averaged inside a
chunk. A learned layer turns these into a chunk score, and the mean, largest and smallest
chunk score are combined into one probability. All learned weights (filters and both layers) come from Adam
steps on log loss over a bounded labelled sample.

A text is processed in groups of chunks, so memory is bounded for a text of any length.

Defined cases: a null or empty text is one chunk of padding; null ids are not held out;
repeated rows score alike; without labelled rows of both classes the score is the
class's share, smoothed; a very long text is scored whole, in groups of chunks; an empty table gives
no rows; other columns are ignored, whatever their names, and `reject_low` keeps them. Ids are
whole numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tidy
from .labelled import sample

CHUNK, STRIDE, STEP, PAD = 384, 320, 4, 256


def descriptors() -> np.ndarray:
    """A row for each byte and one of zeros for padding: class flags and five code signs."""
    rows = np.zeros((257, 12), np.float32)
    for b in range(256):
        c = chr(b)
        flags = [97 <= b <= 122 or b >= 128, 65 <= b <= 90, 48 <= b <= 57, b in (32, 9), b in (10, 13), c in ".,;:!?'\"()-", 33 <= b <= 126 and not c.isalnum() and c not in ".,;:!?'\"()-"]
        code = [(b * m >> s & 1) * 2 - 1 for m, s in ((37, 3), (73, 5), (151, 4), (197, 6), (101, 2))]
        rows[b] = [*map(float, flags), *(0.5 * x for x in code)]
    return rows


def chunks_of(data: bytes) -> np.ndarray:
    """(number of chunks, CHUNK) byte values; the last is padded."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // STRIDE))
    flat = np.full((n - 1) * STRIDE + CHUNK, PAD, np.int16)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STRIDE]


class Network:
    def __init__(self, filters: int = 16, seed: int = 7, bias: float = 0.0):
        rng = np.random.default_rng(seed)
        self.bytes = descriptors()
        width = STEP * self.bytes.shape[1]
        self.w = {
            "first": rng.normal(0, 0.15, (width, filters)), "second": rng.normal(0, 0.15, (width, filters)), "shift": np.zeros(filters),
            "chunk": rng.normal(0, 0.3, 2 * filters), "chunk_shift": np.zeros(1), "join": np.array([1.0, 0.5, 0.5]), "bias": np.array([bias]),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.constant: float | None = None

    def convolved(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.bytes[chunks].reshape(len(chunks), CHUNK // STEP, -1)
        h = (x @ self.w["first"])[:, :-1] + (x @ self.w["second"])[:, 1:] + self.w["shift"]
        return x, np.maximum(h, 0, out=h)

    def chunk_scores(self, chunks: np.ndarray) -> np.ndarray:
        _, h = self.convolved(chunks)
        return np.tanh(np.hstack([h.max(axis=1), h.mean(axis=1)]) @ self.w["chunk"] + self.w["chunk_shift"])

    def joined(self, mean, high, low):
        j = self.w["join"].astype(np.float64) * 4
        return j[0] * mean + j[1] * high + j[2] * low + float(self.w["bias"][0])

    def score(self, texts: list[str | None], group: int = 512) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        parts, sizes = [chunks_of((t or "").encode()) for t in texts], []
        totals, highs, lows = (np.full(len(texts), v, np.float64) for v in (0.0, -2.0, 2.0))

        def flush(own: list) -> None:
            scores = self.chunk_scores(np.concatenate([p for _, p in own])).astype(np.float64)
            ends = np.cumsum([0, *(len(p) for _, p in own)])
            for (i, _), a, b in zip(own, ends[:-1], ends[1:], strict=True):
                totals[i] += scores[a:b].sum()
                highs[i], lows[i] = max(highs[i], scores[a:b].max()), min(lows[i], scores[a:b].min())

        own, held = [], 0
        for i, part in enumerate(parts):
            sizes.append(len(part))
            for at in range(0, len(part), group):
                own.append((i, part[at : at + group]))
                held += len(own[-1][1])
                if held >= group:
                    flush(own)
                    own, held = [], 0
        if own:
            flush(own)
        z = self.joined(totals / np.array(sizes, np.float64), highs, lows) if texts else np.array([])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def gradients(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        parts = [chunks_of(t.encode()) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x, h = self.convolved(np.concatenate(parts))
        top = h.argmax(axis=1)
        pooled = np.hstack([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)])
        s = np.tanh(pooled @ self.w["chunk"] + self.w["chunk_shift"])
        mean = np.add.reduceat(s, starts) / sizes
        at_high = np.array([a + s[a : a + n].argmax() for a, n in zip(starts, sizes, strict=True)])
        at_low = np.array([a + s[a : a + n].argmin() for a, n in zip(starts, sizes, strict=True)])
        z = self.joined(mean, s[at_high], s[at_low])
        dz = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        j = self.w["join"] * 4
        ds = (j[0] * dz / sizes)[owner].astype(np.float32)
        np.add.at(ds, at_high, j[1] * dz)
        np.add.at(ds, at_low, j[2] * dz)
        da = ds * (1 - s * s)
        dp = da[:, None] * self.w["chunk"]
        n = h.shape[2]
        dh = np.repeat(dp[:, None, n:] / h.shape[1], h.shape[1], axis=1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :n], 1)
        dh *= h > 0
        flat = dh.reshape(-1, n)
        return {
            "first": x[:, :-1].reshape(-1, x.shape[2]).T @ flat, "second": x[:, 1:].reshape(-1, x.shape[2]).T @ flat, "shift": flat.sum(0),
            "chunk": pooled.T @ da, "chunk_shift": da.sum(keepdims=True), "join": 4 * np.array([(dz * mean).sum(), (dz * s[at_high]).sum(), (dz * s[at_low]).sum()]), "bias": dz.sum(keepdims=True),
        }

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 5, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Network:
        share = float((np.sum(weight * y) + 0.5) / (np.sum(weight) + 1.0))
        own = cls(seed=seed, bias=float(np.log(share / (1 - share))))
        if len(set(y)) < 2:
            own.constant = share
            return own
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in own.w.items()} for _ in range(2))
        step = 0
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(texts), batch):
                pick = order[at : at + batch]
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in own.gradients([texts[i] for i in pick], y[pick], weight[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    own.w[k] = (own.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return own


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 12_000) -> Network:
    """Fits on at most per_class documents of each class, none over max_chars characters."""
    return Network.fit(*sample(docs, labels, "quality", per_class, max_chars))


def scorer(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for batch in batches:
            texts, scores = batch.column(1), []
            for at in range(0, len(batch), 256):
                scores += own.score(texts.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 at or above the threshold)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out("doc_id", 4).alias("held_out"))
    scored = rows.mapInArrow(tidy(scorer(pickle.dumps(network))), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_low(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """The documents at or above the threshold, with all their columns."""
    packed, at = pickle.dumps(network), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for batch in batches:
            texts, keep = batch.column(at), []
            for a in range(0, len(batch), 256):
                keep += [s >= threshold for s in own.score(texts.slice(a, 256).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
