"""SentencePiece encoding by a streaming Viterbi, and decoding.

The best segmentation is the one with the largest sum of piece scores. The encoder goes
through a text once, one character at a time, and keeps only what can still matter: scores and
back pointers since the last boundary through which all surviving paths run. The ids up to such
a boundary are final and leave the window, so the window is bounded by twice the longest piece
and the distance between such boundaries, whatever the text's length.

All text goes through this one encoder. Where no piece has a meta symbol after another character,
all paths meet before every word; words recur, so the ids of words that it has been through
are kept in a bounded table.

Scores are whole numbers in models whose scores are ranks; sums are exact in 64-bit floats.
Ties go to the path whose last piece is longest. A character in no piece becomes its bytes
(byte fallback) at the lowest score less 10, or the unknown id in a model without byte pieces.

Defined cases: a null text is an empty one and has no ids; a very long text is one like any other; white space is kept as it is, spaces
as the meta symbol, with one put before the text; null ids stay; repeated rows are coded
each; an empty table gives no rows; other columns are kept by `encode_column`.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces and scores of a SentencePiece model, read by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: lib.get_score(i) for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = lib.unk_id()
        self.lost = min(self.scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: The prefix tree: by character the score (None if no piece ends there), ids, and children.
        self.tree: dict = {}
        for piece, i in sorted(self.ids.items()):
            level = self.tree
            for c in piece[:-1]:
                level = level.setdefault(c, [None, (), {}])[2]
            node = level.setdefault(piece[-1], [None, (), {}])
            node[0], node[1] = self.scores[piece], (i,)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]


def streamed(vocabulary: Vocabulary, chars: Iterable[str]) -> Iterator[list[int]]:
    """Lists of final ids, in order, as soon as all surviving paths agree on them.

    The window holds, for its place 0 .. n, the best score of a path to it, where its last piece
    began and that piece's ids. A path survives if it ends at the last place, or at one from
    which the text since is the beginning of a piece. Where the last place is the only one, all
    paths meet there; else their common ancestor is looked for once the window is twice as
    long as the longest piece, and again whenever it has doubled, so that a text on which paths
    never meet (a long run of one letter) takes time in proportion to its length.
    """
    tree, lost, longest = vocabulary.tree, vocabulary.lost, vocabulary.longest
    score, back, held = [0.0], [0], [()]
    alive: list[tuple[int, dict]] = []
    n, look = 0, 2 * longest

    def ids_to(to: int) -> list[int]:
        parts = []
        while to:
            parts.append(held[to])
            to = back[to]
        return [i for own in reversed(parts) for i in own]

    for char in chars:
        best, at, own, left = -np.inf, n, (), []
        # From the longest last piece down: the first of equal sums is the longest.
        for a, children in alive:
            node = children.get(char)
            if node is not None:
                value, ids, more = node
                if value is not None and score[a] + value > best:
                    best, at, own = score[a] + value, a, ids
                if more:
                    left.append((a, more))
        value, ids, more = tree.get(char, (None, (), None))
        if value is None:
            value, ids = lost, vocabulary.fallback(char)
        if more:
            left.append((n, more))
        if score[n] + value > best:
            best, at, own = score[n] + value, n, ids
        n += 1
        alive = left
        if not alive:
            held.append(own)
            back.append(at)
            yield ids_to(n)
            score, back, held, n, look = [0.0], [0], [()], 0, 2 * longest
            continue
        score.append(best)
        back.append(at)
        held.append(own)
        if n >= look:
            ends = {n, *(a for a, _ in alive)}
            while len(ends) > 1:
                last = max(ends)
                ends.remove(last)
                ends.add(back[last])
            meet = ends.pop()
            if meet:
                yield ids_to(meet)
                base = score[meet]
                score, held = [x - base for x in score[meet:]], held[meet:]
                back = [max(0, b - meet) for b in back[meet:]]
                alive, n = [(a - meet, more) for a, more in alive], n - meet
            look = max(2 * longest, 2 * n)
    if n:
        yield ids_to(n)


class Codec:
    def __init__(self, path: str, held: int = 500_000):
        self.vocabulary = Vocabulary(path)
        self.held, self.known = held, {}
        # The common case: no piece has a meta symbol after another character, so all paths
        # meet before every word.
        self.by_space = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.vocabulary.inside)

    def word(self, text: str) -> bytes:
        """A stretch that no piece leaves, through the stream."""
        out = array("I")
        for ids in streamed(self.vocabulary, text):
            out.extend(ids)
        return out.tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """`encode` of each; words not met before are kept for the next while there is room."""
        if not self.by_space:
            return [self.encode(t) for t in texts]
        known, word = self.known, self.word
        here = set().union(*(t.split(" ") for t in texts if t))
        new = {w: word(SPACE + w) for w in here.difference(known)}
        if len(known) + len(new) <= self.held:
            known.update(new)
            return [self.encode(t) for t in texts]
        kept, self.known = known, {w: known[w] for w in here.intersection(known)} | new
        out = [self.encode(t) for t in texts]
        self.known = kept
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        known = self.known
        if not self.by_space:
            return self.word(SPACE + text.replace(" ", SPACE))
        # Parts after a single space are words; a longer run of spaces stays with its word.
        if text[0] == " " or text[-1] == " " or "  " in text:
            return b"".join([known[w[1:]] if w[1:] in known and w[0] == SPACE else self.word(w) for w in WORDS.findall(SPACE + text.replace(" ", SPACE))])
        parts = text.split(" ")
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            return b"".join([known[p] if p in known else self.word(SPACE + p) for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        v, out = self.vocabulary, bytearray()
        for i in ids.tolist():
            out += bytes([v.byte_of[i]]) if i in v.byte_of else v.pieces[i].replace(SPACE, " ").encode()
        text = out.decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


CODECS: dict[tuple[str, int], Codec] = {}


def worker_codec(path: str, held: int) -> Codec:
    """One codec a Python worker, kept from task to task."""
    if (path, held) not in CODECS:
        CODECS.clear()
        CODECS[path, held] = Codec(path, held)
    return CODECS[path, held]


def encode_column(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", held: int = 800_000) -> DataFrame:
    """The documents with their ids (array of int) in a column ids_col, replacing one of that
    name."""
    base = docs.drop(ids_col)
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_codec(model, held)
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                coded = own.encode_all(part.column(at).to_pylist())
                ends = np.cumsum([0, *(len(b) // 4 for b in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    return base.mapInArrow(tidy(run), T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_column(coded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the decoded text in a column text_col."""
    base = coded.drop(text_col)
    at = base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(model, 0)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", held: int = 800_000) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding gives the text back, per document.

    The round trip is checked on the pieces' text: ids are decoded stretch by stretch.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_codec(model, held)
        v = own.vocabulary
        table = np.array([bytes([v.byte_of[i]]) if i in v.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)], object)
        for batch in batches:
            for a in range(0, len(batch), 1024):
                texts = batch.column(1).slice(a, 1024).to_pylist()
                coded = own.encode_all(texts)
                back = [b"".join(table[np.frombuffer(c, "<u4")].tolist()) for c in coded]
                good = [b[1:] == (t or "").encode() for b, t in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1024), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(good)], schema=schema)

    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
