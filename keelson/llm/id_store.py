"""Token-id segments: a concatenated id array with Elias-Fano document boundaries.

A segment is one self-contained block of bytes:

    "KEF1" | id width (1 byte) | 7 zero bytes | n_docs u64 | n_null u64 | first doc_id i64
    | boundaries (Elias-Fano of n_docs + 1 offsets) | doc ids (Elias-Fano of id - first)
    | ids, 2 or 4 bytes each, little-endian

An Elias-Fano block of n ascending values below u keeps floor(log2(u / n)) low bits of each
value in a packed array and its high part as a 1 at position high + i of a bit vector, in
all about 2 + log2(u / n) bits a value. A directory with one 32-bit count per 512 bits of
the vector gives select(i), and so offset i, without a table of 64-bit offsets.

Segments are rows of a Parquet table in ascending doc_id order: Spark's committer writes
them to any store, whole or not at all, so a lost executor leaves no half file.

Defined cases: a null text is an empty one and has the end id alone; an added token written
out in a text is that token, by the library's default; a very long text is encoded whole and is
one document of a segment; null doc_ids come first; repeated doc_ids stand together, ordered by
their ids' bytes (of an id with more rows than a shard, by a digest of them first); an empty
table has no segments; other columns are ignored, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import gc
import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidy, written

MAGIC = b"KEF1"
BLOCK_BITS = 512
#: Where null ids stand: before all others.
NULL_ID = -(1 << 63)


class EliasFano:
    """An ascending sequence of whole numbers from 0; `at` gives any of them by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        u = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        top = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(top[-1]) + 1 if n else 1) // BLOCK_BITS) * BLOCK_BITS
        flags = np.zeros(size, np.uint8)
        flags[top] = 1
        counts = flags.reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.uint32)
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), ranks)

    def select(self, i: int) -> int:
        """Position of the 1 numbered i: the directory names the block, its bits the place."""
        block = int(np.searchsorted(self.ranks, i, "right")) - 1
        width = BLOCK_BITS // 8
        ones = np.flatnonzero(np.unpackbits(self.high[block * width : (block + 1) * width], bitorder="little"))
        return block * BLOCK_BITS + int(ones[i - int(self.ranks[block])])

    def at(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return ((self.select(i) - i) << self.low_bits) | ((chunk >> first % 8) & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        tops = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        lows = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (tops.astype(np.uint64) << np.uint64(self.low_bits)) | lows

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = struct.unpack_from("<QQQQ", data, at)
        at += 32
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        at += n_low + n_high
        n_ranks = n_high * 8 // BLOCK_BITS
        return cls(n, low_bits, low, high, np.frombuffer(data, np.uint32, n_ranks, at)), at + 4 * n_ranks


def pack_segment(doc_ids: list, blobs: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls (None) first; blobs: each document's ids of `width` bytes."""
    n_null = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    gaps = known.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)
    ends = np.cumsum([0, *(len(b) // width for b in blobs)], dtype=np.int64)
    head = MAGIC + bytes([width]) + bytes(7) + struct.pack("<QQq", len(doc_ids), n_null, first)
    return b"".join([head, EliasFano.of(ends).to_bytes(), EliasFano.of(gaps).to_bytes(), *blobs])


class Segment:
    """Reads a packed segment; `ids(i)` finds document i by two selects."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.width = data[4]
        self.n_docs, self.n_null, self.first = struct.unpack_from("<QQq", data, 12)
        self.bounds, at = EliasFano.read(data, 36)
        self.names, at = EliasFano.read(data, at)
        self.flat = np.frombuffer(data, f"<u{self.width}", offset=at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.names.at(i - self.n_null)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.bounds.at(i) : self.bounds.at(i + 1)]

    def doc_ids(self) -> list:
        known = self.names.all() + np.array(self.first, np.int64).astype(np.uint64)
        return [None] * self.n_null + known.astype(np.int64).tolist()


#: How a text is cut into chunks whose encodings do not depend on each other. The
#: pre-tokenizer never joins a non-space to white space after it, nor a letter or digit to a
#: full stop or comma, so a cut at such a place changes no token. Only ' ' and '\n' count as
#: white space here; a text with any other goes to the tokenizer in one piece. An added token
#: such as <|endoftext|> has no such place in it, so it stays in one chunk and becomes its own
#: id, as is the library's default.
CHUNK = re.compile(r"[ \n]?[^\W_]+(?=[ \n.,]|\Z)|[.,](?=[ \n]|\Z)|[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Chunks of one leading space or line end and no other: joined, they are one text whose
#: tokens fall apart again at the tokens that begin with that character.
ONE_SPACE = re.compile(r"[ \n][^ \n]+")
#: After these a full stop or comma is a token of its own.
STOPPED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def bare_model(lib):
    """The tokenizer's model alone. The pre-tokenizer does no more to words of A-Z and a-z than to part them before the
    spaces, and no token has a space after such a letter, so no merge goes across two of them: the model
    takes many at once. None where that does not hold, or where anything else may do more with such words."""
    from tokenizers import Tokenizer

    own = json.loads(lib.to_str())
    model, ahead = own["model"], own["pre_tokenizer"] or {}
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    plain = model["type"] == "BPE" and not any(model.get(k) for k in odd) and ahead.get("type") == "ByteLevel" and ahead.get("use_regex", True) and not ahead.get("add_prefix_space")
    if not plain or any(own.get(k) for k in ("normalizer", "truncation", "padding")) or any(re.fullmatch(r"[\w .,]*", t["content"]) for t in own["added_tokens"]) or any(re.search("[A-Za-z]\u0120", t) for t in model["vocab"]):
        return None
    return Tokenizer(lib.model)


class ChunkEncoder:
    """The tokenizers library behind a bounded table of chunks it has already encoded."""

    def __init__(self, path: str, held: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t[0] in "\u0120\u010a"]] = True
        self.held, self.chunks, self.parts = held, {}, {}
        # A text ends before an added token, and two line ends at an end are one token.
        self.cuts = ["\n\n" + t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.bare = bare_model(self.lib)
        self.stops = {c: self.raw([c])[0] for c in ".,"} if self.bare else {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, chunks: list[str]) -> list[bytes]:
        """Many one-space chunks in one call; one by one if the parts don't add up."""
        return self.apart(self.lib, "".join(chunks), len(chunks)) or self.raw(chunks)

    def words(self, words: list[str]) -> list[bytes]:
        """The same of words of A-Z and a-z with a space before each, by the model alone: \u0120 is its space."""
        return self.apart(self.bare, "\u0120" + "\u0120".join(words), len(words)) or self.raw([" " + w for w in words])

    def apart(self, lib, text: str, n: int) -> list[bytes] | None:
        """The ids of the text, cut before each token that begins with a space or line end; None if that are not n."""
        ids = np.array(lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) != n:
            return None
        flat, ends = ids.tobytes(), [*(cuts * self.width).tolist(), len(ids) * self.width]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def pieces(self, texts: list[str], clean: bool) -> list[bytes]:
        """Each text by its chunks; chunks not met before are encoded now. clean: no text has
        other white space."""
        cut = [CHUNK.findall(t) for t in texts] if clean else [[t] if OTHER_SPACE.search(t) else CHUNK.findall(t) for t in texts]
        new = set().union(*cut).difference(self.chunks)
        plain = [c for c in new if ONE_SPACE.fullmatch(c) and (clean or not OTHER_SPACE.search(c))]
        rest = list(new.difference(plain))
        own = dict(zip(rest, self.raw(rest), strict=True))
        for at in range(0, len(plain), 100):
            own.update(zip(plain[at : at + 100], self.together(plain[at : at + 100]), strict=True))
        if len(self.chunks) + len(own) <= self.held // 10:
            self.chunks.update(own)
            own = {}
        if not own:
            return [b"".join(map(self.chunks.__getitem__, parts)) for parts in cut]
        get, held = own.get, self.chunks.get
        return [b"".join([held(c) or get(c, b"") for c in parts]) for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts without other white space than single inner spaces and up to two line ends fall
        apart before each of these: the pre-tokenizer joins nothing across such a place. Arrow
        splits them and tells the distinct parts; Python looks up each of these once, and
        their ids are gathered in the order of the texts in one buffer."""
        even = [bool(t) and t[0] not in " \n" and t[-1] not in " \n" and "  " not in t and " \n" not in t and "\n " not in t and "\n\n\n" not in t and not any(c in t for c in self.cuts) and not OTHER_SPACE.search(t) for t in texts]
        at = [i for i, ok in enumerate(even) if ok]
        split = pc.split_pattern(pc.replace_substring(pa.array([texts[i] for i in at], pa.large_string()), "\n", " \n"), " ")
        bounds, words = split.offsets.to_numpy(), split.values
        out = texts.copy()
        for i, head in zip(at, words.take(pa.array(bounds[:-1])).to_pylist(), strict=True):
            out[i] = head
        out = self.pieces(out, False)
        parts = words.dictionary_encode()
        ids = pa.array(self.after_break(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
        flat = memoryview(ids.buffers()[2] or b"")
        for i, a, b in zip(at, ends[bounds[:-1] + 1].tolist(), ends[bounds[1:]].tolist(), strict=True):
            out[i] += flat[a:b]
        return out

    def after_break(self, parts: list[str]) -> list[bytes]:
        """The ids of each of the distinct parts with the space before it, or the line end that it
        begins with. The table grows up to `held` parts; what comes later is encoded for
        this call only."""
        get = self.parts.get
        out = list(map(get, parts))
        stopped = self.fill(out, parts)
        # A full stop or comma after a letter or digit is a token of its own: the word before it is what is looked up.
        words = [parts[i][:-1] for i in stopped]
        ids = list(map(get, words))
        self.fill(ids, words)
        for i, own in zip(stopped, ids, strict=True):
            out[i] = own + self.stops[parts[i][-1]]
        return out

    def fill(self, out: list, parts: list[str]) -> list[int]:
        """Encodes the parts that have no ids yet, and puts them in the table if it takes them all; returns which
        are left, as they end in a full stop or comma."""
        letters, rest, stopped, ends = [], [], [], tuple(self.stops)
        for i, ids in enumerate(out):
            if ids is None:
                p = parts[i]
                if self.bare and p.isascii() and p.isalpha():
                    letters.append(i)
                elif p.endswith(ends) and p[-2:-1] in STOPPED:
                    stopped.append(i)
                else:
                    rest.append(i)
        for a in range(0, len(letters), 200):
            some = letters[a : a + 200]
            for i, ids in zip(some, self.words([parts[i] for i in some]), strict=True):
                out[i] = ids
        for a in range(0, len(rest), 200):
            some = rest[a : a + 200]
            for i, ids in zip(some, self.together([p if (p := parts[i])[0] == "\n" else " " + p for i in some]), strict=True):
                out[i] = ids
        if len(self.parts) + len(letters) + len(rest) <= self.held:
            self.parts.update([(parts[i], out[i]) for own in (letters, rest) for i in own])
        return stopped


ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def worker_encoder(path: str, held: int) -> ChunkEncoder:
    """One encoder a Python worker, kept from task to task."""
    if (path, held) not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path, held] = ChunkEncoder(path, held)
    return ENCODERS[path, held]


def shards_of(ids: np.ndarray, blobs: list[bytes], bounds: np.ndarray) -> np.ndarray:
    """The shard of each document: the number of bounds up to its id. An id that is m bounds, so
    that it has about m shards of rows, is dealt over as many by a digest of the document's ids."""
    below, upto = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    out = upto.copy()
    for i in np.flatnonzero(upto - below > 1):
        out[i] = below[i] + 1 + zlib.crc32(blobs[i]) % (upto[i] - below[i])
    return out


def encoder(path: str, bounds: np.ndarray, end_id: int | None, held: int):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_encoder(path, held)
        end = b"" if end_id is None else end_id.to_bytes(own.width, "little")
        gc.disable()  # millions of short lists, none in a cycle
        try:
            for batch in batches:
                names, texts = batch.column(0), batch.column(1)
                for at in range(0, len(batch), 4096):
                    ids = names.slice(at, 4096)
                    blobs = [b + end for b in own.encode([t or "" for t in texts.slice(at, 4096).to_pylist()])]
                    shard = shards_of(ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False), blobs, bounds)
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, pa.array(blobs, pa.binary())], schema=schema)
        finally:
            gc.enable()

    return run


def packer(width: int, segment_ids: int):
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, names, blobs, held = None, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": number, "n_ids": held // width, "payload": pack_segment(names, blobs, width)}], schema=schema)

        for batch in batches:
            for s, d, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and (s != shard or held >= segment_ids * width):
                    yield closed()
                    number, names, blobs, held = number + 1 if s == shard else 0, [], [], 0
                shard = s
                names.append(d)
                blobs.append(b)
                held += len(b)
        if names:
            yield closed()

    return run


def write_ids(docs: DataFrame, tokenizer: str, end_id: int | None = 2, docs_per_shard: int = 4096, max_shards: int = 10_000, segment_ids: int = 1 << 20, held_chunks: int = 1_200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes their segments, ascending in doc_id; returns the table of
    segments (shard, segment, n_ids, payload) as read back from the shared folder.

    Shard bounds are quantiles of the ids, from a scan of the id column alone, so texts are
    encoded once and moved once, straight to the shard they belong to. There are at most
    max_shards of them, whatever the input; a shard is sorted with spilling and cut into segments
    of segment_ids ids, so its size bounds no memory.
    """
    from tokenizers import Tokenizer

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_shards = min(max_shards, max(1, math.ceil(rows.count() / docs_per_shard)))
    bounds = np.array([], np.int64)
    if n_shards > 1:
        shares = [i / n_shards for i in range(1, n_shards)]
        got = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NULL_ID)), shares, max(10_000, 20 * n_shards))).first()[0]
        bounds = np.sort(np.array(got or [], np.int64))
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    coded = rows.mapInArrow(tidy(encoder(tokenizer, bounds, end_id, held_chunks)), "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return written(dealt.mapInArrow(packer(width, segment_ids), "shard int, segment int, n_ids long, payload binary"), "id-segments")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for s, g, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Segment(payload)
            ends = own.bounds.all().astype(np.int64)
            crcs = [zlib.crc32(own.flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = own.n_docs
            yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.int32()), pa.array([g] * n, pa.int32()), pa.array(own.doc_ids(), pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], schema=schema)


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segments' bytes."""
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    # One row a shard, of which there is a bounded number; then within each shard.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_base"))
    bases = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own")).join(starts, "shard").select("shard", "segment", (F.col("shard_base") + F.col("own")).alias("base"))
    each = segments.select("shard", "segment", "payload").mapInArrow(digests, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return each.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
