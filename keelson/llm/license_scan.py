"""Licence notices in whole texts, exact phrases and short notices with a few errors.

The longer phrases are notices too, so that they are found misspelt after any words.

A text is reduced to its words (A-Z lowered; runs of ASCII letters, digits and anything
beyond ASCII), joined by single spaces. Exact phrases are found by their padded form. For
a notice with at most e edits, the notice is cut into e + 1 pieces: any place within e edits
holds one piece unchanged (pigeonhole), so exact hits of pieces give all candidate windows.
The regex library's bounded-error matching then verifies each window and yields the span
and its edits. Rows are independent: one pass, no shuffle.

Defined cases: a null text is empty: no words, no labels, score 0, null places; null ids
stay; repeated rows are scanned each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exact phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, their labels and the edits allowed.
NOTICES = (
    ("licensed under the apache license", "apache", 3),
    ("licensed under the gnu general public license", "gpl", 4),
    ("licensed under the gnu lesser general public license", "lgpl", 3),
    ("licensed under the gnu affero general public license", "agpl", 3),
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("licensed under cc by nd", "cc-by-nd", 1),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons zero", "cc0", 2),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("gnu general public license", "gpl", 2),
    ("apache license", "apache", 1),
)
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """The edits + 1 pieces, with their places in the notice."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(text: bytes, part: bytes, step: int = 1) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + step)


def overlap(x: tuple, y: tuple) -> bool:
    return y[1] < x[2] and x[1] < y[2]


def closest(found: list[tuple]) -> list[tuple]:
    """Of overlapping hits (label, from, to, edits) those with the fewest edits."""
    return [x for x in found if not any(y[3] < x[3] and overlap(x, y) for y in found)]


class Scanner:
    def __init__(self, phrases: dict = PHRASES, notices: tuple = NOTICES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.bare = {p.encode() for p in phrases}
        self.notices = []
        for notice, label, edits in notices:
            own = notice.encode()
            self.notices.append((own, label, edits, pieces(own, edits), regex.compile(b"(?b)(?:" + regex.escape(own, literal_spaces=True) + b"){e<=%d}" % edits)))

    def fuzzy(self, line: bytes) -> list[tuple[str, int, int, int]]:
        """(label, from, to, edits) of the notices in a padded line of words."""
        found = []
        for notice, label, edits, parts, pattern in self.notices:
            windows = sorted((max(0, at - before - edits), at - before + len(notice) + edits) for before, part in parts for at in places(line, part))
            done = -1
            for a, b in windows:
                a = max(a, done)
                while a < b and (m := pattern.search(line, a, b)):
                    found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), notice in self.bare))
                    done = a = max(m.end(), a + 1)
        # A bare phrase says no more than a notice of the same label around it.
        notices = closest([x[:4] for x in found if not x[4]])
        bare = [x[:4] for x in found if x[4] and not any(y[0] == x[0] and overlap(x, y) for y in notices)]
        return closest(notices + bare)

    def scan(self, doc_id: int | None, text: bytes | None) -> dict:
        words = (text or b"").translate(WORD_BYTES).split()
        line = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            for at in places(line, phrase):
                starts.append(line.count(b" ", 0, at))
                base.add(label)
        hits = self.fuzzy(line)
        labels = base | {h[0] for h in hits}
        score = 1.0 if base else max((1 - h[3] / (h[2] - h[1]) for h in hits), default=0.0)
        spans = [{"label": h[0], "first_word": line.count(b" ", 0, h[1] + 1) - 1, "last_word": line.count(b" ", 0, h[2]) - 1, "edits": h[3]} for h in hits]
        return {"doc_id": doc_id, "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(1.0, max(0.0, score)), "spans": spans}


def scanner(phrases: dict, notices: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(phrases, notices)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([own.scan(*r) for r in rows], schema=SCHEMA)

    return run


def scan_licenses(docs: DataFrame, phrases: dict = PHRASES, notices: tuple = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts and places of exact phrases, labels, a score, and the fuzzy spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"
    return rows.mapInArrow(scanner(phrases, notices), kinds)
