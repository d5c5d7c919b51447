"""Fuzzy search for short licence notices: exact seeds locate, bounded-error matching verifies.

A text is lower-cased (A-Z), its words are joined by single spaces, and a notice is looked
for as its words joined the same way, between word borders. With at most ``k`` edits, one of
``k + 1`` pieces of the notice must occur unchanged, at most ``k`` places away from where the
notice would put it. So every occurrence of a piece opens a small window, overlapping windows
are merged, and the ``regex`` library searches each with its bounded-error matching for the
notice with up to ``k`` edits. ``k`` grows with the notice: one edit for every ``EDIT_EVERY``
letters, none for notices shorter than that.

Base labels come from notices found without an edit, all places counted. The method's own
labels are ``near-<label>``, for a notice found with one to ``k`` edits, at whole words, where
no place of the same notice without an edit overlaps.

Defined results: a null or empty text has no words, no labels and score 0; rows with null or
repeated ids, and equal rows, are scanned one by one; a table without rows gives none. The id
and text columns are read by name, so further columns are ignored. Whole texts are scanned;
spans tie by start, then by label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Notice, label.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
EDIT_EVERY = 8
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,word:long,n_words:long,edits:int>>")


class Scanner:
    """Finds notices in one text after the other."""

    def __init__(self, notices=NOTICES, edit_every: int = EDIT_EVERY):
        import regex

        # Word bytes: digits, small letters, and all bytes of letters beyond ASCII.
        self.table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                           for b in range(256))
        self.notices = []
        for notice, label in notices:
            body, edits = notice.encode(), len(notice) // edit_every
            search = regex.compile(rb"(?e)(?<= )(?:%b){e<=%d}(?= )" % (regex.escape(body), edits)).finditer
            self.notices.append((body, label, edits, pigeonholes(body, edits + 1), search))

    def words(self, text: str) -> tuple[bytes, int]:
        """The words between single spaces, a space on either side; and how many."""
        words = text.encode().translate(self.table).split()
        return b" %b " % b" ".join(words) if words else b" ", len(words)

    def scan(self, line: bytes) -> list[tuple[int, int, int, str]]:
        """Start, end, edits and label of every notice found, by start and label."""
        found = []
        for body, label, edits, seeds, search in self.notices:
            exact = [(at + 1, at + 1 + len(body)) for at in places(line, b" %b " % body)]
            found += [(a, z, 0, label) for a, z in exact]
            if edits:
                for a, z in windows(line, body, seeds, edits):
                    for m in search(line, a, z):
                        n = sum(m.fuzzy_counts)
                        if n and b" " not in (m[0][:1], m[0][-1:]) and not any(
                                x < m.end() and m.start() < y for x, y in exact):
                            found.append((m.start(), m.end(), n, label))
        return sorted(found, key=lambda f: (f[0], f[3]))


def pigeonholes(body: bytes, parts: int) -> list[tuple[int, bytes]]:
    """A notice cut into pieces of about equal length, each with its place."""
    cuts = [len(body) * i // parts for i in range(parts + 1)]
    return [(a, body[a:z]) for a, z in zip(cuts, cuts[1:])]


def places(line: bytes, what: bytes) -> Iterator[int]:
    """All places of ``what``, overlapping ones too."""
    at = line.find(what)
    while at >= 0:
        yield at
        at = line.find(what, at + 1)


def windows(line: bytes, body: bytes, seeds: list[tuple[int, bytes]], edits: int) -> list[tuple[int, int]]:
    """Merged stretches of the line that can hold the notice with so many edits, and a byte around them."""
    around = sorted((max(0, at - place - edits - 1), min(len(line), at - place + len(body) + edits + 1))
                    for place, seed in seeds for at in places(line, seed))
    merged: list[list[int]] = []
    for a, z in around:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    return [(a, z) for a, z in merged]


def scan_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               notices=NOTICES, edit_every: int = EDIT_EVERY) -> DataFrame:
    """Per row: number of words, places and labels of notices, and their spans in words.

    The score is that of the best notice found: 1 less its edits for each letter of the span, 0 without one.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, edit_every)
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                line, n_words = scanner.words(text.as_py() or "")
                found = scanner.scan(line)
                spans = [{"label": label if not n else f"near-{label}", "word": line.count(b" ", 0, a) - 1,
                          "n_words": line.count(b" ", a, z) + 1, "edits": n} for a, z, n, label in found]
                base = [s for s in spans if not s["edits"]]
                rows.append({
                    "doc_id": doc_id, "n_words": n_words, "n_base": len(base),
                    "first_word": min((s["word"] for s in base), default=None),
                    "last_word": max((s["word"] for s in base), default=None),
                    "base_labels": ",".join(sorted({s["label"] for s in base})),
                    "labels": ",".join(sorted({s["label"] for s in spans})),
                    "score": max((1 - n / (z - a) for a, z, n, _ in found), default=0.0), "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        batches, SCHEMA)


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()),
                                  ("edits", pa.int32())])))])
