"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never replays merges. An Aho-Corasick automaton lists, for every position of a
piece, the tokens that start there. The encoder takes the longest one and keeps it if the
pair it forms with the token before is compatible: no merge that ranks before both could
join bytes across their border. Otherwise it tries the next shorter token, and after the
shortest it steps back one token and never enters that position again. Each position is
given up at most once, so the work is linear in the length of a piece, and the first
sequence of compatible pairs that reaches the end is the one the merges give.

Texts are first cut into special tokens and pieces, by the pattern of the vocabulary file; a
file that asks for another normaliser, pattern or model than the plain byte-level one is an
error. Pieces repeat a lot, so a worker remembers what it has encoded, up to ``MEMO`` bytes of
pieces no longer than ``KEEP`` letters, and ``PAIRS`` pairs, and then starts anew; this bounds
memory and changes no result. Rows go out in batches of about ``BATCH`` letters of text, and the
decoded text only on request, as its digest is what most jobs need.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the
empty text; rows with null or repeated ids, and equal rows, are encoded one by one; a table
without rows gives none. The operator reads the id and text columns by name, so further
columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of remembered pieces and their ids, with what Python adds to each; longest piece kept; pairs kept.
MEMO, KEEP, PAIRS = 56 << 20, 64, 1 << 18
#: Bytes that an entry of a table takes beside its key and its value.
ENTRY = 104
#: Letters of text whose rows go out together.
BATCH = 2 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
DECODED = ", decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves, the rest for letters from 256 on, in order.
    """
    plain = [b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    letters.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


def class_ranges(pattern: str, last: int) -> str:
    """The code points of a Unicode class, up to ``last``, as ranges for a character set of ``re``."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, last + 1)]))
    return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" if len(m[0]) > 1 else f"\\U{ord(m[0]):08x}"
                   for run in regex.finditer(f"{pattern}+", every) for m in _unbroken(run[0]))


def _unbroken(run: str) -> Iterator[tuple[str]]:
    """A run of letters, cut where the surrogates were left out."""
    if run[0] < "\ud800" and run[-1] > "\udfff":
        cut = next(i for i, c in enumerate(run) if c > "\udfff")
        yield (run[:cut],)
        yield (run[cut:],)
    else:
        yield (run,)


def piece_pattern(last: int = 0x10FFFF) -> str:
    """Contractions, words, numbers, other signs and white space, as byte-level vocabularies cut them.

    Holds for texts without code points above ``last``. ``re`` looks up code points of 16 bits in
    a bit map, but goes through the ranges above them one by one.
    """
    letter, digit, space = (class_ranges(name, last) for name in (r"\p{L}", r"\p{N}", r"\s"))
    return (f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")


def packed(left: int, right: int) -> int:
    return left << 32 | right


def _plain(read: dict) -> None:
    """Raises where the file asks for more than plain byte-level pairs."""
    cut = read.get("pre_tokenizer") or {}
    model = read["model"]
    asked = [name for name in ("normalizer", "post_processor") if read.get(name)]
    asked += [name for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
              if model.get(name)]
    asked += [flag for token in read["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized") if token.get(flag)]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        asked.append("pre_tokenizer")
    if asked:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(sorted(set(asked)))}")


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        read = json.loads(source)
        _plain(read)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = read["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in read["model"]["merges"]]
        #: Two tokens that merge, packed in one number: the rank of the merge.
        self.rank_of = {packed(ids[a], ids[b]): k for k, (a, b) in enumerate(pairs)}
        #: Token: rank of the merge that makes it, and its two parts. Bytes have none.
        self.made_by = {ids[a + b]: (k, ids[a], ids[b]) for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})

    def automaton(self):
        """Of all tokens longer than a byte; a single byte needs no search."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if i not in self.special.values() and len(b) > 1:
                found.add_word(b.decode("latin-1"), (len(b), i))
        found.make_automaton()
        return found


class Encoder:
    """Encodes whole texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        import re

        self.words = vocabulary
        self.matches = vocabulary.automaton().iter
        byte_ids = {b: i for i, b in vocabulary.bytes_of.items() if len(b) == 1}
        self.single = [(1, byte_ids[bytes([b])]) for b in range(256)]
        self.compatible: dict[int, bool] = {}
        self.cut_basic = re.compile(piece_pattern(0xFFFF)).findall
        self.cut_any = re.compile(piece_pattern()).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        special = sorted(map(re.escape, vocabulary.special), key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(special)})").split if special else None
        self.memo = _Memo(self)

    def pair(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side.

        Undo, step by step, the later of the two merges next to the border. If at some step
        the tokens at the border have a merge of their own that comes before the merge just
        undone, it would have been done first, and the pair cannot stand.
        """
        made_by, rank_of = self.words.made_by, self.words.rank_of
        # Merges of equal rank happen from left to right: a merge on the right of the border
        # gives way to one across it of the same rank, a merge on the left does not.
        a, b, before, fits = left, right, float("inf"), True
        while True:
            across = rank_of.get(packed(a, b))
            if across is not None and across < before:
                fits = False
                break
            rank_a, rank_b = made_by.get(a, (-1,))[0], made_by.get(b, (-1,))[0]
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                before, a = rank_a, made_by[a][2]
            else:
                before, b = rank_b + 0.5, made_by[b][1]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[packed(left, right)] = fits
        return fits

    def cut(self, text: str) -> list[str]:
        return (self.cut_any if self.beyond(text) else self.cut_basic)(text)

    def piece(self, piece: bytes) -> bytes:
        single = self.single
        starting: list[list[tuple[int, int]]] = [[single[b]] for b in piece]
        for end, (length, token) in self.matches(piece.decode("latin-1")):
            starting[end - length + 1].append((length, token))  # rising length
        known = self.compatible.get
        taken: list[int] = []
        at, ends = 0, len(piece)
        path = [0]  # start of each taken token, then the position reached
        dead: set[int] = set()
        while at < ends:
            for length, token in reversed(starting[at]):
                if at + length in dead:
                    continue
                if taken:
                    fits = known(taken[-1] << 32 | token)
                    if fits is None:
                        fits = self.pair(taken[-1], token)
                if not taken or fits:
                    taken.append(token)
                    at += length
                    path.append(at)
                    break
            else:
                dead.add(at)
                path.pop()
                taken.pop()
                at = path[-1]
        return struct.pack(f"<{len(taken)}I", *taken)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        if self.specials is None or not any(t in text for t in self.words.special):
            return self.plain(text)
        return b"".join(np.array([self.words.special[part]], "<u4").tobytes() if part in self.words.special
                        else self.plain(part) for part in self.specials(text))


class _Memo(dict):
    """Piece to its ids, for pieces of up to ``KEEP`` letters, within ``MEMO`` bytes."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.held = encoder, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.piece(piece.encode())
        if len(piece) <= KEEP:
            size = getsizeof(piece) + getsizeof(ids) + ENTRY
            if self.held + size > MEMO:
                self.clear()
                self.held = 0
            self.held += size
            self[piece] = ids
        return ids


class Decoder:
    """All tokens' bytes in one array, and where each token starts in it."""

    def __init__(self, vocabulary: Vocabulary):
        most = max(vocabulary.bytes_of, default=-1) + 1
        tokens = [vocabulary.bytes_of.get(i, b"") for i in range(most)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4")
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        before = np.cumsum(lengths) - lengths
        where = np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
        return self.bytes[where].tobytes().decode("utf-8", "replace")


def encode_texts(docs: DataFrame, source: str, id_column: str = "doc_id", text_column: str = "text",
                 with_decoded: bool = False) -> DataFrame:
    """Per row: ids (little-endian unsigned 32-bit), their number, digests, and the decoded text on request.

    ``source`` is the JSON text of the vocabulary file, so that executors need not find it;
    its size is that of one vocabulary.
    """
    # A worker process holds a broadcast value as long as it lives, so the first of its tasks puts
    # the tables built from the file in its place, and later tasks find them and what was remembered.
    shared = docs.sparkSession.sparkContext.broadcast([source])
    schema = SCHEMA + (DECODED if with_decoded else "")
    names = [column.split()[0] for column in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if len(held) == 1:
            vocabulary = Vocabulary(held.pop())
            held += [Encoder(vocabulary), Decoder(vocabulary)]
        encoder, decoder = held
        for part in parts:
            for at, end in _stretches(part.column(1)):
                ids, digests, decoded = [], [], []
                for text in part.column(1).slice(at, end - at):
                    ids.append(encoder.encode(text.as_py() or ""))
                    back = decoder.decode(ids[-1])
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_decoded:
                        decoded.append(back)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).slice(at, end - at),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array(digests, pa.string()), pa.array(ids, pa.binary()),
                    *([pa.array(decoded, pa.string())] if with_decoded else [])], names)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        batches, schema)


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last position of runs of texts with about ``BATCH`` letters, one text at least."""
    at, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= BATCH:
            yield at, end
            at, size = end, 0
    if at < len(texts):
        yield at, len(texts)
