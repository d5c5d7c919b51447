"""Removal of passages that an earlier document holds, by compaction of a De Bruijn graph of words.

A window is ``WINDOW`` consecutive words of one document. Nodes of the graph are runs of
``WINDOW - 1`` words, known by a 64-bit hash; a window is the edge between the two nodes it is
made of, so 128 bits tell windows apart. Only windows that occur in more than one document are
edges.

0. Copies. A document equal in all bytes (by a 128-bit digest) to an earlier one is covered whole if
   it has a window at all, and takes no part in the steps below; neither side loses a
   window by that, as the earlier one has them all. The others are numbered in order of id, so a word's
   place anywhere is one whole number: the document's number and the position in it.
1. Anchors. Of the ``WINDOW - GRAM + 1`` shingles of ``GRAM`` words in a window, the one with the
   least hash is its anchor, so equal windows have equal anchors, and neighbouring windows mostly
   share one: there are about a fifth as many anchors as windows. Anchors are counted with partial
   sums; a window whose anchor stands in one document only repeats nowhere, and goes no further.
2. Runs. Documents that hold repeated anchors meet their positions, and give the nodes of each run
   of windows under them, as one array.
3. Edges. Windows are grouped with partial results; those of more than one document keep their
   source: the first place where they stand.
4. Compaction. A node with more than one edge in or out is a branch. A join brings the branches
   to the edges of each source, and edges that follow each other there without a branch between
   them become one path, cut after ``PATH`` edges. A path has source coordinates.
5. Occurrences. The runs meet the edges again; windows of a later document become spans of a
   path, one row for each path and place.
6. Verification. Each path brings its words from its source, once. A document meets the words of
   its spans, compares them with its own word by word, and only words that equal the source's
   are removed. So no hash decides alone what is removed.

Joins on windows, anchors and paths have nothing above them that needs a key's rows together, so
adaptive execution can split a passage that a third of all documents share. What is gathered for a document is bounded by
its words.

Defined results: a null text, or one without words, has 0 words and the digest of the empty text;
texts of fewer than ``WINDOW`` words stay as they are. A null id comes after all ids, and null ids,
like equal ids, are not before each other, so rows that repeat an id remove nothing from each
other; rows equal in id and text get the same result. Windows are judged on the input: a passage stays in the first
document that holds it, also where that document loses other words. An empty table gives no rows.
The id and text columns are read by name, so further columns are ignored. Texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ranking import with_position
from .near_dedup import Shingler, mix
from .shared import Scratch

WINDOW, GRAM = 13, 5
#: Most edges of a path: bounds the words that a row brings from its source.
PATH = 256
#: Letters of text whose rows go out together.
BATCH = 4 << 20
LAST = (1 << 63) - 1
DOC = ["id", "x"]
#: Bits of a place for the position in a document; the rest are its number.
BITS = 27
_SPREAD = np.random.default_rng(5).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))


# Hashes of words and their runs ------------------------------------------------------


def word_hashes(shingler: Shingler, text: bytes) -> np.ndarray:
    """A hash of each word, over stretches of about a megabyte."""
    data, parts, at = text.translate(_BLANKS), [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", min(at + shingler.stretch, len(data)))
        end = len(data) if end < 0 else end
        parts.append(shingler._words(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    total = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for i in range(n if len(total) else 0):
        total += words[i:len(words) - n + 1 + i] * _SPREAD[i]
    return mix(total)


def anchors_of(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its hash, the first window it stands for, and how many consecutive ones."""
    found, wide = grams(words, gram), window - gram + 1
    n = len(found) - wide + 1
    if n < 1:
        return found[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = found[:n].copy(), np.arange(n)
    for i in range(1, wide):  # ties go to the left
        smaller = found[i:n + i] < least
        least[smaller] = found[i:n + i][smaller]
        at[smaller] = np.flatnonzero(smaller) + i
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return found[at[first]], first, np.diff(np.append(first, n))


# Steps in Python, a batch of texts at a time -----------------------------------------


def _stretches(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``BATCH`` letters, one row at least."""
    at, size = 0, 0
    for end, text in enumerate(part.column(column), 1):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= BATCH:
            yield part.slice(at, end - at)
            at, size = end, 0
    if at < part.num_rows:
        yield part.slice(at)


def find_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``id, x, digest, anchors`` (hashes) and ``spans`` (16 times the first window, plus the number of windows)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in parts:
            for part in _stretches(whole, 2):
                rows, digests, hashes, spans = [], [], [], []
                for i, text in enumerate(part.column(2)):
                    data = text.as_buffer().to_pybytes()
                    found, first, n = anchors_of(word_hashes(shingler, data), window, gram)
                    if len(found):
                        rows.append(i)
                        digests.append(hashlib.md5(data).digest())
                        hashes.append(found.view(np.int64))
                        spans.append(first * 16 + n)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)),
                    pa.array(digests, pa.binary()), pa.array(hashes, kind), pa.array(spans, kind)],
                    ["id", "x", "digest", "anchors", "spans"])

    return docs.where("text IS NOT NULL").mapInArrow(
        batches, "id long, x long, digest binary, anchors array<long>, spans array<long>")


def find_runs(docs: DataFrame, window: int) -> DataFrame:
    """``d, text, spans`` to ``place, nodes``: runs of windows, and the nodes that they go through."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in parts:
            for part in _stretches(whole, 1):
                places, runs = [], []
                for d, text, spans in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    nodes = grams(word_hashes(shingler, text.as_buffer().to_pybytes()), window - 1).view(np.int64)
                    if len(nodes) >> BITS:
                        raise ValueError(f"a text has more than {1 << BITS} words")
                    spans = np.array(spans.as_py(), np.int64)
                    spans.sort()
                    first, end = spans >> 4, (spans >> 4) + (spans & 15)
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
                    for a, z in zip(first[new], end[np.append(new[1:], len(first)) - 1]):
                        places.append((d << BITS) + int(a))
                        runs.append(nodes[a:z + 1])
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(runs, pa.list_(pa.int64()))],
                                                 ["place", "nodes"])

    return docs.mapInArrow(batches, "place long, nodes array<long>")


def path_words(docs: DataFrame, window: int) -> DataFrame:
    """``text, paths`` (start and edges) to ``start, words``, each path's words with blanks between."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _stretches(whole, 0):
                starts, found = [], []
                for text, paths in zip(part.column(0), part.column(1)):
                    words = text.as_buffer().to_pybytes().split()  # at the six white-space bytes
                    for path in paths.as_py():
                        at = path["start"] & ((1 << BITS) - 1)
                        starts.append(path["start"])
                        found.append(b" ".join(words[at:at + path["edges"] + window - 1]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(found, pa.string())], ["start", "words"])

    return docs.mapInArrow(batches, "start long, words string")


def covered(words: list[bytes], spans: list[dict], window: int) -> np.ndarray:
    """Which words lie in a window whose words the source has too."""
    gone = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        theirs, at = span["words"].encode().split(b" "), span["at"]
        same = np.array([a == b for a, b in zip(words[at:at + len(theirs)], theirs)], np.int64)
        whole = np.convolve(same, np.ones(window, np.int64), "valid") == window if len(same) >= window else np.zeros(0, bool)
        for i in span["windows"]:
            if i < len(whole) and whole[i]:
                gone[at + i] += 1
                gone[at + i + window] -= 1
    return np.cumsum(gone)[:-1] > 0


def remove_words(docs: DataFrame, window: int, with_kept: bool) -> DataFrame:
    """``doc_id, text, spans, whole`` to the texts without the covered words: counts, digest, and the words on request."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_kept else "")
    names = [column.split()[0] for column in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _stretches(whole, 1):
                sizes, removed, digests, kept = [], [], [], []
                for text, spans, copy in zip(part.column(1), part.column(2), part.column(3)):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    sizes.append(len(words))
                    if copy.as_py():
                        words = []
                    elif spans.is_valid:
                        gone = covered(words, spans.as_py(), window)
                        words = [word for word, out in zip(words, gone) if not out]
                    removed.append(sizes[-1] - len(words))
                    digests.append(hashlib.sha256(left := b" ".join(words)).hexdigest())
                    if with_kept:
                        kept.append(left.decode())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if with_kept else [])], names)

    return docs.mapInArrow(batches, schema)


# The graph ---------------------------------------------------------------------------


def doc_of(place: Column) -> Column:
    return F.shiftright(place, BITS)


def position_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << BITS) - 1))


def numbered(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``id, x, d`` of the documents that are no copy of an earlier one, numbered by id, and ``id, x`` of the copies."""
    rows = found.select(*DOC, "digest")
    classes = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(
        F.col("digest").alias("same"), "least")
    marked = scratch.write(rows.join(classes, F.col("digest") == F.col("same"), "left").select(
        *DOC, F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copy")).distinct(), "marked")
    firsts = with_position(marked.where("NOT copy").select(*DOC), DOC, "d")
    fits = F.when(F.col("d") < 1 << (63 - BITS), F.col("d")).otherwise(F.raise_error(F.lit("too many documents")).cast("long"))
    return scratch.write(firsts.select(*DOC, fits.alias("d")), "numbered"), marked.where("copy").select(*DOC)


def windows_of(runs: DataFrame) -> DataFrame:
    """``place, a, b``: an edge for each window of the runs."""
    n = F.size("nodes") - 1
    edges = F.arrays_zip(F.slice("nodes", F.lit(1), n).alias("a"), F.slice("nodes", F.lit(2), n).alias("b"))
    return runs.select("place", F.posexplode(edges).alias("i", "edge")).select(
        (F.col("place") + F.col("i")).alias("place"), F.col("edge.a").alias("a"), F.col("edge.b").alias("b"))


def repeated_edges(runs: DataFrame) -> DataFrame:
    """``a, b, source``: windows of more than one document, and the first place where they stand."""
    return windows_of(runs).groupBy("a", "b").agg(F.min("place").alias("source"), F.max("place").alias("last")).where(
        doc_of(F.col("last")) > doc_of(F.col("source"))).select("a", "b", "source")


def branches(edges: DataFrame) -> DataFrame:
    """``node``: nodes with more than one edge in or more than one out."""
    end = lambda node, out: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    ends = edges.select(F.inline(F.array(end("a", 1), end("b", 0))))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where(
        "out > 1 OR into > 1").select("node")


def compact(edges: DataFrame, longest: int = PATH) -> DataFrame:
    """Adds to each edge the path it lies on: ``start``, the place in the source where the path begins."""
    forks = branches(edges).withColumn("fork", F.lit(True))
    placed = edges.join(forks, F.col("a") == F.col("node"), "left").drop("node").withColumn("doc", doc_of(F.col("source")))
    in_doc = W.partitionBy("doc").orderBy("source")  # the edges of one source
    follows = F.coalesce(F.lag("source").over(in_doc) == F.col("source") - 1, F.lit(False)) & F.col("fork").isNull()
    upto = in_doc.rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = F.max(F.when(F.col("follows"), None).otherwise(F.col("source"))).over(upto)
    cut = F.col("source") - (F.col("source") - F.col("begun")) % longest
    return placed.withColumn("follows", follows).withColumn("begun", begun).select("a", "b", "source", cut.alias("start"))


def later_spans(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Per document ``d``, path ``start`` and position ``at``: the windows of the path that the document repeats there.

    ``at`` is where the path's first word would be, before the document's beginning if it repeats a later part.
    """
    mine = paths.select(F.col("a").alias("a_"), F.col("b").alias("b_"), "source", "start")
    met = windows_of(runs).join(mine, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & (
        doc_of(F.col("place")) > doc_of(F.col("source"))))
    offset = F.col("source") - F.col("start")
    return met.groupBy(doc_of(F.col("place")).alias("d"), "start", (position_of(F.col("place")) - offset).alias("at")).agg(
        F.sort_array(F.collect_set(offset.cast("int"))).alias("windows"))  # at most the path's edges


def with_source_words(spans: DataFrame, texts: DataFrame, paths: DataFrame, docs: DataFrame, scratch: Scratch,
                      window: int) -> DataFrame:
    """Per document ``id, x, spans``: its places, the windows there and the words that the sources have there."""
    ids = docs.select("d", "id")
    source = ids.select(F.col("d").alias("source_d"), F.col("id").alias("source_id"))
    # Documents that share an id are not before each other.
    spans = scratch.write(spans.join(ids, "d").join(source, doc_of(F.col("start")) == F.col("source_d")).where(
        "id > source_id").select("d", "start", "at", "windows"), "later")
    wanted = paths.groupBy("start").agg(F.count("*").alias("edges")).join(spans.select("start").distinct(), "start")
    per_source = wanted.withColumn("d", doc_of(F.col("start"))).groupBy("d").agg(
        F.collect_list(F.struct("start", "edges")).alias("paths")).join(docs, "d").select(*DOC, "paths")
    found = path_words(texts.where("text IS NOT NULL").join(per_source, DOC).select("text", "paths"), window)
    # Rows equal in id and text give the same words.
    words = scratch.write(found.groupBy("start").agg(F.first("words").alias("words")), "words")
    low, high = F.col("windows")[0], F.element_at("windows", -1)
    part = F.array_join(F.slice(F.split("words", " ", -1), low + 1, high - low + window), " ")
    at = F.col("at") + low
    return spans.join(words, "start").select("d", F.struct(
        at.alias("at"), F.transform("windows", lambda w: w - low).alias("windows"), part.alias("words")).alias("span")).groupBy(
        "d").agg(F.collect_list("span").alias("spans")).join(docs, "d").select(*DOC, "spans")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
                   gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256``, and on request ``kept``, the words that stay."""
    if not 1 <= gram < window <= gram + 14:
        raise ValueError("a window takes 1 to 14 words more than an anchor")
    scratch = Scratch(docs, "substring", free_shuffles=True)
    doc_id, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("id"), F.xxhash64(text).alias("x"),
                       text.alias("text"))
    texts = rows.select(*DOC, "text")
    found = scratch.write(find_anchors(texts, window, gram), "found")
    firsts, copies = numbered(found, scratch)
    anchors = scratch.write(found.join(firsts, DOC).select("d", "anchors", "spans"), "anchors")
    scratch.drop(found)
    each = anchors.select("d", F.inline(F.arrays_zip("anchors", "spans"))).withColumnRenamed("anchors", "anchor")
    shared = scratch.write(each.groupBy("anchor").agg(F.min("d").alias("low"), F.max("d").alias("high")).where(
        "low <> high").select(F.col("anchor").alias("h")), "shared")
    opened = scratch.write(each.join(shared, F.col("anchor") == F.col("h")).groupBy("d").agg(
        F.collect_set("spans").alias("spans")).join(firsts, "d"), "opened")
    scratch.drop(anchors)
    runs = scratch.write(find_runs(texts.where("text IS NOT NULL").join(opened, DOC).select("d", "text", "spans"), window), "runs")
    edges = scratch.write(repeated_edges(runs), "edges")
    paths = scratch.write(compact(edges), "paths")
    scratch.drop(edges)
    spans = scratch.write(later_spans(runs, paths), "spans")
    scratch.drop(runs)
    sure = with_source_words(spans, texts, paths, firsts, scratch, window).withColumn("whole", F.lit(False))
    sure = scratch.write(sure.unionByName(copies.withColumn("spans", F.lit(None)).withColumn("whole", F.lit(True))), "sure")
    return remove_words(rows.join(sure, DOC, "left").select("doc_id", "text", "spans", "whole"), window, with_kept)
