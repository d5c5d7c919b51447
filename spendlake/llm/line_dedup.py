"""Line deduplication by overlapping windows of three lines.

Every run of three consecutive lines of a text is a window, known by a 128-bit hash of its
lines' hashes. Of equal windows anywhere in the table the first one stays, in the order of
document and position; all others are covered. The positions covered by a document's windows
are merged, and covered lines are removed. Lines keep their order, and nothing else is lost: a
line whose windows are all first occurrences stays, however often it occurs by itself.

Windows are counted with partial sums on the map side, and only windows that repeat come back
by a join that adaptive execution can split, so a passage that a third of all documents share
is no hot task. Covered positions are gathered per document, which bounds them by its lines.
Texts move once, to meet the positions; a text without covered lines comes back as it was.

Documents are told apart by id and text: rows equal in both are one document and get the same
result, so repeated rows remove nothing from each other. Order of documents: by id, null
ids last, then by the hash of the text.

Defined results: a null text stays null, with 0 lines; an empty text has one empty line; texts
of fewer than three lines have no windows and stay as they are; a text all of whose lines are
covered becomes empty. An empty table gives no rows. The id and text columns are read by name;
further columns are kept, and replaced if they have the name of a column made here. Whole
texts of any length are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import free

LINES = 3
MADE = ("n_lines", "n_removed")


def digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def windows(docs: DataFrame, lines: int) -> DataFrame:
    """``window, doc, at``: each window's hash, its document and its first line's position."""
    hashes = F.transform(F.split("text", "\n"), lambda line: F.md5(line.cast("binary")))
    keyed = docs.where("text IS NOT NULL").select(document("id", "text").alias("doc"), hashes.alias("h"))
    starts = F.when(F.size("h") >= lines, F.sequence(F.lit(0), F.size("h") - lines)).otherwise(
        F.array().cast("array<int>"))
    joined = F.transform(starts, lambda at: F.unhex(F.md5(F.concat(*[
        F.get("h", at + i) for i in range(lines)]).cast("binary"))))
    return keyed.select("doc", F.posexplode(joined).alias("at", "window"))


def document(doc_id: str, text: str) -> Column:
    """A document's place in the order: null ids last, then the id, then the text's hash."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"),
                    digest(F.col(text).cast("binary")).alias("text"))


def covered(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Per document with repeated windows, ``doc`` and the starts of those that are not the first."""
    every = windows(docs, lines)
    first = every.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")).where(
        "n > 1").select(F.col("window").alias("w"), F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at"))
    later = every.join(first, F.col("window") == F.col("w")).where(
        ~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("at") == F.col("first_at"))))
    # Repeated rows repeat their windows, and the set makes them one again.
    return later.groupBy("doc").agg(F.collect_set("at").alias("starts"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   lines: int = LINES) -> DataFrame:
    """All columns of ``docs``, the text without covered lines, ``n_lines`` and ``n_removed``."""
    _id, _text, _gone, _digest = free(docs, "_id", "_text", "_gone", "_digest")
    text, doc_id = F.col(f"`{text_column}`"), F.col(f"`{id_column}`").cast("long")
    marked = covered(docs.select(doc_id.alias("id"), text.alias("text")), lines).select(
        F.col("doc.id").alias(_id), F.col("doc.text").alias(_text),
        F.array_distinct(F.flatten(F.transform("starts", lambda at: F.sequence(at, at + (lines - 1))))).alias(_gone))
    kept = [c for c in docs.columns if c not in MADE]
    both = docs.select(*[F.col(f"`{c}`") for c in kept], digest(text.cast("binary")).alias(_digest)).join(
        marked, doc_id.eqNullSafe(F.col(_id)) & (F.col(_digest) == F.col(_text)), "left")
    split = F.split(text, "\n")
    # Positions as a map, so that a long text is not searched once for each of its lines.
    gone = F.map_from_arrays(F.col(_gone), F.transform(_gone, lambda _: F.lit(True)))
    rest = F.array_join(F.filter(split, lambda line, at: ~F.coalesce(F.element_at(gone, at), F.lit(False))), "\n")
    out = [F.when(F.col(_gone).isNull(), text).otherwise(rest).alias(text_column) if c == text_column
           else F.col(f"`{c}`") for c in kept]
    return both.select(*out, F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
                       F.when(F.col(_gone).isNull(), 0).otherwise(F.size(_gone)).cast("long").alias("n_removed"))
