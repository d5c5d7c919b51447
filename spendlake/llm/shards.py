"""Sharding by a permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (id, checksum, size), nulls first. A keyed Feistel
permutation with cycle walking sends a number to a place p; the shard is ``p mod shards`` and
the slot ``p div shards``. So shard counts differ by one at most, slots have no gaps, and the
shard and slot of a row follow from its number, n and the seed alone. The law is ``rows``.

Numbering range-partitions narrow rows (no texts) and settles them, so no task holds them all
and reruns agree. Rows that tie in the whole order are equal in all that is returned.

Defined results: a null text has size 1 and the checksum of the empty text; null ids are
numbered first; repeated rows get numbers of their own; an empty table gives no rows. Columns
are read by name, so further columns are ignored. Texts of any length count with all their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import with_position
from .permute import permuted
from .shared import written

SHARDS = 16
SEED = 20_240_607


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = written(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")), "shards")
    n = narrow.count()
    numbered = with_position(narrow, [F.asc_nulls_first("doc_id"), "text_crc32", "size"], "place")
    placed = permuted(numbered.withColumn("place", (F.col("place") - 1).cast("long")), "place", n, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
