"""URL filters as a temporal list join: every capture against the entries active when it was fetched.

A list is a table of dated entries ``list, kind, key, day, active``: from ``day`` on the entry
is on (``active``) or off again. ``kind`` is ``domain`` (the host itself and all hosts under
it) or ``url`` (one address, without scheme and fragment). Entries become validity intervals
``[day, next day of the same list, kind and key)``; several entries of one day count as one,
off winning over on. Intervals of one key never overlap, so a capture meets at most one
interval of each list and key.

A capture looks up its address and each domain above its host. The as-of join is an equality
join on the key with the interval as a further condition, so the rows it makes are those that
match, and adaptive execution can split a host that holds a third of all captures. Captures that
share address and day are looked up once. The verdict is that of the most specific key, the
address before any domain and the longer domain before the shorter; if lists disagree on it,
the one last in the alphabet wins, so ``block`` over ``allow``.

Defined results: a null or unreadable URL has no host and the verdict ``unknown``; a capture
without a day matches nothing and is ``unknown`` too; without a match the verdict is ``pass``.
Entries with a null key or day count for nothing. Repeated captures each get their row. An
empty list lets everything pass; an empty table gives no rows. Columns are read by name and
further columns of captures are kept, unless they have the name of a column made here. Addresses
of any length are compared whole; a host is looked up once for each of its labels, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free

MADE = ("host", "verdict", "rule", "rule_since")


def host_of(url: Column) -> Column:
    """Host in small letters, without user, port and closing dots; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def address_of(url: Column, host: Column) -> Column:
    """Host, path and query."""
    return F.concat(host, F.regexp_extract(url, r"^[^:]*://[^/?#]*([^#]*)", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, key, since, until``: when an entry is on; ``until`` is null while it lasts.

    A window holds one row for each day on which one entry changes.
    """
    daily = entries.where("key IS NOT NULL AND day IS NOT NULL").groupBy("list", "kind", "key", "day").agg(
        F.min("active").alias("active"))
    following = F.lead("day").over(W.partitionBy("list", "kind", "key").orderBy("day"))
    return daily.withColumn("until", following).where("active").select(
        "list", "kind", "key", F.col("day").alias("since"), "until")


def candidates(url: str, host: str) -> Column:
    """The keys a capture is looked up by, with how specific each is."""
    parts = F.split(F.col(host), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key"),
        (F.size(parts) - i + 1).alias("depth")))
    address = F.array(F.struct(F.lit("url").alias("kind"), address_of(F.col(url), F.col(host)).alias("key"),
                               F.lit(1 << 20).alias("depth")))
    return F.when(F.col(host).isNotNull(), F.concat(address, domains))


def judge(captures: DataFrame, entries: DataFrame, url_column: str = "url", day_column: str = "fetched") -> DataFrame:
    """All columns of ``captures``, with ``host, verdict, rule`` and ``rule_since``."""
    # What decides: one row for each address and day.
    asked = captures.select(F.col(url_column).alias("u"), F.col(day_column).alias("d")).where(
        "u IS NOT NULL AND d IS NOT NULL").distinct()
    keys = asked.withColumn("h", host_of(F.col("u"))).select("u", "d", F.inline(candidates("u", "h")))
    valid = intervals(entries).select("list", F.col("kind").alias("k"), F.col("key").alias("of"), "since", "until")
    met = keys.join(valid, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("of")) & (F.col("since") <= F.col("d"))
                    & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
    address, at, best = free(captures, "u", "d", "best")
    verdicts = met.groupBy(F.col("u").alias(address), F.col("d").alias(at)).agg(
        F.max(F.struct("depth", "list", "key", "since")).alias(best))
    kept = [F.col(f"`{c}`") for c in captures.columns if c not in MADE]
    url, day = F.col(f"`{url_column}`"), F.col(f"`{day_column}`")
    host = host_of(url)
    return captures.select(*kept).join(
        verdicts, (url == F.col(address)) & (day == F.col(at)), "left").select(
        *kept, host.alias("host"),
        F.when(host.isNull() | day.isNull(), "unknown").otherwise(F.coalesce(f"{best}.list", F.lit("pass"))).alias("verdict"),
        F.col(f"{best}.key").alias("rule"), F.col(f"{best}.since").alias("rule_since"))
