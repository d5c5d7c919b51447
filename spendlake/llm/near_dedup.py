"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each text becomes the set of its hashed word shingles, a MinHash signature of ``HASHES``
   values and ``BANDS`` band keys. Texts that are equal byte by byte form a class; from here on
   a class is one row, so thousands of copies cost no more than one.
2. Classes that share a band key are candidates. A small bucket compares all of its members.
   A large one first compares its least member with all others, so a group of near copies
   mostly collapses into one component, whatever its size. Then what is left outside the
   bucket's largest component meets the rest in cells: blocks of about ``BLOCK`` members
   against each other, each in a group of its own. It compares signatures in place and packs
   the pairs that no batch rules out into one row; then only members of such pairs bring their
   sets, and the cell gives out links that join components. Members of one component need no
   comparison, so in the end every pair in a bucket has been compared or is linked through
   others, and rows are made for members, never for all pairs.
3. A candidate pair goes through its signatures batch by batch. With ``m`` of ``n`` values
   equal and a uniform prior, the posterior chance that the similarity reaches the threshold is
   that of at most ``m`` successes in ``n + 1`` trials at the threshold; a pair whose chance
   falls below ``MISS`` is pruned.
4. Survivors are verified on their full sets.
5. Links form components; the smallest id of a component names it.

A pair at the threshold is no candidate with chance ``(1 - t ** (HASHES / BANDS)) ** BANDS``,
5e-6 at 0.75, and less above it.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing, not even another such text. With fewer words than a shingle takes, the whole sequence
is the one shingle. Null ids never name a component unless it has no other; rows equal in id
and text are kept or dropped together. An empty table gives no rows. The id and text columns
are read by name; ``deduplicate`` keeps all columns. Texts of any length are read whole, in
stretches of about a megabyte. Words and shingles are told apart by 64-bit hashes: two unlike
shingles of one pair of texts that share a hash count as one, with a chance of about 1e-11 for a
pair of ten thousand shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import stars
from .shared import Scratch, free, written

WORDS, THRESHOLD = 5, 75
HASHES, BANDS = 128, 32
MISS, BATCH = 1e-6, 32
#: Up to so many members, a bucket compares all of them at once.
SMALL = 32
#: Members of a block of a large bucket, about.
BLOCK = 256


# Texts to sets and signatures --------------------------------------------------------

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in range(9, 14) else b for b in range(256))
_STEP = 0x9E3779B97F4A7C15 | 1


class Shingler:
    """Sets of 64-bit shingle hashes, computed over a text's bytes at once."""

    def __init__(self, words: int = WORDS, stretch: int = 1 << 20):
        self.words, self.stretch = words, stretch
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.spread = np.random.default_rng(11).integers(1, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, in order of their hashes."""
        data = text.encode().translate(_FOLD)
        parts, at = [], 0
        while at < len(data):
            end = data.find(b" ", min(at + self.stretch, len(data)))
            end = len(data) if end < 0 else end
            parts.append(self._words(np.frombuffer(data, np.uint8, end - at, at)))
            at = end
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = min(self.words, len(words))
        if not n:
            return words
        total = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            total += words[i:len(words) - n + 1 + i] * self.spread[i]
        return np.unique(mix(total))

    def _words(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word: its bytes as digits of a number modulo 2**64, well mixed."""
        if len(self.powers) < len(data):
            size = max(len(data), 1 << 12)
            self.powers = np.cumprod(np.full(size, _STEP, np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(_STEP, -1, 1 << 64), np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=sums[1:])
        edge = np.flatnonzero(np.diff(np.concatenate([[True], data == 32, [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """MinHash signatures and band keys of shingle sets."""

    def __init__(self, hashes: int = HASHES, bands: int = BANDS):
        drawn = np.random.default_rng(23)
        self.by = drawn.integers(1, 1 << 63, (hashes, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = drawn.integers(0, 1 << 63, (hashes, 1), np.uint64)
        self.bands = bands
        self.of_band = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(self, shingles: np.ndarray, chunk: int = 512) -> tuple[bytes, np.ndarray]:
        """The signature, 16 bits a value, and a key for each band."""
        least = np.full(len(self.by), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), chunk):
            np.minimum(least, (shingles[None, at:at + chunk] * self.by + self.plus).min(axis=1), out=least)
        key = self.of_band.copy()
        for column in least.reshape(self.bands, -1).T:
            key = mix(key * np.uint64(_STEP) + column)
        return (mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes(), key.view(np.int64)


def sign_texts(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` to ``doc_id, digest, n_shingles, bands, sig``, for texts with words."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for part in parts:
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                text = text.as_py() or ""
                found = shingler.hashes(text)
                if len(found):
                    out.append((doc_id, hashlib.md5(text.encode()).digest(), len(found), *signer.sign(found)))
            ids, digests, sizes, signatures, keys = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "digest", "n_shingles", "bands", "sig"])

    return rows.mapInArrow(batches, "doc_id long, digest binary, n_shingles long, bands array<long>, sig binary")


def set_texts(rows: DataFrame) -> DataFrame:
    """``digest, text`` to ``digest, shingles`` (sorted 64-bit hashes); a task gives each digest once."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for part in parts:
            out = []
            for digest, text in zip(part.column(0).to_pylist(), part.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest, shingler.hashes(text.as_py()).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()),
                                              pa.array([s for _, s in out], pa.binary())], ["digest", "shingles"])

    return rows.mapInArrow(batches, "digest binary, shingles binary")


# Verification ------------------------------------------------------------------------


def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """After ``n`` values, fewer equal ones than this prune a pair: the posterior chance is below ``miss``."""
    found = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while True:
            term = comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if chance + term >= miss or m == n:
                break
            chance, m = chance + term, m + 1
        found.append((n, m + 1))
    return found


def prune(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``a, b, sig_a, sig_b`` that no batch of their signatures rules out: ``a, b``."""
    bounds = least_matches(threshold / 100)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(part.num_rows, -1) for i in (2, 3))
            alive, equal, at = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), 0
            for n, least in bounds:
                equal[alive] += (left[alive, at:n] == right[alive, at:n]).sum(axis=1)
                alive, at = alive[equal[alive] >= least], n
            yield part.select([0, 1]).take(pa.array(alive))

    return pairs.mapInArrow(batches, "a binary, b binary")


def similar(x: bytes, y: bytes, threshold: int) -> bool:
    """Whether two full sets reach the threshold."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(x) + len(y) - shared)


def verify(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``a, b, set_a, set_b`` whose full sets reach the threshold: ``a, b``."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = [i for i, (x, y) in enumerate(zip(part.column(2), part.column(3))) if similar(x.as_py(), y.as_py(), threshold)]
            yield part.select([0, 1]).take(pa.array(good, pa.int64()))

    return pairs.mapInArrow(batches, "a binary, b binary")


def with_both(pairs: DataFrame, values: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    """Adds a value of each side of ``a, b``."""
    for side, name in zip(("a", "b"), names):
        pairs = pairs.join(values.select(F.col("digest").alias(side), F.col(value).alias(name)), side)
    return pairs.select("a", "b", *names)


# Candidates and components -----------------------------------------------------------


def live(members: DataFrame) -> DataFrame:
    """``key, c, root, n``: members of buckets that hold more than one component, and the bucket's size."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_keys = sizes.where("lo <> hi").select(F.col("key").alias("k"), "n")
    return open_keys.join(members, F.col("k") == F.col("key")).select("key", "c", "root", "n")


def first_pairs(members: DataFrame) -> DataFrame:
    """All pairs of small buckets, and the least member of a large one with all others."""
    small, large = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
    others = small.select(F.col("key").alias("k"), F.col("c").alias("b"))
    least = large.groupBy("key").agg(F.min("c").alias("a")).select(F.col("key").alias("k"), "a")
    return small.join(others, (F.col("key") == F.col("k")) & (F.col("c") < F.col("b"))).select(
        F.col("c").alias("a"), "b").unionByName(
        large.join(least, (F.col("key") == F.col("k")) & (F.col("c") != F.col("a"))).select(
            "a", F.col("c").alias("b"))).distinct()


def cells(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large buckets in cells: what is outside the largest component against it and itself.

    A member comes once for each block that it meets.
    """
    held = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    held = held.select(F.col("key").alias("k"), "main", blocks(F.col("n_main")).alias("mains"),
                       blocks(F.col("n") - F.col("n_main")).alias("rests"))
    placed = members.join(held, F.col("key") == F.col("k")).withColumn("in_main", F.col("root") == F.col("main"))
    own = F.pmod(F.xxhash64("c"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    placed = placed.withColumn("own", own)
    cell = lambda main, i, j, side: F.struct(
        F.lit(main).alias("main"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mine = F.col("own")
    met = F.when(F.col("in_main"), F.transform(upto(F.col("rests")), lambda j: cell(True, mine, j, 0))).otherwise(F.concat(
        F.transform(upto(F.col("mains")), lambda i: cell(True, i, mine, 1)),
        F.transform(upto(F.col("rests")), lambda j: F.when(mine <= j, cell(False, mine, j, 0)).otherwise(
            cell(False, j, mine, 1)))))
    return placed.select("key", "c", "root", F.inline(met)).join(
        classes.select(F.col("digest").alias("c"), "n_shingles", "bands", "sig"), "c")


CELL = ["key", "main", "i", "j"]


def compare_cells(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each cell with pairs of different components that no batch rules out.

    ``members`` and ``roots`` are those of such pairs, ``pairs`` their positions, two and two. A
    pair that meets in several buckets counts in the first of its bands only.
    """
    bounds = least_matches(threshold / 100)

    def compare(table: pa.Table) -> pa.Table:
        side, j = table["side"].to_numpy(), table["j"].to_numpy()
        c, root = np.array(table["c"].to_pylist(), object), np.array(table["root"].to_pylist(), object)
        size = table["n_shingles"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(len(c), -1)
        bands = np.array(table["bands"].to_pylist(), np.int64)
        band = int((bands[0] == table["key"][0].as_py()).argmax())
        within = not table["main"][0].as_py() and bool((table["i"].to_numpy() == j).all())
        left, right = (np.arange(len(c)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), 64):
            part = left[at:at + 64]
            near = (100 * np.minimum.outer(size[part], size[right]) >= threshold * np.maximum.outer(size[part], size[right]))
            near &= root[part][:, None] != root[right][None, :]
            if within:
                near &= part[:, None] < right[None, :]
            x, y = np.nonzero(near)
            x, y, equal, start = part[x], right[y], np.zeros(len(x), np.int64), 0
            for n, least in bounds:
                equal = equal + (sig[x, start:n] == sig[y, start:n]).sum(axis=1)
                good = equal >= least
                x, y, equal, start = x[good], y[good], equal[good], n
            first = (bands[x] == bands[y]).argmax(axis=1) == band
            found_a.append(x[first])
            found_b.append(y[first])
        used, at = np.unique(np.column_stack([np.concatenate(found_a), np.concatenate(found_b)]), return_inverse=True)
        n = min(1, len(used))  # a cell without such pairs gives no row
        names = pa.list_(pa.binary())
        return table.slice(0, n).select(CELL).append_column("members", pa.array([c[used].tolist()] * n, names)).append_column(
            "roots", pa.array([root[used].tolist()] * n, names)).append_column(
            "pairs", pa.array([at.astype("<i4").tobytes()] * n, pa.binary()))

    return rows.groupBy(*CELL).applyInArrow(
        compare, "key long, main boolean, i int, j int, members array<binary>, roots array<binary>, pairs binary")


def verify_cells(packed: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a, b`` between components of each cell, on full sets.

    Pairs whose components the cell has linked already are passed over, so a cell gives out
    fewer links than it has members.
    """
    own = [f"{c}_of" for c in CELL]
    brought = packed.withColumnsRenamed(dict(zip(CELL, own))).select(
        *own, F.posexplode("members").alias("at", "digest")).join(sets, "digest")

    def check(cell: pa.Table, held: pa.Table) -> pa.Table:
        members, roots = cell["members"][0].as_py(), cell["roots"][0].as_py()
        found = dict(zip(held["at"].to_pylist(), held["shingles"]))
        parent = {root: root for root in roots}

        def top(root: bytes) -> bytes:
            while parent[root] != root:
                parent[root] = parent[parent[root]]
                root = parent[root]
            return root

        links = []
        for x, y in np.frombuffer(cell["pairs"][0].as_py(), "<i4").reshape(-1, 2).tolist():
            p, q = top(roots[x]), top(roots[y])
            if p != q and similar(found[x].as_py(), found[y].as_py(), threshold):
                parent[p] = q
                links.append((members[x], members[y]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return packed.groupBy(*CELL).cogroup(brought.groupBy(*own)).applyInArrow(check, "a binary, b binary")


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def classes_of(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per class of equal texts (``doc_id, text``): ``digest, n_shingles, component_id``."""
    scratch = Scratch(rows, "near")
    classes = scratch.write(sign_texts(rows).groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("sig").alias("sig")), "classes")
    keys = classes.select(F.explode("bands").alias("key"), F.col("digest").alias("c"))
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    members = scratch.write(keys.join(met, F.col("key") == F.col("k")).select("key", "c", F.col("c").alias("root")), "members")
    one = classes.select("digest", "least_id").join(members.select(F.col("c").alias("digest")).distinct(), "digest")
    texts = rows.where("text IS NOT NULL").select("doc_id", "text", digest_of(F.col("text")).alias("_digest"))
    sets = scratch.write(set_texts(texts.join(one, (F.col("_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(
        F.col("least_id"))).select("digest", "text")), "sets")

    members = scratch.write(live(members), "buckets")
    pairs = first_pairs(members)
    likely = scratch.write(prune(with_both(pairs, classes, "sig", ("sig_a", "sig_b")), threshold), "likely")
    links = scratch.write(verify(with_both(likely, sets, "shingles", ("set_a", "set_b")), threshold).distinct(), "sure")
    roots = scratch.write(stars(links, scratch), "roots")
    large = members.where(F.col("n") > SMALL).select("key", "c").join(
        roots.select(F.col("node").alias("c"), "root"), "c", "left").select(
        "key", "c", F.coalesce("root", "c").alias("root"))
    large = scratch.write(live(large), "buckets")
    packed = scratch.write(compare_cells(cells(large, classes), threshold), "packed")
    links = links.unionByName(scratch.write(verify_cells(packed, sets, threshold), "sure"))
    roots = scratch.write(stars(links, scratch), "roots")
    rooted = classes.select("digest", "least_id", "n_shingles").join(
        roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = written(rooted.join(named, "root").select("digest", "n_shingles", "component_id"), "components")
    scratch.clear()
    return found


def mark(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    found = classes_of(rows, threshold).withColumnRenamed("digest", "_digest")
    component = F.when(F.col("_digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", digest_of(F.col("text")).alias("_d")).join(
        found, F.col("_d") == F.col("_digest"), "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                threshold: int = THRESHOLD) -> DataFrame:
    """The documents that stay: one of each component, with all columns."""
    doc_id, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`")
    digest, component = free(docs, "_digest", "_component")
    found = classes_of(docs.select(doc_id.alias("doc_id"), text.alias("text")), threshold).select(
        F.col("digest").alias(digest), F.col("component_id").alias(component))
    return docs.join(found, digest_of(text) == F.col(digest), "left").where(
        F.col(digest).isNull() | doc_id.eqNullSafe(F.col(component))).drop(digest, component)
