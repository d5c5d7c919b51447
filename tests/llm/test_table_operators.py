"""Operators that compare documents with each other, against brute force on messy rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import components, exact_dedup, line_dedup, mix_sources, near_dedup, permute, shards, top_k, url_filter


def test_exact_dedup(messy, rows):
    got = exact_dedup.mark_copies(messy).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    digests = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    seen = defaultdict(list)
    for r in got:
        members = digests[r["text_sha256"]]
        assert r["group_size"] == len(members)
        assert r["keep_id"] == min((m for m in members if m is not None), default=None)
        seen[r["text_sha256"]].append(r)
    for digest, members in seen.items():
        assert Counter(r["doc_id"] for r in members) == Counter(digests[digest])
        kept = [r for r in members if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]


def test_exact_dedup_small_digits_give_the_same(messy):
    plain = Counter(map(tuple, exact_dedup.mark_copies(messy.where("doc_id <> 104")).collect()))
    fine = Counter(map(tuple, exact_dedup.mark_copies(messy.where("doc_id <> 104"), first=3, grow=7).collect()))
    assert plain == fine


def brute_lines(rows):
    """Text after removal, for each distinct (id, text), in the order of the operator."""
    documents = sorted({(r[0] is None, r[0] if r[0] is not None else 0, hashlib.md5(r[1].encode()).digest(), r[1])
                        for r in rows if r[1] is not None})
    seen, out = set(), {}
    for none, doc_id, _, text in documents:
        lines, gone = text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at:at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        out[None if none else doc_id, text] = ("\n".join(v for i, v in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup(messy, rows):
    want = brute_lines(rows)
    got = line_dedup.remove_repeats(messy)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "kept" in got.columns
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == Counter(
        (r[0], *(want[r[0], r[1]] if r[1] is not None else (None, 0, 0))) for r in rows)
    assert sum(n for _, _, n in want.values()) >= 15


def test_line_dedup_within_one_text(spark):
    text = "a\nb\nc\nd\na\nb\nc\nx\na\nb"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert line_dedup.remove_repeats(frame).first()["text"] == "a\nb\nc\nd\nx\na\nb"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset(
        [tuple(words)] if words else [])


def brute_components(rows):
    least = {}
    for doc_id, text, *_ in rows:
        s = shingles(text)
        if s:
            least.setdefault(s, []).append(doc_id)
    sets, root = list(least), {}
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(b)] = find(a)
    for i, s in enumerate(sets):
        root.setdefault(find(i), []).extend(least[s])
    return {s: min((d for d in root[find(i)] if d is not None), default=None) for i, s in enumerate(sets)}


@pytest.mark.parametrize("small, block", [(near_dedup.SMALL, near_dedup.BLOCK), (2, 4)])
def test_near_dedup(messy, rows, small, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    want = brute_components(rows)
    expected = Counter()
    for doc_id, text, *_ in rows:
        s = shingles(text)
        component = want[s] if s else doc_id
        expected[doc_id, len(s), component, doc_id == component] += 1
    assert Counter(map(tuple, near_dedup.mark(messy).collect())) == expected


def test_near_dedup_finds_pairs_just_above_the_threshold(spark):
    """Pairs planted at similarities from 0.70 to 0.90, each in words of its own: all at 0.75 or more are linked, no other."""
    made = np.random.default_rng(12)
    rows, want = [], {}
    for pair in range(160):
        n = int(made.integers(120, 260))
        words = [f"p{pair}w{i}" for i in range(n)]
        changed = list(words)
        # A changed word takes up to five shingles of each side out of the intersection.
        for at in made.choice(np.arange(5, n - 5, 6), max(1, int(n * made.uniform(0.010, 0.036))), replace=False):
            changed[at] = f"q{pair}x{at}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(changed))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[pair] = 100 * len(a & b) >= 75 * len(a | b), len(a & b) / len(a | b)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {pair: got[2 * pair + 1] == 2 * pair for pair in want} == {pair: near for pair, (near, _) in want.items()}
    assert sum(0.75 <= s < 0.85 for _, s in want.values()) > 40 and sum(0.65 < s < 0.75 for _, s in want.values()) > 15


def test_near_dedup_equals_all_pairs_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows)
    for r in near_dedup.mark(docs).collect():
        s = shingles(dict(rows)[r["doc_id"]])
        assert r["component_id"] == (want[s] if s else r["doc_id"]) and r["n_shingles"] == len(s)


def test_near_dedup_keeps_one_of_each_group(messy, rows):
    kept = near_dedup.deduplicate(messy)
    assert kept.columns == messy.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[30] == 1 and not any(ids[i] for i in (*range(31, 90), 91))
    assert ids[100] == ids[101] == ids[103] == 1 and ids[124] == 1 and ids[125] == 0


def test_posterior_bounds():
    bounds = near_dedup.least_matches(0.75)
    assert [n for n, _ in bounds] == [32, 64, 96, 128]
    assert all(0 < m < 0.75 * n for n, m in bounds)
    made = np.random.default_rng(0)
    assert (made.binomial(128, 0.75, 200_000) < bounds[-1][1]).mean() < 1e-4


def test_long_text_in_stretches_gives_the_same_set():
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(5000))
    whole, pieces = near_dedup.Shingler().hashes(text), near_dedup.Shingler(stretch=100).hashes(text)
    assert len(whole) == len(shingles(text)) and (whole == pieces).all()


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5001), (5001, 5000)]
    got = dict(map(tuple, components.stars(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and got[5001] == 5000


def test_shards(messy, rows):
    got = shards.assign(messy).collect()
    n = len(rows)
    assert len(got) == n
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    for shard, members in itertools.groupby(sorted(got, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        assert [r["slot"] for r in members] == list(range(counts[shard]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter(map(tuple, got)) == Counter(map(tuple, shards.assign(messy.repartition(5)).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation_is_one(spark, n):
    got = sorted(r[0] for r in permute.permuted(spark.range(n).withColumnRenamed("id", "x"), "x", n, 5).collect())
    assert got == list(range(n))


def test_mix(messy, rows):
    got = mix_sources.plan(messy, blocks=64, shards=5)
    assert got.count() == len(rows)
    plan = got.collect()
    words = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words[id(r)]
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, targets = set(names), {}
    while True:
        rate = (1.5 * sum(sizes.values()) - sum(targets.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if rate * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left.discard(s)
    targets |= {s: rate * weight[s] for s in left}
    taken = Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert len(r["draws"]) <= 2 and all(0 <= d["shard"] < 5 for d in r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
    # A source misses its target by half the smallest block that its last pass left, at most.
    block = mix_sources.block_of(F.col("doc_id"), mix_sources.words(F.col("text")), 64, mix_sources.SEED).alias("block")
    blocks = defaultdict(lambda: [0, 0])
    for r in mix_sources.plan(messy, blocks=64, shards=5).select("source", "size", block, F.size("draws").alias("n")).collect():
        blocks[r["source"], r["block"]][0] += r["size"]
        blocks[r["source"], r["block"]][1] = r["n"]
    for s in names:
        passes = targets[s] // sizes[s] if sizes[s] else 0
        left = [size for (source, _), (size, n) in blocks.items() if source == s and size and n == passes]
        assert abs(taken[s] - targets[s]) <= min(left, default=0) / 2 + 1e-6
    again = {(r["doc_id"], r["text"], str(r["draws"])) for r in mix_sources.plan(messy.repartition(7), blocks=64, shards=5).collect()}
    assert again == {(r["doc_id"], r["text"], str(r["draws"])) for r in plan}


def test_mix_equals_its_sql_on_white_space_of_all_kinds(spark, tmp_path):
    import duckdb

    from spendlake.llm import queries

    made = np.random.default_rng(7)
    texts = ["".join(made.choice(["w", "x y", "\r", "\x0b", "\x0c", "\r\n", "\t", "\x1f", "\u00a0", "zz"]) for _ in range(made.integers(0, 60)))
             for _ in range(300)]
    rows = [(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(texts)] + [(300, None, "none"), (301, "", "none")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in db.execute(queries.SQL["op8_mix_sources"]).fetchall()}
    got = queries.QUERIES["op8_mix_sources"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == want
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]][1] or "")) for r in got)


def test_mix_rows_follow_the_draws(messy):
    planned = sum(len(r["draws"]) for r in mix_sources.plan(messy, blocks=64).collect())
    mixed = mix_sources.mix(messy, blocks=64)
    assert mixed.count() == planned and {"copy", "shard", "order_key", "text"} <= set(mixed.columns)


def test_hypergeometric_and_tree(spark):
    frame = spark.range(4000).select(F.lit(30).alias("g"), F.lit(50).alias("b"), F.lit(20).alias("d"),
                                     ((F.col("id") + 0.5) / 4000).alias("u"))
    x = np.array([r[0] for r in frame.select(mix_sources.hypergeometric(F.col("g"), F.col("b"), F.col("d"), F.col("u"))).collect()])
    assert abs(x.mean() - 7.5) < 0.02 and abs(x.var() - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.05
    quota = {1: 100, 2: 7, 3: 0, 4: 41}
    tree = mix_sources.split_tree(spark.createDataFrame(list(quota.items()), "source_rank long, quota long"), 7, 3).collect()
    per_source, per_shard = Counter(), Counter()
    for r in tree:
        assert r["quota"] >= 0
        per_source[r["source_rank"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert {k: per_source[k] for k in quota} == quota
    assert set(per_shard) == set(range(7)) and max(per_shard.values()) - min(per_shard.values()) <= 2


def test_top_k(spark):
    made = np.random.default_rng(2)
    vectors = [(i, [float(v) for v in np.round(made.normal(0, 1, 8), 1)]) for i in range(400)]
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors += [(404, [1.0, 2.0]), (405, []), (450, [1e30] + [1.0] * 7)]
    vectors += [(i, vectors[0][1]) for i in range(500, 520)]
    for rows in (vectors, [v for v in vectors if v[0] != 450]):
        frame = spark.createDataFrame([(*v, "x", 1.0) for v in rows], "vec_id long, vector array<double>, rank string, score double")
        good = {i: [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)) for i, v in rows
                if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
        want = set()
        for q in (i for i in good if i % 50 == 0):
            score = {i: max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(good[q], v)))) for i, v in good.items() if i != q}
            want |= {(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])}
        got = top_k.top_k(frame, frame.where("vec_id % 50 = 0"), block=90, query_block=3)
        assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert top_k.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert top_k.top_k(frame.where("vec_id < 3"), frame.where("vec_id = 0")).count() == 2


def test_url_filter(spark):
    captures = [(1, "https://a.b.Example.com:80/x?y#z", 5), (2, "http://user@example.com./", 5), (3, "https://other.net/p", 5),
                (4, None, 5), (5, "not an address", 5), (6, "https://example.com/x", None), (7, "https://a.b.example.com/x?y", 25),
                (1, "https://a.b.Example.com:80/x?y#z", 5), (8, "https://a.b.example.com/x?y", 15), (None, "https://b.example.com/", 1)]
    entries = [("block", "domain", "example.com", 2, True), ("block", "domain", "example.com", 20, False),
               ("allow", "domain", "b.example.com", 10, True), ("block", "url", "a.b.example.com/x?y", 4, True),
               ("block", "url", "a.b.example.com/x?y", 14, False), ("block", "url", "a.b.example.com/x?y", 14, True),
               ("allow", "domain", "example.com", 2, True), ("block", "domain", None, 1, True), ("block", "domain", "com", None, True)]
    frame = spark.createDataFrame([(*c, "v", "h") for c in captures], "page_id long, url string, fetched int, verdict string, depth string")
    dated = spark.createDataFrame(entries, "list string, kind string, key string, day int, active boolean")
    got = Counter((r["page_id"], r["verdict"], r["rule"]) for r in url_filter.judge(frame, dated).collect())
    assert got == Counter([
        (1, "block", "a.b.example.com/x?y"), (1, "block", "a.b.example.com/x?y"), (2, "block", "example.com"), (3, "pass", None),
        (4, "unknown", None), (5, "unknown", None), (6, "unknown", None), (7, "allow", "b.example.com"),
        (8, "allow", "b.example.com"), (None, "pass", None)])
    assert url_filter.judge(frame.limit(0), dated).count() == 0
    assert {r["verdict"] for r in url_filter.judge(frame, dated.limit(0)).collect()} == {"pass", "unknown"}


def test_empty_tables(empty):
    assert exact_dedup.mark_copies(empty).count() == 0
    assert line_dedup.remove_repeats(empty).count() == 0
    assert near_dedup.mark(empty).count() == 0
    assert near_dedup.deduplicate(empty).count() == 0
    assert shards.assign(empty).count() == 0
    assert mix_sources.plan(empty).count() == 0
    assert mix_sources.mix(empty).count() == 0
