"""The filter audit and the Merkle manifest, against plain Python on messy rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spendlake.llm import filter_audit, merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest ---------------------------------------------------------------------


def leaf(values):
    shown = [None if v is None else str(v) for v in values]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def lower(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tree(nodes, fan=16):
    """The root, and for each node the runs it passes: what is left and right of it."""
    level, at, passed = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place // fan * fan
            passed[i].append(("".join(level[start:place]), "".join(level[place + 1:start + fan])))
            at[i] = place // fan
        level = [sha("".join(level[i:i + fan])) for i in range(0, len(level), fan)]
    return level[0], passed


def brute_manifest(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        by_source[source].append((doc_id, leaf((doc_id, source, lang, n_chars, text)),
                                  leaf((doc_id, source, lang, n_chars, lower(text)))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = tree([x[1] for x in by_source[source]])
    root, above = tree([trees[s][0] for s in order])
    out = Counter()
    for i, source in enumerate(order):
        for (doc_id, own, changed), path in zip(by_source[source], trees[source][1]):
            path = path + above[i]
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            fold = changed if tampered else own
            for left, right in path:
                fold = sha(left + fold + right)
            out[doc_id, own, trees[source][0], root, sha("".join(a + b for a, b in path)), fold, fold == root] += 1
    return out


@pytest.mark.parametrize("digits", [1, 2])
def test_manifest_equals_plain_python(messy, rows, digits):
    got = Counter(map(tuple, merkle.prove(messy, digits).collect()))
    assert got == brute_manifest(rows)
    assert len({k[2] for k in got}) == 7 and {k[6] for k in got} == {True, False}


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 1), (300, 18), (20, 20)])
def test_manifest_of_full_and_broken_runs(spark, n, sources):
    rows = [(i, "Text" if i % 3 else None, None, f"é{i % sources}" if i % sources else None, i) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for digits in (1, 2):
        assert Counter(map(tuple, merkle.prove(frame, digits).collect())) == brute_manifest(rows)


def test_manifest_path_alone_gives_the_root(messy):
    rows = merkle.manifest(messy).collect()
    for r in rows:
        node = r["leaf"]
        for run in r["path"]:
            node = sha(run["left"] + node + run["right"])
        assert node == r["root"] == r["folded_root"] and r["verified"]


def test_manifest_of_an_empty_table(empty):
    assert merkle.prove(empty).count() == 0


def test_manifest_nests_without_a_second_shuffle(spark, tmp_path):
    spark.range(5000).selectExpr("'' AS tree", "5000L AS n", "id AS r", "string(id) AS node", "struct(id) AS item").write.parquet(f"{tmp_path}/nodes")
    plan = merkle.nest(spark.read.parquet(f"{tmp_path}/nodes"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


# Filter audit ------------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = ({i for i, *values in labels if values[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    parts = defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": doc_id is not None and doc_id > least[text]}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, total = {}, Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                total[part, letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(letter in d[0] for d in docs) - len(gone), sum(d[0] == {letter} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


MORE = [(300, "Word " * 150, "fr", "s", 1), (301, "a # b", "en", "s", 1), (302, "ABC DEF", "", "s", 1), (300, "Word " * 150, "fr", "s", 1),
        (299, "Word " * 150, "en", "s", 1), (303, " ".join(f"w{i}" for i in range(120)), None, "s", 1), (304, "", "de", "s", 1)]
LABELS = [(0, 1, 0), (1, 1, 1), (30, 0, 1), (50, 1, None), (51, 1, 0), (60, 1, 0), (60, 0, 1), (101, None, 1), (104, 1, 1), (300, 1, 0),
          (None, 1, 1), (9999, 1, 1), (301, 0, 1)]


def test_audit_equals_running_every_order(spark, messy, rows):
    more = spark.createDataFrame(MORE, "doc_id long, text string, lang string, source string, n_chars long")
    docs = messy.unionByName(more, allowMissingColumns=True)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.MADE]
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()} == brute_audit([*rows, *MORE], LABELS)
    kinds = dict(got.dtypes)
    assert kinds["step"] == "int" and all(kinds[c] == "bigint" for c in filter_audit.MADE)


def test_audit_potential_is_the_mean_over_orders(spark):
    worth = [0, 3, 5, 6, 1, 4, 6, 9]
    frame = spark.createDataFrame([(worth,)], "n array<long>")
    got = frame.select(filter_audit.potentials(F.col("n"), 3).alias("p")).first()["p"]
    for i in range(3):
        value = sum(worth[sum(1 << x for x in order[:order.index(i) + 1])] - worth[sum(1 << x for x in order[:order.index(i)])]
                    for order in itertools.permutations(range(3)))
        assert got[7] - 3 * got[7 ^ (1 << i)] == value


def test_audit_of_empty_tables(spark, empty, messy):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, no_labels).count() == 0
    found = filter_audit.audit(messy, no_labels)
    assert found.count() == 600 * len({r[0] for r in messy.select(F.coalesce("lang", F.lit(""))).collect()})
    assert found.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
