"""Substring removal against plain Python, on messy rows and on texts with very many repeats."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendlake.llm import substring_dedup as sub


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """``doc_id, n_words, n_removed, kept`` of every row; null ids are greater than all others."""
    order = lambda i: (i is None, i or 0)
    least = {}
    for doc_id, text in rows:
        words = split(text)
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            least[w] = min(least.get(w, order(doc_id)), order(doc_id))
    out = Counter()
    for doc_id, text in rows:
        words, gone = split(text), set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < order(doc_id):
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def test_messy_rows(messy, rows):
    got = sub.remove_repeats(messy, with_kept=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    want = brute([r[:2] for r in rows], sub.WINDOW)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(k[2] > 0 for k in want) > 50 and "kept" not in sub.remove_repeats(messy).columns


@pytest.mark.parametrize("seed, window, gram, letters, path", [(1, 4, 2, 3, 256), (2, 4, 2, 6, 3), (3, 6, 3, 2, 5), (4, 13, 5, 2, 256), (5, 3, 1, 12, 1)])
def test_many_repeats_branches_and_loops(spark, seed, window, gram, letters, path, monkeypatch):
    monkeypatch.setattr(sub.compact, "__defaults__", (path,))
    made = random.Random(seed)
    passages = [[made.choice("abcdefghijkl"[:letters]) for _ in range(made.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(made.randint(0, 4)):
            piece = made.choice(passages)
            start = made.randrange(len(piece))
            words += piece[start:start + made.randint(1, 40)] + [made.choice(["x", "yy", f"u{i}"])] * made.randint(0, 2)
        rows.append((made.choice([i, i, i, i // 2, None]), made.choice([" ", "\n", " \t"]).join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sub.remove_repeats(frame, window=window, gram=gram, with_kept=True).collect()
    want = brute(rows, window)
    assert Counter(map(tuple, got)) == want and sum(k[2] for k in want) > 30


def test_a_long_passage_in_many_documents(spark):
    made = random.Random(8)
    passage = " ".join(f"w{made.randrange(10 ** 6)}" for _ in range(700))
    rows = [(i, f"own{i} {passage if i % 2 else passage[i * 3:]} end{i}") for i in range(40)] + [(i, passage) for i in range(40, 80)]
    got = sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()
    assert Counter(map(tuple, got)) == brute(rows, sub.WINDOW)


def test_window_is_judged_on_the_input(spark):
    a = " ".join(f"a{i}" for i in range(13))
    b = " ".join(f"b{i}" for i in range(13))
    rows = [(1, a), (2, f"{a} {b}"), (3, b), (4, f"{a} {b}"), (5, " ".join(f"a{i}" for i in range(12)))]
    got = {r["doc_id"]: r for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [a, b, "", "", rows[4][1]]


def test_words_that_differ_from_the_source_stay():
    words = [f"w{i}".encode() for i in range(20)]
    theirs = words[2:17]
    theirs[1] = b"other"
    span = {"words": b" ".join(theirs).decode(), "at": 2, "windows": [0, 1, 2]}
    assert np.flatnonzero(sub.covered(words, [span], 13)).tolist() == list(range(4, 17))


def test_anchor_of_equal_windows_is_equal():
    made = np.random.default_rng(4)
    words = made.integers(0, 1 << 63, 400, np.uint64)
    hashes, first, n = sub.anchors_of(words)
    assert n.sum() == 400 - 12 and (n >= 1).all() and (n <= 9).all() and len(hashes) < 120
    of_window = np.repeat(hashes, n)
    for at in (0, 57, 387):
        alone, _, _ = sub.anchors_of(words[at:at + 13])
        assert alone.tolist() == [of_window[at]]
    assert len(sub.anchors_of(words[:12])[0]) == 0


def test_empty_table_and_short_texts(spark, empty):
    assert sub.remove_repeats(empty).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two")]
    got = sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True)
    assert Counter(map(tuple, got.collect())) == brute(rows, sub.WINDOW)
    with pytest.raises(ValueError):
        sub.remove_repeats(empty, window=30, gram=5)
