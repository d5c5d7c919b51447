from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, target string, kept string, "
          "digest string, n_lines string, draws int, copy int, score string, ids string, `_id` string, `_b` int")
EXTRA = (1, "t", "k", "d", "n", 2, 3, "s", "i", "_", 4)
PASSAGE = "shared line one of the notice\nshared line two of the notice\nshared line three of it"


def messy_rows() -> list[tuple]:
    """Nulls, empty and long texts, equal rows, repeated ids, ties, copies and near copies."""
    made = random.Random(5)
    vocabulary = [a + b for a in ("lo", "mi", "tra", "ke", "su", "é", "ño") for b in ("ra", "ne", "ti", "xo", "pa", "den")]
    prose = lambda n: " ".join(made.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join(prose(12) for _ in range(6)), "en" if i % 2 else "fr", f"s{i % 4}", 1) for i in range(30)]
    base = prose(200)
    words = base.split()
    for i in range(30, 50):
        near = list(words)
        near[made.randrange(200)] = f"other{i}"
        rows.append((i, " ".join(near), "en", "hot", 1))
    rows += [(i, base, "en", "hot", 1) for i in range(50, 90)]
    rows += [(90, base.upper(), "en", "hot", 1), (91, base.replace(" ", "\t\n "), "en", "hot", 1)]
    rows += [(100, None, "en", "s1", None), (101, "", None, None, 0), (102, " \t\n", "en", None, 3), (103, None, None, None, None)]
    rows += [(None, "a row without an id", "en", "s2", 1), (None, "a row without an id", "en", "s2", 1), (None, None, None, None, None)]
    rows += [(104, "the same row", "en", "s3", 1)] * 3 + [(105, "an id", "en", "s3", 1), (105, "an id again", "fr", "s3", 1)]
    rows += [(i, f"{prose(8)}\n{PASSAGE}\n{prose(8)}", "en", "s0", 1) for i in range(110, 116)]
    rows += [(120, prose(20_000), "en", "long", 1), (121, "x" * 50_000, "en", "long", 1), (122, "12345 !!! ---", "en", "s1", 1)]
    rows += [(123, "<|endoftext|> x<|endoftext|>\n🙂 ½ ２ don't", "en", "s1", 1)]
    rows += [(124, "one two three", "en", "s1", 1), (125, "ONE  two\nthree", "en", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
