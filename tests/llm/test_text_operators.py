"""Operators that read each text by itself: tokens, licences, language."""

from __future__ import annotations

import hashlib
import json
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

from spendlake.llm import bpe, language_id, license_scan
from spendlake.llm.queries import vocabulary_file

tokenizers = pytest.importorskip("tokenizers")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def source():
    return vocabulary_file()


@pytest.fixture(scope="module")
def library(source):
    return tokenizers.Tokenizer.from_str(source)


def test_bpe_equals_the_library(messy, rows, source, library):
    got = Counter(tuple(r[:4]) for r in bpe.encode_texts(messy, source).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())] += 1
    assert got == want


def test_bpe_round_trip_and_random_pieces(source, library):
    vocabulary = bpe.Vocabulary(source)
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    made = random.Random(3)
    for _ in range(2000):
        text = "".join(made.choice("aab b  \n\t'sré1²½漢\u0085\x1c.!_🙂 the in er on 'll") for _ in range(made.randint(0, 50)))
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == text


def test_bpe_memory_bound_changes_nothing(source, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 300)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    encoder = bpe.Encoder(bpe.Vocabulary(source))
    for text in ["unbelievable tokenisation of antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaa", "1234567 1234567"] * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_holds_a_bounded_number_of_bytes(source, library, monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary(source))
    long_word = "ab" * 100_000
    assert encoder.encode(f"{long_word} x")[:4] and all(len(piece) <= bpe.KEEP for piece in encoder.memo)
    monkeypatch.setattr(bpe, "MEMO", 100_000)
    for i in range(3000):
        encoder.encode(f"w{i}x{i * 7} other{i}")
        assert encoder.memo.held <= bpe.MEMO
    assert encoder.memo.held == sum(sys.getsizeof(k) + sys.getsizeof(v) + bpe.ENTRY for k, v in encoder.memo.items())


def test_bpe_gives_the_decoded_text_on_request(messy, rows, source):
    assert "decoded" not in bpe.encode_texts(messy, source).columns
    got = Counter((r["doc_id"], r["decoded"]) for r in bpe.encode_texts(messy, source, with_decoded=True).collect())
    assert got == Counter((r[0], r[1] or "") for r in rows)


@pytest.mark.parametrize("part, key, value", [
    (None, "normalizer", {"type": "NFC"}), ("pre_tokenizer", "add_prefix_space", True), ("model", "end_of_word_suffix", "</w>"),
    ("pre_tokenizer", "type", "Whitespace"), ("model", "dropout", 0.1)])
def test_bpe_refuses_files_of_another_kind(source, part, key, value):
    read = json.loads(source)
    (read[part] if part else read)[key] = value
    with pytest.raises(ValueError, match=part if part == "pre_tokenizer" else key):
        bpe.Vocabulary(json.dumps(read))


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for notice, label in license_scan.NOTICES for i in range(len(words))
              if words[i:i + len(notice.split())] == notice.split()]
    return (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


def test_licences_base_equals_brute_force(spark, messy, rows):
    more = [(200, "Under the MIT License. CC-BY cc by; Apache  License, GNU General Public License v3", None, None, None),
            (201, "mit license mit license cc by cc by", None, None, None), (202, "smit license cc byte", None, None, None)]
    frame = messy.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string"))
    got = Counter(tuple(r) for r in license_scan.scan_texts(frame).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == Counter((r[0], *brute_licences(r[1])) for r in [*rows, *more])


def test_licences_near_notices_and_spans(spark):
    frame = spark.createDataFrame([
        (1, "released under the Apach License and the GNU Generel Public Licence"), (2, "a plain text of no licence"),
        (3, "the apache license"), (4, "mit licenses given"), (5, "apache")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_texts(frame).collect()}
    assert got[1]["labels"] == "near-apache,near-gpl" and got[1]["base_labels"] == "" and 0 < got[1]["score"] < 1
    assert [(s["word"], s["n_words"], s["edits"]) for s in got[1]["spans"]] == [(3, 2, 1), (7, 4, 2)]
    assert got[2]["labels"] == got[5]["labels"] == "" and got[2]["score"] == 0.0
    assert got[3]["labels"] == "apache" and got[3]["score"] == 1.0
    assert got[4]["labels"] == "near-mit"


def test_licences_pigeonholes_lose_no_match():
    """Every match of the whole line lies in a window that the seeds open."""
    scanner, made = license_scan.Scanner(), random.Random(9)
    for body, _, edits, seeds, search in scanner.notices:
        for _ in range(300 if edits else 0):
            changed = bytearray(body)
            for _ in range(made.randint(0, edits)):
                at = made.randrange(len(changed))
                made.choice([lambda: changed.__setitem__(at, 120), lambda: changed.__delitem__(at), lambda: changed.insert(at, 120)])()
            line = b" some words %b and more words " % bytes(changed)
            whole = {m.span() for m in search(line)}
            inside = {m.span() for a, z in license_scan.windows(line, body, seeds, edits) for m in search(line, a, z)}
            assert bool(whole) == bool(inside)


def test_empty_tables(empty, source):
    assert bpe.encode_texts(empty, source).count() == 0
    assert license_scan.scan_texts(empty).count() == 0
    assert language_id.identify(empty).count() == 0


def test_language_of_messy_rows(messy, rows):
    got = language_id.identify(messy, epochs=1)
    assert got.columns[-3:] == ["held_out", "lang_pred", "score"] and got.count() == len(rows)
    by_id = {r["doc_id"]: r for r in got.collect()}
    for doc_id in (100, 101, 102, 103, 122):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    assert by_id[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in by_id.values())
    assert by_id[121]["lang_pred"] in ("en", "fr")


def test_language_learns_nothing_from_held_out_rows(spark):
    frame = spark.createDataFrame([(i, "some text here", None) for i in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(frame).collect()} == {"und"}
    one = spark.createDataFrame([(i, "some text here", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(one).collect()} == {("en", 1.0)}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.identify(docs).where("held_out AND length(text) > 100").selectExpr("avg(int(lang = lang_pred)) AS right").first()
    assert held["right"] > 0.97


def test_network_learns_from_the_largest_response():
    """Training lowers the loss on windows that one byte pair tells apart."""
    made = np.random.default_rng(1)
    x = made.integers(97, 110, (128, language_id.WINDOW)).astype(np.uint8)
    y = np.arange(128) % 2
    x[y == 1, 100:102] = 120
    start = language_id.start(2)
    end = language_id.train(x, y, 2, epochs=40)
    loss = lambda m: -np.log(language_id.probabilities(m, x)[np.arange(128), y] + 1e-9).mean()
    assert loss(end) < 0.2 * loss(start)


def brute_language(model, languages, text):
    """Label and score by one window, place and filter after the other, in double precision."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, mean = text.encode(), np.zeros(len(languages))
    for at in range(0, len(data), language_id.WINDOW):
        part = data[at:at + language_id.WINDOW]
        window = part + bytes(language_id.WINDOW - len(part))
        pooled = []
        for width in language_id.WIDTHS:
            table = model[f"filter{width}"].astype(float)
            for f in range(table.shape[2]):
                pooled.append(max(0.0, max(sum(table[k, window[i + k], f] for k in range(width))
                                           for i in range(language_id.WINDOW - width + 1))))
        z = np.array(pooled) @ model["weight"].astype(float) + model["bias"].astype(float)
        mean += len(part) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    mean /= len(data)
    return languages[int(mean.argmax())], float(mean.max())


def test_language_equals_a_plain_convolution(spark):
    """Row by row, on texts of every kind and windows that are full, broken and padded."""
    made = random.Random(4)
    words = {"aa": ["kas", "tolo", "mire", "sanu"], "bb": ["ßtra", "wünd", "groß", "fe"], "cc": ["漢字", "かな", "ka", "ルビ"]}
    prose = lambda lang, n: " ".join(made.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang, made.choice([1, 3, 40, 70])), lang) for i, lang in enumerate(sorted(words) * 30)]
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "123 !", "bb"), (203, "x" * 256, None), (204, "y" * 257, None), (205, prose("aa", 9) + prose("cc", 99), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, model = language_id.learn(docs, epochs=2)
    got = {r["doc_id"]: r for r in language_id.identify(docs, known=(languages, model)).collect()}
    for doc_id, text, _ in rows[::7] + rows[-6:]:
        label, score = brute_language(model, languages, text)
        assert got[doc_id]["score"] == pytest.approx(score, abs=2e-4)
        assert got[doc_id]["lang_pred"] == label
