"""Language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes, the last one padded. Filters of several widths
run over the bytes of a window; a byte is one-hot, so a filter is a table with a row for each
byte value and place, and its response a sum of looked-up rows. The largest response of each
filter in the window goes through a rectifier and one softmax layer. The network is trained in
numpy by Adam. The prediction for a text weighs the windows' probabilities by their bytes; all
bytes of a text are used.

Training takes a bounded sample: about ``SAMPLE`` documents of each language (all, if fewer),
drawn by a hash of the row, and of each up to ``TAKE`` windows spread over the whole text. So
the driver sees about ``SAMPLE * TAKE`` windows for each language, however large the table is.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text if no row can be learned from. With one language to learn, all other texts get it. Rows
with a null language are not learned from; rows with a null id are neither learned from nor
held out. Rows with repeated ids, and equal rows, are predicted one by one. A tie goes to the
language first in order. Columns are read by name, so further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 600
TAKE = 4
EPOCHS = 8
UNKNOWN = "und"


# The network -------------------------------------------------------------------------


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of a window, the last one padded with zeros."""
    rows = max(1, -(-len(data) // window))
    out = np.zeros(rows * window, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, window)


def start(languages: int, seed: int = 7, filters: int = FILTERS, widths=WIDTHS) -> dict[str, np.ndarray]:
    """Random filters and an empty softmax layer."""
    made = np.random.default_rng(seed)
    model = {f"filter{w}": made.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths}
    model["weight"] = np.zeros((filters * len(widths), languages), np.float32)
    model["bias"] = np.zeros(languages, np.float32)
    return model


def responses(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Response of each filter at each place: windows, places, filters."""
    width, places = len(table), x.shape[1] - len(table) + 1
    total = table[0].take(x[:, :places], axis=0)
    for k in range(1, width):
        total += table[k].take(x[:, k:k + places], axis=0)
    return total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: dict[str, np.ndarray], x: np.ndarray, rows: int = 32) -> np.ndarray:
    """Per window, in batches that stay in the processor's cache."""
    tables = [v for k, v in model.items() if k.startswith("filter")]
    out = np.empty((len(x), len(model["bias"])), np.float32)
    for a in range(0, len(x), rows):
        part = x[a:a + rows]
        pooled = np.concatenate([responses(t, part).max(axis=1) for t in tables], axis=1)
        out[a:a + rows] = softmax(np.maximum(pooled, 0) @ model["weight"] + model["bias"])
    return out


def train(x: np.ndarray, y: np.ndarray, languages: int, epochs: int = EPOCHS, batch: int = 64,
          rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the cross entropy; a filter's gradient reaches the bytes at its largest response."""
    model = start(languages, seed)
    names = [k for k in model if k.startswith("filter")]
    means = {k: np.zeros_like(v) for k, v in model.items()}
    squares = {k: np.zeros_like(v) for k, v in model.items()}
    order, step = np.random.default_rng(seed + 1), 0
    for _ in range(epochs):
        turn = order.permutation(len(x))
        for a in range(0, len(turn), batch):
            rows, target = x[turn[a:a + batch]], y[turn[a:a + batch]]
            found = [responses(model[k], rows) for k in names]
            best = [r.argmax(axis=1) for r in found]
            pooled = np.concatenate([np.take_along_axis(r, b[:, None], 1)[:, 0] for r, b in zip(found, best)], axis=1)
            hidden = np.maximum(pooled, 0)
            error = softmax(hidden @ model["weight"] + model["bias"])
            error[np.arange(len(rows)), target] -= 1
            error /= len(rows)
            back = (error @ model["weight"].T) * (pooled > 0)
            slopes = {"weight": hidden.T @ error, "bias": error.sum(axis=0)}
            for i, name in enumerate(names):
                table, at = model[name], best[i]
                part = back[:, i * table.shape[2]:(i + 1) * table.shape[2]]
                slope = np.zeros_like(table)
                column = np.broadcast_to(np.arange(table.shape[2]), at.shape)
                for k in range(len(table)):
                    np.add.at(slope[k], (np.take_along_axis(rows, at + k, 1), column), part)
                slopes[name] = slope
            step += 1
            for k, slope in slopes.items():
                means[k] += 0.1 * (slope - means[k])
                squares[k] += 0.001 * (slope * slope - squares[k])
                model[k] -= rate * (means[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(squares[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


# On tables ---------------------------------------------------------------------------


def remainder(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def sample_windows(docs: DataFrame, id_column: str, text_column: str, lang_column: str,
                   sample: int, take: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows of a bounded sample of the rows to learn from, and their languages."""
    rows = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"), F.col(lang_column).alias("l")).where(
        F.col("l").isNotNull() & (remainder("i") != 1))
    usable = rows.where(F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, sample / counts[lang]))])[F.col("l")]
    draw = F.pmod(F.xxhash64("i", "t", F.lit("draw")), F.lit(1 << 30)) < share * (1 << 30)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                all_rows = windows_of(text.as_py().encode())
                chosen = np.unique(np.linspace(0, len(all_rows) - 1, min(take, len(all_rows))).round().astype(int))
                out += [(lang, all_rows[k].tobytes()) for k in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in out], pa.string()),
                                              pa.array([v[1] for v in out], pa.binary())], ["lang", "window"])

    got = sorted(map(tuple, usable.where(draw).select("l", "t").mapInArrow(cut, "lang string, window binary").collect()))
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(len(got), WINDOW)
    return languages, x, np.array([languages.index(lang) for lang, _ in got], np.int64)


Learned = tuple[list[str], dict[str, np.ndarray] | None]


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
          sample: int = SAMPLE, take: int = TAKE, epochs: int = EPOCHS) -> Learned:
    """The languages and the network trained on a sample of ``docs``; none for fewer than two languages."""
    languages, x, y = sample_windows(docs, id_column, text_column, lang_column, sample, take)
    return languages, train(x, y, len(languages), epochs) if len(languages) > 1 else None


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             sample: int = SAMPLE, take: int = TAKE, epochs: int = EPOCHS, known: Learned | None = None) -> DataFrame:
    """All columns of ``docs``, and ``held_out``, ``lang_pred`` and ``score``; replaces columns of those names.

    Without ``known``, it learns from ``docs``.
    """
    known = known or learn(docs, id_column, text_column, lang_column, sample, take, epochs)
    learned = docs.sparkSession.sparkContext.broadcast(known)  # tables of a few hundred KB
    made = ("held_out", "lang_pred", "score")
    rest = [c for c in docs.columns if c not in made]
    inputs = docs.select(*[F.col(f"`{c}`") for c in rest],
                         F.coalesce(remainder(id_column) == 1, F.lit(False)).alias("held_out"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, network = learned.value
        for part in parts:
            texts = part.column(rest.index(text_column))
            labels, scores = predict_texts(network, names, (t.as_py() for t in texts))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                [*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*inputs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return inputs.mapInArrow(batches, schema)


def predict_texts(model: dict[str, np.ndarray] | None, languages: list[str],
                  texts: Iterator[str | None], most: int = 4096) -> tuple[list[str], list[float]]:
    """Language and score of each text. Windows of several texts go through the network together."""
    labels: list[str] = []
    scores: list[float] = []
    waiting: list[tuple[int, np.ndarray, int]] = []  # position of the result, windows, bytes

    def flush() -> None:
        if not waiting:
            return
        got = probabilities(model, np.concatenate([w for _, w, _ in waiting]))
        at = 0
        for place, rows, size in waiting:
            weights = np.full(len(rows), WINDOW, np.float64)
            weights[-1] = size - WINDOW * (len(rows) - 1)
            mean = weights @ got[at:at + len(rows)] / size
            at += len(rows)
            best = int(mean.argmax())
            labels[place], scores[place] = languages[best], float(min(1.0, mean[best]))
        waiting.clear()

    held = 0
    for text in texts:
        labels.append(UNKNOWN)
        scores.append(0.0)
        if not languages or text is None or not any(map(str.isalpha, text)):
            continue
        if model is None:
            labels[-1], scores[-1] = languages[0], 1.0
            continue
        data = text.encode()
        waiting.append((len(labels) - 1, windows_of(data), len(data)))
        held += len(waiting[-1][1])
        if held >= most:
            flush()
            held = 0
    flush()
    return labels, scores
