"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import hash60, type_of

#: Buckets of hashed byte trigrams.
FEATURES = 2048
#: Training examples are consecutive pieces of the sampled texts, each about this long.
EXAMPLE_BYTES = 240
WINDOW = 1 << 19

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[x for x in range(128) if not chr(x).isalpha()]] = 32


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte but the last two; ASCII is lower-cased, its marks are blanks."""
    b = _LOWER[data]
    mixed = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - FEATURES.bit_length() + 1)


def code_matrix(classes: int, seed: int = 7) -> np.ndarray:
    """A codeword of +1 and -1 for each class: the exhaustive code up to 5 classes, else the best of random codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        bits = 2 ** (classes - 1) - 1
        rows = [np.ones(bits)]
        for i in range(1, classes):
            run = 2 ** (classes - 1 - i)
            rows.append(np.resize(np.repeat([-1.0, 1.0], run), bits))
        return np.array(rows)
    rng, best, distance = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(500):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = (code.shape[1] - code @ code.T) / 2
        least = int(apart[~np.eye(classes, dtype=bool)].min())
        if least > distance:
            best, distance = code, least
    return best


@dataclass(frozen=True)
class Model:
    """Weights by trigram bucket and bit, biases, codewords and the weight of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each text (row) against each codeword."""
        fit = np.exp(-np.clip(margins, -2, 2)[:, None, :] * self.code[None])
        return (fit * self.bit_weight[None]).sum(axis=2)


def _examples(texts: list[str]) -> np.ndarray:
    """Trigram shares of consecutive pieces that together are the whole of each text."""
    rows = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        for a in range(0, len(data), EXAMPLE_BYTES):
            piece = data[a : a + EXAMPLE_BYTES]
            if len(piece) >= 3:
                h = np.bincount(trigram_buckets(piece), minlength=FEATURES).astype(np.float32)
                rows.append(h / h.sum())
    return np.array(rows, dtype=np.float32).reshape(-1, FEATURES)


def train(samples: dict[str, list[str]], ridge: float = 1e-5) -> Model | None:
    """Least-squares binary classifiers for the bits; none without two languages.

    A bit's weight for a language is its accuracy on held-out texts of it, every
    fifth of the sample, as shares of the language's sum.
    """
    languages = sorted(k for k, v in samples.items() if any(len(t.encode()) >= 3 for t in v))
    if len(languages) < 2:
        return None
    code = code_matrix(len(languages))
    gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros((FEATURES + 1, code.shape[1]))
    held = []
    for i, language in enumerate(languages):
        texts = samples[language]
        fit = [t for k, t in enumerate(texts) if k % 5 or len(texts) < 5]
        held.append(_examples([t for k, t in enumerate(texts) if k % 5 == 0]))
        x = _examples(fit)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)]) / np.sqrt(max(1, len(x)))
        gram += x.T @ x
        moment += (x.T @ np.full((len(x), 1), 1 / np.sqrt(max(1, len(x))), np.float32)) * code[i]
    gram[np.diag_indices(FEATURES)] += ridge
    solved = np.linalg.solve(gram + 1e-9 * np.eye(FEATURES + 1), moment)
    weights, bias = solved[:-1], solved[-1]
    right = np.array([(np.sign(x @ weights + bias) == code[i]).mean(axis=0) if len(x) else np.ones(code.shape[1]) for i, x in enumerate(held)])
    right = np.maximum(right, 1e-3)
    return Model(languages, code, weights, bias, right / right.sum(axis=1, keepdims=True))


def batch_margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, trigrams) of the texts between the offsets of one byte buffer.

    The buffer is read in windows, so that a very long text needs no more memory.
    """
    n = len(offsets) - 1
    sums, counts = np.zeros((n, model.code.shape[1])), np.maximum(np.diff(offsets) - 2, 0)
    begins, ends = offsets[:-1], offsets[:-1] + counts
    for a in range(int(offsets[0]), max(int(offsets[0]), int(offsets[-1]) - 2), WINDOW):
        b = min(a + WINDOW, int(offsets[-1]) - 2)
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
        inside = np.arange(first, last)
        s, e = np.maximum(begins[inside], a) - a, np.minimum(ends[inside], b) - a
        kept = e > s
        if kept.any():
            values = model.weights[trigram_buckets(data[a : b + 2])]
            values = np.vstack([values, np.zeros((1, values.shape[1]))])
            cuts = np.stack([s[kept], e[kept]], axis=1).ravel()
            sums[inside[kept]] += np.add.reduceat(values, cuts, axis=0)[::2]
    return sums / np.maximum(counts, 1)[:, None] + model.bias, counts


def _decode(model: Model, ambiguous_below: float, least: int):
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            margins, counts = batch_margins(model, data, offsets) if len(texts) else (np.zeros((0, 1)), np.zeros(0))
            loss = model.losses(margins) if len(texts) else np.zeros((0, 2))
            order = np.argsort(loss, axis=1, kind="stable")
            best, second = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
            gap = np.round((second - best) / (second + best), 6)
            none = counts == 0
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(names[order[:, 0]], pa.string(), mask=none),
                    pa.array(names[order[:, 1]], pa.string(), mask=none),
                    pa.array(gap, pa.float64(), mask=none),
                    pa.array((gap < ambiguous_below) | (counts < least)),
                ],
                names=["doc_id", "language", "runner_up", "gap", "ambiguous"],
            )

    return run


#: Characters of one piece of a long labelled text.
PIECE_CHARS = 400


def bounded_text(text: Column, chars: int) -> Column:
    """The text, or of a longer one pieces from all over it that have about ``chars`` characters together."""
    pieces = max(2, chars // PIECE_CHARS)
    step = (F.length(text) - PIECE_CHARS) / F.lit(pieces - 1.0)
    own = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(PIECE_CHARS)))
    return F.when(F.length(text) <= max(chars, 2 * PIECE_CHARS), text).otherwise(F.array_join(own, " "))


def training_sample(docs: DataFrame, rows: int, chars: int) -> dict[str, list[str]]:
    """The texts, bounded to ``chars`` characters, of the ``rows`` documents of least hash in each language."""
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "text_key")
    ids = (
        docs.where("lang is not null and text is not null and text <> ''")
        .select("lang", "doc_id", hash60(F.col("doc_id")).alias("hash"), F.xxhash64("text").alias("text_key"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= rows)
        .select("lang", "doc_id", "text_key")
    )
    # at most ``rows`` a language
    picked = F.broadcast(ids.dropDuplicates().toDF("own_lang", "own_id", "own_key"))
    met = docs.select("doc_id", "text", "lang").join(
        picked,
        F.col("doc_id").eqNullSafe(F.col("own_id"))
        & (F.col("lang") == F.col("own_lang"))
        & (F.xxhash64("text") == F.col("own_key")),
    )
    out: dict[str, list[str]] = {}
    for r in sorted(met.select("lang", bounded_text(F.col("text"), chars).alias("text")).distinct().collect()):
        out.setdefault(r[0], []).append(r[1])
    return out


def identify_languages(
    docs: DataFrame, train_rows: int = 250, ambiguous_below: float = 0.08, least_trigrams: int = 12, train_chars: int = 100_000
) -> DataFrame:
    """(doc_id, language, runner_up, gap, ambiguous): one row for each document.

    The labels are the ``lang`` of at most ``train_rows`` documents a language, of
    each of which at most about ``train_chars`` characters train, from all over the text.
    Each language has a codeword; a binary classifier of byte trigrams predicts
    each bit, from the whole text. The language of least loss is chosen, with
    exponential loss and each bit weighted by its held-out accuracy. ``gap`` is
    the relative difference to the runner-up; below ``ambiguous_below``, or
    under ``least_trigrams`` trigrams, the text is ambiguous.

    Null texts and those under 3 bytes have no language and are ambiguous. Ties
    go to the language first in alphabetical order. Repeated rows and ids, of any type or null,
    are kept as they are. Columns other than doc_id, text and lang are not read.
    An empty table gives no rows; without two labelled languages every language
    is null and ambiguous.
    """
    model = train(training_sample(docs, train_rows, train_chars))
    inputs = docs.select("doc_id", "text")
    if model is None:
        nothing = F.lit(None).cast("string")
        return inputs.select(
            "doc_id", nothing.alias("language"), nothing.alias("runner_up"), F.lit(None).cast("double").alias("gap"), F.lit(True).alias("ambiguous")
        )
    return inputs.mapInArrow(
        _decode(model, ambiguous_below, least_trigrams),
        f"doc_id {type_of(docs, 'doc_id')}, language string, runner_up string, gap double, ambiguous boolean",
    )
