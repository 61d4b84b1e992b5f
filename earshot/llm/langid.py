"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: the runs of three and four bytes
of its lower-cased words, word edges included, hashed into a fixed number of rows. The
model is fitted in numpy on the driver, by stochastic gradient descent, on a bounded
sample of labelled rows that arrive as counts per subword row, never as texts.
Afterwards embeddings and softmax weights are multiplied out, so that scoring sums one
short row per subword, over whole texts of any length, in Arrow batches.

A part of the sample is kept from the fit. On it a temperature calibrates the scores,
and the rejection threshold is the score under which fewer than `reject_rate` of its
rightly recognised texts lie, 0.5 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import textbytes as tb
from earshot.llm.frames import append_columns

ROWS_BITS = 14
DIMENSIONS = 16
#: Labelled rows the model is fitted on at most, or one of each language if there are more of those.
SAMPLE_ROWS = 4_000
_SLICES = 50
UNDETERMINED = "und"
_LETTER_BYTE = tb.byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])


def _subwords(part: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row of every subword of the texts, and where each text's begin."""
    n, count = len(part.data), len(part)
    low = tb.LOWER[part.data]
    low = np.where(_LETTER_BYTE[low], low, np.uint8(0x20))
    # Each text gets a blank on either side, so that no subword spans two of them.
    gap = np.repeat(np.arange(count, dtype=np.int64) * 2 + 1, np.diff(part.offsets))
    padded = np.full(n + 2 * count, 0x20, np.uint8)
    padded[np.arange(n) + gap] = low
    begins = part.offsets[:-1] + 2 * np.arange(count)
    wide, blank = padded.astype(np.uint32), padded == 0x20
    out, where = [], []
    if len(padded) >= 4:
        three = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
        inner = ~blank[1:-1]
        out.append(three[inner])
        where.append(np.flatnonzero(inner))
        four = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        inner = ~(blank[1:-2] | blank[2:-1])
        out.append(four[inner] ^ np.uint32(0x5BD1E995))
        where.append(np.flatnonzero(inner))
    grams = np.concatenate(out) if out else np.zeros(0, np.uint32)
    where = np.concatenate(where) if where else np.zeros(0, np.int64)
    grams = ((grams * np.uint32(0x9E3779B1)) ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA77)
    rows = (grams >> np.uint32(32 - ROWS_BITS)).astype(np.int32)
    text = np.searchsorted(begins, where, side="right") - 1
    order = np.argsort(text, kind="stable")
    return rows[order], np.searchsorted(text[order], np.arange(count + 1))


def _has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; the few without an ASCII one are asked a character at a time."""
    out = np.zeros(len(column), bool)
    ascii_letter = tb.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
    for part in tb.slices(column):
        sums = np.concatenate([[0], np.cumsum(ascii_letter[part.data])])
        some = sums[part.offsets[1:]] > sums[part.offsets[:-1]]
        out[part.first : part.first + len(part)] = some
        for i in np.flatnonzero(~some & (np.diff(part.offsets) > 0)).tolist():
            text = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace")
            out[part.first + i] = any(c.isalpha() for c in text)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of logits per subword row
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated probabilities of each text, a column per language."""
        out = np.zeros((len(column), len(self.languages)))
        for part in tb.slices(column, tb.SLICE_BYTES // 2):
            rows, begins = _subwords(part)
            n = np.diff(begins)
            sums = np.zeros((len(part), len(self.languages)))
            some = n > 0
            if some.any():
                sums[some] = np.add.reduceat(self.table[rows], begins[:-1][some], axis=0, dtype=np.float64)
            out[part.first : part.first + len(part)] = sums / np.maximum(n, 1)[:, None] + self.bias
        out = np.exp((out - out.max(axis=1, keepdims=True)) / self.temperature)
        return out / out.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, text: str, label: str, rows: int) -> tuple[list, list]:
    """Subword rows and counts of the sampled texts, with their labels; the sample is by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for part in tb.slices(batch.column(0)):
                found, begins = _subwords(part)
                for i in range(len(part)):
                    got, n = np.unique(found[begins[i] : begins[i + 1]], return_counts=True)
                    ids.append(got.astype(np.int32))
                    counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), batch.column(1)],
                names=["ids", "counts", "label"],
            )

    labelled = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).dropna()
    # Equal shares of the languages: the first distinct texts, in hash order, of every slice of each.
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    languages = labelled.select("label").distinct().count()
    if not languages:
        return [], []
    share = max(1, rows // languages)
    slices = min(_SLICES, share)
    order = Window.partitionBy("label", "slice").orderBy("h")
    first = hashed.select("label", "h", F.pmod("h", F.lit(slices)).alias("slice")).distinct()
    first = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share // slices)
    chosen = hashed.join(F.broadcast(first.select("label", "h")), ["label", "h"])
    chosen = chosen.dropDuplicates(["label", "h"]).orderBy("label", "h").select("text", "label")
    got = chosen.mapInArrow(count, "ids array<int>, counts array<int>, label string").toArrow()
    # Views of the columns' own memory: as lists of Python numbers they would be ten times as large.
    pairs = list(zip(_rows_of(got["ids"]), _rows_of(got["counts"])))
    keep = [i for i, p in enumerate(pairs) if len(p[0])]
    labels = got["label"].to_pylist()
    return [pairs[i] for i in keep], [labels[i] for i in keep]


def _rows_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out.extend(values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))
    return out


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS, seed: int = 3,
    epochs: int = 6, rate: float = 2.0, reject_rate: float = 0.001,
) -> Model | None:
    """A model of all labels of docs, from rows with text and label.

    At most sample_rows of them, in equal shares of the labels; with more labels than that,
    one row of each. A label of which no sampled text has a subword is not learned. None if
    no row has both.
    """
    pairs, labels = _sample(docs, text, label, sample_rows)
    if not pairs:
        return None
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    random = np.random.default_rng(seed)
    order = random.permutation(len(pairs))
    held = order[: len(order) // 5] if len(order) >= 20 else order
    fitted = order[len(order) // 5 :] if len(order) >= 20 else order
    # A language with all its rows kept from the fit would not be learned: one of them is fitted.
    only = ~np.isin(y[held], y[fitted])
    if only.any():
        first = np.flatnonzero(only)[np.unique(y[held[only]], return_index=True)[1]]
        fitted, rest = np.concatenate([fitted, held[first]]), np.delete(held, first)
        held = rest if len(rest) else fitted
    embed = random.normal(0, 0.1, (1 << ROWS_BITS, DIMENSIONS))
    weights = random.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(fitted).tolist():
            ids, counts = pairs[i]
            # A random part of the text's subwords: short texts are to be recognised as well.
            keep = random.random(len(ids)) < random.choice((0.05, 0.3, 1.0))
            if keep.any():
                ids, counts = ids[keep], counts[keep]
            share = counts / counts.sum()
            mean = share @ embed[ids]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            embed[ids] -= step * share[:, None] * back
    table = embed @ weights
    logits = np.array([(pairs[i][1] @ table[pairs[i][0]]) / pairs[i][1].sum() + bias for i in held])
    temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: _loss(logits / t, y[held]))
    z = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
    z /= z.sum(axis=1, keepdims=True)
    right = z.max(axis=1)[z.argmax(axis=1) == y[held]]
    threshold = min(0.5, float(np.quantile(right, reject_rate))) if len(right) else 0.5
    return Model(languages, table.astype(np.float32), bias, float(temperature), threshold)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(y)), y]))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred string, score double (0 to 1) and rejected boolean.

    A text that is null or has no letter is `und` with score 0 and rejected, and so is
    every text if there is no model. Other texts get a learned language; they are
    rejected when its calibrated score is below the model's threshold. Equal texts get
    equal results. Columns of the three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        model = shared.value
        letters = _has_letter(column)
        if model is None:
            letters[:] = False
            best, score = np.zeros(len(column), int), np.zeros(len(column))
        else:
            p = model.scores(column)
            best, score = p.argmax(axis=1), p.max(axis=1)
        names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())]
        score = np.where(letters, score, 0.0)
        return [
            pa.array(names, pa.string()), pa.array(score),
            pa.array(~letters | (score < (model.threshold if model else 1))),
        ]

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return append_columns(docs, text, fields, work)


def held_out(key: str = "doc_id") -> Column:
    """Every fifth document, by checksum of its id: never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(5)) == 0
