"""Passages that repeat across documents, by content-defined chunking.

A gear hash rolls over the bytes of a text; it depends on the last sixteen bytes only.
A byte where it falls under a bound is a candidate, and a candidate with no other one
shortly before it is a cut. So cuts depend on nothing but the bytes around them, and
after an insertion the same chunks follow. Chunks are short; four of them in a row are
looked up together by one digest, which keeps common phrases from passing as repeats.
Adjoining windows that occur in another document are one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import packets
from earshot.llm import textbytes as tb
from earshot.llm.frames import without
from earshot.plans.sizing import broadcast_if_bounded, materialize

_GEAR = (tb.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
REACH = 16  # bytes the hash depends on
CANDIDATE = 6  # one byte in so many is a candidate
LEAST = 7  # and a cut if the one before it is so many bytes off
MOST = 512  # longer chunks are cut every so many bytes
WINDOW = 4
#: A reported passage has so many bytes at least, some 25 words of prose, or so many words,
#: which a passage of more than 50 keeps when its edges are cut to chunk borders.
PASSAGE_BYTES = 140
PASSAGE_WORDS = 30


def _cuts(part: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk of the texts, and its text."""
    h = _GEAR[part.data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    at = np.flatnonzero(h < (1 << 16) // CANDIDATE)
    text = np.searchsorted(part.offsets, at, side="right") - 1
    inside = at - part.offsets[text] >= REACH - 1
    at, text = at[inside], text[inside]
    alone = np.ones(len(at), bool)
    alone[1:] = (at[1:] - at[:-1] >= LEAST) | (text[1:] != text[:-1])
    ends = at[alone] + 1
    starts = np.unique(np.concatenate([part.offsets[:-1][np.diff(part.offsets) > 0], ends[ends < len(part.data)]]))
    # The start after a text's last cut may be the next text's own start; both are there already.
    length = np.diff(np.append(starts, len(part.data)))
    many = np.flatnonzero(length > MOST)
    if len(many):
        more = [np.arange(starts[i] + MOST, starts[i] + length[i], MOST) for i in many.tolist()]
        starts = np.sort(np.concatenate([starts, *more]))
    return starts, np.searchsorted(part.offsets, starts, side="right") - 1


_SPAN = np.dtype([("start", "<u4"), ("length", "<u4"), ("word", "<u4"), ("words", "<u4")])


def _word_starts(part: tb.Texts) -> np.ndarray:
    flag = tb.NOT_SPACE[part.data]
    opens = flag.copy()
    opens[1:] &= ~flag[:-1]
    edge = part.offsets[:-1][part.offsets[:-1] < len(flag)]
    opens[edge] = flag[edge]
    return np.flatnonzero(opens)


def _packer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in tb.slices(batch.column(1), 2 * tb.SLICE_BYTES):
                starts, text = _cuts(part)
                if not len(starts):
                    continue
                ends = np.append(starts[1:], len(part.data))
                ends = np.minimum(ends, part.offsets[text + 1])
                chunk = tb.span_hashes(part.data, starts, ends)
                count = np.bincount(text, minlength=len(part))
                last = np.cumsum(count)[text] - 1  # a text's last chunk
                to = np.minimum(np.arange(len(starts)) + WINDOW - 1, last)
                whole = np.flatnonzero((to - np.arange(len(starts)) == WINDOW - 1) | (count[text] < WINDOW) & (np.cumsum(count)[text] - count[text] == np.arange(len(starts))))
                n = to[whole] - whole + 1
                token = np.zeros(len(whole), np.uint64)
                for k in range(WINDOW):
                    own = n > k
                    token[own] = token[own] * np.uint64(0xD1342543DE82EF95) + chunk[whole[own] + k]
                token = tb.mix(token + n.astype(np.uint64))
                span = np.empty(len(whole), _SPAN)
                span["start"] = starts[whole] - part.offsets[text[whole]]
                span["length"] = ends[to[whole]] - starts[whole]
                words = _word_starts(part)
                begun, past = np.searchsorted(words, starts[whole]), np.searchsorted(words, ends[to[whole]])
                span["word"], span["words"] = begun - np.searchsorted(words, part.offsets[text[whole]]), past - begun
                own_ids = ids[part.first : part.first + len(part)]
                out = packets.pack(token, text[whole], span, own_ids, np.zeros(len(part), np.int32), buckets)
                if out is not None:
                    yield out

    return run


def _repeats(bucket: packets.Bucket) -> pa.RecordBatch | None:
    at = np.flatnonzero(bucket.shared)
    if not len(at):
        return None
    start, word = (bucket.extra[c][at].astype(np.int64) for c in ("start", "word"))
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (
            bucket.ids[at], start, start + bucket.extra["length"][at], bucket.first[at], word, word + bucket.extra["words"][at]
        )],
        names=["id", "start", "past", "first", "word", "past_word"],
    )


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", passage_bytes: int = PASSAGE_BYTES, passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """doc_id, start_byte, n_bytes, first_doc_id and kept boolean of every passage that is in several documents.

    A passage is a maximal stretch of bytes of a text's UTF-8 that repeated windows
    cover, of passage_bytes or passage_words (begun in it) at least; its edges lie on
    chunk borders inside the true ones. Passages of which this document is the first (smallest id) have kept = true
    and are reported apart from those first seen elsewhere, so that deleting the rest
    leaves one copy of everything. A repeat inside one document alone is none. Null and
    empty texts have no passages; rows with a null id take no part; rows that share an
    id are one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = packets.buckets_of(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).dropna()
    packed = rows.mapInArrow(_packer(buckets), packets.PACKED)
    found = packets.shared_tokens(packed, buckets, _SPAN, _repeats, "id long, start long, past long, first long, word long, past_word long")
    own = found.select("*", (F.col("id") == F.col("first")).alias("kept"))
    order = Window.partitionBy("id", "kept").orderBy("start", "past")
    reach = F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = own.select("*", F.when(F.col("start") > reach, 1).otherwise(0).alias("new"))
    numbered = begun.select("*", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("number"))
    joined = numbered.groupBy("id", "kept", "number").agg(F.min("start").alias("start"), F.max("past").alias("past"), F.min("first").alias("first"),
        (F.max("past_word") - F.min("word")).alias("words"))
    long_enough = (F.col("past") - F.col("start") >= passage_bytes) | (F.col("words") >= passage_words)
    return joined.filter(long_enough).select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_byte"), (F.col("past") - F.col("start")).alias("n_bytes"),
        F.col("first").alias("first_doc_id"), "kept",
    )


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept_text") -> DataFrame:
    """docs with the text less its passages that are kept elsewhere; a null text stays null.

    A cut inside a multi-byte character drops that character. A column of the name is replaced.
    """
    spans = passages.filter("not kept").groupBy(F.col("doc_id").alias("__id")).agg(
        F.sort_array(F.collect_list(F.struct("start_byte", "n_bytes"))).alias("__spans")
    )
    base = without(docs, out)
    joined = base.join(broadcast_if_bounded(materialize(spans, "spans"), 50_000), F.col(key) == F.col("__id"), "left").drop("__id")
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType())])
    at, spans_at = [c.lower() for c in base.columns].index(text.lower()), len(base.columns)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column(at), batch.column(spans_at)):
                raw, spans = value.as_py(), spans.as_py()
                if raw is not None and spans:
                    data, parts, last = raw.encode(), [], 0
                    for s in spans:
                        parts.append(data[last : s["start_byte"]])
                        last = s["start_byte"] + s["n_bytes"]
                    raw = b"".join([*parts, data[last:]]).decode("utf-8", "ignore")
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    return joined.mapInArrow(run, schema)
