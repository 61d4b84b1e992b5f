"""Ranked lexical search: a sharded inverted index and Block-Max MaxScore over it.

The index is a table of shards. A shard is one row: some documents that lay together, a
dictionary of their terms, and for each term a list of postings (document, occurrences)
in compressed blocks, with each block's largest contribution beside it. Shards are made
where the documents lie, without a shuffle, and are bounded in bytes of text.

A search goes through a shard query by query. Lists in descending order of the most they
can give (their bound) are essential until those left cannot lift a document into the
best k together; documents of essential lists alone are candidates. The maxima of the
blocks that candidates fall into on the other lists reject most of them before any such
block is decompressed. A task keeps one heap of k per query for all of its shards, whose
least score is the threshold for the next shard; the heaps of all tasks are merged by rank.

A document's score is the sum over the query's terms of w * ((10^9 tf) div (1000 tf + 8 m)),
where w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L; N counts the
documents with a term, L all terms, n the document's, df the documents that hold the term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import textbytes as tb
from earshot.plans.sizing import materialize

#: Bytes of text per shard; a longer single text is a shard of its own.
SHARD_BYTES = 8_000_000
#: Shards per file of the index, and so in a task's memory, however much of the documents one task reads.
FILE_SHARDS = 2
BLOCK = 128
#: Query terms (a term counts once for each query that has it) that are sent to the tasks at once.
TERMS_AT_ONCE = 200_000

_PARTS = (
    "ids", "lengths", "hashes", "term_bytes", "term_ends", "lists", "postings", "block_first", "block_last", "block_max",
    "block_at", "block_kind", "payload",
)
_SHARD = ", ".join(f"{p} binary" for p in _PARTS)
_WIDTHS = np.array([1, 2, 4])
_KINDS = (np.dtype("u1"), np.dtype("<u2"), np.dtype("<u4"))


@dataclass
class Index:
    """An index table with the figures of all its documents."""

    shards: DataFrame
    n_docs: int
    n_terms: int


# --- building ----------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(3, np.int64)
    for batch in batches:
        for part in tb.slices(batch.column(0)):
            counts = tb.words(part, tb.ALNUM).per_text
            totals += [(counts > 0).sum(), counts.sum(), len(part.data)]
    yield pa.RecordBatch.from_arrays([pa.array([int(t)], pa.int64()) for t in totals], names=["docs", "terms", "bytes"])


def _ragged(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[s:s + n] of all spans, one after another."""
    ends = np.cumsum(length)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def _scale(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with these numbers of terms."""
    lengths = lengths.astype(np.int64)
    if len(lengths) and int(lengths.max()) * n_docs * 90 >= 1 << 63:
        return np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return 10 + 90 * lengths * n_docs // max(1, n_terms)


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Builder:
    """Gathers documents and writes them as one shard."""

    def __init__(self, n_docs: int, n_terms: int):
        self.totals = n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.bytes = self.docs = 0
        self.ids, self.lengths, self.terms, self.postings = [], [], [], []

    def add(self, ids: np.ndarray, part: tb.Texts) -> None:
        w = tb.words(part, tb.ALNUM)
        kept = np.flatnonzero(w.per_text)
        if not len(kept):
            return
        number = np.full(len(part), -1, np.int64)
        number[kept] = self.docs + np.arange(len(kept))
        order = np.lexsort((w.text, w.hash))
        hashed, text = w.hash[order], w.text[order]
        new_term = np.concatenate([[True], hashed[1:] != hashed[:-1]])
        heads = np.flatnonzero(new_term | np.concatenate([[True], text[1:] != text[:-1]]))
        tf = np.diff(np.append(heads, len(hashed)))
        self.postings.append((hashed[heads], number[text[heads]].astype(np.uint32), tf.astype(np.uint32)))
        first = order[new_term]
        size = w.end[first] - w.start[first]
        self.terms.append((hashed[new_term], _ragged(w.low, w.start[first], size), size))
        self.ids.append(ids[kept])
        self.lengths.append(w.per_text[kept].astype(np.int64))
        self.docs += len(kept)
        self.bytes += len(part.data)

    def shard(self) -> pa.RecordBatch | None:
        if not self.docs:
            return None
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        hashed, doc, tf = (np.concatenate(x) for x in zip(*self.postings))
        terms, at = np.unique(np.concatenate([t[0] for t in self.terms]), return_index=True)
        size = np.concatenate([t[2] for t in self.terms])
        begin = np.cumsum(size) - size
        term_bytes = _ragged(np.concatenate([t[1] for t in self.terms]), begin[at], size[at])
        self.clear()
        # Slices came in the order of their documents, so a stable sort keeps lists ascending.
        order = np.argsort(hashed, kind="stable")
        hashed, doc, tf = hashed[order], doc[order], tf[order]
        starts = np.searchsorted(hashed, terms)
        held = np.diff(np.append(starts, len(hashed)))
        blocks = -(-held // BLOCK)
        lists = np.concatenate([[0], np.cumsum(blocks)])
        within = np.arange(lists[-1]) - np.repeat(lists[:-1], blocks)
        head = np.repeat(starts, blocks) + within * BLOCK
        count = np.diff(np.append(head, len(doc)))
        gains = _gain(tf, _scale(lengths, *self.totals)[doc])
        low, high, most = doc[head], doc[head + count - 1], np.maximum.reduceat(tf, head)
        doc_kind = np.digitize(high - low, [1 << 8, 1 << 16])
        tf_kind = np.digitize(most, [1 << 8, 1 << 16])
        span = count * (_WIDTHS[doc_kind] + _WIDTHS[tf_kind])
        block_at = np.cumsum(span) - span
        payload = np.zeros(int(span.sum()), np.uint8)
        of = np.repeat(np.arange(len(head)), count)
        place = np.arange(len(doc)) - head[of]
        base = block_at[of]
        for values, kinds in ((doc - low[of], doc_kind), (tf, tf_kind)):
            for kind, dtype in enumerate(_KINDS):
                which = np.flatnonzero(kinds[of] == kind)
                raw = values[which].astype(dtype).view(np.uint8).reshape(len(which), dtype.itemsize)
                payload[(base[which] + place[which] * dtype.itemsize)[:, None] + np.arange(dtype.itemsize)] = raw
            base = base + (count * _WIDTHS[kinds])[of]
        columns = (
            ids.astype("<i8"), lengths.astype("<i8"), terms.astype("<u8"), term_bytes, np.cumsum(size[at]).astype("<i8"),
            lists.astype("<i8"), held.astype("<i8"), low.astype("<u4"), high.astype("<u4"), np.maximum.reduceat(gains, head).astype("<i8"),
            block_at.astype("<i8"), (doc_kind + 4 * tf_kind).astype("u1"), payload,
        )
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=list(_PARTS))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written to the shared folder.

    Terms are runs of digits, letters a to z (A to Z lower-cased) and characters beyond
    ASCII, of the whole text. Documents without a term, null or empty ones, are not in
    it and do not count. Rows with a null key take no part; rows that share a key are
    documents of their own. Other columns are not read, whatever their names. An empty
    table gives an index that finds nothing.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).dropna()
    counted = rows.select("text").mapInArrow(_count, "docs long, terms long, bytes long")
    n_docs, n_terms, size = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "terms", "bytes"))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(n_docs, n_terms)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in tb.slices(batch.column(1)):
                if builder.bytes and builder.bytes + len(part.data) > shard_bytes:
                    yield builder.shard()
                builder.add(ids[part.first : part.first + len(part)], part)
        if (last := builder.shard()) is not None:
            yield last

    # Small partitions are taken together, so that there is about a shard in each.
    wanted = max(-(-size // shard_bytes), rows.sparkSession.sparkContext.defaultParallelism)
    return Index(materialize(rows.coalesce(wanted).mapInArrow(run, _SHARD), "index", FILE_SHARDS), n_docs, n_terms)


# --- searching ---------------------------------------------------------------------


class Shard:
    """One row of the index; posting lists are decompressed a block at a time."""

    def __init__(self, row: dict[str, memoryview], n_docs: int, n_terms: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.hashes = read("ids", "<i8"), read("hashes", "<u8")
        self.m = _scale(read("lengths", "<i8"), n_docs, n_terms)
        self.term_bytes, self.term_ends = row["term_bytes"], read("term_ends", "<i8")
        self.lists, self.postings = read("lists", "<i8"), read("postings", "<i8")
        self.first, self.last, self.most = read("block_first", "<u4"), read("block_last", "<u4"), read("block_max", "<i8")
        self.at, self.kind, self.payload = read("block_at", "<i8"), read("block_kind", "u1"), row["payload"]
        self.decompressed = 0
        self._whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The list of each term, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, at, -1)
        for i in np.flatnonzero(out >= 0).tolist():
            t = out[i]
            if bytes(self.term_bytes[self.term_ends[t - 1] if t else 0 : self.term_ends[t]]) != terms[i]:
                out[i] = -1
        return out

    def block(self, t: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and what the term gives each of them, of one block of list t, before weighting."""
        self.decompressed += 1
        n = min(BLOCK, int(self.postings[t]) - (b - int(self.lists[t])) * BLOCK)
        kind, at = int(self.kind[b]), int(self.at[b])
        doc = np.frombuffer(self.payload, _KINDS[kind & 3], n, at) + self.first[b]
        tf = np.frombuffer(self.payload, _KINDS[kind >> 2], n, at + n * int(_WIDTHS[kind & 3]))
        return doc, _gain(tf, self.m[doc])

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list; kept, since the next query may have the term too."""
        if t not in self._whole:
            parts = [self.block(t, b) for b in range(self.lists[t], self.lists[t + 1])]
            self._whole[t] = tuple(map(np.concatenate, zip(*parts)))
        return self._whole[t]


def best_of(shard: Shard, lists: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the shard's documents that may be among the best k, given that k score floor or more elsewhere.

    All documents of the k highest scores are among them, ties included.
    """
    bounds = weights * np.array([shard.most[shard.lists[t] : shard.lists[t + 1]].max() for t in lists.tolist()], np.int64)
    order = np.argsort(-bounds, kind="stable")
    lists, weights, bounds = lists[order], weights[order], bounds[order]
    left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
    score = np.zeros(len(shard.ids), np.int64)
    threshold, essential = floor, 0
    while essential < len(lists) and left[essential] >= max(threshold, 1):
        docs, gains = shard.whole(int(lists[essential]))
        score[docs] += weights[essential] * gains
        essential += 1
        if len(score) > k:
            threshold = max(threshold, int(np.partition(score, len(score) - k)[len(score) - k]))
    docs = np.flatnonzero((score > 0) & (score + left[essential] >= threshold))
    got = score[docs]
    others = range(essential, len(lists))
    if len(docs) and others:
        # What each candidate's block on each other list can give at most.
        blocks, most = np.zeros((len(others), len(docs)), np.int64), np.zeros((len(others), len(docs)), np.int64)
        for row, i in enumerate(others):
            a, b = int(shard.lists[lists[i]]), int(shard.lists[lists[i] + 1])
            at = a + np.searchsorted(shard.last[a:b], docs)
            inside = at < b
            at = np.minimum(at, b - 1)
            inside &= shard.first[at] <= docs
            blocks[row], most[row] = at, np.where(inside, weights[i] * shard.most[at], 0)
        rest = most.sum(axis=0)
        for row, i in enumerate(others):
            keep = got + rest >= threshold
            if not keep.all():
                docs, got, rest, blocks, most = docs[keep], got[keep], rest[keep], blocks[:, keep], most[:, keep]
            asked = np.flatnonzero(most[row])
            rest = rest - most[row]
            t = int(lists[i])
            for b in np.unique(blocks[row, asked]).tolist():
                mine = asked[blocks[row, asked] == b]
                held, gains = shard.block(t, b)
                at = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
                got[mine] += np.where(held[at] == docs[mine], weights[i] * gains[at], 0)
            if len(got) > k:
                threshold = max(threshold, int(np.partition(got, len(got) - k)[len(got) - k]))
    keep = (got > 0) & (got >= threshold)
    return docs[keep], got[keep]


def _query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """item and term, once each."""
    rows = queries.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_numpy()
            for part in tb.slices(batch.column(1)):
                w = tb.words(part, tb.ALNUM)
                raw = w.low.tobytes()
                terms = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items[part.first + w.text]), pa.array(terms, pa.binary())], names=["item", "term"]
                )

    return rows.mapInArrow(run, "item long, term binary").distinct()


def _hashes(terms: list[bytes]) -> np.ndarray:
    length = np.array([len(t) for t in terms], np.int64)
    ends = np.cumsum(length)
    return tb.span_hashes(np.frombuffer(b"".join(terms), np.uint8), ends - length, ends)


def _shards(batches: Iterator[pa.RecordBatch], index: tuple[int, int]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard({name: memoryview(batch.column(name)[i].as_buffer()) for name in _PARTS}, *index)


def _frequencies(index: Index, terms: list[bytes]) -> np.ndarray:
    """In how many documents each term is."""
    totals = index.n_docs, index.n_terms
    shared = index.shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, df = _hashes(shared.value), np.zeros(len(shared.value), np.int64)
        for shard in _shards(batches, totals):
            at = shard.find(shared.value, hashes)
            df += np.where(at >= 0, shard.postings[at], 0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    # A row for each term of this block of queries, at most.
    for row in index.shards.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


def _search(index: Index, asked: list[tuple[int, bytes]], k: int) -> DataFrame:
    """item, doc_id and score: the best k of every task for each query of a block."""
    terms = sorted({t for _, t in asked})
    number = {t: i for i, t in enumerate(terms)}
    df, n_docs = _frequencies(index, terms), index.n_docs
    # In doubles, as the formula says.
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
    of: dict[int, list[int]] = {}
    for item, term in asked:
        i = number[term]
        if df[i] and weight[i] > 0:
            of.setdefault(item, []).append(i)
    totals = index.n_docs, index.n_terms
    shared = index.shards.sparkSession.sparkContext.broadcast((terms, weight, {q: np.array(sorted(t)) for q, t in of.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, of = shared.value
        if not of:
            return
        hashes = _hashes(terms)
        heaps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in _shards(batches, totals):
            at = shard.find(terms, hashes)
            for item, mine in of.items():
                mine = mine[at[mine] >= 0]
                if not len(mine):
                    continue
                ids, scores = heaps.get(item, (np.zeros(0, np.int64),) * 2)
                floor = int(scores[k - 1]) if len(scores) >= k else 0
                docs, got = best_of(shard, at[mine], weight[mine], k, floor)
                if len(docs):
                    ids, scores = np.concatenate([ids, shard.ids[docs]]), np.concatenate([scores, got])
                    order = np.lexsort((ids, -scores))[:k]
                    heaps[item] = ids[order], scores[order]
        if heaps:
            items = np.repeat(np.array(list(heaps), np.int64), [len(h[0]) for h in heaps.values()])
            ids, scores = (np.concatenate(x) for x in zip(*heaps.values()))
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

    return index.shards.mapInArrow(run, "item long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, rank int (from 1), doc_id, score: the k documents of highest score above 0 for each query.

    Equal scores go by ascending doc_id. Each term of a query counts once; queries that
    share a key are one, with the terms of all. Queries with a null key, without text or
    without terms find nothing. Queries are sent to the tasks in blocks of some
    TERMS_AT_ONCE terms, each block one pass over the index.
    """
    asked = materialize(_query_terms(queries, key, text), "query-terms")
    blocks = max(1, -(-asked.count() // TERMS_AT_ONCE))
    found = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        part = _search(index, [(r["item"], bytes(r["term"])) for r in mine.toLocalIterator()], k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("item").cast(queries.schema[key].dataType).alias(key), "rank", "doc_id", "score"
    )
