"""Toxicity by the nearest labelled examples: exact cosine over a block-max index of all their terms.

Terms are words and their leading five to eight bytes. The index has every term of its
examples, of either class, by TF-IDF with frequencies counted over all documents; a term
over-represented in toxic examples weighs the more, the larger its log-likelihood ratio,
and no term weighs less than its TF-IDF. The examples are a bounded sample of the labelled
rows, the one bound there is. They lie in blocks of 64 alike ones.

The commonest terms are held as columns, with their largest weight in each block; the
others as postings. A query adds up its postings, bounds every block by their largest sum
in it and the columns' maxima, and visits the blocks that can still hold a nearer example
than the k found, many queries at once. What comes near the k-th is computed again from
the sparse vectors: the neighbours are exact.

Neighbours vote with weights that fall with distance, classes weighed back to their
shares among all labels. A monotone map, fitted on the examples with each left out of
its own neighbours, turns votes into calibrated scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import textbytes as tb
from earshot.llm.frames import append_columns
from earshot.plans.sizing import materialize

#: Bound of the sample: labelled examples of each class.
CLASS_ROWS = 6_000
CHANCE = 15.0  # what chance may do to a log-likelihood ratio; the rest adds to a term's weight
NEIGHBOURS = 15
BLOCK = 64
COLUMNS = 1_024  # so many of the commonest terms are columns, the others postings
_GROUP = 8  # blocks visited at once
_QUERIES = 128
_RANGES = 64  # of terms, for adding up counts
_NEAR = 1e-5  # more than single precision can be off
SHARPNESS = 4  # votes weigh as this power of the cosine
KEPT_CACHE = 20_000
_PREFIXES = (5, 6, 7, 8)
_POSTING = np.dtype([("example", "<i4"), ("weight", "<f4")])
_WORD = tb.byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])


def _terms(part: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the texts, and its text, in no order."""
    w = tb.words(part, _WORD)
    hashes, texts = [w.hash], [w.text]
    for n in _PREFIXES:
        longer = np.flatnonzero(w.end - w.start > n)
        start = w.start[longer]
        hashes.append(tb.mix(tb.span_hashes(w.low, start, start + n) ^ np.uint64(n)))
        texts.append(w.text[longer])
    return np.concatenate(hashes), np.concatenate(texts)


@dataclass
class Vocabulary:
    """Sorted term hashes with the weight of each: inverse document frequency, times evidence."""

    terms: np.ndarray
    weight: np.ndarray
    slots: np.ndarray | None = field(init=False, default=None)  # made where texts are read

    def _hash(self) -> None:
        self._mask = np.uint64((1 << max(16, int(2 * len(self.terms)).bit_length())) - 1)
        at = (self.terms & self._mask).astype(np.int32)
        self.crowded = np.zeros(int(self._mask) + 1, bool)
        ordered = np.sort(at)
        self.crowded[ordered[1:][ordered[1:] == ordered[:-1]]] = True
        self.slots = np.full(int(self._mask) + 1, -1, np.int32)
        self.slots[at] = np.arange(len(at), dtype=np.int32)

    def __reduce__(self):
        return Vocabulary, (self.terms, self.weight)

    def counts(self, part: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term number and count of all terms of the vocabulary in the texts, ordered."""
        empty = np.zeros(0, np.int64)
        if not len(self.terms):
            return empty, empty, empty
        if self.slots is None:
            self._hash()
        hashes, texts = _terms(part)
        slot = (hashes & self._mask).astype(np.int64)
        which = self.slots[slot].astype(np.int64)
        same = (which >= 0) & (self.terms[which] == hashes)
        others = np.flatnonzero(self.crowded[slot] & ~same)
        if len(others):
            which[others] = np.minimum(np.searchsorted(self.terms, hashes[others]), len(self.terms) - 1)
            same[others] = self.terms[which[others]] == hashes[others]
        pair, n = np.unique(texts[same] * len(self.terms) + which[same], return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), n

    def vectors(self, part: tb.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and unit weights of each text."""
        text, term, n = self.counts(part)
        weight = (1 + np.log(n)) * self.weight[term] if len(n) else np.zeros(0)
        bounds = np.searchsorted(text, np.arange(len(part) + 1))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            v = weight[a:b]
            out.append((term[a:b], v / np.sqrt((v * v).sum()) if b > a else v))
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after another."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """Examples as sparse rows; made from them where it is used: columns, postings, and the maxima of blocks."""

    def __init__(self, n_terms: int, begins: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.n_terms, self.begins, self.terms, self.weights = n_terms, begins, terms, weights
        self.n = len(begins) - 1
        self.n_blocks = -(-self.n // BLOCK)
        self.column = None

    def _post(self) -> None:
        """Columns of the commonest terms with the maxima of blocks, and postings of the other terms."""
        df = np.bincount(self.terms, minlength=self.n_terms)
        columns = np.sort(np.argsort(-df, kind="stable")[:COLUMNS])
        self.column = np.full(self.n_terms, -1, np.int32)
        self.column[columns] = np.arange(len(columns), dtype=np.int32)
        of = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.begins))
        column = self.column[self.terms]
        rare = column < 0
        self.dense = np.zeros((self.n_blocks * BLOCK, len(columns)), np.float32)
        self.dense[of[~rare], column[~rare]] = self.weights[~rare]
        self.maxima = self.dense.reshape(self.n_blocks, BLOCK, len(columns)).max(axis=1)
        terms = self.terms[rare]
        order = np.argsort(terms, kind="stable").astype(np.int32)
        # An example and its weight side by side: one access fetches both.
        self.posted = np.empty(len(order), _POSTING)
        self.posted["example"], self.posted["weight"] = of[rare][order], self.weights[rare][order]
        self.post = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=self.n_terms))])

    def __reduce__(self):
        return Index, (self.n_terms, self.begins, self.terms, self.weights)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of the k nearest examples of every query, exactly; ties go to the lower number."""
        if self.column is None:
            self._post()
        m, width = len(queries), self.n_blocks * BLOCK
        query = np.zeros((m, self.dense.shape[1]), np.float32)
        posted = np.zeros((m, width), np.float32)
        pairs = self.posted.view(np.int64)
        for i, (terms, weights) in enumerate(queries):
            c = self.column[terms]
            query[i, c[c >= 0]] = weights[c >= 0]
            rare, w = terms[c < 0], weights[c < 0].astype(np.float32)
            a, b = self.post[rare], self.post[rare + 1]
            met = pairs.take(_ranges(a, b)).view(_POSTING)
            if len(met):
                posted[i] = np.bincount(met["example"], met["weight"] * np.repeat(w, b - a), width)
        # What only adds to a score: the k-th best of the blocks' largest sums of postings is a threshold already.
        most = posted.reshape(m, self.n_blocks, BLOCK).max(axis=2)
        bounds = query @ self.maxima.T + most
        scores = np.zeros((m, width), np.float32)
        best = np.zeros((m, k), np.float32)
        sure = np.zeros(m, np.float32)
        if self.n_blocks > k + 1 and leave_out is None:
            sure = np.partition(most, self.n_blocks - k, axis=1)[:, self.n_blocks - k]
        for g in np.argsort(-np.add.reduceat(bounds.sum(axis=0), np.arange(0, self.n_blocks, _GROUP)), kind="stable").tolist():
            blocks = slice(g * _GROUP, min((g + 1) * _GROUP, self.n_blocks))
            span = slice(blocks.start * BLOCK, blocks.stop * BLOCK)
            live = np.flatnonzero(bounds[:, blocks].max(axis=1) >= np.maximum(np.maximum(best[:, 0], sure) - _NEAR, 1e-12))
            if not len(live):
                continue
            part = query[live] @ self.dense[span].T + posted[live, span]
            if leave_out is not None:
                own = np.flatnonzero((leave_out[live] >= span.start) & (leave_out[live] < span.stop))
                part[own, leave_out[live[own]] - span.start] = 0
            scores[live, span] = part
            both = np.concatenate([best[live], part], axis=1)
            both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            best[live] = np.sort(both, axis=1)
        out = []
        own = np.zeros(self.n_terms)
        for i, (terms, weights) in enumerate(queries):
            at = np.flatnonzero(scores[i] >= max(best[i, 0] - _NEAR, 1e-30))
            own[terms] = weights
            inner = _ranges(self.begins[at], self.begins[at + 1])
            products = own.take(self.terms.take(inner)) * self.weights.take(inner)
            own[terms] = 0
            cosine = np.bincount(np.repeat(np.arange(len(at)), self.begins[at + 1] - self.begins[at]), products, len(at))
            order = np.lexsort((at, -cosine))[:k]
            out.append((at[order], cosine[order]))
        return out


@dataclass
class Model:
    vocabulary: Vocabulary
    ids: np.ndarray
    toxic: np.ndarray
    class_weight: np.ndarray  # of either class
    index: Index
    k: int
    prior: float
    empty_score: float  # of a text without any term
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the monotone map
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sent: Broadcast | None = None

    def share(self, spark: SparkSession):
        """Vocabulary and index as they are sent to the workers: once."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast((self.vocabulary, self.index))
        return self.sent

    def without_index(self) -> Model:
        return replace(self, vocabulary=None, index=None, sent=None)

    @property
    def blocks(self) -> list[np.ndarray]:
        """The examples by terms, block by block, in full: for tests."""
        out = []
        for a in range(0, self.index.n, BLOCK):
            b = min(a + BLOCK, self.index.n)
            m = np.zeros((b - a, self.index.n_terms))
            x = slice(self.index.begins[a], self.index.begins[b])
            m[np.repeat(np.arange(b - a), np.diff(self.index.begins[a : b + 1])), self.index.terms[x]] = self.index.weights[x]
            out.append(m)
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, exactly; ties go to the lower number."""
        return self.index.nearest([(terms, weights)], self.k)[0]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = np.minimum(cosine, 1.0) ** SHARPNESS * self.class_weight[self.toxic[found]]
        # A little of the prior stands for what is far from every example.
        return float((weight @ self.toxic[found] + 0.01 * self.prior) / (weight.sum() + 0.01))

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.votes, self.scores) if len(self.votes) else votes


def _monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: knots and their values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    # Half a vote of either side keeps scores off 0 and 1.
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.25) / (p[2] + 0.5) for p in pools])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for part in tb.slices(batch.column(0)):
            hashes, texts = _terms(part)
            order = np.lexsort((texts, hashes))
            hashes, texts = hashes[order], texts[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
            hashes, toxic = hashes[new], label[part.first + texts[new]]
            if len(hashes):
                heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                n, t = np.diff(np.append(heads, len(hashes))), np.add.reduceat(toxic.astype(np.int64), heads)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[heads].view(np.int64)), pa.array(t), pa.array(n - t)], names=["term", "t", "o"])


def _all_terms(chosen: DataFrame, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Every term of the examples, and by how much its evidence for toxic ones raises its weight: 1 at least."""
    counts = chosen.select("text", "toxic").mapInArrow(_term_counts, "term long, t long, o long").groupBy("term").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o")
    )
    both, n = F.col("t") + F.col("o"), n_toxic + n_other
    part = lambda x, share: F.when(x > 0, x * F.log(x / (both * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), n_toxic / n) + part(F.col("o"), n_other / n))
    factor = F.when(F.col("t") * n_other > F.col("o") * n_toxic, 1 + F.greatest(ratio - CHANCE, F.lit(0.0))).otherwise(1.0)
    rows = counts.select("term", factor.cast("float").alias("factor")).toArrow()
    terms, factors = rows.column("term").to_numpy().view(np.uint64), rows.column("factor").to_numpy()
    order = np.argsort(terms)
    return terms[order], factors[order]


def _document_frequencies(docs: DataFrame, text: str, terms: np.ndarray) -> np.ndarray:
    """In how many of all documents each term occurs.

    A task sends its counts packed by ranges of terms; what adds up a range holds no more
    than the range, whatever the number of tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms, np.ones(len(terms))))
    n_terms, parts = len(terms), _RANGES
    edges = np.arange(parts + 1) * n_terms // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in tb.slices(batch.column(0)):
                total += np.bincount(shared.value.counts(part)[1], minlength=n_terms)
        some = np.flatnonzero(total)
        at = np.searchsorted(some, edges)
        rows = [(k, np.stack([some[a:b], total[some[a:b]]]).tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                some, n = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, -1)
                sums.setdefault(key, np.zeros(edges[key + 1] - edges[key], np.int64))[some - edges[key]] += n
        kinds = (list(sums), pa.int32()), ([s.tobytes() for s in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(*x) for x in kinds], names=["key", "counts"])

    schema = "key int, counts binary"
    got = docs.select(text).mapInArrow(count, schema).repartition("key").mapInArrow(add, schema).toArrow()
    shared.destroy()
    out = np.zeros(n_terms, np.int64)
    for key, raw in zip(got.column("key").to_pylist(), got.column("counts")):
        out[edges[key] : edges[key + 1]] = np.frombuffer(raw.as_buffer(), np.int64)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    class_rows: int = CLASS_ROWS, k: int = NEIGHBOURS,
) -> Model | None:
    """A model from at most class_rows labelled examples of each class; None without both classes.

    labels has the key and 0 or 1; other labels and null keys are left out, and of a key
    with several labels the largest counts. docs may repeat a key: one of its texts is used.
    """
    clean = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).filter("toxic in (0, 1) and id is not null")
    clean = clean.groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in clean.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    parts = [clean.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(class_rows) for c in (0, 1)]
    chosen = materialize(
        docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(parts[0].unionAll(parts[1])), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")),
        "examples",
    )
    sampled = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(sampled) < 2:
        return None
    terms, evidence = _all_terms(chosen, sampled[1], sampled[0])
    n_docs = docs.count()
    idf = np.log((1 + n_docs) / (1 + _document_frequencies(docs, text, terms))) + 1
    known = Vocabulary(terms, idf * evidence)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch.column(2)):
                own = shared.value.vectors(part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, len(part)).cast(pa.string()), batch.column(1).slice(part.first, len(part)),
                    pa.array([v[0].astype(np.int32) for v in own], pa.list_(pa.int32())), pa.array([v[1].astype(np.float32) for v in own], pa.list_(pa.float32())),
                ], names=["id", "toxic", "terms", "weights"])

    rows = chosen.select("id", "toxic", "text").mapInArrow(vectors, "id string, toxic int, terms array<int>, weights array<float>").toArrow()
    shared.destroy()
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    ids = rows.column("id").to_pylist()
    pairs = list(zip(_lists(rows.column("terms")), _lists(rows.column("weights"))))
    del rows
    weight = np.array([totals[c] / sampled[c] for c in (0, 1)])
    prior = totals[1] / (totals[0] + totals[1])
    some = np.array([len(p[0]) > 0 for p in pairs])
    mass = weight[toxic[~some]]
    empty = float((mass @ toxic[~some] + prior) / (mass.sum() + 1))
    return _index(docs.sparkSession, known, ids, toxic, pairs, np.flatnonzero(some), weight, k, prior, empty)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out.extend(values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))
    return out


def _packed(n_terms: int, pairs: list, at: np.ndarray) -> Index:
    begins = np.concatenate([[0], np.cumsum([len(pairs[i][0]) for i in at.tolist()])]).astype(np.int64)
    terms, weights = (np.concatenate([*(pairs[i][c] for i in at.tolist()), np.zeros(0, kind)]) for c, kind in ((0, np.int32), (1, np.float32)))
    return Index(n_terms, begins, terms, weights)


def _alike(index: Index, centres: int = 32, rounds: int = 6, width: int = 256) -> np.ndarray:
    """A cluster for every example, by spherical k-means of hashed vectors from evenly spaced ones."""
    place = tb.mix(np.arange(index.n_terms, dtype=np.uint64) + np.uint64(1))
    slot, sign = (place % np.uint64(width)).astype(np.int64), np.where(place >> np.uint64(63), 1.0, -1.0)
    unit = np.zeros((index.n, width), np.float32)
    for i, (a, b) in enumerate(zip(index.begins[:-1].tolist(), index.begins[1:].tolist())):
        t = index.terms[a:b]
        unit[i] = np.bincount(slot[t], sign[t] * index.weights[a:b], width)
    unit /= np.maximum(np.sqrt(np.einsum("ij,ij->i", unit, unit)), 1e-9)[:, None]
    centre = unit[np.linspace(0, len(unit) - 1, centres).astype(int)]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(axis=1)
        centre = np.array([unit[own == c].sum(axis=0) for c in range(centres)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return own


def _left_out_votes(spark: SparkSession, model: Model) -> np.ndarray:
    """The vote on every example by its nearest others, worked out in tasks."""
    light, shared = model.without_index(), model.share(spark)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[1]
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for a in range(0, len(numbers), _QUERIES):
                which = numbers[a : a + _QUERIES]
                vectors = [(index.terms[x], index.weights[x]) for x in map(slice, index.begins[which].tolist(), index.begins[which + 1].tolist())]
                votes = [light.vote(*x) for x in index.nearest(vectors, light.k, which)]
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(votes)], names=["i", "vote"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, model.index.n // (4 * _QUERIES)))
    got = spark.range(0, model.index.n, 1, tasks).mapInArrow(vote, "i long, vote double").toArrow()
    votes = np.zeros(model.index.n)
    votes[got.column("i").to_numpy()] = got.column("vote").to_numpy()
    return votes


def _index(spark: SparkSession, known: Vocabulary, ids: list, toxic: np.ndarray, pairs: list, at: np.ndarray, weight: np.ndarray, k: int, prior: float, empty: float) -> Model:
    # Alike examples side by side: blocks then differ in their maxima.
    at = np.array(sorted(at.tolist(), key=lambda i: ids[i]), np.int64)
    if len(at):
        own = _alike(_packed(len(known.terms), pairs, at))
        at = at[np.lexsort((np.arange(len(at)), toxic[at], own))]
    index = _packed(len(known.terms), pairs, at)
    pairs.clear()
    model = Model(known, np.array([ids[i] for i in at.tolist()], dtype=object), toxic[at], weight, index, k, prior, empty)
    if len(at):
        votes = _left_out_votes(spark, model)
        model.votes, model.scores = _monotone(votes, toxic[at].astype(np.float64), weight[toxic[at]])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score double (0 to 1), predicted int, evidence array of example ids and similarity array of their cosines.

    A text with no term of any example, an empty or a null one, gets the share of toxic
    rows among such examples and no evidence. Without a model every score is 0. Equal
    texts get equal scores. Columns of the four names are replaced.
    """
    light = None if model is None else model.without_index()
    shared = None if model is None else model.share(docs.sparkSession)
    cache: dict[bytes, tuple] = {}

    def work(column: pa.Array) -> list[pa.Array]:
        model = light
        scores, evidence, cosines = [], [], []
        if model is None:
            scores, evidence, cosines = [0.0] * len(column), [[]] * len(column), [[]] * len(column)
        else:
            vocabulary, index = shared.value
            for part in tb.slices(column):
                vectors = vocabulary.vectors(part)
                keys = [hashlib.blake2b(t.tobytes() + w.tobytes(), digest_size=16).digest() for t, w in vectors]
                known = {key: cache.get(key) for key in keys}
                new = {key: v for key, v in zip(keys, vectors) if known[key] is None and len(v[0])}
                todo = list(new)
                for a in range(0, len(todo), _QUERIES):
                    some = todo[a : a + _QUERIES]
                    for key, (found, cosine) in zip(some, index.nearest([new[x] for x in some], model.k)):
                        value = float(model.calibrated(np.array([model.vote(found, cosine)]))[0]) if len(found) else model.empty_score
                        known[key] = (value, model.ids[found[:3]].tolist(), np.minimum(cosine[:3], 1).tolist())
                        if len(cache) < KEPT_CACHE:
                            cache[key] = known[key]
                for key in keys:
                    for out, v in zip((scores, evidence, cosines), known[key] or (model.empty_score, [], [])):
                        out.append(v)
        values = np.clip(np.array(scores, np.float64), 0, 1)
        return [
            pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.string())),
            pa.array(cosines, pa.list_(pa.float64())),
        ]

    fields = [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("similarity", T.ArrayType(T.DoubleType())),
    ]
    return append_columns(docs, text, fields, work)

