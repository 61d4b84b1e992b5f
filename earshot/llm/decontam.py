"""Benchmark decontamination: which words of a document lie in a passage of a benchmark item.

An item is a set of windows: every run of `window` consecutive words, or the whole item
if it has fewer words. Finding windows in documents is a set join with full containment,
for which a prefix of one token suffices. Tokens are shingles of up to three words,
ordered by how often they occur in the documents; each window is joined by its rarest
one. A joined pair is kept if the window, laid where the token stands, begins and ends
inside the document (positional and length bounds), then if the hash of the words there
is the window's, and at last if the words themselves are.

The documents are never shuffled. The benchmark is broadcast in slices of at most
`slice_bytes` of text, however large it is; beyond one slice the documents are read
again for each, with what was found so far beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import textbytes as tb
from earshot.llm.frames import without
from earshot.plans.sizing import materialize

SHINGLE = 3
SLICE_BYTES = 16 << 20


class _Windows:
    """The distinct windows of some items, their shingles, and after choose() their prefix tokens."""

    def __init__(self, ids: list, texts: pa.Array, window: int) -> None:
        keys, token_of, offset_of, of_window = {}, [], [], []
        self.text: list[bytes] = []
        self.ids: list[set] = []
        lengths, hashes = [], []
        for part in tb.slices(texts):
            w = tb.words(part, tb.ALNUM)
            ends = np.cumsum(w.per_text)
            for i, n in enumerate(w.per_text.tolist()):
                if not n:
                    continue
                base, length = int(ends[i]) - n, min(n, window)
                k = min(SHINGLE, length)
                first = np.arange(base, base + n - length + 1)
                whole = tb.sequence_hash(w.hash, first, length)
                tokens = tb.sequence_hash(w.hash, np.arange(base, base + n - k + 1), k)
                item = ids[part.first + i]
                for j, h in enumerate(whole.tolist()):
                    words = b" ".join(w.low[w.start[x] : w.end[x]].tobytes() for x in range(base + j, base + j + length))
                    at = keys.get(words)
                    if at is None:
                        at = keys[words] = len(self.text)
                        self.text.append(words)
                        self.ids.append(set())
                        lengths.append(length)
                        hashes.append(h)
                        n_tokens = length - k + 1
                        token_of.append(tokens[j : j + n_tokens])
                        offset_of.append(np.arange(n_tokens))
                        of_window.append(np.full(n_tokens, at))
                    if item is not None:
                        self.ids[at].add(item)
        self.length = np.array(lengths, np.int64)
        self.hash = np.array(hashes, np.uint64)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self._token, self._offset, self._of = join(token_of, np.uint64), join(offset_of, np.int64), join(of_window, np.int64)
        self._k = np.minimum(SHINGLE, self.length)[self._of] if len(self._of) else self._of
        self.shingles = {int(k): np.unique(self._token[self._k == k]) for k in np.unique(self._k)}
        self.prefix: dict[int, tuple] = {}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep the rarest token of each window, by its count in the documents."""
        rarity = np.zeros(len(self._token), np.int64)
        for k, known in self.shingles.items():
            own = self._k == k
            rarity[own] = counts[k][np.searchsorted(known, self._token[own])]
        order = np.lexsort((self._offset, self._token, rarity, self._of))
        first = order[np.concatenate([[True], self._of[order][1:] != self._of[order][:-1]])] if len(order) else order
        for k in self.shingles:
            own = first[self._k[first] == k]
            own = own[np.argsort(self._token[own], kind="stable")]
            tokens, begins = np.unique(self._token[own], return_index=True)
            self.prefix[k] = (tokens, np.append(begins, len(own)), self._of[own], self._offset[own], _sieve(tokens))
        del self._token, self._offset, self._of, self._k


def _sieve(tokens: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << 16, bool)
    flags[(tokens & np.uint64(0xFFFF)).astype(np.int64)] = True
    return flags


def _look_up(hashes: np.ndarray, tokens: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is one of the sorted tokens, and which."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    which = np.minimum(np.searchsorted(tokens, hashes[at]), len(tokens) - 1)
    same = tokens[which] == hashes[at]
    return at[same], which[same]


def _runs(w: tb.Words, k: int) -> np.ndarray:
    """Hashes of k words from every word on that has k - 1 more in the slice."""
    return tb.sequence_hash(w.hash, np.arange(max(0, len(w.start) - k + 1)), k)


def _find(w: tb.Words, windows: _Windows) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of the windows that occur."""
    ends = np.cumsum(w.per_text)
    firsts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (tokens, begins, of, offset, sieve) in windows.prefix.items():
        at, which = _look_up(_runs(w, k), tokens, sieve)
        n = begins[which + 1] - begins[which]
        pair = np.repeat(begins[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window, text = of[pair], np.repeat(w.text[at], n)
        first = np.repeat(at, n) - offset[pair]
        inside = (first >= ends[text] - w.per_text[text]) & (first + windows.length[window] <= ends[text])
        first, window = first[inside], window[inside]
        for length in np.unique(windows.length[window]).tolist():
            own = windows.length[window] == length
            a, b = first[own], window[own]
            same = tb.sequence_hash(w.hash, a, length) == windows.hash[b]
            firsts.append(a[same])
            found.append(b[same])
    first, window = np.concatenate(firsts), np.concatenate(found)
    exact = [
        b" ".join(w.low[w.start[x] : w.end[x]].tobytes() for x in range(a, a + int(windows.length[b]))) == windows.text[b]
        for a, b in zip(first.tolist(), window.tolist())
    ]
    exact = np.array(exact, bool)
    return first[exact], window[exact]


def _count_tokens(docs: DataFrame, text: str, windows: _Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the items occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({k: (v, _sieve(v)) for k, v in windows.shingles.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, (v, _) in shared.value.items()}
        for batch in batches:
            for part in tb.slices(batch.column(0)):
                w = tb.words(part, tb.ALNUM)
                for k, (tokens, sieve) in shared.value.items():
                    hashes = _runs(w, k)
                    at, which = _look_up(hashes, tokens, sieve)
                    totals[k] += np.bincount(which[w.text[at] == w.text[at + k - 1]], minlength=len(tokens))
        for k, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], names=["k", "token", "n"]
            )

    rows = docs.select(text).mapInArrow(count, "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    counts = {k: np.zeros(len(v), np.int64) for k, v in windows.shingles.items()}
    ks, tokens, ns = (got.column(c).to_numpy() for c in ("k", "token", "n"))
    for k in counts:
        counts[k][tokens[ks == k]] = ns[ks == k]
    return counts


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 13, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """docs with n_words long, hit_spans array<struct<first, past>> and item_ids array.

    Words are lower-cased runs of digits, letters a-z and characters outside ASCII.
    hit_spans are the disjoint word ranges, in order, that windows cover; item_ids the
    distinct items with a window in the document, in ascending order.

    A null or empty text has no words and no spans. Items without words match nothing;
    an item with a null id marks words but is in no list; items that share an id are
    one. Repeated documents are judged one by one. An empty benchmark hits nothing.
    Columns of the three names are replaced.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_id].dataType
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n_slices = max(1, -(-total // slice_bytes))
    span = T.StructType([T.StructField("first", T.IntegerType(), False), T.StructField("past", T.IntegerType(), False)])
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(span, False)),
        T.StructField("item_ids", T.ArrayType(item_type, False)),
    ]
    out = without(docs, *[f.name for f in fields])
    source = [c.lower() for c in out.columns].index(text.lower())
    plain = out.schema
    schema = T.StructType([*plain.fields, *fields])
    for i in range(n_slices):
        part = benchmark.filter(F.pmod(F.xxhash64(item_text), F.lit(n_slices)) == i) if n_slices > 1 else benchmark
        rows = part.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).filter("text is not null").toArrow()
        windows = _Windows(rows.column("id").to_pylist(), rows.column("text"), window)
        windows.choose(_count_tokens(docs, text, windows))
        shared = spark.sparkContext.broadcast(windows)
        again = i > 0

        def mark(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            kinds = [to_arrow_type(f.dataType) for f in fields]
            for batch in batches:
                known = [batch.column(len(plain) + j) for j in (1, 2)] if again else None
                columns = _mark(batch.column(source), shared.value, known, kinds)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], *columns], names=schema.names)

        out = out.mapInArrow(mark, schema)
        if i + 1 < n_slices:
            out = materialize(out, "passages")
    return out


def _mark(column: pa.Array, windows: _Windows, known: list | None, kinds: list) -> list[pa.Array]:
    n_words, spans, items = [], [], []
    for part in tb.slices(column):
        w = tb.words(part, tb.ALNUM)
        ends = np.cumsum(w.per_text)
        base = ends - w.per_text
        first, window = _find(w, windows)
        past = first + windows.length[window]
        own: list[set] = [set() for _ in range(len(part))]
        for text, x in set(zip(w.text[first].tolist(), window.tolist())):
            own[text] |= windows.ids[x]
        if known:
            for i in range(len(part)):
                own[i].update(known[1][part.first + i].as_py())
                for s in known[0][part.first + i].as_py():
                    first, past = np.append(first, base[i] + s["first"]), np.append(past, base[i] + s["past"])
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, past, -1)
        hit = np.cumsum(change)[:-1] > 0
        edge = np.zeros(len(hit), bool)
        edge[base[w.per_text > 0]] = True
        begins = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
        stops = np.flatnonzero(hit & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([hit[1:], [False]]))) + 1
        of = w.text[begins]
        by_text = np.searchsorted(of, np.arange(len(part) + 1))
        begins, stops = (begins - base[of]).tolist(), (stops - base[of]).tolist()
        for i in range(len(part)):
            spans.append([{"first": a, "past": b} for a, b in zip(begins[by_text[i] : by_text[i + 1]], stops[by_text[i] : by_text[i + 1]])])
            items.append(sorted(own[i]))
        n_words.append(w.per_text)
    counted = np.concatenate(n_words).astype(np.int64) if n_words else np.zeros(0, np.int64)
    return [pa.array(counted), pa.array(spans, kinds[1]), pa.array(items, kinds[2])]
