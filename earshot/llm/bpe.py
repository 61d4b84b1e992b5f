"""Byte-level BPE: texts to token ids and back, merging by a segment tree over adjacent pairs.

A text is cut at special tokens, then into pieces by the vocabulary's pattern; each piece
starts as one symbol per byte. A segment tree holds, at leaf i, the rank of the merge of
symbol i with its right neighbour. The root's minimum is the leftmost of the lowest-ranked
merges; doing it changes three leaves, each in logarithmic time, and so on until the root
says that no pair can be merged. A piece of n bytes takes O(n log n), however repetitive.

The trees of short pieces lie side by side in one array and are worked on together. They
recur, so a worker keeps the ids of those it has merged, up to a fixed number of them.
Texts are worked on in runs of pieces, never all pieces of a long text at once.

The vocabulary file is read by the driver and travels with the tasks; its size is that of
the file. Workers need no copy of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from earshot.llm.frames import without

#: The fixed pattern of byte-level vocabularies whose pre-tokenizer uses one.
#: White space is the Unicode property, which leaves the separators U+001C to U+001F out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Letters and digits that the `regex` library knows and the vocabulary's
#: Unicode version, 16.0, does not. There they are neither.
NEWER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)

#: Longer pieces are merged anew each time; that many shorter ones are remembered.
REMEMBERED_CHARS = 48
REMEMBERED_PIECES = 300_000
#: Pieces of up to one more byte have their trees side by side, see Vocabulary.merge_many.
TREES_AT_ONCE = 64
#: Pieces worked on at once, and tokens after which a batch of texts is handed on.
RUN = 50_000
BATCH_TOKENS = 1_000_000

NONE = 1 << 62
_SHIFT = 40
_AT = (1 << _SHIFT) - 1


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes take the code
    points from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairTree:
    """Minimum of (rank, position) over the adjacent pairs of a piece, with point updates."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        leaves = [NONE if r is None else (r << _SHIFT) | i for i, r in enumerate(ranks)]
        leaves += [NONE] * (self.size - len(ranks))
        self.nodes = [NONE] * self.size + leaves
        nodes = self.nodes
        for i in range(self.size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def root(self) -> int:
        """The position of the leftmost lowest-ranked pair, or -1."""
        best = self.nodes[1]
        return -1 if best == NONE else best & _AT

    def put(self, i: int, rank: int | None) -> None:
        nodes = self.nodes
        at = i + self.size
        value = NONE if rank is None else (rank << _SHIFT) | i
        if nodes[at] == value:
            return
        nodes[at] = value
        while at > 1:
            at >>= 1
            a, b = nodes[2 * at], nodes[2 * at + 1]
            low = a if a < b else b
            if nodes[at] == low:
                break
            nodes[at] = low


class Vocabulary:
    """A byte-level BPE vocabulary: ranks of merges, bytes of tokens, special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and spec.get("normalizer") is None
            and (spec.get("decoder") or {}).get("type") == "ByteLevel"
            and not any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            raise ValueError("only byte-level BPE without dropout, prefixes, suffixes, fallbacks and stripping special tokens")
        letters, vocab = _byte_letters(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        as_bytes = {token: bytes(map(letters.__getitem__, token)) for token in vocab}
        size = 1 + max(chain(vocab.values(), self.special.values()))
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = as_bytes[token]
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [vocab[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.merged_id = np.zeros(1 + len(model["merges"]), np.int64)
        for rank, merged in self.merges.values():
            self.merged_id[rank] = merged
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([m[0] for m in self.merges.values()], np.int64)[order]
        self.pieces, self.newer = regex.compile(PIECES), regex.compile(f"[{NEWER}]")
        exact = PIECES.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{NEWER}]]")
        for kind in (r"\p{L}+", r"\p{N}+"):
            exact = exact.replace(f" ?{kind}", f" ?[{kind[:-1]}--[{NEWER}]]+")
        self.exact_pieces = regex.compile(exact, regex.VERSION1)
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        tree = PairTree([rank[0] if (rank := merges.get(pair)) else None for pair in zip(ids, ids[1:])])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.root()) >= 0:
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, None)
            if k < n:
                before[k] = i
                rank = merges.get((ids[i], ids[k]))
                tree.put(i, rank[0] if rank else None)
            else:
                tree.put(i, None)
            if (h := before[i]) >= 0:
                rank = merges.get((ids[h], ids[i]))
                tree.put(h, rank[0] if rank else None)
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE >> _SHIFT where there is no such merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], NONE >> _SHIFT)

    def merge_many(self, pieces: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces of 1 to leaves + 1 bytes, one after another, and how many each has.

        The same tree for each piece, one row of an array; every step does one merge in
        each piece that has one left.
        """
        size, many = np.array([len(p) for p in pieces]), len(pieces)
        width = leaves + 1
        column = np.arange(width)
        inside = column < size[:, None]
        # One column more at the right end, for what is written beyond a piece.
        ids = np.full((many, width + 1), -1, np.int64)
        ids[:, :width][inside] = np.array(self.byte_id)[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, width), ids.shape).copy()
        nodes = np.full((many, 2 * leaves), NONE, np.int64)
        row, at = np.nonzero(inside[:, 1:])
        rank = self._ranks(ids[row, at], ids[row, at + 1])
        nodes[row, leaves + at] = np.where(rank == NONE >> _SHIFT, NONE, rank << _SHIFT | at)
        for level in range(leaves.bit_length() - 2, -1, -1):
            low, high = 1 << level, 2 << level
            nodes[:, low:high] = np.minimum(nodes[:, 2 * low : 2 * high : 2], nodes[:, 2 * low + 1 : 2 * high : 2])
        row = np.arange(many)
        while len(row := row[nodes[row, 1] != NONE]):
            root = nodes[row, 1]
            i = root & _AT
            j = after[row, i]
            k = after[row, j]
            ids[row, i], ids[row, j] = self.merged_id[root >> _SHIFT], -1
            after[row, i] = k
            before[row, k] = i
            h = before[row, i]
            ends, starts = k >= size[row], h < 0
            own = self._ranks(ids[row, i], np.where(ends, 0, ids[row, k]))
            left = self._ranks(np.where(starts, 0, ids[row, h]), ids[row, i])
            none = NONE >> _SHIFT
            own, left = np.where(ends | (own == none), NONE, own << _SHIFT | i), np.where(left == none, NONE, left << _SHIFT | h)
            nodes[row, leaves + i] = own
            inner, first = j < leaves, ~starts
            nodes[row[inner], leaves + j[inner]] = NONE
            nodes[row[first], leaves + h[first]] = left[first]
            rows, up = np.concatenate([row, row[inner], row[first]]), leaves + np.concatenate([i, j[inner], h[first]])
            for _ in range(leaves.bit_length() - 1):
                up = up >> 1
                nodes[rows, up] = np.minimum(nodes[rows, 2 * up], nodes[rows, 2 * up + 1])
        kept = ids >= 0
        return ids[kept].astype(np.int32), kept.sum(axis=1)

    def _learn(self, pieces: set[str]) -> None:
        """Merges these pieces and remembers them."""
        by_leaves: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode()
            leaves = 1 << max(1, (len(raw) - 2).bit_length())
            if leaves > TREES_AT_ONCE:
                self.known[piece] = np.array(self.merge(raw), np.int32).tobytes()
            else:
                by_leaves.setdefault(leaves, []).append(piece)
        for leaves, group in by_leaves.items():
            step = max(1, 200_000 // leaves)
            for a in range(0, len(group), step):
                ids, counts = self.merge_many([p.encode() for p in group[a : a + step]], leaves)
                raw, edges = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
                self.known.update(zip(group[a : a + step], map(raw.__getitem__, map(slice, edges[:-1], edges[1:]))))

    def _runs(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pieces, none very long, and the ids of special tokens, in order."""
        cuts = self.cut.finditer(text) if self.cut and any(s in text for s in self.special) else ()
        # Stretches are cut out: the pattern must not look beyond the special token that ends one.
        stretches, at = [], 0
        for m in cuts:
            stretches += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        for part in [*stretches, text[at:]]:
            if isinstance(part, int):
                yield part
                continue
            pattern = self.pieces if part.isascii() or not self.newer.search(part) else self.exact_pieces
            if len(part) <= 2 * RUN:
                yield pattern.findall(part)
                continue
            found = (m.group() for m in pattern.finditer(part))
            while run := list(islice(found, RUN)):
                yield run

    def encode_many(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of texts; the strings of special tokens in them are those tokens."""
        done: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], list[str] | int]] = []

        def flush() -> None:
            runs = [run for _, run in waiting if not isinstance(run, int)]
            pieces = set(chain.from_iterable(runs))
            if len(self.known) + len(pieces) > REMEMBERED_PIECES:
                self.known.clear()
            self._learn(pieces.difference(self.known))
            for out, run in waiting:
                out.append(np.int32(run).tobytes() if isinstance(run, int) else b"".join(map(self.known.__getitem__, run)))
            for piece in pieces:
                if len(piece) > REMEMBERED_CHARS:
                    del self.known[piece]
            waiting.clear()

        gathered = 0
        for text in texts:
            done.append([])
            for run in self._runs(text):
                waiting.append((done[-1], run))
                gathered += 1 if isinstance(run, int) else len(run)
                if gathered >= 2 * RUN:
                    flush()
                    gathered = 0
        flush()
        return [np.frombuffer(b"".join(parts), np.int32) for parts in done]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a file's text, built once per worker."""
    return Vocabulary(text)


def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file beside the driver, checked to be one that is understood."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    Vocabulary(text)
    return text


def _numbers(parts: list[np.ndarray], null: np.ndarray) -> pa.Array:
    """Lists of ids as an Arrow list column."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate([np.zeros(0, np.int32), *parts])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array(null))


def _in_parts(
    df: DataFrame, source: str, result: T.StructField, vocabulary_text: str,
    work: Callable[[Vocabulary, pa.Array], pa.Array], size: Callable[[pa.Array], np.ndarray],
) -> DataFrame:
    """df with a column made of another, in parts of about BATCH_TOKENS tokens."""
    kept = without(df, *([] if source.lower() == result.name.lower() else [result.name]))
    at = kept.columns.index(source)
    fields = [f for f in kept.schema.fields if f.name.lower() != result.name.lower()]
    schema = T.StructType([*fields, result])
    names = schema.names
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text)
    carried = [i for i, f in enumerate(kept.schema.fields) if f.name.lower() != result.name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            running = np.cumsum(size(batch.column(at)))
            a = 0
            while a < batch.num_rows:
                limit = (running[a - 1] if a else 0) + BATCH_TOKENS
                b = max(a + 1, int(np.searchsorted(running, limit, side="right")))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in carried), work(vocab, part.column(at))], names=names)
                a = b

    return kept.mapInArrow(run, schema)


def encode_texts(df: DataFrame, vocabulary_text: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of a text column, array<int>.

    A null text has null ids, an empty one an empty array. Special tokens written out in
    a text become that token. Rows are independent: repeats and ties are encoded alike, an
    empty table stays empty, very long texts are worked on in runs of pieces. A column that
    is called like the result, in any case, is replaced; others pass through unchanged.
    """

    def work(vocab: Vocabulary, texts: pa.Array) -> pa.Array:
        null = texts.is_null().to_numpy(zero_copy_only=False)
        return _numbers(vocab.encode_many(texts.fill_null("").to_pylist()), null)

    # A token is hardly ever less than half a byte of text, and here some three.
    def size(texts: pa.Array) -> np.ndarray:
        return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 3 + 1

    return _in_parts(df, text, T.StructField(ids, T.ArrayType(T.IntegerType())), vocabulary_text, work, size)


def decode_ids(df: DataFrame, vocabulary_text: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of an array of token ids.

    Null ids give a null text, no ids an empty one. An id outside the vocabulary, negative
    or null is an error. Columns are treated as by encode_texts.
    """

    def work(vocab: Vocabulary, lists: pa.Array) -> pa.Array:
        out = []
        for one in lists:
            if not one.is_valid:
                out.append(None)
                continue
            numbers = one.values.to_numpy(zero_copy_only=False)
            if len(numbers) and (one.values.null_count or numbers.min() < 0 or numbers.max() >= len(vocab.bytes_of)):
                raise ValueError("token ids outside of the vocabulary")
            out.append(vocab.decode(numbers.tolist()))
        return pa.array(out, pa.string())

    def size(lists: pa.Array) -> np.ndarray:
        return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    return _in_parts(df, ids, T.StructField(text, T.StringType()), vocabulary_text, work, size)
