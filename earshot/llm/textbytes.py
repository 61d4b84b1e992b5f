"""Words, their hashes and shingles of whole Arrow string columns, a slice of bytes at a time.

Everything works on the UTF-8 bytes of many texts at once. Word characters are given
as a table of 256 flags: every byte of a multi-byte character is 0x80 or more, so a
class that treats all of those alike is exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a slice of its own.
SLICE_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(flags) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(flags)] = True
    return table


#: `[^\x20\x09-\x0D]+`: anything but ASCII white space.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, anything not ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash over all of them."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Texts:
    """Some texts as bytes: text i is data[offsets[i]:offsets[i + 1]]; first is its row in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in slices of about limit bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


@dataclass
class Words:
    """The words of some texts, in order: where each begins and ends, its text, its hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    per_text: np.ndarray  # words of each text
    low: np.ndarray  # the bytes, lower-cased


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for many spans, equal for equal bytes: differences of prefix sums."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start])


def words(texts: Texts, is_word: np.ndarray) -> Words:
    low = LOWER[texts.data]
    n = len(low)
    flag = is_word[low]
    opens, closes = flag.copy(), flag.copy()
    if n:
        opens[1:] &= ~flag[:-1]
        closes[:-1] &= ~flag[1:]
        edge = texts.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        opens[edge] = flag[edge]
        closes[edge - 1] = flag[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(texts.offsets, start, side="right") - 1
    return Words(start, end, text, span_hashes(low, start, end), np.bincount(text, minlength=len(texts)), low)


def sequence_hash(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the length words from each of first on."""
    out = np.full(len(first), length, np.uint64)
    for k in range(length):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[first + k]
    return mix(out)


def shingles(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of length words; a text of fewer words is one run as a whole.

    Ordered by text. Runs of different lengths never share a hash but by chance.
    """
    n = len(w.start)
    first = np.arange(max(0, n - length + 1))
    first = first[w.text[first] == w.text[first + length - 1]]
    hashed, text = sequence_hash(w.hash, first, length), w.text[first]
    ends = np.cumsum(w.per_text)
    for short in range(1, length):
        which = np.flatnonzero(w.per_text == short)
        if len(which):
            hashed = np.concatenate([hashed, sequence_hash(w.hash, ends[which] - short, short)])
            text = np.concatenate([text, which])
    order = np.argsort(text, kind="stable")
    return hashed[order], text[order]


def distinct_per_text(hashed: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one after another, and where each text's begin.

    text holds the texts' numbers in ascending order.
    """
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    hashed = hashed.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            hashed[a:b].sort()
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    text = text[keep]
    return hashed[keep], np.searchsorted(text, np.arange(n_texts + 1))
