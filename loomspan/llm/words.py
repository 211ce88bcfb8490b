"""Words, word hashes and n-gram hashes of Arrow text columns, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and what lies beyond ASCII stay, in lower case; all else separates.
_PLAIN = _LOWER.copy()
_PLAIN[[x for x in range(128) if not chr(x).isalnum()]] = 0x20
#: Text bytes that are worked on at a time; a longer document is worked on alone.
CHUNK = 1 << 20


class _Powers:
    """base**i and base**-i modulo 2**64, grown when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_GRAM)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def within(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by document and then by value, which are hashes: one sort of a number that holds the document and most of the
    hash. Where two hashes agree in that much the whole of them is looked at."""
    if not len(doc) or doc[-1] >= 1 << 20 or doc.max() >= 1 << 20:
        return np.lexsort((value, doc))
    key = doc.astype(np.uint64) << np.uint64(44) | value >> np.uint64(20)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order if (value[order[same]] == value[order[same + 1]]).all() else np.lexsort((value, doc))


def by_pairs(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Order by major, which repeats little, and then by minor."""
    order = np.argsort(major)
    same = major[order[1:]] == major[order[:-1]]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    some = order[tied]
    order[tied] = some[np.lexsort((minor[some], major[some]))]
    return order


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts, in UTF-8, or of bytes, and n + 1 offsets into them; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in slices of at most `most` bytes of text or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """start, end: byte positions of each word; first: n + 1 offsets of the documents' words; hash: 64 bits a word."""

    def __init__(self, texts: pa.Array, lower: bool = False, plain: bool = False) -> None:
        data, offsets = raw(texts)
        if lower or plain:
            data = (_PLAIN if plain else _LOWER)[data]
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        head, tail = inside.copy(), inside.copy()
        if len(data):
            head[1:] &= ~inside[:-1]
            tail[:-1] &= ~inside[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            head[cuts] = inside[cuts]
            tail[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if len(self.start):
            up, down = _BYTES.upto(len(data))
            with np.errstate(over="ignore"):
                value = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
                value[~inside] = 0
                self.hash = mix(np.add.reduceat(value, self.start) * down[self.start] + np.uint64(0x632BE59BD9B4E019))
        else:
            self.hash = np.empty(0, np.uint64)

    def doc(self) -> np.ndarray:
        """For each word, the row of its document."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside a document, their first word, and n + 1 offsets by document."""
        total = len(self.hash)
        up, down = _WORDS.upto(total + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(total + 1, np.uint64)
            np.cumsum(self.hash * up[:total], out=sums[1:])
            many = np.maximum(self.count - n + 1, 0)
            first = np.r_[0, np.cumsum(many)]
            at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], many)
            return mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)), at, first


def whole_hash(words: Words, rows: np.ndarray) -> np.ndarray:
    """Hash of a document's whole word sequence, for the given rows; it never equals a shorter or longer one's by design."""
    up, down = _WORDS.upto(len(words.hash) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words.hash) + 1, np.uint64)
        np.cumsum(words.hash * up[: len(words.hash)], out=sums[1:])
        a, b = words.first[rows], words.first[rows + 1]
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
