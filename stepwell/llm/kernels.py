"""Vectorised text kernels on UTF-8 bytes, shared by the operators of this subpackage.

They run inside Arrow batches on the executors: an Arrow string column is a byte
buffer plus offsets, and words, word hashes and shingles of many documents come out
of a few numpy passes without a Python object per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time: bounds the 8-byte temporaries of a pass.
CHUNK = 1 << 20
_POSITIONS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection with good avalanche (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64).copy()
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers: the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xD1342543DE82EF95))


#: ASCII white space: the bytes that end a word in `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit; bytes above 0x7F belong to words.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[0x80:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    PUNCTUATION[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_PLACE = stream(3, _POSITIONS) | U64(1)


def _letters(seed: int, space: np.ndarray, lower: bool) -> np.ndarray:
    table = stream(seed, 256)
    if lower:
        table = table[LOWER]
    table = table.copy()
    table[space] = 0
    return table


_LETTERS: dict[tuple, np.ndarray] = {}


def letters(seed: int, space: np.ndarray, lower: bool) -> np.ndarray:
    key = (seed, space.tobytes(), lower)
    if key not in _LETTERS:
        _LETTERS[key] = _letters(*((seed, space, lower)))
    return _LETTERS[key]


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if isinstance(array, pa.ChunkedArray):  # older pyarrow keeps the chunks
        array = pa.concat_arrays(array.chunks)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = array.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Row ranges of at most `limit` bytes each; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


@dataclass
class Words:
    """Words of a run of documents: byte ranges, 64-bit hashes, and each document's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    second: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _bounds(body: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~space[body]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(body))]
    begin[inner] |= word[inner]  # a document never shares a word with the one before it
    end[inner - 1] |= word[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _sums(body: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Of each word the sum of letter value times place value, modulo 2^64, for each table of letter values."""
    out = [np.empty(len(starts), U64) for _ in tables]
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(int(np.searchsorted(starts, starts[a] + CHUNK)), a + 1)
            stop = int(starts[b]) if b < len(starts) else len(body)
            part = body[starts[a] : stop]
            at = starts[a:b] - starts[a]
            place = np.arange(len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
            values = _PLACE[place & (_POSITIONS - 1)]
            if len(part) > _POSITIONS and (far := place >= _POSITIONS).any():
                values[far] *= mix((place[far] >> 16).astype(U64)) | U64(1)
            for table, sums in zip(tables, out, strict=True):
                sums[a:b] = np.add.reduceat(table[part] * values, at)
            a = b
    return out


def words(body: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lower: bool = False, second: bool = False) -> Words:
    """Words of each document with their hashes; `second` adds an independent hash, for 128 bits in all."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(U64), np.zeros(len(offsets), np.int64), none.astype(U64) if second else None)
    starts, ends = _bounds(body, offsets, space)
    first, again = hashes(body, starts, ends, space, lower, second)
    return Words(starts, ends, first, np.searchsorted(starts, offsets), again)


def hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE, lower: bool = False, second: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """64-bit hashes of words given by their byte ranges, none empty, with nothing but space between them, and a second one."""
    tables = [letters(1, space, lower)] + [letters(2, space, lower)] * second
    sums = _sums(body, starts, tables)
    with np.errstate(over="ignore"):
        size = (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
        sums = [mix(s + size) for s in sums]
    return sums[0], sums[1] if second else None


def taken(body: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Byte ranges behind each other."""
    before = np.cumsum(lens) - lens
    return body[np.repeat(starts - before, lens) + np.arange(int(lens.sum()))]


def grams(hashes: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Hash of the n hashes from each place on; n - 1 places fewer than there are hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    weights = stream(seed, n) | U64(1)
    with np.errstate(over="ignore"):
        total = hashes[:m] * weights[0]
        for j in range(1, n):
            total += hashes[j : j + m] * weights[j]
    return mix(total)


def ids_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An integer column as int64 values (0 for null) and the mask of its nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    empty = np.asarray(array.is_null())
    return np.asarray(array.cast(pa.int64()).fill_null(0)), empty


def long_array(values: np.ndarray, empty: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.asarray(values, np.int64), pa.int64(), mask=empty if empty is not None and empty.any() else None)
