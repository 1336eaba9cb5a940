"""Vectorised text primitives on the buffers of an Arrow string column: words, word hashes and shingles.

Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z, which is exact on UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; words are never cut.
BLOCK = 1 << 19
U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
CODE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U64), np.zeros(0, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP^i and its inverse modulo 2^64; only tables up to two blocks are kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, 2 * BLOCK)
    inverse = pow(STEP, -1, 1 << 64)
    tables = []
    for base in (STEP, inverse):
        t = np.full(size, U64(base))
        t[0] = 1
        tables.append(np.cumprod(t, dtype=U64))
    if size == 2 * BLOCK:
        _powers = tables[0], tables[1]
    return tables[0], tables[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each text the bounds of its words."""
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over blocks of the bytes."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        a, b = starts[i], ends[j - 1]
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(CODE[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats included, and their bounds.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    n, counts = len(words), np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(to[-1], U64)
    if n >= k:
        acc = words[: n - k + 1] * U64(0xD6E8FEB86659FD93)
        for j in range(1, k):
            acc = mix(acc + words[j : n - k + 1 + j])
        keep = np.ones(n, bool)
        for t in range(1, k):
            keep[bounds[1:][counts >= t] - t] = False
        full = np.repeat(counts >= k, sizes)
        out[full] = acc[keep[: n - k + 1]]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        acc = np.array([0x5851F42D4C957F2D + int(counts[d])], U64)
        for w in words[bounds[d] : bounds[d + 1]]:
            acc = mix(acc + w)
        out[to[d]] = acc[0]
    return out, to


def text_shingles(column: pa.Array | pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    return shingles(word_hashes(data, starts, ends), bounds, k)


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """The batch in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)
