"""Vectorised byte and word helpers shared by the text operators.

Everything here works on one Arrow batch inside a Spark task: the batch's texts are
one contiguous UTF-8 buffer, and words, word hashes and shingle hashes are computed
with whole-array numpy operations over that buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and \x09-\x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between batches."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) if have is None else max(n, 2 * len(have))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a slice holds about max_bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(column) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one uint8 array and their n+1 offsets in it; a null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n+1 entries)."""
    inside = ~_IS_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # a word starts at a non-space after a space or a text's start, and ends likewise
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    edge[0] = inside[0]
    edge[1:-1] = inside[1:] & (~inside[:-1] | cut[1:-1])
    starts = np.flatnonzero(edge[:-1])
    edge[1:-1] = inside[:-1] & (~inside[1:] | cut[1:-1])
    edge[0], edge[-1] = False, inside[-1]
    ends = np.flatnonzero(edge)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial modulo 2**64 over coded bytes, read off prefix sums."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(data) + 1)[starts])


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's first index (n+1 entries)."""
    data, offsets = utf8_buffer(column)
    data = LOWER[data] if lower else data
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows in order; a text of 1 to k-1 words gives its whole sequence."""
    counts = np.diff(first)
    whole = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(whole)]).astype(np.int64)
    rows = np.repeat(np.arange(len(counts)), whole)
    at = np.arange(out_first[-1]) - out_first[rows] + first[rows]
    out = np.zeros(len(at), dtype=np.uint64)
    limit = first[rows + 1] if len(rows) else at
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        there = np.where(at + j < limit, padded[at + j], np.uint64(j + 1))
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + there)
    return out, out_first
