"""Vectorised text helpers used inside Arrow tasks.

Every helper works on one chunk: the UTF-8 bytes of a few documents laid end
to end, with their offsets. Chunks are cut at document borders at about
``CHUNK_BYTES``, so a task holds a chunk and its arrays, never a whole
partition; a longer document is a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: bits of a shortened hash; two that are equal by chance only let more through the filter it is for
SHORT = 40
U64 = np.uint64
#: odd multiplier of the rolling hash, its inverse modulo 2**64, and the n-gram multiplier
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
GRAM = 0xD6E8FEB86659FD93
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(separators: bytes, lower: bool = True) -> np.ndarray:
    """One random 64-bit value a byte; separators are 0. With ``lower`` A-Z take a-z's values."""
    v = mix64(np.arange(1, 257, dtype=U64) * U64(GRAM)) | U64(1)
    if lower:
        v[0x41:0x5B] = v[0x61:0x7B]
    v[np.frombuffer(separators, np.uint8)] = 0
    return v


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole documents, each run about ``limit`` bytes."""
    for batch in batches:
        data, offs = text_buffer(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def find_words(buf: np.ndarray, offs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte, end byte of every word of a chunk, and each document's first word number.

    A word is a maximal run of bytes whose value is not 0, inside one document.
    """
    n = len(buf)
    if n == 0:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    v = values[buf]
    inside = v != 0
    border = np.zeros(n + 1, bool)
    border[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    v *= up[:n]
    sums = np.zeros(n + 1, U64)
    np.cumsum(v, out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts])
    return h, starts, ends, np.searchsorted(starts, offs)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (over document borders too: mask those)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    g = h[:m].copy()
    for j in range(1, n):
        g *= U64(GRAM)
        g += h[j : j + m]
    return mix64(g + U64(n))


def sliding_min_pos(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values, the position of its smallest value, the rightmost of ties."""
    m = len(x) - w + 1
    if m <= 0:
        return np.empty(0, np.int64)
    best, pos, span = x.copy(), np.arange(len(x)), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[:-step], best[step:]
        right = b <= a
        best, pos = np.where(right, b, a), np.where(right, pos[step:], pos[:-step])
        span += step
    return pos[:m]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def pack_hashes(h: np.ndarray) -> pa.RecordBatch:
    """b, low: the first ``SHORT`` bits of hashes, sorted and packed: 32 bits each, one row for each value of the bits before them."""
    h = np.sort(h >> U64(64 - SHORT))
    b = (h >> U64(32)).astype(np.int32)
    ends = np.append(np.flatnonzero(np.diff(b)) + 1, len(b)) if len(b) else np.empty(0, np.int64)
    low = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append([0], 4 * ends).astype(np.int32)), pa.py_buffer(h.astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(b[ends - 1]), low], ["b", "low"])


def repeated_hashes(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The shortened hashes that occur more than once in rows of ``pack_hashes`` sorted by b."""
    def solve(b: int, rows: list[bytes]) -> pa.RecordBatch:
        low = np.sort(np.frombuffer(b"".join(rows), np.uint32))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64) | b << 32)], [name])

    now, wait = None, []
    for batch in batches:
        for b, low in zip(batch.column("b").to_pylist(), batch.column("low").to_pylist()):
            if b != now and wait:
                yield solve(now, wait)
                wait = []
            now = b
            wait.append(low)
    if wait:
        yield solve(now, wait)


def join_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words of each document joined by one space: bytes, documents' offsets, words' starts and ends in them.

    Between two words of a document there is at least one separator byte; the
    one after the first word becomes the space, so nothing but a mask is built.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s, e = (starts, ends) if keep is None else (starts[keep], ends[keep])
    doc = doc if keep is None else doc[keep]
    gap = np.zeros(len(s), np.int64)
    gap[:-1] = doc[:-1] == doc[1:]
    step = np.zeros(len(buf) + 1, np.int8)
    step[s] = 1
    step[e + gap] -= 1
    data = buf.copy()
    data[e[gap > 0]] = 0x20
    data = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s + gap, out=at[1:])
    return data, at[np.searchsorted(doc, np.arange(len(first)))], at[:-1], at[:-1] + (e - s)
