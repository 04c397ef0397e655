"""Numpy kernels over Arrow string buffers: whole batches are tokenised and hashed without building a Python string.

A word is a maximal run of word bytes (ASCII letters and digits, and every byte from 0x80, that is, all letters outside ASCII);
words never cross documents. Null texts count as empty. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = U64(0xD6E8FEB86659FD93)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: 0 blank, 1 word byte, 2 other visible bytes
CLASS = np.where(WORD, 1, 2).astype(np.uint8)
CLASS[[*range(0, 33), 127]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(column, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes: first row, row after the last, bytes, offsets from 0. A longer document is a run of its own."""
    data, offs = buffers(column)
    lo, rows = 0, len(offs) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


def release() -> None:
    """Hands freed memory back to the system: workers live on from task to task beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def runs(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one nonzero kind within a document: starts, ends, document index."""
    n = len(kind)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offs[:-1]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    on = kind[starts] != 0
    starts, ends = starts[on], ends[on]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each byte run, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends and document indexes."""
    starts, ends, doc = runs(WORD[data].view(np.uint8), offs)
    return run_hashes(data, starts, ends), starts, ends, doc


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n successive values from each position on; positions in the last n-1 are left out."""
    if len(h) < n:
        return np.zeros(0, U64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g *= STEP
        g += h[k : len(h) - n + 1 + k]
    return mix(g)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word n-gram hashes of each document, one after the other, and their len+1 offsets.

    A document with 1 to n-1 words has one shingle of all of them; one without words has none.
    """
    docs = len(offs) - 1
    h, _, _, doc = words(data, offs)
    count = np.bincount(doc, minlength=docs)
    g = ngrams(h, n)
    whole = doc[: len(g)] == doc[n - 1 : n - 1 + len(g)]
    g, owner = g[whole], doc[: len(g)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        extra = np.array([ngrams(h[f : f + count[d]], int(count[d]))[0] for f, d in zip(first, short)], U64)
        g, owner = np.concatenate([g, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        g, owner = g[order], owner[order]
    parts, sizes, at = [], np.zeros(docs, np.int64), np.searchsorted(owner, np.arange(docs + 1))
    for d in range(docs):
        if at[d + 1] > at[d]:
            s = np.sort(g[at[d] : at[d + 1]])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            parts.append(s)
            sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def spans(offs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [offs[i], offs[i+1]), each added up by itself; empty spans give 0."""
    out = np.zeros(len(offs) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        out[some] = np.add.reduceat(values, offs[some])
    return out
