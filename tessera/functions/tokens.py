"""Token streams as numpy arrays: whole Arrow batches of texts are split at white space and hashed without a Python string for each token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A hash of each range of ``values``, by prefix sums of a polynomial."""
    base, inverse = _BASES[which]
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * _powers(base, len(values))[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(inverse, len(values))[starts])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty, and the offsets of its values."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, row after the last, bytes, offsets from 0. A longer text is a run of its own."""
    data, offs = texts(column)
    lo = 0
    while lo < len(offs) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1), len(offs) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def fnv1a(column) -> np.ndarray:
    """FNV-1a, 64 bits, of each text of a column or list; the longest text sets the number of steps."""
    data, offs = texts(pa.array(column, pa.string()) if isinstance(column, list) else column)
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    out, begin, size = np.full(len(order), 0xCBF29CE484222325, U64), offs[:-1][order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k))
        out[:live] = (out[:live] ^ data[begin[:live] + k]) * U64(0x100000001B3)
    back = np.empty_like(out)
    back[order] = out
    return back


class Tokens:
    """The tokens of some texts: ``doc``, ``line`` (from 1) and two 64-bit hashes of each, and where each document's begin (``first``)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        visible = ~_SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = visible[1:] != visible[:-1]
        edge[offs[:-1]] = True
        cuts = np.flatnonzero(edge) if len(data) else np.zeros(0, np.int64)
        on = visible[cuts[:-1]] if len(cuts) else np.zeros(0, bool)
        starts, ends = cuts[:-1][on], cuts[1:][on]
        self.doc = np.searchsorted(offs, starts, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        self.line = breaks[starts] - breaks[offs[self.doc]] + 1
        self.hashes = [ranges(data, starts, ends, w) for w in (0, 1)]
        self.first = np.searchsorted(self.doc, np.arange(len(offs)))

    def windows_at(self, k: int) -> np.ndarray:
        n = len(self.doc)
        return np.flatnonzero(self.doc[: max(0, n - k + 1)] == self.doc[k - 1 :]) if n else np.zeros(0, np.int64)

    def windows(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """First tokens of all windows of k tokens of one document, and two hashes of each window: 128 bits, so equal hashes mean equal tokens."""
        at = self.windows_at(k)
        return at, [ranges(h, at, at + k, w) for w, h in enumerate(self.hashes)]

    def minimizers(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First tokens of all windows of k tokens, where in each the least hash of k / 2 tokens lies (the first of equals), and that hash. Equal windows have it at
        equal distances, so a window that occurs twice has a hash that lies at two places; a place serves some k / 4 windows."""
        at, m = self.windows_at(k), max(1, k // 2)
        n, width = len(self.doc), k - m + 1
        if not len(at):
            return at, at, np.zeros(0, U64)
        starts = np.arange(n - m + 1)
        low, place, have = ranges(self.hashes[0], starts, starts + m, 0), starts, 1
        while have < width:
            step = min(have, width - have)
            later = low[step:] < low[: len(low) - step]
            low, place = np.where(later, low[step:], low[: len(low) - step]), np.where(later, place[step:], place[: len(place) - step])
            have += step
        return at, place[at], low[at]
