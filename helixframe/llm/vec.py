"""Array kernels over batches of UTF-8 texts, shared by the operators of this subpackage.

Everything here works on whole Arrow buffers (no Python loop over characters or words), so that one
worker handles tens of megabytes a second in bounded memory: callers cut their batches with
:func:`slices`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Spans are hashed in two prime fields of this size. Modulo a power of two, long words over two letters that differ
#: everywhere (Thue-Morse words) would have equal hashes whatever the base.
_PRIME = (1 << 31) - 1
_BASES = (0x2C1B3C6D, 0x165667B1)
#: Values that are worked on at a time where that keeps them in the processor's cache.
STRETCH = 1 << 14


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo the prime, below 2**31 + 2."""
    x = (x & U64(_PRIME)) + (x >> U64(31))
    return (x & U64(_PRIME)) + (x >> U64(31))


def _rest(x: np.ndarray) -> np.ndarray:
    x = _fold(x)
    return np.where(x >= U64(_PRIME), x - U64(_PRIME), x)


def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        pair = []
        for b in (base, pow(base, -1, _PRIME)):
            p = np.ones(1, np.uint32)
            while len(p) < size:
                more = min(len(p), size - len(p))
                p = np.concatenate([p, _rest(p[:more].astype(U64) * U64(pow(b, len(p), _PRIME))).astype(np.uint32)])
            pair.append(p)
        out.append(tuple(pair))
    return out


#: The longest tables of powers so far; those of over ``KEPT`` powers, for a text of such length, go after use.
_TABLES: list[list[tuple[np.ndarray, np.ndarray]]] = []
KEPT = 5 << 20


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo the prime, at least n of each."""
    size = -(-n >> 16) << 16
    if size > KEPT:
        return _powers(size)
    if not _TABLES or len(_TABLES[0][0][0]) < size:
        _TABLES[:] = [_powers(size)]
    return _TABLES[0]


class SpanHash:
    """Hashes of any span of a sequence of 64-bit values in constant time each: 62 bits, from polynomials in two prime
    fields, and the length."""

    def __init__(self, values: np.ndarray, narrow: bool = False):
        """narrow: all values are below 512, and hashed as they are."""
        n = len(values)
        self.lanes = []
        values = values.astype(U64, copy=False) if narrow else mix64(values)
        for lane, (pw, ipw) in enumerate(powers(n + 1)):
            term = values if narrow else (values >> U64(31 * lane)) & U64(_PRIME)
            term = term * pw[:n]
            if not narrow or n >= 1 << 23:
                term = _fold(term)
            sums = np.zeros(n + 1, U64)
            np.cumsum(term, out=sums[1:])
            self.lanes.append((sums, ipw))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        one, two = (_rest(_fold(sums[stop] - sums[start]) * ipw[start]) for sums, ipw in self.lanes)
        return mix64(((one << U64(31)) | two) ^ (np.asarray(stop - start)).astype(U64) * U64(0xD6E8FEB86659FD93))

    def sliding(self, width: int) -> np.ndarray:
        """Hash of each span of this width."""
        start = np.arange(max(0, len(self.lanes[0][0]) - width))
        return self(start, start + width)


def byte_grams(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` bytes (a multiple of 8): good enough to order and to group runs by, not to tell them apart."""
    n = max(0, len(buf) - width + 1)
    padded, out = np.ascontiguousarray(buf), np.zeros(n, U64)
    for cut in range(0, n, STRETCH):
        part = out[cut : cut + STRETCH]
        for k in range(0, width, 8):
            part += np.ndarray((len(part),), "<u8", padded, offset=cut + k, strides=(1,)) * U64(0x9E3779B97F4A7C15 + (k << 32))
        part[:] = mix64(part)
    return out


def distinct_spans(values: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First span of each distinct content, and the place of each span's content in that list. Exact: spans of one hash
    are compared with the first of them, and those that differ are told apart by their own values. h: the spans' hashes, where
    they are known."""
    h = SpanHash(values.astype(U64), values.dtype == np.uint8)(start, stop) if h is None else h
    _, first, slot = np.unique(h, return_index=True, return_inverse=True)
    head = first[slot]
    size = stop - start
    wrong = size != size[head]
    for cut in range(0, len(start), 1 << 14):
        part = slice(cut, cut + (1 << 14))
        n = np.where(wrong[part], 0, size[part])
        differs = values[ragged(start[part], n)] != values[ragged(start[head[part]], n)]
        if differs.any():
            wrong[cut + np.unique(np.repeat(np.arange(len(n)), n)[differs])] = True
    if wrong.any():
        seen: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(wrong).tolist():
            content = values[start[k] : stop[k]].tobytes()
            if content not in seen:
                seen[content] = len(first) + len(extra)
                extra.append(k)
            slot[k] = seen[content]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, slot


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches, column: str = "text", max_bytes: int = 4 << 20):
    """The record batches cut so that each holds about max_bytes of the column's text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        _, off = text_buffer(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of true elements, which end at each row's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each start lies."""
    return np.searchsorted(offsets, starts, "right") - 1


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def white_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, stops, and the n+1 offsets of the rows in them."""
    start, stop = runs(~WHITE[buf], offsets)
    return start, stop, np.searchsorted(start, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of this width: of windows twice as wide at each step, over stretches that stay in the cache."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out = np.empty(n, values.dtype)
    for cut in range(0, n, STRETCH):
        size, span = min(STRETCH, n - cut), 1
        part = values[cut : cut + size + width - 1]
        while 2 * span <= width:
            part = np.minimum(part[:-span], part[span:])
            span *= 2
        np.minimum(part[:size], part[width - span : width - span + size], out=out[cut : cut + size])
    return out


def anchor_runs(grams: np.ndarray, offsets: np.ndarray, window: int, gram: int, least: np.ndarray | None = None):
    """Group the windows of each row by the least hash among the grams they hold.

    grams: hash of the gram that starts at each element; offsets: of the rows in elements. Equal windows
    have equal least hashes wherever they lie. Returns (key, first window, last window + 1) of each
    maximal run of neighbouring windows with one key, cut to at most ``window`` windows. least: the windows' least hashes, where
    they are known.
    """
    none = np.zeros(0, np.int64)
    least = sliding_min(grams, window - gram + 1) if least is None else least
    n = len(least)
    if not n:
        return least, none, none
    valid = np.zeros(n + 1, np.int32)
    lengths = np.diff(offsets)
    full = lengths >= window
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, (offsets[:-1] + lengths - window + 1)[full], -1)
    ok = np.cumsum(valid[:-1]) > 0
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    change[offsets[offsets < n]] = True
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], n)
    keep = ok[lo]
    lo, hi = lo[keep], hi[keep]
    pieces = -(-(hi - lo) // window)
    if len(pieces) and pieces.max() > 1:
        each = np.repeat(np.arange(len(lo)), pieces)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo, hi = lo[each] + nth * window, np.minimum(hi[each], lo[each] + (nth + 1) * window)
    return least[lo], lo, hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start+length-1."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
