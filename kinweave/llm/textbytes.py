"""Whole Arrow batches of texts as one byte buffer, hashed with numpy instead of a Python loop per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: ASCII white space as the word rules take it: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffer_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring ranges as those of the whole. Not linear: no sums or powers that texts could cancel."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15)
        x += b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer.

    Ranges below 128 bytes are covered by two blocks of 2**k bytes, whose hashes are made for all places at once by
    doubling; longer ones are hashed one by one."""

    TABLE = mix(np.arange(1, 257, dtype=np.uint64), 77)
    LONG = 128
    #: Places and ranges that are worked on at a time, so that arrays stay in a core's cache.
    PLACES, RANGES = 1 << 15, 1 << 12

    def __init__(self, data: np.ndarray):
        self.data = data

    def _short(self, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        low = int(start.min())
        start, end = start - low, end - low
        block = self.TABLE[self.data[low : low + int(end.max())]]
        power = np.frexp(end - start)[1] - 1
        for k in range(int(power.max()) + 1):
            if k:
                half = 1 << k - 1
                block = joined_hash(block[:-half], block[half:])
            own = np.flatnonzero(power == k)
            if len(own):
                out[own] = joined_hash(out[own], joined_hash(block[start[own]], block[end[own] - (1 << k)]))

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        length = (end - start).astype(np.int64)
        out = mix(length.astype(np.uint64), 5 + seed)  # of empty ranges
        short = np.flatnonzero((length > 0) & (length < self.LONG))
        for i in range(0, len(short), self.RANGES):
            own = short[i : i + self.RANGES]
            got = out[own]
            self._short(start[own], end[own], got)
            out[own] = got
        long = np.flatnonzero(length >= self.LONG)
        if len(long):
            view = memoryview(np.ascontiguousarray(self.data))
            out[long] = [xxhash.xxh3_64_intdigest(view[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        return out

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k bytes."""
        n = max(0, len(self.data) - k + 1)
        out = np.empty(n, np.uint64)
        power = k.bit_length() - 1
        for at in range(0, n, self.PLACES):
            block = self.TABLE[self.data[at : at + self.PLACES + k - 1]]
            for i in range(power):
                block = joined_hash(block[: -(1 << i)], block[1 << i :])
            if k != 1 << power:
                block = joined_hash(block[: -(k - (1 << power))], block[k - (1 << power) :])
            out[at : at + self.PLACES] = block
        return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each run of bytes that aren't white space; runs end with their document."""
    inside = ~SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    real = inside[start] if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Parts of a batch with about ``most`` bytes of text each (one longer text stands alone), so that the arrays
    made per byte stay bounded whatever the batch size of the session is."""
    col = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def word_count(data: np.ndarray, most: int = 1 << 20) -> int:
    """Words of one text, counted block by block."""
    total, before = 0, True
    for a in range(0, len(data), most):
        space = SPACE[data[a : a + most]]
        total += int((~space & np.concatenate([[before], space[:-1]])).sum())
        before = bool(space[-1])
    return total


#: A longer text is worked on in parts where that bounds what is held per byte.
PART_BYTES = 4 << 20


def word_parts(data: np.ndarray, overlap: int = 0, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of one text with about ``most`` bytes, cut at white space. Each part but the first begins
    with the last ``overlap`` words of the one before; a word longer than ``most`` stays whole."""
    space = SPACE[data]
    start = 0
    while True:
        end = min(len(data), start + most)
        while end < len(data):  # on to the next white space
            found = np.flatnonzero(space[end : end + most])
            end = end + int(found[0]) if len(found) else min(len(data), end + most)
            if len(found):
                break
        yield start, end
        if end >= len(data):
            return
        start, seen = end, 0
        while seen < overlap and start > 0:  # back over the words before the cut
            back = max(0, start - most)
            edge = np.flatnonzero(~space[back:start] & np.concatenate([[back == 0], space[back : start - 1]]))
            if not len(edge):
                start = back
                continue
            take = min(overlap - seen, len(edge))
            start, seen = back + int(edge[-take]), seen + take
