"""Vectorised work on blocks of whole texts inside Spark tasks.

A block is the UTF-8 bytes of some documents back to back, with the offset of each; all functions
work on every word of a block at once, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Multipliers of the splitmix64 and murmur3 finalisers (fixed values).
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks that keep the first k bytes of a little-endian word of eight.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of text; a longer text comes alone, whole."""
    for batch in batches:
        lengths = np.diff(offsets_of(batch.column(column)))
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def block_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of the texts; a null is an empty text. Eight zero bytes follow the last text."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    at = offsets_of(texts)
    data = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if at[-1] > at[0]:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text) of the runs of bytes other than ASCII white space."""
    n = int(offsets[-1])
    inside = np.zeros(n + 1, bool)
    np.logical_not(IS_SPACE[data[:n]], out=inside[:n])
    edge = np.empty(n + 1, bool)
    edge[:1] = True
    edge[1:] = ~inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge)
    last = np.empty(n + 1, bool)  # of byte i: a word cannot go on at i + 1
    last[:n] = edge[1:] | ~inside[1:]
    last[n] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight at a time."""
    eights = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64) + np.uint64((seed + 1) * int(M1) % 2**64))
    live, at = np.flatnonzero(left > 0), starts.astype(np.int64)
    while len(live):
        take = np.minimum(left[live], 8)
        h[live] = mix((h[live] ^ (eights[at[live]] & KEEP[take])) * M1)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return h


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in it) of each element of rows that have so many elements."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def shingles_of(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, shingles before each text) of k successive words; fewer words than k are one shingle, none are none."""
    n = np.diff(before)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row, i = ragged(counts)
    first = before[:-1][row] + i
    left = (before[1:][row] - first).astype(np.int64)
    out = np.zeros(len(row), np.uint64)
    for j in range(k):
        there = left > j
        if there.all():
            out = mix((out ^ h[first + j]) * M1 + np.uint64(j + 1))
        else:
            out[there] = mix((out[there] ^ h[first[there] + j]) * M1 + np.uint64(j + 1))
    return out, np.concatenate([[0], np.cumsum(counts)])


class Index:
    """Places of keys in a table, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.row = np.full(1 << self.bits, -1, np.int32)
        slot, live = self._slot(keys), np.arange(len(keys))
        while len(live):
            free = self.row[slot[live]] < 0
            self.row[slot[live[free]]] = live[free]
            live = live[self.row[slot[live]] != live]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 if it is not there."""
        slot = self._slot(keys)
        row = self.row[slot]
        live = np.flatnonzero((row >= 0) & (self.keys[row] != keys)) if len(self.keys) else np.zeros(0, int)
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
            row[live] = self.row[slot[live]]
            live = live[(row[live] >= 0) & (self.keys[row[live]] != keys[live])]
        return row
