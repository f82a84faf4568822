"""Hashes of the words and word shingles of whole texts, column-wise from their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20_240_601)
#: A fixed random number for each byte and for each place in a word.
MARKS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes whose words are hashed together, so that what is made of them stays near the processor.
NEAR = 1 << 15

#: An odd number and its inverse among 64-bit numbers.
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets from 0); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return whole, offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, byte after it, number of words of each text)."""
    blank = BLANK[buf]
    opens = ~blank
    opens[1:] &= blank[:-1]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    opens[heads] = ~blank[heads]
    closes = ~blank
    closes[:-1] &= blank[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = ~blank[tails]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, stop, np.diff(np.searchsorted(start, offsets))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, number of words of each text); words are runs without ASCII white space."""
    buf, offsets = raw_bytes(texts)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    start, stop, counts = word_bounds(buf, offsets)
    hashes = np.empty(len(start), dtype=np.uint64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(buf) + NEAR, NEAR)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        hashes[i:j] = _hashes(buf[start[i] : stop[j - 1]], start[i:j] - start[i], stop[i:j] - start[i])
    return hashes, counts


def _hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words of bytes that begin with one."""
    place = np.arange(len(buf))
    begins = np.zeros(len(buf), dtype=np.int64)
    begins[start] = np.diff(start, prepend=0)
    place -= np.cumsum(begins)
    marks = MARKS[buf] * PLACES[place & 1023]
    if place.max() >= 1024:
        marks = marks * (place // 1024 * 2 + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks, dtype=np.uint64)])
    return mixed(sums[stop] - sums[start] + (stop - start).astype(np.uint64))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbouring words, whatever text they are of."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * STEPS[k]
    return mixed(out)


def spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words of each span, whatever its place: differences of a polynomial's prefix sums, divided by the power of the place."""
    powers = np.cumprod(np.full(len(hashes) + 1, ODD, dtype=np.uint64)) * INVERSE
    inverse = np.cumprod(np.full(len(hashes) + 1, INVERSE, dtype=np.uint64)) * ODD
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Of one text: a hash of each ``n`` neighbouring words, of all its words if there are fewer, none if there are none."""
    return runs(hashes, min(n, len(hashes))) if len(hashes) else hashes
