"""Minimizers of texts' bytes: what a text has in common with any text that contains it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a gram, and grams of a window: a text of ``GRAM + WINDOW - 1`` bytes has one minimizer.
GRAM, WINDOW = 16, 25
#: Bytes of texts that are looked at at once.
BLOCK_BYTES = 2 << 20
_MARKS = np.random.default_rng(20_250_101).integers(1, 1 << 63, 256, dtype=np.uint64)
#: An odd number and its inverse among 64-bit numbers.
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets from 0) of runs of texts of about ``limit`` bytes; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        own = offsets[at : end + 1]
        yield at, np.frombuffer(data, dtype=np.uint8)[own[0] : own[-1]] if data is not None else np.empty(0, np.uint8), own - own[0]
        at = end


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def minimizers(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the grams that are smallest in some window of a text, neighbours that repeat left out; none of shorter texts."""
    if len(buf) < GRAM + WINDOW - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    powers = np.cumprod(np.full(len(buf) + 1, ODD, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MARKS[buf] * powers[:-1], dtype=np.uint64)])
    h = (sums[GRAM:] - sums[:-GRAM]) * np.cumprod(np.full(len(buf) - GRAM + 1, INVERSE, dtype=np.uint64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = _least(h ^ (h >> np.uint64(32)), WINDOW)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = of[: len(least)] == of[GRAM + WINDOW - 2 :]
    whole[1:] &= (least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1]) | ~whole[:-1]
    return of[: len(least)][whole], least[whole].view(np.int64)
