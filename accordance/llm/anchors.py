"""Content-defined anchors: places in a text that any copy of a long enough passage has too."""

from __future__ import annotations

import numpy as np

from accordance.llm.common import prefix_hashes, substring_hashes

GRAM = 16


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """min(keys[i : i + width]) for every i, by running minima of blocks from both sides."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, hash prefixes) for a block of texts, places within the block.

    The window [p, p + length) belongs to the place of the least gram hash among the ``width``
    grams from p on, the leftmost of equals; equal windows have it at the same distance.
    An anchor's windows are a run.
    """
    h = prefix_hashes(data)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, h
    at = np.arange(len(data) - GRAM + 1)
    grams = substring_hashes(h, at, at + GRAM)
    keys = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    best = (window_minima(keys, width) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    p = np.arange(len(data) - length + 1)
    p = p[row[p] == row[p + length - 1]]
    best = best[p]
    change = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (p[1:] != p[:-1] + 1)])
    first = p[change]
    last = p[np.r_[change[1:], len(p)] - 1] if len(p) else empty
    return row[first], best[change], first, last, h
