"""Content anchors: how windows that may be equal are brought together.

Of the short grams in a window, the one with the smallest hash is the window's anchor.
It depends on the window's content alone, so equal windows have equal anchors, and
neighbouring windows mostly share theirs: a run of windows with one anchor is a piece.
Pieces number about two in every ``window - gram`` places, which is what is shuffled
instead of every window.
"""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> np.uint64(30)
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` (a power of two) items, given the items' hashes."""
    step, odd = 1, _ODD
    while step < gram:
        h = h[:-step] * np.uint64(odd) + h[step:]
        step, odd = step * 2, odd * odd % (1 << 64)
    return mixed(h.copy() if gram == 1 else h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def pieces(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each piece, given the items' hashes."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return runs_of(gram_hashes(h, gram), window - gram + 1)


def runs_of(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, given the hashes of the grams and how many a window has."""
    least = window_minima(grams, width)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[first], first, np.diff(np.concatenate((first, [len(least)])))
