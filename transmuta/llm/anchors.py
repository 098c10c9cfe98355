"""Content-defined anchors: equal windows of `width` bytes have the same anchor, wherever they stand.

The anchor of a window is its leftmost gram (GRAM bytes) of smallest hash. Neighbouring windows mostly share an anchor, so
a text falls into runs of windows, each run a stretch of text a little longer than a window.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
PIECE = 1 << 18  # bytes worked on at a time; runs do not depend on it
_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM bytes, by doubling: hash(2k bytes at i) = hash(k at i) * f^k + hash(k at i + k)."""
    h = data.astype(_U) + _U(1)
    factor, width = _FACTOR, 1
    while width < GRAM:
        h = h[:-width] * _U(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return _mix(h)


def _leftmost_minima(h: np.ndarray, span: int) -> np.ndarray:
    """For each i the position of the leftmost smallest of h[i : i + span]."""
    # hashes are compared with the position in the low bits, so that the leftmost of equal ones wins
    best = np.arange(len(h), dtype=np.int64)
    value = h
    width = 1
    while 2 * width <= span:
        a, b = value[:-width], value[width:]
        right = b < a
        best = np.where(right, best[width:], best[:-width])
        value = np.where(right, b, a)
        width *= 2
    rest = span - width
    if rest:
        right = value[rest:] < value[:-rest]
        best = np.where(right, best[rest:], best[:-rest])
    return best


def runs(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash as int64, first window, number of windows) of each run, in order; empty if data is shorter than a window."""
    windows = len(data) - width + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    array = np.frombuffer(data, np.uint8)
    places, hashes = [], []
    for start in range(0, windows, PIECE):
        stop = min(windows, start + PIECE)
        h = gram_hashes(array[start:stop + width - 1])
        best = _leftmost_minima(h, width - GRAM + 1)
        places.append(best + start)
        hashes.append(h[best])
    place, value = np.concatenate(places), np.concatenate(hashes)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return value[first].view(np.int64), first, np.diff(first, append=windows)
