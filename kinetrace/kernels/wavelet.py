"""Wavelet scan of one multivariate series (NumPy).

Undecimated Haar decomposition, two levels.  A short excursion shows as two level-1
details of opposite sign that enclose at most ``WIDTH`` readings, a level change as
one detail alone, and a stuck sensor as a run of exactly zero details.  Nothing here
knows a source: heights and the histograms from which the source's usual detail is
found are returned, and compared after aggregation.
"""

from __future__ import annotations

import numpy as np

WIDTH = 4  #: longest excursion, in readings
CONTRAST = 3.0  #: edges of an excursion against the steps beside and inside it
SHORTEST_RUN = 6  #: shorter runs of equal readings are only counted
RUN_CAP = 1023  #: run lengths from here on share a histogram cell
BINS = 6  #: histogram cells per octave of |detail|
BIN_SHIFT = 300


def fill(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry the last present value over missing ones (the first back to the start)."""
    missing = ~np.isfinite(x)
    if not missing.any():
        return x, missing
    n = len(x)
    at = np.where(missing, 0, np.arange(n)[:, None])
    np.maximum.accumulate(at, axis=0, out=at)
    first = np.argmax(~missing, axis=0)
    at = np.maximum(at, first[None, :])
    y = np.take_along_axis(x, at, axis=0)
    return np.where(np.isfinite(y), y, 0.0), missing


def bin_of(d: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(d) * BINS).astype(np.int64) + BIN_SHIFT


def _edges(y: np.ndarray, step: np.ndarray, size: np.ndarray, w: int) -> np.ndarray:
    """Height of an excursion of the ``w`` readings from each reading 1 on; 0 where there is none."""
    n = len(y)
    rise, fall = step[1 : n - w], step[1 + w : n]
    edge = np.where(rise * fall < 0, np.minimum(np.abs(rise), np.abs(fall)), 0.0)
    if w == 2:  # two readings side by side that leave the level in opposite directions
        across = step[2 : n - 1]
        apart = (rise * across < 0) & (across * fall < 0) & (np.abs(across) > np.maximum(np.abs(rise), np.abs(fall)))
        both = np.where(apart, np.minimum(np.abs(rise), np.abs(fall)), 0.0)
    if not edge.any() and not (w == 2 and both.any()):
        return edge
    if w > 1:
        inside = size[2 : n - w + 1]
        for k in range(2, w):
            inside = np.maximum(inside, size[1 + k : n - w + k])
        # the level-2 detail of a longer excursion keeps at least half of its height
        mean = sum(y[1 + k : n - w + k] for k in range(w)) / w
        keeps = np.minimum(np.abs(mean - y[: n - w - 1]), np.abs(mean - y[1 + w : n])) >= edge / 2
        edge = np.where(keeps & (edge >= CONTRAST * inside), edge, 0.0)
    if w == 2:
        edge = np.maximum(edge, both)
    return np.where(np.abs(y[1 + w : n] - y[: n - w - 1]) * 1.5 <= edge, edge, 0.0)


def excursions(y: np.ndarray) -> np.ndarray:
    """Height, per reading and dimension, of the excursion a reading belongs to (else 0).

    The steps beside an excursion must be small against its own, but for those of another
    excursion: found first are the ones with a quiet side, then all others.  At either end
    of the series an excursion has one edge, judged by the steps that follow it.
    """
    n, width = y.shape
    out = np.zeros((n, width))
    if n < 3:  # no telling which of two readings left the level
        return out
    step = np.zeros((n + 1, width))
    step[1:n] = y[1:] - y[:-1]  # twice the level-1 detail
    size = np.abs(step)
    found = {w: e for w in range(1, min(WIDTH, max(1, n - 3)) + 1) if (e := _edges(y, step, size, w)).any()}
    others = size.copy()  # steps but for those of excursions with a quiet side
    quiet = {w: (e > 0) & (e >= CONTRAST * np.minimum(size[: n - w - 1], size[2 + w : n + 1])) for w, e in found.items()}
    for w, some in quiet.items():
        at, d = np.nonzero(some)
        for k in (1, 1 + w, 2 if w == 2 else 1):
            others[at + k, d] = 0.0
    for w, edge in found.items():
        between = ~quiet[w] & (others[1 : n - w] == 0) & (others[1 + w : n] == 0)  # what lies between two excursions is the level
        fine = (edge >= CONTRAST * np.maximum(others[: n - w - 1], others[2 + w : n + 1])) & ~between
        edge = np.where(fine, edge, 0.0)
        for k in range(w):
            np.maximum(out[1 + k : n - w + k], edge, out=out[1 + k : n - w + k])
    for w in range(1, min(WIDTH, (n - 2) // 2) + 1):
        last = n - w
        for edge, rest, within, span in (
            (others[w], others[w + 1 : w + 1 + WIDTH], size[1:w], out[:w]),
            (others[last], others[max(1, last - WIDTH) : last], size[last + 1 : n], out[last:]),
        ):
            beside = np.maximum(rest.max(axis=0), within.max(axis=0, initial=0.0))
            np.maximum(span, np.where(edge >= CONTRAST * beside, edge, 0.0), out=span)
    return out


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of equal neighbours; same[i]: reading i + 1 equals i."""
    starts = np.flatnonzero(np.r_[True, ~same])
    return starts, np.r_[starts[1:], len(same) + 1]
