"""Sketches that keyed state can hold: of bounded size, and two of them can be merged."""

from __future__ import annotations

import numpy as np


class Quantiles:
    """Quantiles of a stream of numbers from buffers of ``size`` values, one for each power of two of weight.

    A buffer that overflows is sorted, and every other value goes on with twice the weight, the first ones and the second
    ones by turns. One such step moves a rank by its weight at most, and there are n / size / weight of them, so a rank is
    off by at most (number of buffers - 1) * n / size; up to ``size`` values quantiles are exact. There are about
    log2(n / size) + 2 buffers.
    """

    def __init__(self, size: int = 8192, state: list[list[float]] | None = None):
        *buffers, turns = state or [[], [0]]
        self.size, self.buffers, self.turns = size, [np.asarray(b, float) for b in buffers], [int(t) for t in turns]

    def state(self) -> list[list[float]]:
        """What makes the sketch again: the buffers, then whose turn it is in each."""
        return [*(b.tolist() for b in self.buffers), [float(t) for t in self.turns]]

    def add(self, values: np.ndarray) -> None:
        """Values that are not numbers do not count."""
        values = np.asarray(values, float)
        self.buffers[0] = np.concatenate([self.buffers[0], values[~np.isnan(values)]])
        self._settle()

    def merge(self, other: Quantiles) -> None:
        for level, buffer in enumerate(other.buffers):
            self._grow(level)
            self.buffers[level] = np.concatenate([self.buffers[level], buffer])
        self._settle()

    def count(self) -> int:
        return sum(len(b) << level for level, b in enumerate(self.buffers))

    def rank_error(self) -> float:
        """The bound on how far a rank may be off, as a share of all values."""
        return (len(self.buffers) - 1) / self.size

    def at(self, share: float) -> float:
        """The quantile, interpolated between its two neighbours; NaN without values."""
        n = self.count()
        if not n:
            return float("nan")
        values = np.concatenate(self.buffers)
        weights = np.repeat(1 << np.arange(len(self.buffers)), [len(b) for b in self.buffers])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        place = (n - 1) * share
        low, high = (values[order[np.searchsorted(upto, p, side="right")]] for p in (int(np.floor(place)), int(np.ceil(place))))
        return float(low + (high - low) * (place - np.floor(place)))

    def _grow(self, level: int) -> None:
        while len(self.buffers) <= level:
            self.buffers.append(np.zeros(0))
            self.turns.append(0)

    def _settle(self) -> None:
        level = 0
        while level < len(self.buffers):
            own = self.buffers[level]
            if len(own) > self.size:
                own = np.sort(own)
                even = len(own) & ~1
                self._grow(level + 1)
                self.buffers[level + 1] = np.concatenate([self.buffers[level + 1], own[self.turns[level] : even : 2]])
                self.buffers[level], self.turns[level] = own[even:], 1 - self.turns[level]
            level += 1
