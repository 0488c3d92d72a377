"""Cheapest chains of choices, cut anywhere without loss.

A record has candidates, each with a cost of its own, a format and a time. Going from one record's
candidate to the next record's costs ``switch`` if the formats differ and ``backward`` if the time
jumps back; a candidate of format ``NONE`` (the record says nothing) costs neither way. A stretch of
records is summed up by a table: the cost of the cheapest chain from each candidate of its first to
each candidate of its last record. Tables of neighbouring stretches are joined by a min-plus product,
so a chain is the same however it is cut, and no stretch has to be read with its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The format of the candidate that stands for no reading at all.
NONE = -1


@dataclass
class Costs:
    switch: float = 1.0
    backward: float = 0.5

    def step(self, f0: np.ndarray, t0: np.ndarray, f1: np.ndarray, t1: np.ndarray) -> np.ndarray:
        """The costs (..., before, after) of going from candidates to candidates."""
        out = self.switch * (f0[..., :, None] != f1[..., None, :]) + self.backward * (t1[..., None, :] < t0[..., :, None])
        return np.where((f0[..., :, None] == NONE) | (f1[..., None, :] == NONE), 0.0, out)


@dataclass
class Stretch:
    """The table of a stretch, and formats and times of its first and last record's candidates."""

    table: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product over the last axis of ``a`` and the next to last of ``b``."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


class Chain:
    """Consecutive records: costs, formats and times (records, candidates), cost infinite where there is none."""

    def __init__(self, cost: np.ndarray, form: np.ndarray, time: np.ndarray, costs: Costs):
        self.costs = costs
        self.n, self.k = cost.shape
        # segments of equal length (but for the last) are worked on side by side
        self.length = max(1, int(np.ceil(np.sqrt(self.n))))
        self.segments = -(-self.n // self.length)
        shape = (self.segments, self.length)
        fill = self.segments * self.length - self.n
        pad = lambda x: np.concatenate([x, np.zeros((fill, self.k), x.dtype)]).reshape(*shape, self.k)
        self.cost, self.form, self.time = pad(cost), pad(form), pad(time)
        self.tail = self.length - fill  # records of the last segment

    def _active(self, j: int) -> slice:
        """The segments that have a record at place ``j``."""
        return slice(0, self.segments if j < self.tail else self.segments - 1)

    def _step(self, j: int, at: slice) -> np.ndarray:
        return self.costs.step(self.form[at, j - 1], self.time[at, j - 1], self.form[at, j], self.time[at, j])

    def stretches(self) -> list[Stretch]:
        """One of each segment."""
        table = np.full((self.segments, self.k, self.k), np.inf)
        own = np.arange(self.k)
        table[:, own, own] = self.cost[:, 0]
        for j in range(1, self.length):
            at = self._active(j)
            table[at] = _joined(table[at], self._step(j, at)) + self.cost[at, j][:, None, :]
        ends = [self.length - 1] * (self.segments - 1) + [self.tail - 1]
        return [Stretch(table[s], (self.form[s, 0], self.time[s, 0]), (self.form[s, e], self.time[s, e])) for s, e in enumerate(ends)]

    def pick(self, ends: list[tuple[int, int]]) -> np.ndarray:
        """The chosen candidate of each record, with each segment's first and last one given."""
        a, b = np.array(ends).T
        best = np.full((self.segments, self.k), np.inf)
        rows = np.arange(self.segments)
        best[rows, a] = self.cost[rows, 0, a]
        back = np.zeros((self.length, self.segments, self.k), dtype=np.int32)
        for j in range(1, self.length):
            at = self._active(j)
            through = best[at][:, :, None] + self._step(j, at)
            back[j, at] = through.argmin(axis=1)
            best[at] = through.min(axis=1) + self.cost[at, j]
        out = np.zeros((self.segments, self.length), dtype=np.int64)
        here = b.copy()
        for j in range(self.length - 1, 0, -1):
            at = self._active(j)
            out[at, j] = here[at]
            here[at] = back[j, rows[at], here[at]]
        out[:, 0] = here
        return out.reshape(-1)[: self.n]


def combine(parts: list[Stretch], costs: Costs) -> Stretch:
    """The stretch of consecutive stretches."""
    table = parts[0].table
    for before, part in zip(parts, parts[1:], strict=False):
        table = _joined(_joined(table, costs.step(*before.last, *part.first)), part.table)
    return Stretch(table, parts[0].first, parts[-1].last)


def resolve(parts: list[Stretch], costs: Costs, a: int | None = None, b: int | None = None) -> list[tuple[int, int]]:
    """The first and last candidate of each stretch on the cheapest chain from ``a`` to ``b`` (free if None)."""
    arrive = np.zeros(parts[0].table.shape[0])
    if a is not None:
        arrive = np.where(np.arange(len(arrive)) == a, 0.0, np.inf)
    entered, left = [], []
    for i, part in enumerate(parts):
        if i:
            step = best[:, None] + costs.step(*parts[i - 1].last, *part.first)  # noqa: F821
            left.append(step.argmin(axis=0))
            arrive = step.min(axis=0)
        through = arrive[:, None] + part.table
        entered.append(through.argmin(axis=0))
        best = through.min(axis=0)
    here = int(best.argmin()) if b is None else b
    out = []
    for i in range(len(parts) - 1, -1, -1):
        first = int(entered[i][here])
        out.append((first, here))
        if i:
            here = int(left[i - 1][first])
    return out[::-1]
