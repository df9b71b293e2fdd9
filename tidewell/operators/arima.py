"""ARIMA(1,1,1) by exact Gaussian likelihood, all series of a task at once.

For w[t] = phi w[t-1] + e[t] + theta e[t-1], the differences of a series, the Kalman filter's prediction error is
u[t] = w[t] - phi w[t-1] - theta / r[t-1] u[t-1], where the relative variance r[t] has a closed form. That is an affine
recursion, so a filter over many rows is an associative scan, done here by doubling, and a stretch of rows is summarised
by what it does to the error that enters it: the error that leaves, and the sums of the likelihood as quadratics of it.
Summaries of neighbouring stretches merge, so a series of any length is one tree of summaries for a candidate. Both
parameters are tanh of free ones: stationary and invertible.
"""

from __future__ import annotations

import numpy as np

from tidewell.operators.descent import Model
from tidewell.operators.series import MIN_POINTS

TOGETHER = 13  # candidates whose filters run together
SMALL = 1e-300


def relative_variance(phi: np.ndarray, theta: np.ndarray, k: np.ndarray) -> np.ndarray:
    """r of the k-th difference (from 0), with phi and theta of the same shape."""
    above = (phi + theta) ** 2 / (1 - phi * phi)
    square = theta * theta
    power = np.power(square, k)
    return 1 + above * power / (1 + above * (1 - power) / (1 - square))


def summarise(pos: np.ndarray, w: np.ndarray, before: np.ndarray, starts: np.ndarray, free: np.ndarray) -> np.ndarray:
    """``summarise_some`` for any number of candidates, a few at a time."""
    parts = [summarise_some(pos, w, before, starts, free[:, at : at + TOGETHER]) for at in range(0, free.shape[1], TOGETHER)]
    return np.concatenate(parts, axis=1)


def summarise_some(pos: np.ndarray, w: np.ndarray, before: np.ndarray, starts: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Summaries (FIELDS, candidates, stretches) of consecutive stretches of rows.

    ``pos`` counts the rows of a series from 0, ``starts`` are the places at which stretches begin; ``w`` and ``before`` are
    the difference of a row and of the one before. ``free`` has the candidates of each stretch: (stretches, candidates, 2).
    """
    lengths = np.diff(np.append(starts, len(pos)))
    of = np.repeat(np.arange(len(starts)), lengths)
    phi, theta = (np.ascontiguousarray(np.tanh(free[:, :, k]).T[:, of]) for k in range(2))
    k = np.maximum(pos - 1, 0)
    r = relative_variance(phi, theta, k)
    used = pos >= 1
    error = np.where(used, w - np.where(pos >= 2, phi * np.where(pos >= 2, before, 0.0), 0.0), 0.0)
    pull = np.where(pos >= 2, -theta / relative_variance(phi, theta, np.maximum(k - 1, 0)), 0.0)
    # the share of the entering error that reaches a row, by sums of logarithms
    size = np.log(np.maximum(np.abs(pull), SMALL))
    whole, minus = np.cumsum(size, axis=1), np.cumsum(pull < 0, axis=1)
    back = np.maximum(starts - 1, 0)
    base = np.where(starts > 0, whole[:, back], 0.0)[:, of]
    odd = (minus - np.where(starts > 0, minus[:, back], 0)[:, of]) % 2
    fresh = np.isin(of, np.flatnonzero(pos[starts] == 0))  # stretches that no error enters
    share = np.where(fresh, 0.0, np.where(odd == 1, -1.0, 1.0) * np.exp(np.maximum(whole - base, -700.0)))
    reach = pull
    reach[:, starts] = 0.0
    step, longest = 1, int(lengths.max())
    while step < longest and np.abs(reach).max() > 1e-18:
        error[:, step:] += reach[:, step:] * error[:, :-step].copy()
        reach[:, step:] *= reach[:, :-step].copy()
        step *= 2
    weight = np.where(used, 1 / r, 0.0)
    plain = used.astype(float)
    sums = [error * error, error * share, share * share]
    logs = np.where(used, np.log(r), 0.0)
    rows = [part * scale for scale in (weight, plain) for part in sums] + [logs]
    ends = starts + lengths - 1
    return np.stack([share[:, ends], error[:, ends], *[np.add.reduceat(part, starts, axis=1) for part in rows]])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summary of two neighbouring stretches."""
    out = np.empty_like(a)
    out[0] = a[0] * b[0]
    out[1] = b[1] + b[0] * a[1]
    for at in (2, 5):
        uu, ug, gg = b[at], b[at + 1], b[at + 2]
        out[at] = a[at] + uu + 2 * a[1] * ug + a[1] ** 2 * gg
        out[at + 1] = a[at + 1] + a[0] * (ug + a[1] * gg)
        out[at + 2] = a[at + 2] + a[0] ** 2 * gg
    out[8] = a[8] + b[8]
    return out


class Arima(Model):
    """Summaries are nine numbers a candidate: decay, leaving error, three weighted and three plain sums, logarithms."""

    columns = ("y", "y1", "y2")
    least_rows = MIN_POINTS
    chunk_rows = 10_000
    block_rows = 20_000
    limit = 3.0
    start = np.array([(a, b) for a in np.linspace(-2.7, 2.7, 13) for b in np.linspace(-2.7, 2.7, 13)])

    def whole(self, pos: np.ndarray, values: list[np.ndarray], free: np.ndarray) -> np.ndarray:
        y, y1, y2 = values
        return summarise(pos, y - y1, y1 - y2, np.flatnonzero(pos == 0), free).transpose(1, 2, 0)

    def stretch(self, pos: np.ndarray, values: list[np.ndarray], free: np.ndarray) -> np.ndarray:
        y, y1, y2 = values
        return summarise(pos, y - y1, y1 - y2, np.array([0]), free)[:, :, 0].T

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return merge(left.T, right.T).T

    def total(self, summary: np.ndarray) -> np.ndarray:
        return summary[:, None]

    def objective(self, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Twice the negative log likelihood at the best innovation variance, without constants."""
        n = rows - 1
        return n * np.log(np.maximum(total[..., 2] / n, SMALL)) + total[..., 8]

    def result(self, point: np.ndarray, total: np.ndarray, rows: np.ndarray) -> list[list[float]]:
        """phi, theta, plain squared error, last error over its relative variance: one row for each series."""
        phi, theta = np.tanh(point[:, 0]), np.tanh(point[:, 1])
        last = total[0, :, 1] / relative_variance(phi, theta, rows - 2)
        return np.column_stack([phi, theta, total[0, :, 5], last]).tolist()
