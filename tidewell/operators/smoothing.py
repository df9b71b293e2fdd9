"""Simple smoothing with an additive season of twelve, fitted by Newton steps, all series of a task at once.

The state is a level and twelve seasonal terms: error = y - level - season, level += alpha error, season += gamma error. For
fixed parameters a whole season is one affine map of the state, the same for every season: x -> A x + B y, with the errors
C x + D y. States at the beginnings of all seasons are so a linear recursion with a constant matrix, solved by doubling.
The first twelve rows of a series are its initial state; the rows of an unfinished last season follow one by one, for all
series together.

A stretch of a long series is summarised by what it does to the state that enters it, x -> M x + b, and by its squared
error x'Qx + 2 r'x + c; neighbouring summaries merge.
"""

from __future__ import annotations

import numpy as np

from tidewell.operators.descent import Model

SEASON = 12
STATE = SEASON + 1
TOGETHER = 9  # candidates that run together
SMALL = 1e-300


def logistic(free: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-free))


def season_map(alpha: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, ...]:
    """A, B, C, D of one season, with the shape of the parameters in front."""
    shape = alpha.shape
    # columns: the thirteen numbers of the state, then the twelve values
    now = np.zeros((*shape, STATE, STATE + SEASON))
    now[..., np.arange(STATE), np.arange(STATE)] = 1
    errors = np.zeros((*shape, SEASON, STATE + SEASON))
    for j in range(SEASON):
        errors[..., j, :] = -now[..., 0, :] - now[..., 1 + j, :]
        errors[..., j, STATE + j] += 1
        now[..., 0, :] += alpha[..., None] * errors[..., j, :]
        now[..., 1 + j, :] += gamma[..., None] * errors[..., j, :]
    return now[..., :STATE], now[..., STATE:], errors[..., :STATE], errors[..., STATE:]


def run(y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entering: np.ndarray, free: np.ndarray):
    """(errors' products, leaving states) of stretches that begin with a season.

    ``y`` has columns beside one another, (rows, columns): the last ones may be the homogeneous parts of a state that is
    not known yet. ``entering`` is (stretches, STATE, columns), ``free`` (stretches, candidates, 2). The products are
    (stretches, candidates, columns, columns), the states (stretches, candidates, STATE, columns).
    """
    alpha, gamma = logistic(free[..., 0]), logistic(free[..., 1])
    a, b, c, d = season_map(alpha, gamma)
    columns = y.shape[1]
    whole, rest = lengths // SEASON, lengths % SEASON
    most = int(whole.max(initial=0))
    count = len(starts)
    # states at the beginning of every season and after the last whole one
    slots = whole + 1
    of = np.repeat(np.arange(count), slots)
    first = np.cumsum(slots) - slots
    k = np.arange(len(of)) - first[of]
    values = np.zeros((len(of), SEASON, columns))
    full = k < whole[of]
    rows = (starts[of] + k * SEASON)[full][:, None] + np.arange(SEASON)
    values[full] = y[rows]
    state = np.zeros((len(of), alpha.shape[1], STATE, columns))
    state[first] = entering[:, None]
    later = np.flatnonzero(k > 0)
    state[later] = b[of[later]] @ values[later - 1][:, None]
    power, step = a, 1
    while step <= most:
        reached = np.flatnonzero(k >= step)
        state[reached] += power[of[reached]] @ state[reached - step]
        power, step = power @ power, 2 * step
    errors = c[of[full]] @ state[full] + d[of[full]] @ values[full][:, None]
    products = np.zeros((count, alpha.shape[1], columns, columns))
    seasons = np.swapaxes(errors, -1, -2) @ errors
    held = np.flatnonzero(whole > 0)
    if len(held):
        begin = (np.cumsum(whole) - whole)[held]
        products[held] = np.add.reduceat(seasons, begin, axis=0)
    last = state[first + whole]
    for j in range(int(rest.max(initial=0))):
        at = np.flatnonzero(rest > j)
        value = y[starts[at] + whole[at] * SEASON + j]
        error = value[:, None] - last[at, :, 0] - last[at, :, 1 + j]
        last[at, :, 0] += alpha[at][..., None] * error
        last[at, :, 1 + j] += gamma[at][..., None] * error
        products[at] += error[..., :, None] * error[..., None, :]
    return products, last


class Smoothing(Model):
    """Summaries are (candidates, STATE * STATE + STATE + STATE * STATE + STATE + 1): M, b, Q, r, c."""

    columns = ("y",)
    least_rows = 2 * SEASON
    chunk_rows = 833 * SEASON
    block_rows = 12_000
    limit = 6.0
    start = np.array([(np.log(a / (10 - a)), np.log(g / (10 - g))) for a in range(1, 10) for g in range(1, 10)])

    def whole(self, pos: np.ndarray, values: list[np.ndarray], free: np.ndarray) -> np.ndarray:
        """(candidates, series, 1 + STATE): squared error and last state of consecutive whole series."""
        y = values[0][:, None]
        begins = np.flatnonzero(pos == 0)
        lengths = np.diff(np.append(begins, len(pos))) - SEASON
        opening = y[begins[:, None] + np.arange(SEASON)]
        level = opening.mean(axis=1, keepdims=True)
        entering = np.concatenate([level, opening - level], axis=1)
        parts = []
        for at in range(0, free.shape[1], TOGETHER):
            products, last = run(y, begins + SEASON, lengths, entering, free[:, at : at + TOGETHER])
            parts.append(np.concatenate([products[..., 0], last[..., 0]], axis=2))
        return np.concatenate(parts, axis=1).transpose(1, 0, 2)

    def stretch(self, pos: np.ndarray, values: list[np.ndarray], free: np.ndarray) -> np.ndarray:
        y = values[0]
        start, entering = 0, np.zeros((STATE, 1 + STATE))
        if pos[0] == 0:  # no state enters the first stretch
            start, level = SEASON, y[:SEASON].mean()
            entering[:, 0] = np.concatenate([[level], y[:SEASON] - level])
        else:
            entering[:, 1:] = np.eye(STATE)
        wide = np.zeros((len(y), 1 + STATE))
        wide[:, 0] = y
        parts = []
        for at in range(0, free.shape[1], TOGETHER):
            products, last = run(wide, np.array([start]), np.array([len(y) - start]), entering[None], free[:, at : at + TOGETHER])
            parts.append(_joined(last[0, :, :, 1:], last[0, :, :, 0], products[0, :, 1:, 1:], products[0, :, 1:, 0], products[0, :, 0, 0]))
        return np.concatenate(parts)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ma, ba, qa, ra, ca = _split(left)
        mb, bb, qb, rb, cb = _split(right)
        reached = np.einsum("nij,nj->ni", qb, ba)
        back = ma.transpose(0, 2, 1)
        return _joined(
            mb @ ma,
            np.einsum("nij,nj->ni", mb, ba) + bb,
            qa + back @ qb @ ma,
            ra + np.einsum("nij,nj->ni", back, reached + rb),
            ca + cb + np.einsum("ni,ni->n", ba, reached + 2 * rb),
        )

    def total(self, summary: np.ndarray) -> np.ndarray:
        """A merged summary in the form of ``whole``, for one series."""
        _, b, _, _, c = _split(summary)
        return np.concatenate([c[:, None], b], axis=1)[:, None]

    def objective(self, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n = rows - SEASON
        return n * np.log(np.maximum(total[..., 0] / n, SMALL))

    def result(self, point: np.ndarray, total: np.ndarray, rows: np.ndarray) -> list[list[float]]:
        """alpha, gamma, squared error, level and the twelve seasonal terms: one row for each series."""
        return np.column_stack([logistic(point), total[0]]).tolist()


def _joined(m, b, q, r, c) -> np.ndarray:
    n = len(m)
    return np.hstack([m.reshape(n, -1), b, q.reshape(n, -1), r, c[:, None]])


def _split(s: np.ndarray):
    n = len(s)
    m, b, q, r, c = np.split(s, np.cumsum([STATE * STATE, STATE, STATE * STATE, STATE]), axis=1)
    return m.reshape(n, STATE, STATE), b, q.reshape(n, STATE, STATE), r, c[:, 0]
