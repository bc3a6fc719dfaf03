"""Linear-chain conditional random fields with two states, over numpy arrays.

A sequence's score for the states y is the sum of emission[t] over the t with y[t] = 1, plus a weight for
each pair of neighbouring states. Forward and backward messages are kept as log ratios of state 1 to
state 0. Long sequences are cut into blocks whose transfer matrices are computed for all blocks at once
and then chained, which is exact and takes BLOCK + length / BLOCK vector steps in place of length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK = 48
AT_ONCE = 200_000  # positions that are gone through together, which bounds the memory


def _forward(e: np.ndarray, first: np.ndarray, length: np.ndarray, w: np.ndarray) -> np.ndarray:
    """r[t], the log ratio of the forward messages; sequences lie at first[i] .. first[i] + length[i]."""
    n_blocks = -(-length // BLOCK)
    seq = np.repeat(np.arange(len(first)), n_blocks)
    begin = np.cumsum(n_blocks) - n_blocks
    inside = np.arange(len(seq)) - begin[seq]
    start = first[seq] + inside * BLOCK
    size = np.minimum(length[seq] - inside * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")
    start_o, size_o = start[order], size[order]
    fresh = inside[order] == 0
    # transfer of whole blocks that have a block behind them: m[i][j], from state i before to state j at the end
    m = [[np.zeros(len(order)), np.full(len(order), -np.inf)], [np.full(len(order), -np.inf), np.zeros(len(order))]]
    if (n_blocks > 1).any():
        for t in range(BLOCK):
            k = int(np.searchsorted(-size_o, -t, side="left"))  # blocks longer than t
            if not k:
                break
            x = e[start_o[:k] + t]
            for i in (0, 1):
                a, b = m[i][0][:k], m[i][1][:k]
                to0 = np.logaddexp(a + w[0, 0], b + w[1, 0])
                to1 = np.logaddexp(a + w[0, 1], b + w[1, 1]) + x
                if t == 0:  # a sequence's first position is entered without a transition
                    to0, to1 = np.where(fresh[:k], 0.0, to0), np.where(fresh[:k], x, to1)
                m[i][0][:k], m[i][1][:k] = to0, to1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # the ratio before each block: 0 before a sequence (no transition counts there)
    before = np.full(len(seq), np.nan)
    r = np.zeros(len(first))
    by_length = np.argsort(-n_blocks, kind="stable")
    for j in range(int(n_blocks.max(initial=0))):
        k = int(np.searchsorted(-n_blocks[by_length], -j, side="left"))
        s = by_length[:k]
        b = begin[s] + j
        before[b] = r[s]
        p = place[b]
        if j == 0:
            r[s] = m[0][1][p] - m[0][0][p]
        else:
            r[s] = np.logaddexp(m[0][1][p], r[s] + m[1][1][p]) - np.logaddexp(m[0][0][p], r[s] + m[1][0][p])
    out = np.empty(len(e))
    v = before[order]
    for t in range(BLOCK):
        k = int(np.searchsorted(-size_o, -t, side="left"))
        if not k:
            break
        x = e[start_o[:k] + t]
        step = np.logaddexp(w[0, 1], w[1, 1] + v[:k]) - np.logaddexp(w[0, 0], w[1, 0] + v[:k])
        if t == 0:
            step = np.where(fresh[:k], 0.0, step)
        v[:k] = step + x
        out[start_o[:k] + t] = v[:k]
    return out


def log_ratios(e: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log ratios; forward[t] + backward[t] is the logit of the marginal of state 1."""
    length = np.diff(offsets)
    ok = length > 0
    first, length = offsets[:-1][ok], length[ok]
    if not len(first):
        return np.zeros(0), np.zeros(0)
    f = _forward(e, first, length, w)
    n = len(e)
    # the chain read from its end: transitions transposed, and the emission taken out again
    b = _forward(e[::-1], (n - first - length)[::-1], length[::-1], w.T)[::-1] - e
    return f, b


def marginals(e: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The probability of state 1 at each position, from emissions e of sequences divided by offsets."""
    p = np.empty(len(e))
    for i, j in _some(offsets):
        a, b = offsets[i], offsets[j]
        forward, backward = log_ratios(e[a:b], offsets[i : j + 1] - a, w)
        p[a:b] = 1.0 / (1.0 + np.exp(-np.clip(forward + backward, -60, 60)))
    return p


def _some(offsets: np.ndarray):
    """Ranges of sequences of at most AT_ONCE positions; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + AT_ONCE, side="right")) - 1)
        yield i, j
        i = j


def _expected(e: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of log partition functions, marginals, expected transition counts), some sequences at a time."""
    z, p, counts = 0.0, np.empty(len(e)), np.zeros((2, 2))
    for i, j in _some(offsets):
        a, b = offsets[i], offsets[j]
        part = _expected_of(e[a:b], offsets[i : j + 1] - a, w)
        z, counts = z + part[0], counts + part[2]
        p[a:b] = part[1]
    return z, p, counts


def _expected_of(e: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    f, b = log_ratios(e, offsets, w)
    p = 1.0 / (1.0 + np.exp(-np.clip(f + b, -60, 60)))
    length = np.diff(offsets)
    follows = np.ones(len(e), bool)
    follows[offsets[:-1][length > 0]] = False
    t = np.flatnonzero(follows)
    # pairs: forward ratio before, emission and backward ratio behind
    before, behind = f[t - 1], e[t] + b[t]
    logs = np.stack([np.full(len(t), w[0, 0]), w[0, 1] + behind, w[1, 0] + before, w[1, 1] + before + behind])
    norm = np.logaddexp.reduce(logs, axis=0)
    counts = np.exp(logs - norm).sum(axis=1).reshape(2, 2)
    # log Z by the chain rule: each position's normaliser given the forward ratio
    z = np.zeros(len(e))
    firsts = offsets[:-1][length > 0]
    z[firsts] = np.logaddexp(0.0, e[firsts])
    u = f[t - 1]
    lse = np.logaddexp(0.0, u)
    from0 = np.logaddexp(w[0, 0] - lse, w[1, 0] + u - lse)
    from1 = np.logaddexp(w[0, 1] - lse, w[1, 1] + u - lse) + e[t]
    z[t] = np.logaddexp(from0, from1)
    return float(z.sum()), p, counts


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """The scalar product on one thread: vectors this short only keep BLAS's threads spinning."""
    return float(np.einsum("i,i->", a, b))


def fit(
    emission: Callable[[np.ndarray], np.ndarray],
    gather: Callable[[np.ndarray], np.ndarray],
    n_weights: int,
    y: np.ndarray,
    offsets: np.ndarray,
    l2: float = 1.0,
    steps: int = 60,
    start: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of emission features and transitions that maximise the labelled sequences' likelihood.

    emission(weights) gives e; gather(values) adds a value per position up by feature (its transpose).
    L-BFGS with backtracking, from the weights and transitions in `start` or from zeros.
    """
    length = np.diff(offsets)
    follows = np.ones(len(y), bool)
    follows[offsets[:-1][length > 0]] = False
    t = np.flatnonzero(follows)
    seen = np.bincount(2 * y[t - 1].astype(int) + y[t].astype(int), minlength=4).reshape(2, 2).astype(float)

    def loss(x):
        w = x[n_weights:].reshape(2, 2)
        e = emission(x[:n_weights])
        z, p, counts = _expected(e, offsets, w)
        value = z - float(e[y > 0].sum()) - float((seen * w).sum()) + 0.5 * l2 * _dot(x, x)
        g = np.concatenate([gather(p - y), (counts - seen).ravel()]) + l2 * x
        return value, g

    x = np.zeros(n_weights + 4) if start is None else start.copy()
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, a = g.copy(), []
        for s, v, rho in reversed(pairs):
            k = rho * _dot(s, d)
            a.append(k)
            d -= k * v
        if pairs:
            s, v, rho = pairs[-1]
            d *= _dot(s, v) / _dot(v, v)
        else:
            d /= max(1.0, np.abs(d).max())
        for (s, v, rho), k in zip(pairs, reversed(a), strict=True):
            d += s * (k - rho * _dot(v, d))
        slope, size = -_dot(g, d), 1.0
        for _ in range(12):
            after, fresh = loss(x - size * d)
            if after <= value + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        s, v = -size * d, fresh - g
        if (bend := _dot(s, v)) > 1e-12:
            pairs = [*pairs[-4:], (s, v, 1.0 / bend)]
        done = value - after < 1e-5 * max(1.0, abs(value))
        x, value, g = x + s, after, fresh
        if done:
            break
    return x[:n_weights], x[n_weights:].reshape(2, 2)
