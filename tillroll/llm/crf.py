"""A linear-chain conditional random field with two states (0 boilerplate, 1 content).

A sequence with feature rows x_1..x_T and states y scores

    sum_t [y_t = 1] * (w . x_t)  +  stay * #{t : y_t = y_(t-1)}.

``fit`` maximises the conditional likelihood under a Gaussian prior centred at the
given weights; ``viterbi`` returns the best states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    weights: tuple[float, ...]
    stay: float


def viterbi(unary: list[float], stay: float) -> list[int]:
    """Best states for content-minus-boilerplate scores ``unary``; ties go to content.

    An empty sequence has no states.
    """
    if not unary:
        return []
    bad, good = 0.0, unary[0]
    came: list[tuple[int, int]] = []
    for u in unary[1:]:
        b_from = 1 if good > bad + stay else 0          # best predecessor of "boilerplate"
        g_from = 0 if bad > good + stay else 1          # best predecessor of "content"
        came.append((b_from, g_from))
        bad, good = ((good if b_from else bad + stay), (good + stay if g_from else bad) + u)
    state = 1 if good >= bad else 0
    out = [state]
    for step in reversed(came):
        state = step[state]
        out.append(state)
    out.reverse()
    return out


def _likelihood(w, stay, x, y, mask, prior_w, prior_stay, strength):
    """Penalised mean log likelihood and its gradient over padded sequences."""
    n, steps, _ = x.shape
    u = x @ w
    lengths = mask.sum(1)
    fwd = np.zeros((n, steps, 2))
    fwd[:, 0, 1] = u[:, 0]
    for t in range(1, steps):
        a, b = fwd[:, t - 1, 0], fwd[:, t - 1, 1]
        fwd[:, t, 0] = np.logaddexp(a + stay, b)
        fwd[:, t, 1] = np.logaddexp(a, b + stay) + u[:, t]
    bwd = np.zeros((n, steps, 2))
    for t in range(steps - 2, -1, -1):
        live = (t + 1 < lengths)
        a, b = bwd[:, t + 1, 0], bwd[:, t + 1, 1] + u[:, t + 1]
        bwd[:, t, 0] = np.where(live, np.logaddexp(a + stay, b), 0.0)
        bwd[:, t, 1] = np.where(live, np.logaddexp(a, b + stay), 0.0)
    last = fwd[np.arange(n), lengths - 1]
    log_z = np.logaddexp(last[:, 0], last[:, 1])
    p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - log_z[:, None]) * mask
    grad_w = np.einsum("nt,ntf->f", (y - p1) * mask, x)
    pair = mask[:, 1:]
    same = (y[:, 1:] == y[:, :-1]) * pair
    p_same = sum(np.exp(np.minimum(0.0, fwd[:, :-1, s] + stay + s * u[:, 1:] + bwd[:, 1:, s] - log_z[:, None]))
                 for s in (0, 1)) * pair
    grad_stay = float((same - p_same).sum())
    value = float((u * y * mask).sum() + stay * same.sum() - log_z.sum())
    value -= strength * (np.sum((w - prior_w) ** 2) + (stay - prior_stay) ** 2) / 2
    return (value / n, (grad_w - strength * (w - prior_w)) / n,
            (grad_stay - strength * (stay - prior_stay)) / n)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], prior: Crf, strength: float = 20.0,
        steps: int = 150, rate: float = 0.08) -> Crf:
    """Train on (features [T, F], states [T]) pairs; without any, the prior itself.

    ``strength`` is the precision of the Gaussian prior in pseudo-sequences.
    """
    sequences = [s for s in sequences if len(s[1])]
    prior_w = np.array(prior.weights, float)
    if not sequences:
        return prior
    longest = max(len(s[1]) for s in sequences)
    n, width = len(sequences), len(prior_w)
    x, y, mask = np.zeros((n, longest, width)), np.zeros((n, longest)), np.zeros((n, longest), int)
    for i, (feat, states) in enumerate(sequences):
        x[i, :len(states)], y[i, :len(states)], mask[i, :len(states)] = feat, states, 1
    theta = np.append(prior_w, prior.stay)
    m = v = np.zeros_like(theta)
    for k in range(1, steps + 1):                       # Adam
        _, gw, gs = _likelihood(theta[:-1], theta[-1], x, y, mask, prior_w, prior.stay, strength)
        g = np.append(gw, gs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Crf(tuple(float(t) for t in theta[:-1]), float(theta[-1]))
