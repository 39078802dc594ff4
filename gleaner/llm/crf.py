"""A linear-chain conditional random field with two states, in numpy.

State 1 is *content*, state 0 *boilerplate*. A position carries a row of active binary
features (padded with ``n_features``, whose weight is zero). Training is penalised maximum
likelihood by full-batch Adam over padded sequences; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray  # [n_features + 1, 2], last row zero
    trans: np.ndarray  # [2, 2], from, to
    start: np.ndarray  # [2]

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[feats].sum(axis=1)

    def decode(self, feats: np.ndarray) -> np.ndarray:
        """States of one sequence; of equally good paths the one with more content."""
        em = self.emissions(feats).tolist()
        if not em:
            return np.zeros(0, np.int8)
        (t00, t01), (t10, t11) = self.trans.tolist()
        s0, s1 = em[0][0] + self.start[0], em[0][1] + self.start[1]
        back = []
        for e0, e1 in em[1:]:
            a, b = s0 + t00, s1 + t10
            c, d = s0 + t01, s1 + t11
            back.append((b >= a, d >= c))
            s0, s1 = (b if b >= a else a) + e0, (d if d >= c else c) + e1
        state = int(s1 >= s0)
        out = [state]
        for to0, to1 in reversed(back):
            state = int(to1 if state else to0)
            out.append(state)
        return np.array(out[::-1], np.int8)


def all_content(n_features: int) -> Crf:
    """The model used where nothing is labelled: every position is content."""
    w = np.zeros((n_features + 1, 2))
    return Crf(w, np.zeros((2, 2)), np.array([0.0, 1.0]))


def fit(seqs: list[np.ndarray], labels: list[np.ndarray], n_features: int, l2: float = 0.02, rounds: int = 90, rate: float = 0.15) -> Crf:
    """Fit on sequences of feature rows ``[L, A]`` and states ``[L]``."""
    pairs = [(s, y) for s, y in zip(seqs, labels) if len(s)]
    if not pairs or len({int(v) for _, y in pairs for v in y}) < 2:
        return all_content(n_features)
    n, longest, width = len(pairs), max(len(s) for s, _ in pairs), pairs[0][0].shape[1]
    x = np.full((n, longest, width), n_features, np.int32)
    y = np.zeros((n, longest), np.int8)
    live = np.zeros((n, longest), bool)
    for i, (s, lab) in enumerate(pairs):
        x[i, : len(s)], y[i, : len(s)], live[i, : len(s)] = s, lab, True
    flat = x[live]
    flat_ids = flat.ravel()
    gold = np.zeros((n_features + 1, 2))
    for k in (0, 1):
        gold[:, k] = np.bincount(flat[y[live] == k].ravel(), minlength=n_features + 1)
    both = live[:, 1:] & live[:, :-1]
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (y[:, :-1][both], y[:, 1:][both]), 1)
    gold_s = np.bincount(y[:, 0], minlength=2).astype(float)
    total = float(live.sum())
    theta = [np.zeros((n_features + 1, 2)), np.zeros((2, 2)), np.zeros(2)]
    m = [np.zeros_like(t) for t in theta]
    v = [np.zeros_like(t) for t in theta]
    em = np.zeros((n, longest, 2))
    for step in range(1, rounds + 1):
        w, tr, st = theta
        em[live] = w[flat].sum(axis=1)
        alpha = np.zeros((n, longest, 2))
        beta = np.zeros((n, longest, 2))
        alpha[:, 0] = em[:, 0] + st
        for t in range(1, longest):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + tr[0], alpha[:, t - 1, 1, None] + tr[1]) + em[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            right = beta[:, t + 1] + em[:, t + 1]
            nxt = np.logaddexp(right[:, 0, None] + tr[:, 0], right[:, 1, None] + tr[:, 1])
            beta[:, t] = np.where(live[:, t + 1, None], nxt, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        post = np.exp(alpha + beta - z[:, None, None])[live]
        exp_w = np.zeros_like(w)
        for k in (0, 1):
            exp_w[:, k] = np.bincount(flat_ids, weights=np.repeat(post[:, k], width), minlength=n_features + 1)
        pair = np.exp(alpha[:, :-1, :, None] + tr + (em + beta)[:, 1:, None, :] - z[:, None, None, None])[both].sum(axis=0)
        first = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None]).sum(axis=0)
        grads = [(gold - exp_w) / total - l2 * w / 100, (gold_t - pair) / total - l2 * tr / 100, (gold_s - first) / total - l2 * st / 100]
        grads[0][-1] = 0
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    theta[0][-1] = 0
    return Crf(*theta)
