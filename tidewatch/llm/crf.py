"""Linear-chain conditional random field over two labels, trained on labelled sequences and decoded by Viterbi."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Model(NamedTuple):
    weights: dict[str, float]  # of a feature for label 1 against label 0
    edges: list[list[list[float]]]  # [kind of edge][label before][label]
    start: list[float]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[list[list[str]], list[int], list[int]]], rounds: int = 150, rate: float = 0.15, penalty: float = 0.02) -> Model:
    """Maximum likelihood with an L2 penalty by gradient steps over all sequences (features, kinds of edges, labels) at once.

    Forward and backward passes run over padded sequences together; the order of sums is fixed, so reruns give the same model.
    """
    names = sorted({f for feats, _, _ in sequences for fs in feats for f in fs})
    index = {f: k for k, f in enumerate(names)}
    n, t = len(sequences), max(len(feats) for feats, _, _ in sequences)
    at = np.array([i * t + j for i, (feats, _, _) in enumerate(sequences) for j, fs in enumerate(feats) for _ in fs])
    which = np.array([index[f] for feats, _, _ in sequences for fs in feats for f in fs])
    labels, kinds, real = np.zeros((n, t), int), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (feats, kind, label) in enumerate(sequences):
        labels[i, : len(feats)], kinds[i, : len(feats)], real[i, : len(feats)] = label, kind, True
    w, edges, start = np.zeros(len(names)), np.zeros((2, 2, 2)), np.zeros(2)
    parameters = [w, edges, start]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    blocks = real.sum()
    for step in range(1, rounds + 1):
        score = np.bincount(at, w[which], n * t).reshape(n, t)
        emit = np.stack([np.zeros_like(score), score], axis=2)
        move = edges[kinds]
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = start + emit[:, 0]
        for j in range(1, t):
            ahead = _log_sum(alpha[:, j - 1, :, None] + move[:, j], 1) + emit[:, j]
            alpha[:, j] = np.where(real[:, j, None], ahead, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            back = _log_sum(move[:, j + 1] + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(real[:, j + 1, None], back, 0)
        total = _log_sum(alpha[:, -1], 1)
        share = np.exp(alpha + beta - total[:, None, None])
        wrong = np.where(real, share[:, :, 1] - labels, 0)
        g_w = np.bincount(which, wrong.reshape(-1)[at], len(names))
        g_start = np.array([(share[:, 0, y] - (labels[:, 0] == y)).sum() for y in (0, 1)])
        g_edges = np.zeros_like(edges)
        pair = np.exp(alpha[:, :-1, :, None] + move[:, 1:] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        for kind in (0, 1):
            here = real[:, 1:] & (kinds[:, 1:] == kind)
            for a in (0, 1):
                for b in (0, 1):
                    g_edges[kind, a, b] = (np.where(here, pair[:, :, a, b] - ((labels[:, :-1] == a) & (labels[:, 1:] == b)), 0)).sum()
        for k, (p, g) in enumerate(zip(parameters, (g_w, g_edges, g_start))):
            g = g / blocks + penalty * p / 100
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, w)}, edges.tolist(), start.tolist())


def viterbi(scores: list[float], kinds: list[int], model: Model) -> list[int]:
    """The likeliest labels, given each item's score for label 1 against 0."""
    if not scores:
        return []
    zero, one = model.start[0], model.start[1] + scores[0]
    came: list[tuple[int, int]] = []
    for s, kind in zip(scores[1:], kinds[1:]):
        (a, b), (c, d) = model.edges[kind]
        to_zero, to_one = (0, zero + a) if zero + a >= one + c else (1, one + c), (0, zero + b) if zero + b > one + d else (1, one + d)
        came.append((to_zero[0], to_one[0]))
        zero, one = to_zero[1], to_one[1] + s
    labels = [int(one > zero)]
    for step in reversed(came):
        labels.append(step[labels[-1]])
    return labels[::-1]
