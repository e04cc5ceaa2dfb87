"""Coaddition kernels: the weights T of inputs in outputs, for one linear system or a batch of equal shape.

A system has overlaps A of inputs with each other (n x n), B of outputs with inputs (m x n) and the target's own
overlap C. A kernel returns T (m x n) and, for every output, kappa (in units of A), the noise Sigma = sum of T squared,
and the leakage U/C. All arrays may have leading axes, over which a kernel works at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Solution:
    t: np.ndarray
    kappa: np.ndarray
    sigma: np.ndarray
    leakage: np.ndarray


def _diagonal(a: np.ndarray, by) -> np.ndarray:
    return a + np.asarray(by)[..., None, None] * np.eye(a.shape[-1])


def _overlap(b: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (b * t).sum(axis=-1)


def exact_leakage(a: np.ndarray, b: np.ndarray, c: float, t: np.ndarray) -> np.ndarray:
    """U/C by the full quadratic form, for weights that don't solve the system."""
    return 1 + (_overlap(t @ a, t) - 2 * _overlap(b, t)) / c


def factored(a: np.ndarray) -> np.ndarray:
    """Cholesky factor; a matrix that isn't positive definite is lifted by its lowest eigenvalue and a margin first.

    The margin is relative to the mean of the diagonal, so that rounding can't leave the lifted matrix singular.
    """
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        if a.ndim > 2:
            return np.stack([factored(x) for x in a])
        margin = 1e-12 * len(a) * max(np.trace(a) / len(a), np.abs(a).max(), 1e-300)
        lowest = np.linalg.eigvalsh(a)[0]
        while True:
            try:
                return np.linalg.cholesky(_diagonal(a, max(-lowest, 0.0) + margin))
            except np.linalg.LinAlgError:
                margin *= 10


def _inverse(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangle, by halves where it is large: a general inverse would work on its zeros as well."""
    n = low.shape[-1]
    if n <= 32:
        return np.linalg.inv(low)
    first, rest = slice(0, n // 2), slice(n // 2, n)
    out = np.zeros_like(low)
    out[..., first, first], out[..., rest, rest] = _inverse(low[..., first, first]), _inverse(low[..., rest, rest])
    out[..., rest, first] = -out[..., rest, rest] @ low[..., rest, first] @ out[..., first, first]
    return out


def _solved(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of b through (L L^T)^-1; L is inverted once, for all outputs."""
    inverse = _inverse(low)
    return b @ np.swapaxes(inverse, -1, -2) @ inverse


def cholesky(a: np.ndarray, b: np.ndarray, c: float, kappa: float) -> Solution:
    absolute = kappa * c
    t = _solved(factored(_diagonal(a, absolute)), b)
    sigma = _overlap(t, t)
    return Solution(t, np.full(sigma.shape, absolute), sigma, 1 - (absolute * sigma + _overlap(b, t)) / c)


def eigen(a: np.ndarray, b: np.ndarray, c: float, kappa: float) -> Solution:
    values, vectors = np.linalg.eigh(a)
    p, absolute = b @ vectors, kappa * c
    weight = p / (values[..., None, :] + absolute)
    sigma = _overlap(weight, weight)
    leakage = 1 - _overlap(values[..., None, :] + 2 * absolute, weight * weight) / c
    return Solution(weight @ np.swapaxes(vectors, -1, -2), np.full(sigma.shape, absolute), sigma, leakage)


def eigen_bisected(a: np.ndarray, b: np.ndarray, c: float, low: float, high: float, target: float, most: float, rounds: int = 13) -> Solution:
    """Kappa of every output by geometric bisection: down while U/C is over the target and Sigma under its limit."""
    values, vectors = np.linalg.eigh(a)
    p = b @ vectors
    kappa, factor = np.full(p.shape[:-1], c * np.sqrt(low * high)), np.sqrt(high / low)
    for _ in range(rounds):
        weight = p / (values[..., None, :] + kappa[..., None])
        sigma = _overlap(weight, weight)
        leakage = 1 - _overlap(values[..., None, :] + 2 * kappa[..., None], weight * weight) / c
        factor = np.sqrt(factor)
        kappa = kappa * np.where((leakage > target) & (sigma < most), 1 / factor, factor)
    weight = p / (values[..., None, :] + kappa[..., None])
    sigma = _overlap(weight, weight)
    leakage = 1 - _overlap(values[..., None, :] + 2 * kappa[..., None], weight * weight) / c
    return Solution(weight @ np.swapaxes(vectors, -1, -2), kappa, sigma, leakage)


def _node_weights(system: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Weights of the nodes; rank may be short where their solutions nearly agree: the least-norm weights then.

    Two nodes by their determinant: it keeps the digits that eigenvalues far apart lose.
    """
    if system.shape[-1] != 2:
        return (np.linalg.pinv(system, rcond=1e-13, hermitian=True) @ d[..., None])[..., 0]
    p, q, r = system[..., 0, 0], system[..., 0, 1], system[..., 1, 1]
    det = p * r - q * q
    whole = np.abs(det) > 1e-13 * (p + r) ** 2
    w = np.stack([r * d[..., 0] - q * d[..., 1], p * d[..., 1] - q * d[..., 0]], axis=-1) / np.where(whole, det, 1)[..., None]
    if not whole.all():
        w[~whole] = (np.linalg.pinv(system[~whole], rcond=1e-13, hermitian=True) @ d[~whole][..., None])[..., 0]
    return w


def _between_nodes(nodes_t: np.ndarray, a: np.ndarray, b: np.ndarray, c: float, kappas: np.ndarray, target: float, most: float, exact: bool) -> Solution:
    """Weights within the span of the nodes' solutions, kappa of every output bracketed by the nodes and bisected.

    nodes_t: nodes first, then T. Reported kappa is the one that the last of 12 steps leads to, as Sigma and U/C are
    those that it started from.
    """
    d = np.stack([_overlap(b, t) for t in nodes_t], axis=-1)
    noise = np.stack([np.stack([_overlap(s, t) for t in nodes_t], axis=-1) for s in nodes_t], axis=-2)
    if exact:
        signal = np.stack([np.stack([_overlap(s @ a, t) for t in nodes_t], axis=-1) for s in nodes_t], axis=-2)
    else:
        lower = d[..., None, :] - (kappas * c)[:, None] * noise
        signal = np.tril(lower) + np.swapaxes(np.tril(lower, -1), -1, -2)
    d, signal = d / c, signal / c
    at = np.full(d.shape[:-1], len(kappas) - 1)
    going = np.ones(at.shape, bool)
    for node in range(len(kappas) - 2, -1, -1):
        at = np.where(going, node, at)
        leakage = 1 - 2 * d[..., node] + signal[..., node, node]
        going &= (leakage > target) & (noise[..., node, node] < most)
    kappa, factor = np.sqrt(kappas[at] * kappas[at + 1]), (kappas[at + 1] / kappas[at]) ** 0.25
    for _ in range(12):
        w = _node_weights(signal + kappa[..., None, None] * noise, d)
        sigma = _overlap((noise @ w[..., None])[..., 0], w)
        leakage = 1 - kappa * sigma - _overlap(d, w)
        kappa = kappa * np.where((leakage > target) & (sigma < most), 1 / factor, factor)
        factor = np.sqrt(factor)
    return Solution(np.einsum("p...ai,...ap->...ai", nodes_t, w), kappa * c, sigma, leakage)


def cholesky_nodes(a: np.ndarray, b: np.ndarray, c: float, kappas: list[float], target: float, most: float) -> Solution:
    ks = np.asarray(sorted(kappas), float)
    solved = np.stack([_solved(factored(_diagonal(a, k * c)), b) for k in ks])
    return _between_nodes(solved, a, b, c, ks, target, most, False)


def conjugate_gradient(a: np.ndarray, b: np.ndarray, near: np.ndarray, rtol: float = 1.5e-3, rounds: int = 30) -> np.ndarray:
    """Rows of b through a^-1, every output on its own inputs (`near`) alone; an output stops when its residual is small."""
    x, r = np.zeros_like(b), np.where(near, b, 0.0)
    p, rho = r.copy(), _overlap(r, r)
    stop = rtol**2 * rho
    for _ in range(rounds):
        go = rho > stop
        if not go.any():
            break
        ap = np.where(near, p @ a, 0.0)
        along = _overlap(p, ap)
        step = np.where(go & (along > 0), rho / np.where(along > 0, along, 1), 0.0)
        x, r = x + step[..., None] * p, r - step[..., None] * ap
        new = _overlap(r, r)
        p = np.where(go[..., None], r + (new / np.where(rho > 0, rho, 1))[..., None] * p, p)
        rho = np.where(go, new, rho)
    return x


def iterated(a: np.ndarray, b: np.ndarray, c: float, kappa: float, near: np.ndarray, rtol: float = 1.5e-3, rounds: int = 30, exact: bool = False) -> Solution:
    absolute = kappa * c
    t = conjugate_gradient(_diagonal(a, absolute), b, near, rtol, rounds)
    sigma = _overlap(t, t)
    leakage = exact_leakage(a, b, c, t) if exact else 1 - (absolute * sigma + _overlap(b, t)) / c
    return Solution(t, np.full(sigma.shape, absolute), np.maximum(sigma, 1e-32), np.maximum(leakage, 1e-32))


def iterated_nodes(a: np.ndarray, b: np.ndarray, c: float, kappas: list[float], target: float, most: float, near: np.ndarray, rtol: float = 1.5e-3, rounds: int = 30) -> Solution:
    ks = np.asarray(sorted(kappas), float)
    solved = np.stack([conjugate_gradient(_diagonal(a, k * c), b, near, rtol, rounds) for k in ks])
    out = _between_nodes(solved, a, b, c, ks, target, most, True)
    return Solution(out.t, out.kappa, np.maximum(out.sigma, 1e-32), np.maximum(out.leakage, 1e-32))


def empirical(a: np.ndarray, b: np.ndarray, c: float, distance: np.ndarray, radius: float) -> Solution:
    """Weights fall linearly with the distance of an input; an output without inputs within the radius has none."""
    weight = np.maximum(radius - distance, 0)
    total = weight.sum(axis=-1, keepdims=True)
    t = np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)
    return Solution(t, np.zeros(t.shape[:-1]), _overlap(t, t), exact_leakage(a, b, c, t))


def solve(kernel: str, a: np.ndarray, b: np.ndarray, c: float, distance: np.ndarray, radius: float, kappas: list[float], target: float = 1e-6, most: float = 0.5) -> Solution:
    """The kernel named Eigen, Cholesky, Iterative or Empirical with one kappa or several; without inputs nothing is solved."""
    if not a.shape[-1]:
        outputs = b.shape[:-1]
        return Solution(np.zeros((*outputs, 0)), np.ones(outputs), np.zeros(outputs), np.ones(outputs))
    one, near = len(kappas) == 1, distance < radius
    if kernel == "Empirical":
        return empirical(a, b, c, distance, radius)
    if kernel == "Iterative":
        return iterated(a, b, c, kappas[0], near) if one else iterated_nodes(a, b, c, kappas, target, most, near)
    if kernel == "Cholesky":
        return cholesky(a, b, c, kappas[0]) if one else cholesky_nodes(a, b, c, kappas, target, most)
    if kernel == "Eigen":
        return eigen(a, b, c, kappas[0]) if one else eigen_bisected(a, b, c, min(kappas), max(kappas), target, most)
    raise ValueError(f"no kernel {kernel}")
