"""Counter-based random numbers and samplers for the simulator: the same key gives the same draw anywhere."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Uniforms in (0, 1) of 64-bit keys."""
    return _uniform(mix(keys), draw)


def _uniform(mixed: np.ndarray, draw: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = mix(mixed + np.uint64(draw) * np.uint64(0x9E3779B97F4A7C15))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def keys(*parts) -> np.ndarray:
    """One 64-bit key of several integer parts (broadcast)."""
    out = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix((out ^ np.asarray(p).astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return out


def _normal(mixed: np.ndarray, draw: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniform(mixed, draw))) * np.cos(2 * np.pi * _uniform(mixed, draw + 1))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z) / math.sqrt(2)))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of normal_cdf by bisection, to 1e-12."""
    lo, hi = np.full(np.shape(p), -40.0), np.full(np.shape(p), 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = normal_cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def truncated_normal(u: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Standard normal at most ``most``, by inversion; far in the tail by its exponential limit."""
    out = most + np.log(u) / np.maximum(-most, 1.0)
    near = most > -8
    out[near] = normal_quantile(u[near] * normal_cdf(most[near]))
    return np.minimum(out, most)


def levy(z: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Levy with location 0: scale over the square of a standard normal."""
    return scale / np.maximum(z * z, 1e-300)


def inverse_gaussian(x: np.ndarray, u: np.ndarray, mean: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Michael, Schucany and Haas: from a standard normal x and a uniform u."""
    y = mean * x * x
    root = mean + mean / (2 * shape) * (y - np.sqrt(4 * shape * y + y * y))
    root = np.maximum(root, 1e-300)
    return np.where(u > mean / (mean + root), mean * mean / root, root)


def first_passage(distance, toward, sigma, keys_, draw, sampler: str = "reference") -> np.ndarray:
    """Time to a barrier at distance with drift toward it (negative: away), noise sigma.

    Without drift a Levy time. With drift away, sampler "reference" uses the transform with a truncated normal; "exact" the law
    of the passage given that it happens, an inverse Gaussian of the opposite drift.
    """
    shape = (distance / sigma) ** 2
    mixed = mix(keys_)
    x, u = _normal(mixed, draw), _uniform(mixed, draw + 2)
    out = levy(x, shape)
    moving = toward != 0
    mean = np.where(moving, distance / np.where(moving, np.abs(toward), 1.0), 1.0)
    ahead = moving & (toward > 0) if sampler == "reference" else moving
    out[ahead] = inverse_gaussian(x[ahead], u[ahead], mean[ahead], shape[ahead])
    away = moving & ~ahead
    if away.any():
        most = -2 * np.sqrt(distance[away] * np.abs(toward[away])) / sigma[away]
        cut = truncated_normal(_uniform(mixed[away], draw + 3), most)
        m, s = -mean[away], shape[away]
        y = m * cut * cut
        root = m + m / (2 * s) * (y - np.sqrt(np.maximum(4 * s * y + y * y, 0.0)))
        pick = np.where(u[away] > m / (m + root), m * m / root, root)
        out[away] = np.abs(pick)
    return out
