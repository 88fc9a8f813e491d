"""Kernel weights of serial covariances."""

from __future__ import annotations

import math

import numpy as np


def default_bandwidth(periods: int, horizon: int) -> int:
    return max(horizon, math.floor(4 * (periods / 100) ** (2 / 9)))


def quadratic_spectral(z: np.ndarray) -> np.ndarray:
    """``3 (sin z / z - cos z) / z**2``, by its series near zero."""
    z = np.abs(np.asarray(z, dtype=float))
    q = z * z
    near = 1 - q / 10 * (1 - q / 28 * (1 - q / 54 * (1 - q / 88)))
    safe = np.where(z < 0.1, 1.0, z)
    return np.where(z < 0.1, near, 3 * (np.sin(safe) / safe - np.cos(safe)) / (safe * safe))


def weights(kernel: str, bandwidth: int, lags: np.ndarray) -> np.ndarray:
    """Weights of the given positive lags; zero where the kernel leaves a lag out."""
    lags = np.asarray(lags, dtype=float)
    if kernel == "quadratic_spectral":
        return quadratic_spectral(6 * math.pi * lags / (5 * bandwidth)) if bandwidth else np.zeros(len(lags))
    u = lags / (bandwidth + 1)
    if kernel == "bartlett":
        w = 1 - u
    else:
        w = np.where(u <= 0.5, 1 - 6 * u**2 * (1 - u), 2 * (1 - np.minimum(u, 1)) ** 3)
    return np.where(lags <= bandwidth, w, 0.0)


def last_lag(kernel: str, bandwidth: int, span: int) -> int:
    """Largest lag with a weight, within a span of periods."""
    if kernel == "quadratic_spectral":
        return span if bandwidth else 0
    return min(bandwidth, span)
