"""Kernels of spectral surrogates."""

from __future__ import annotations

import numpy as np


def turned_modes(values: np.ndarray, truncate: float, calibration: float) -> np.ndarray:
    """Which modes take a random sign: those whose scale, calibration / sqrt(|eigenvalue|), exceeds truncate; all at 0.

    Small eigenvalues belong to smooth, long-range modes; large ones to local modes, which stay.
    """
    if truncate <= 0:
        return np.ones(len(values), bool)
    return calibration / np.sqrt(np.maximum(np.abs(values), 1e-8)) > truncate
