"""Word features the two classifiers share."""

from __future__ import annotations

import zlib

import numpy as np


def hashed(text: str, bits: int) -> int:
    return zlib.crc32(text.encode()) & ((1 << bits) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
