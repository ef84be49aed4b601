"""Prefix polynomial hashes of bytes, modulo a prime and vectorized."""

from __future__ import annotations

import random

import numpy as np

#: Two hashes, one for each of two bases, tell texts apart.
PRIME = (1 << 31) - 1


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 63 modulo PRIME."""
    p, s = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    x[x >= p] -= p
    return x


def random_bases() -> tuple[int, int]:
    """Drawn afresh for each run, so that no text can be made to collide; results don't depend on them."""
    draw = random.SystemRandom()
    return draw.randrange(1 << 20, PRIME - 1), draw.randrange(1 << 20, PRIME - 1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k modulo PRIME for k below n."""
    if base not in _powers or len(_powers[base][0]) < n:
        if base not in _powers and len(_powers) > 1:  # those of another run
            _powers.clear()
        made = []
        for b in (base, pow(base, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, reduced(out * np.uint64(pow(b, len(out), PRIME)))])
            made.append(out)
        _powers[base] = (made[0], made[1])
    return _powers[base]


class Prefixes:
    """Prefix polynomial hashes of an array of bytes; of(i, j) hashes bytes i to j - 1."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = powers(base, len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((terms & np.uint64(PRIME)) + (terms >> np.uint64(31)), out=self.sums[1:])

    def of(self, i, j) -> np.ndarray:
        x = self.sums[j] - self.sums[i]
        return reduced(((x & np.uint64(PRIME)) + (x >> np.uint64(31))) * self.down[i])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))
