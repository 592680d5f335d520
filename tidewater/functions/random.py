"""A small generator whose draws are the same everywhere."""

from __future__ import annotations

import math

_MASK = 0xFFFFFFFF


class Mulberry32:
    """The mulberry32 generator; the order of draws matters. Fixed constants of the published algorithm."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def uniform(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _MASK
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & _MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61))) & _MASK
        return (t ^ t >> 14) / 2**32

    def gaussian(self) -> float:
        u = max(self.uniform(), 1e-12)
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.uniform())

    def shuffled(self, values: list) -> list:
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            j = int(self.uniform() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out
