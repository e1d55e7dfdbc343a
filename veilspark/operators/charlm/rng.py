"""Repeatable random numbers: mulberry32 uniforms, Box-Muller normals, Fisher-Yates order."""

from __future__ import annotations

import math

_MASK = 0xFFFFFFFF


class Rng:
    """State of 32 bits; seed 0 counts as 1."""

    def __init__(self, seed: int):
        self.state = seed & _MASK or 1

    def next(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _MASK
        x = self.state
        x = (x ^ x >> 15) * (x | 1) & _MASK
        x ^= (x + (x ^ x >> 7) * (x | 61)) & _MASK
        return (x ^ x >> 14) / 2**32

    def normal(self) -> float:
        radius = math.sqrt(-2 * math.log(1 - self.next()))
        return radius * math.cos(2 * math.pi * self.next())

    def below(self, n: int) -> int:
        return int(self.next() * n)

    def order(self, n: int) -> list[int]:
        """0 .. n-1 shuffled from the end."""
        out = list(range(n))
        for i in reversed(range(1, n)):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out
