"""Seeded generators of test data."""

from __future__ import annotations

from collections.abc import Iterator

#: Multiplier and modulus of the minimal standard generator (fixed values).
MULTIPLIER, MODULUS = 16807, (1 << 31) - 1


class Random:
    """The minimal standard generator: x -> 16807 x mod 2^31 - 1."""

    def __init__(self, seed: int):
        self.x = seed % MODULUS or 1

    def next(self) -> int:
        self.x = self.x * MULTIPLIER % MODULUS
        return self.x

    def uniform(self, n: int) -> int:
        """0 .. n - 1"""
        return self.next() % n

    def one_in(self, n: int) -> bool:
        return self.uniform(n) == 0

    def skewed(self, bits: int) -> int:
        """Below 2^b for a b uniform in 0 .. bits: small numbers are likelier."""
        return self.uniform(1 << self.uniform(bits + 1))


def random_string(rnd: Random, n: int) -> bytes:
    return bytes(32 + rnd.uniform(95) for _ in range(n))


def random_key(rnd: Random, n: int, alphabet: bytes = b"\x00\x01abcde\xfd\xfe\xff") -> bytes:
    """Keys of few and of extreme bytes, for tests of orders."""
    return bytes(alphabet[rnd.uniform(len(alphabet))] for _ in range(n))


def compressible(rnd: Random, ratio: float, n: int) -> bytes:
    """``n`` bytes that compress to about ``ratio`` of their size."""
    part = random_string(rnd, max(1, int(n * ratio)))
    return (part * (n // len(part) + 1))[:n]


def operations(rnd: Random, n: int) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Puts and deletes in equal parts, one key in three a single byte."""
    for _ in range(n):
        key = random_key(rnd, 1 if rnd.one_in(3) else rnd.uniform(9))
        yield (1, key, random_string(rnd, 100 + rnd.uniform(100) if rnd.one_in(20) else rnd.uniform(8))) if rnd.one_in(2) else (0, key, None)
