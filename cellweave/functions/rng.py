"""Replayable pseudo-random numbers: the same from Python, Spark SQL and DuckDB SQL.

A number is an arithmetic hash of a seed and up to three integer keys, so any
row can draw its own in parallel, and a plan that runs again draws the same.
"""

from __future__ import annotations

import math

from .dialect import Dialect

PRIME = 2147483647
_KEYS = (104729, 1299709, 15485863)
_ROUNDS = ((48271, 13), (69621, 11))


def bits(seed: int, *keys: int) -> int:
    """A number from 0 to 2**31 - 1."""
    x = (seed * 7919 + sum(k * m for k, m in zip(keys, _KEYS, strict=False)) + 12345) % PRIME
    for factor, shift in _ROUNDS:
        x = x * factor % PRIME
        x ^= x >> shift
    return x * 16807 % PRIME


def uniform(seed: int, *keys: int) -> float:
    """From 0, below 1."""
    return bits(seed, *keys) / 2147483648.0


def normal(seed: int, *keys: int) -> float:
    u, v = uniform(seed, *keys), uniform(seed + 1_000_003, *keys)
    return math.sqrt(-2 * math.log(1 - u)) * math.cos(2 * math.pi * v)


def bits_sql(d: Dialect, seed: int, *keys: str) -> str:
    x = f"(({seed * 7919 + 12345}" + "".join(f" + cast({k} as bigint) * {m}" for k, m in zip(keys, _KEYS, strict=False)) + f") % {PRIME})"
    for factor, shift in _ROUNDS:
        x = f"(({x} * {factor}) % {PRIME})"
        x = d.xor(x, f"({x} >> {shift})")
    return f"(({x} * 16807) % {PRIME})"


def uniform_sql(d: Dialect, seed: int, *keys: str) -> str:
    return f"({bits_sql(d, seed, *keys)} / 2147483648e0)"


def normal_sql(d: Dialect, seed: int, *keys: str) -> str:
    u, v = uniform_sql(d, seed, *keys), uniform_sql(d, seed + 1_000_003, *keys)
    return f"(sqrt(-2e0 * ln(1e0 - {u})) * cos({2 * math.pi!r} * {v}))"
