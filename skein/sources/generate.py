"""Seeded Kronecker graphs; edge i depends on the seed and i alone, so ranges are made independently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph

# The recurrence z = X z1 + Y z5 mod 2^31 - 1, the initiator in ten-thousandths, noise, scrambling constants.
P31, X, Y = 2**31 - 1, 107374182, 104480
A, BC, DENOMINATOR, NOISE = 5700, 1900, 10000, 1000
MIX0, MIX1 = 0x4519840211493211, 0x3050852102C843A5


def seed_state(s1: int, s2: int) -> list[int]:
    low = (1 << 30) - 1
    return [(s1 & low) + 1, (s1 >> 30 & low) + 1, (s2 & low) + 1, (s2 >> 30 & low) + 1, ((s2 >> 60) << 4) + (s1 >> 60) + 1]


def _product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[sum(x * y for x, y in zip(row, col, strict=True)) % P31 for col in zip(*b, strict=True)] for row in a]


def jump(exponent: int) -> list[list[int]]:
    """The transition matrix to a power, by squaring."""
    step = [[X, 0, 0, 0, Y]] + [[int(i == j) for j in range(5)] for i in range(4)]
    out = [[int(i == j) for j in range(5)] for i in range(5)]
    while exponent:
        if exponent & 1:
            out = _product(out, step)
        step, exponent = _product(step, step), exponent >> 1
    return out


def _apply(m: list[list[int]], z: np.ndarray) -> np.ndarray:
    out = np.zeros_like(z)
    for i in range(5):
        for j in range(5):
            if m[i][j]:
                out[i] = (out[i] + z[j] * np.uint64(m[i][j])) % np.uint64(P31)
    return out


def _draw(z: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Steps the states ``z`` (5, n) at ``where``, in place; their new values."""
    new = (z[0, where] * np.uint64(X) + z[4, where] * np.uint64(Y)) % np.uint64(P31)
    z[1:, where] = z[:-1, where]
    z[0, where] = new
    return new


def _reverse64(v: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def scramble(v: np.ndarray, log_n: int, k0: int, k1: int) -> np.ndarray:
    """A fixed permutation of 0..2^log_n - 1."""
    v = v.astype(np.uint64) + np.uint64((k0 + k1) % 2**64)
    for factor in (k0 | MIX0, k1 | MIX1):
        v = _reverse64(v * np.uint64(factor % 2**64)) >> np.uint64(64 - log_n)
    return v.astype(np.int64)


def kronecker_range(log_n: int, start: int, end: int, seeds: tuple[int, int] = (1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges ``start`` to ``end``: per edge, ``log_n`` draws choose quadrants, with noise by level, never below the diagonal."""
    n = end - start
    base = seed_state(*seeds)
    one = np.array(base, np.uint64)[:, None]
    key = _apply(jump((50 << 128) + (7 << 64)), one.copy())
    draws = [int(_draw(key, np.array([True]))[0]) for _ in range(4)]
    k0, k1 = ((draws[i] * 0xFFFFFFFF + draws[i + 1]) % 2**64 for i in (0, 2))
    z, index = np.repeat(one, n, axis=1), np.arange(start, end, dtype=np.uint64)
    for b in range(max(1, int(end).bit_length())):
        on = (index >> np.uint64(b) & np.uint64(1)).astype(bool)
        if on.any():
            z[:, on] = _apply(jump(1 << 64 + b), z[:, on])
    src, dst = np.zeros(n, np.int64), np.zeros(n, np.int64)
    biased = 0xFFFFFFFF % DENOMINATOR
    for level in range(log_n):
        todo, value = np.ones(n, bool), np.zeros(n, np.int64)
        while todo.any():
            got = _draw(z, todo).astype(np.int64)
            value[todo] = got
            todo[todo] = got < biased
        value %= DENOMINATOR
        bc = BC + int((2 * NOISE * level) / log_n) - NOISE
        a = A * (DENOMINATOR - 2 * BC) // (DENOMINATOR - 2 * bc)
        quad = np.select([value < bc, value < 2 * bc, value < 2 * bc + a], [1, 2, 0], 3)
        s, d = quad // 2, quad % 2
        flip = (src == dst) & (s > d)
        s, d = np.where(flip, 0, s), np.where(flip, 1, d)
        half = 1 << log_n - 1 - level
        src, dst = src + half * s, dst + half * d
    return scramble(src, log_n, k0, k1), scramble(dst, log_n, k0, k1)


def kronecker_edges(spark: SparkSession, log_n: int = 16, edge_factor: int = 16, seeds: tuple[int, int] = (1, 2), partitions: int | None = None) -> DataFrame:
    """``(edge, src, dst)``: all generated edges, loops and repeats included."""
    m = edge_factor << log_n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ids = f["id"].to_numpy()
                s, d = kronecker_range(log_n, int(ids[0]), int(ids[-1]) + 1, seeds)
                yield pd.DataFrame({"edge": ids, "src": s[ids - ids[0]], "dst": d[ids - ids[0]]})

    return spark.range(0, m, 1, partitions or max(1, min(m >> 16, 10_000))).mapInPandas(run, "edge long, src long, dst long")


def kronecker(spark: SparkSession, log_n: int = 16, edge_factor: int = 16, seeds: tuple[int, int] = (1, 2)) -> Graph:
    e = kronecker_edges(spark, log_n, edge_factor, seeds).where("src <> dst").select("src", "dst").distinct()
    return Graph(spark.range(1 << log_n), e)


def random_numbers(n: int, seeds: tuple[int, int] = (1, 2), position: int = 0) -> np.ndarray:
    """``n`` doubles in [0, 1) from ``position`` on, two draws each."""
    z = _apply(jump(2 * position), np.array(seed_state(*seeds), np.uint64)[:, None])
    at = np.array([True])
    out = []
    for _ in range(n):
        hi, lo = int(_draw(z, at)[0]), int(_draw(z, at)[0])
        out.append((hi + lo / P31) / P31)
    return np.array(out)


def with_random_weights(g: Graph, seed: int = 0xDEADBEEF) -> Graph:
    """Weights from 0 to, without, the number of vertices, by a seeded multiplicative hash of the edge."""
    n = g.vertices.count()
    turn = lambda x: x % 2147483648 * 2654435761 % 4294967296
    u = turn(turn(turn(F.lit(seed).cast("long")) + F.col("src")) + F.col("dst")) / float(1 << 32)
    return Graph(g.vertices, g.edges.select("src", "dst", (u * n).alias("weight")))
