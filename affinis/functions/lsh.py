"""Families of locality-sensitive hashes and what combines them, as Column expressions with parameters made on the driver.

A family gives hash(vec) -> Column of longs, range (0: not bounded) and, where it has one, delta(vec): how far the value
is from its lower edge, in units of the hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 0xFFFFFFFF


class HashFamily(Protocol):
    range: int

    def hash(self, vec: Column) -> Column: ...


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _dot(vec: Column, a: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(vec.cast("array<double>"), literal(a), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Trivial:
    range: int = 1

    def hash(self, vec: Column) -> Column:
        return F.lit(0).cast("long")


@dataclass(frozen=True)
class PStable:
    """floor((a.x + b) / w): Gaussian a for Euclidean distance, Cauchy a for L1."""

    a: tuple[float, ...]
    b: float
    w: float
    range: int = 0

    @classmethod
    def random(cls, dim: int, w: float, rnd: np.random.Generator, law: str = "gaussian") -> PStable:
        a = rnd.standard_normal(dim) if law == "gaussian" else rnd.standard_cauchy(dim)
        return cls(tuple(a.tolist()), float(rnd.uniform(0, w)), w)

    def value(self, vec: Column) -> Column:
        return (_dot(vec, self.a) + self.b) / self.w

    def hash(self, vec: Column) -> Column:
        return F.floor(self.value(vec))

    def delta(self, vec: Column) -> Column:
        return self.value(vec) - F.floor(self.value(vec))


@dataclass(frozen=True)
class Hyperplane:
    a: tuple[float, ...]
    range: int = 2

    @classmethod
    def random(cls, dim: int, rnd: np.random.Generator) -> Hyperplane:
        a = rnd.standard_normal(dim)
        return cls(tuple((a / np.sqrt((a * a).sum())).tolist()))

    def hash(self, vec: Column) -> Column:
        return (_dot(vec, self.a) >= 0).cast("long")

    def delta(self, vec: Column) -> Column:
        return F.abs(_dot(vec, self.a))


@dataclass(frozen=True)
class Threshold:
    """Whether a component (from 0) reaches a threshold: L1 within a box."""

    dim: int
    at: float
    range: int = 2

    @classmethod
    def random(cls, dim: int, low: float, high: float, rnd: np.random.Generator) -> Threshold:
        return cls(int(rnd.integers(dim)), float(rnd.uniform(low, high)))

    def hash(self, vec: Column) -> Column:
        return (F.element_at(vec, self.dim + 1).cast("double") >= self.at).cast("long")

    def delta(self, vec: Column) -> Column:
        return F.abs(F.element_at(vec, self.dim + 1).cast("double") - self.at)


@dataclass(frozen=True)
class Spectral:
    """Bits from the signs of products of sines over principal components; at most 32."""

    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    omegas: tuple[tuple[float, ...], ...]

    @property
    def range(self) -> int:
        return 1 << len(self.omegas)

    def hash(self, vec: Column) -> Column:
        centred = F.zip_with(vec.cast("array<double>"), literal(self.mean), lambda x, m: x - m)
        along = F.array(*[_dot(centred, c) for c in self.components])
        out = F.lit(0).cast("long")
        for i, omega in enumerate(self.omegas):
            waves = F.zip_with(along, literal(omega), lambda x, o: F.sin(x * o + np.pi / 2))
            product = F.aggregate(waves, F.lit(1.0), lambda s, x: s * x)
            out = out + F.when(product > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        return out


def fit_spectral(x: np.ndarray, bits: int) -> Spectral:
    """The lowest-frequency modes of the box of a sample's principal components."""
    if not 0 < bits <= 32:
        raise ValueError("1 to 32 bits")
    mean = x.mean(0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T))
    pc = vectors[:, ::-1][:, : min(bits, x.shape[1])].T
    along = (x - mean) @ pc.T
    low, high = along.min(0), along.max(0)
    modes = sorted(((k * np.pi / max(high[j] - low[j], 1e-12), j) for j in range(len(pc)) for k in range(1, bits + 1)))[:bits]
    omegas = tuple(tuple(w if i == j else 0.0 for i in range(len(pc))) for w, j in modes)
    shift = tuple((mean + low @ pc).tolist())
    return Spectral(shift, tuple(map(tuple, pc.tolist())), omegas)


@dataclass(frozen=True)
class Quantiser:
    """The index of the nearest of some centroids."""

    centroids: tuple[tuple[float, ...], ...]

    @property
    def range(self) -> int:
        return len(self.centroids)

    def hash(self, vec: Column) -> Column:
        x = vec.cast("array<double>")
        gap = lambda c: F.aggregate(F.zip_with(x, literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).cast("long").alias("i")) for i, c in enumerate(self.centroids)])).i


def fit_quantiser(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> Quantiser:
    """k-means of a sample."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return Quantiser(tuple(map(tuple, c.tolist())))


@dataclass(frozen=True)
class Tail:
    """Another hash modulo n."""

    of: HashFamily
    n: int

    @property
    def range(self) -> int:
        return self.n

    def hash(self, vec: Column) -> Column:
        return F.pmod(self.of.hash(vec), F.lit(self.n))


@dataclass(frozen=True)
class LowBit:
    of: HashFamily
    range: int = 2

    def hash(self, vec: Column) -> Column:
        return F.pmod(self.of.hash(vec), F.lit(2))

    def delta(self, vec: Column) -> Column:
        d = self.of.delta(vec)
        return F.least(d, 1 - d)


@dataclass(frozen=True)
class RepeatHash:
    """Sum of a(i) * h(i) modulo 2^32."""

    of: tuple[HashFamily, ...]
    a: tuple[int, ...]
    range: int = 0

    @classmethod
    def random(cls, of: Sequence[HashFamily], rnd: np.random.Generator) -> RepeatHash:
        return cls(tuple(of), tuple(int(x) for x in rnd.integers(1, 1 << 31, len(of))))

    def hash(self, vec: Column) -> Column:
        out = F.lit(0).cast("long")
        for f, a in zip(self.of, self.a, strict=True):
            out = (out + (f.hash(vec).bitwiseAND(UINT32) * F.lit(a)).bitwiseAND(UINT32)).bitwiseAND(UINT32)
        return out


@dataclass(frozen=True)
class Repeat:
    """The values of bounded hashes as digits of one number."""

    of: tuple[HashFamily, ...]

    def __post_init__(self) -> None:
        if not all(f.range for f in self.of) or self.range > 1 << 32:
            raise ValueError("bounded hashes, 2^32 values at most")

    @property
    def range(self) -> int:
        return int(np.prod([f.range for f in self.of], dtype=object))

    def hash(self, vec: Column) -> Column:
        out = F.lit(0).cast("long")
        for f in self.of:
            out = out * F.lit(f.range) + f.hash(vec)
        return out


@dataclass(frozen=True)
class Xor:
    of: tuple[HashFamily, ...]
    range: int = 2

    def hash(self, vec: Column) -> Column:
        out = F.lit(0).cast("long")
        for f in self.of:
            out = out.bitwiseXOR(f.hash(vec))
        return out

    def delta(self, vec: Column) -> Column:
        return F.least(*[f.delta(vec) for f in self.of])
