"""Distances and similarities as Column expressions, and the registry of default distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(a: ColumnLike, b: ColumnLike, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of term over the components of two vectors, in double precision."""
    pairs = F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), term)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l1(a: ColumnLike, b: ColumnLike) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def l2_squared(a: ColumnLike, b: ColumnLike) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(l2_squared(a, b))


def chebyshev(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_max(F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), lambda x, y: F.abs(x - y)))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def normalise(a: ColumnLike) -> Column:
    """The vector at unit length; a zero vector stays."""
    v = _col(a).cast("array<double>")
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def hamming(a: ColumnLike, b: ColumnLike) -> Column:
    """Differing bits of two arrays of integer words."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_words(a: ColumnLike, b: ColumnLike) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def weighted_hamming(a: ColumnLike, b: ColumnLike, weights: ColumnLike) -> Column:
    """Sum of the weights at which two arrays of bits differ."""
    differ = F.zip_with(_col(a), _col(b), lambda x, y: (x != y).cast("double"))
    return F.aggregate(F.zip_with(differ, _col(weights).cast("array<double>"), lambda d, w: d * w), F.lit(0.0), lambda s, x: s + x)


def count_map(tokens: ColumnLike) -> Column:
    """Token -> how often it occurs in an array."""
    t = _col(tokens)
    return F.map_from_entries(F.transform(F.array_distinct(t), lambda x: F.struct(x, F.size(F.filter(t, lambda y: y == x)))))


def multiset_tanimoto(a: ColumnLike, b: ColumnLike) -> Column:
    """Sum of the smaller counts over the sum of the larger ones; null if both are empty."""
    both = F.map_zip_with(count_map(a), count_map(b), lambda k, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    shared = F.aggregate(F.map_values(both), F.lit(0), lambda s, x: s + x)
    return tanimoto_of_counts(shared, F.size(_col(a)), F.size(_col(b)))


def tanimoto_of_counts(shared: Column, n_a: Column, n_b: Column) -> Column:
    """Similarity from how many elements two multisets share and how many each has."""
    union = n_a + n_b - shared
    return F.when(union > 0, shared / union)


def set_jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union > 0, F.size(F.array_intersect(_col(a), _col(b))) / union)


def fingerprint_tanimoto(a: ColumnLike, b: ColumnLike) -> Column:
    """Bits set in both over bits set in either, of two arrays of integer words."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    both = total(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseAND(y))))
    either = total(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseOR(y))))
    return F.when(either > 0, both / either)


def common_substructure_distance(common: ColumnLike, size_a: ColumnLike, size_b: ColumnLike) -> Column:
    """1 - Tanimoto of the size of a maximum common substructure, which a plug-in has computed."""
    return 1 - tanimoto_of_counts(_col(common), _col(size_a), _col(size_b))


def smoothed_recall(matched: ColumnLike, size: ColumnLike) -> Column:
    return (_col(matched) + 1) / (_col(size) + 1)


VECTOR_DISTANCES: dict[str, Callable[[ColumnLike, ColumnLike], Column]] = {
    "l1": l1,
    "l2": l2,
    "l2_squared": l2_squared,
    "chebyshev": chebyshev,
    "cosine": cosine_distance,
    "negative_dot": lambda a, b: -dot(a, b),
}

_DEFAULTS: dict[str, Callable[[ColumnLike, ColumnLike], Column]] = {
    "ap": lambda a, b: 1 - multiset_tanimoto(a, b),
    "fp": lambda a, b: 1 - fingerprint_tanimoto(a, b),
    "vector": l2,
}


def set_default_distance(descriptor_type: str, distance: Callable[[ColumnLike, ColumnLike], Column]) -> None:
    """distance(a, b): a Column of doubles from two descriptor columns; it may be a pandas UDF."""
    _DEFAULTS[descriptor_type.lower()] = distance


def default_distance(descriptor_type: str) -> Callable[[ColumnLike, ColumnLike], Column]:
    try:
        return _DEFAULTS[descriptor_type.lower()]
    except KeyError:
        raise ValueError(f"no distance is registered for {descriptor_type!r}") from None
