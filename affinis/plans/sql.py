"""The measures as SQL functions, so that plain SQL can call them. They are SQL expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
_COUNTS = "map_from_entries(transform(array_distinct({0}), t -> struct(t, size(filter({0}, u -> u = t)))))"
_SHARED = f"aggregate(map_values(map_zip_with({_COUNTS.format('a')}, {_COUNTS.format('b')}, (k, x, y) -> least(coalesce(x, 0), coalesce(y, 0)))), 0, (s, x) -> s + x)"
_VECTORS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"

FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "l1_distance": (_VECTORS, "DOUBLE", _SUM.format("abs(x - y)")),
    "l2_distance": (_VECTORS, "DOUBLE", f"sqrt({_SUM.format('(x - y) * (x - y)')})"),
    "chebyshev_distance": (_VECTORS, "DOUBLE", "array_max(zip_with(a, b, (x, y) -> abs(x - y)))"),
    "dot_product": (_VECTORS, "DOUBLE", _SUM.format("x * y")),
    "cosine_distance": (_VECTORS, "DOUBLE", f"1 - {_SUM.format('x * y')} / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
    "multiset_tanimoto": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", f"try_divide({_SHARED}, size(a) + size(b) - {_SHARED})"),
    "set_jaccard": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "try_divide(size(array_intersect(a, b)), size(array_union(a, b)))"),
    "hamming_distance": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "INT", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"),
    "atom_pair_code": ("a BIGINT, b BIGINT, d INT", "BIGINT", "(shiftleft(least(a, b), 20) & 4294967295) | shiftleft(cast(d & 63 AS BIGINT), 13) | greatest(a, b)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Define them in the session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
