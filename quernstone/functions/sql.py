"""Functions for SQL users, as SQL expressions that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, type and expression of each function.
FUNCTIONS = [
    ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    (
        "cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN size(a) = size(b) AND size(a) > 0 AND aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) > 0"
        " THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) ELSE 0D END",
    ),
    ("decay", "days INT", "DOUBLE", "pow(0.98D, least(greatest(days, 0), 180))"),
    ("rank_share", "place INT", "DOUBLE", "1D / (60 + place)"),
    ("content_id", "t STRING", "STRING", "sha2(CAST(t AS BINARY), 256)"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
