"""The engine's small decisions as SQL functions, so that they can be used in spark.sql; each is one SQL expression, so it is inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fixed values of the expressions are those of driftmill.operators.
FUNCTIONS = {
    "clip01": "(x DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, x))",
    "drift_state": "(d2 DOUBLE, early DOUBLE, significant DOUBLE, critical DOUBLE) RETURNS STRING RETURN CASE WHEN d2 <= early THEN 'NOMINAL' WHEN d2 <= significant THEN 'EARLY_DRIFT' WHEN d2 <= critical THEN 'SIGNIFICANT_DRIFT' ELSE 'HIGH_DEVIATION' END",
    "quality_score": "(d2 DOUBLE, critical DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(100D, 100 * (1 - d2 / critical)))",
    "health_index": "(quality DOUBLE, distance DOUBLE) RETURNS DOUBLE RETURN 0.6D * quality + 0.4D * greatest(0D, least(100D, 100 * exp(-distance / 3)))",
    "health_state": "(health DOUBLE) RETURNS STRING RETURN CASE WHEN health >= 85 THEN 'NOMINAL' WHEN health >= 70 THEN 'WATCH' WHEN health >= 50 THEN 'EARLY_DRIFT' ELSE 'HIGH_DEVIATION' END",
    "provenance_score": "(source STRING) RETURNS DOUBLE RETURN CASE source WHEN 'experimental' THEN 100D WHEN 'scan_a' THEN 100D WHEN 'public' THEN 80D WHEN 'simulated' THEN 60D ELSE 50D END",
    "hamming": "(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
    "wilson_low": "(hits DOUBLE, n DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN greatest(0D, (hits / n + z * z / (2 * n) - z * sqrt(hits / n * (1 - hits / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))",
    "wilson_high": "(hits DOUBLE, n DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN least(1D, (hits / n + z * z / (2 * n) + z * sqrt(hits / n * (1 - hits / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))",
}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS known to the session, by their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(FUNCTIONS)
