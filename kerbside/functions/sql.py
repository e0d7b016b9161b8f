"""Functions for user SQL, registered on a session as SQL expressions, so that they stay in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name(parameters) -> type, body
_DEFINITIONS = {
    "st_makepoint(x DOUBLE, y DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE>": "named_struct('x', x, 'y', y)",
    "st_distance(a STRUCT<x: DOUBLE, y: DOUBLE>, b STRUCT<x: DOUBLE, y: DOUBLE>) RETURNS DOUBLE": "hypot(a.x - b.x, a.y - b.y)",
    "st_dwithin(a STRUCT<x: DOUBLE, y: DOUBLE>, b STRUCT<x: DOUBLE, y: DOUBLE>, d DOUBLE) RETURNS BOOLEAN": "hypot(a.x - b.x, a.y - b.y) <= d",
    "st_distance_deg(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": "2 * 6371008.8 * asin(least(1.0D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    "st_dwithin_deg(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE, d DOUBLE) RETURNS BOOLEAN": "2 * 6371008.8 * asin(least(1.0D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))) <= d",
    "angdiff(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "(a - b) - 360.0D * floor(((a - b) + 180.0D) / 360.0D)",
    "turn_label(a DOUBLE, b DOUBLE) RETURNS STRING": "CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' ELSE CASE WHEN (b - a) - 360.0D * floor(((b - a) + 180.0D) / 360.0D) < -135 THEN 'uturn' WHEN (b - a) - 360.0D * floor(((b - a) + 180.0D) / 360.0D) < -35 THEN 'right' WHEN (b - a) - 360.0D * floor(((b - a) + 180.0D) / 360.0D) < 35 THEN 'straight' WHEN (b - a) - 360.0D * floor(((b - a) + 180.0D) / 360.0D) < 135 THEN 'left' ELSE 'uturn' END END",
    "wilson_lo(k BIGINT, n BIGINT) RETURNS DOUBLE": "coalesce(greatest(0.0D, (k / nullif(n, 0) + 1.9208D / nullif(n, 0) - 1.96D * sqrt((k / nullif(n, 0)) * (1 - k / nullif(n, 0)) / nullif(n, 0) + 0.9604D / (nullif(n, 0) * nullif(n, 0)))) / (1 + 3.8416D / nullif(n, 0))), 0.0D)",
    "wilson_hi(k BIGINT, n BIGINT) RETURNS DOUBLE": "coalesce(least(1.0D, (k / nullif(n, 0) + 1.9208D / nullif(n, 0) + 1.96D * sqrt((k / nullif(n, 0)) * (1 - k / nullif(n, 0)) / nullif(n, 0) + 0.9604D / (nullif(n, 0) * nullif(n, 0)))) / (1 + 3.8416D / nullif(n, 0))), 1.0D)",
}
NAMES = tuple(d.partition("(")[0] for d in _DEFINITIONS)


def register(spark: SparkSession) -> tuple[str, ...]:
    """Makes the functions known to the session's SQL; returns their names."""
    for head, body in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return NAMES
