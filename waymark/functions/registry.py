"""Rules by name for SQL (Q1): SQL functions of the session, which Catalyst writes into the query like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.functions.geo import EARTH_M
from waymark.functions.text import _fold_table

_FOLDED = "translate(lower(trim(coalesce({}, ''))), '{}', '{}')"


def _key(value: str) -> str:
    return f"regexp_replace({_FOLDED.format(value, *_fold_table())}, '[^a-z0-9]+', '')"


#: Name: parameters, type and body.
FUNCTIONS = {
    "canon_text": ("t STRING", "STRING", _key(r"regexp_replace(trim(t), '(?U)\\b\\d{4}\\s*$', '')")),
    "canon_number": ("t STRING", "STRING", _key("t")),
    "is_house_number": ("t STRING", "BOOLEAN", r"coalesce(trim(t), '') rlike '^(?:Unit[A-Za-z0-9]+/\\d+(?:-\\d+)?|\\d+[A-Za-z]?(?:-\\d+[A-Za-z]?)?)$'"),
    "flat_metres": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        f"{EARTH_M} * sqrt(power(radians(lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2) + power(radians(lat2 - lat1), 2))",
    ),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
