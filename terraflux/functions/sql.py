"""Functions over plain numbers for SQL text, as SQL functions: Catalyst puts their bodies in place,
so a box or a distance in a WHERE clause reaches the Parquet scan as ranges of the columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..geom.measure import EARTH_RADIUS

_HALF = f"degrees(m / {EARTH_RADIUS}) * 1.000001"
_DISTANCE = f"2 * {EARTH_RADIUS} * asin(least(1.0D, sqrt(pow(sin((radians(y1) - radians(y0)) / 2), 2) + cos(radians(y0)) * cos(radians(y1)) * pow(sin(radians(x1 - x0) / 2), 2))))"

#: name -> (parameters, result, body)
FUNCTIONS = {
    "tf_in_box": ("lon DOUBLE, lat DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "BOOLEAN", "lon >= x0 AND lon <= x1 AND lat >= y0 AND lat <= y1"),
    "tf_distance": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "DOUBLE", _DISTANCE),
    "tf_within": ("lon DOUBLE, lat DOUBLE, x0 DOUBLE, y0 DOUBLE, m DOUBLE", "BOOLEAN", f"lat >= y0 - {_HALF} AND lat <= y0 + {_HALF} AND {_DISTANCE.replace('y1', 'lat').replace('x1', 'lon')} <= m"),
    "tf_heading": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "DOUBLE", "pmod(degrees(atan2(sin(radians(x1 - x0)) * cos(radians(y1)), cos(radians(y0)) * sin(radians(y1)) - sin(radians(y0)) * cos(radians(y1)) * cos(radians(x1 - x0)))) + 360D, 360D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make them known to the session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
