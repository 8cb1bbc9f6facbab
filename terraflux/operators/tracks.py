"""Track and sequence operators as windows, and the smaller processes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native
from ..functions.hashes import attribute_hash
from ..sources.shared import materialise


def segments(df: DataFrame, track: str, time: str, lon: str, lat: str, tie: str, *, min_points: int = 2, break_on_day: bool = False, filter_singular: bool = True) -> DataFrame:
    """Consecutive points of each track as segments (track, start and end time and place). Tracks
    with ``min_points`` points or fewer give none; with break_on_day no segment crosses a day;
    with filter_singular none has equal ends."""
    part = [track, F.to_date(time)] if break_on_day else [track]
    w = Window.partitionBy(*part).orderBy(time, tie)
    nxt = lambda c: F.lead(c).over(w)
    got = df.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy(track)), "end_time": nxt(time), "end_lon": nxt(lon), "end_lat": nxt(lat)}).where("end_time is not null")
    got = got.where(F.col("__n") > min_points).select(F.col(track).alias("track"), F.col(time).alias("start_time"), F.col(lon).alias("start_lon"), F.col(lat).alias("start_lat"), "end_time", "end_lon", "end_lat")
    return got.where("start_lon <> end_lon or start_lat <> end_lat") if filter_singular else got


def with_distance(df: DataFrame, track: str, time: str, lon: str, lat: str, tie: str) -> DataFrame:
    """df with the great-circle distance from the track's point before, null at its first."""
    w = Window.partitionBy(track).orderBy(time, tie)
    return df.withColumn("step_m", native.distance_sphere(F.lag(lon).over(w), F.lag(lat).over(w), F.col(lon), F.col(lat)))


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key; an aggregation, so a key of any size costs a row for each task."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def every_nth(df: DataFrame, share: float, order: list[str], by: str | None = None) -> DataFrame:
    """Every nth row, n = int(1 / share), in the given order, by key (a null one is ""). A share
    over a half keeps all."""
    n = int(1 / share)
    if n < 2:
        return df
    if by is None:
        # places by range partition and within it, rather than one window over all rows; written
        # once, since a second run may draw the ranges elsewhere
        ids = [f"c{i}" for i in range(len(df.columns))]
        keys = [ids[df.columns.index(c)] for c in order]
        ranged = df.toDF(*ids).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
        placed = ranged.select(*ids, F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
        placed = materialise(placed, "ranged")
        sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = F.broadcast(sizes.select(F.col("part").alias("of"), before.alias("before")))
        return placed.join(starts, F.col("part") == F.col("of")).where((F.col("before") + F.col("place")) % n == 0).select(*ids).toDF(*df.columns)
    w = Window.partitionBy(F.coalesce(F.col(by).cast("string"), F.lit(""))).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w) - 1).where(F.col("__k") % n == 0).drop("__k")


def time_bins(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with the number of its group of ``size`` consecutive rows; for small tables."""
    return df.withColumn("bin", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def date_offset(df: DataFrame, column: str, period: str) -> DataFrame:
    """A date column moved by an ISO duration such as P1DT2H or -PT30M."""
    m = re.fullmatch(r"(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", period)
    if not m:
        raise ValueError(f"not a duration: {period}")
    d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    move = F.make_dt_interval(F.lit(int(d)), F.lit(int(h)), F.lit(int(mi)), F.lit(s))
    return df.withColumn(column, F.col(column) - move if m[1] else F.col(column) + move)


def _hashed(column: str, modulus: int) -> Column:
    """murmur3 of the value's text, its size modulo; a null value counts as empty text."""
    return (F.abs(attribute_hash(F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("long")) % modulus).cast("int")


def hash_attribute(df: DataFrame, column: str, modulus: int, name: str = "hash") -> DataFrame:
    """A column with the hash of another, 0 to modulus - 1."""
    return df.withColumn(name, _hashed(column, modulus))


#: Seven colours for hashed attributes.
COLOURS = ("#6495ED", "#B0C4DE", "#00FFFF", "#9ACD32", "#00FA9A", "#FFF8DC", "#F5DEB3")


def hash_colour(df: DataFrame, column: str, name: str = "colour") -> DataFrame:
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, COLOURS)), _hashed(column, len(COLOURS)) + 1))


def age_off(df: DataFrame, time: str, now: Column, ttl: str) -> DataFrame:
    """Rows younger than the time to live (an interval text)."""
    return df.where(F.col(time) > now - F.expr(f"interval {ttl}"))
