"""Joins by place, by time and by key, each as an equi-join plus a filter."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native

# tasks


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out anew, by the keys if given, to as many tasks as keep the cluster busy. A small file is
    one task, and adaptive execution joins small partitions, however much work their rows are. Without
    keys, what has tasks enough stays as it is."""
    spark = df.sparkSession
    n = 4 * max(4, spark.sparkContext.defaultParallelism)
    if keys:
        return df.repartition(n, *keys)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


# grids


def cells_of(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of (i, j) of all cells of the given size that a box touches."""
    lo = lambda v: F.floor(v / size).cast("int")
    return F.flatten(F.transform(F.sequence(lo(x0), lo(x1)), lambda i: F.transform(F.sequence(lo(y0), lo(y1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def data_bounds(df: DataFrame, lon: str, lat: str) -> tuple[float, float, float, float]:
    return tuple(df.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first())


def grid_partition(df: DataFrame, lon: str, lat: str, n: int, strategy: str = "equal", sample: float = 0.1) -> tuple[DataFrame, DataFrame | None]:
    """df with a column ``cell``, repartitioned by it. equal: cells over the data's bounds;
    earth: over the world; weighted: bounds at quantiles of each axis; rtree: packed
    envelopes of a sample. Points outside get -1."""
    side = max(1, int(math.sqrt(n)))
    x, y = F.col(lon), F.col(lat)
    if strategy in ("equal", "earth"):
        b = (-180.0, -90.0, 180.0, 90.0) if strategy == "earth" else data_bounds(df, lon, lat)
        if b[0] is None:
            return df.withColumn("cell", F.lit(-1)), None
        span = lambda lo, hi: hi if hi > lo else lo + 1.0
        i, j = native.grid_cell(x, b[0], span(b[0], b[2]), side), native.grid_cell(y, b[1], span(b[1], b[3]), side)
        cell = F.coalesce(i * side + j, F.lit(-1))
    elif strategy == "weighted":
        cuts = [sorted(set(df.approxQuantile(c, [k / side for k in range(1, side)], 0.001))) if side > 1 else [] for c in (lon, lat)]
        at = lambda v, edges: sum(((v >= e).cast("int") for e in edges), F.lit(0))
        cell = F.when(x.isNotNull() & y.isNotNull(), at(x, cuts[0]) * side + at(y, cuts[1])).otherwise(-1)
    elif strategy == "rtree":
        boxes = rtree_boxes([(r[0], r[1]) for r in df.select(lon, lat).where(x.isNotNull() & y.isNotNull()).sample(sample, seed=7).limit(20_000).collect()], n)
        cell = F.lit(-1)
        for k, b in reversed(list(enumerate(boxes))):
            cell = F.when(native.in_box(x, y, *b), F.lit(k)).otherwise(cell)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return df.withColumn("cell", cell.cast("int")).repartition("cell"), None


def grid_boxes(bounds: tuple[float, float, float, float], side: int) -> list[tuple[float, float, float, float]]:
    """The cells of an equal or earth grid, in the order of their numbers."""
    x0, y0, x1, y1 = bounds
    w, h = (x1 - x0) / side, (y1 - y0) / side
    return [(x0 + i * w, y0 + j * h, x0 + (i + 1) * w, y0 + (j + 1) * h) for i in range(side) for j in range(side)]


def cover(df: DataFrame, box: tuple[str, str, str, str], cells: list[tuple[float, float, float, float]]) -> DataFrame:
    """df dealt out by the cells of another table (fixed boxes): a row for each that its box meets, in a
    column ``cell``, -1 where it meets none. For joins with the table that has these cells."""
    boxes = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)]) for k, b in enumerate(cells)])
    met = F.transform(F.filter(boxes, lambda b: native.boxes_meet(tuple(map(F.col, box)), (b["x0"], b["y0"], b["x1"], b["y1"]))), lambda b: b["k"])
    return df.withColumn("cell", F.explode(F.when(F.size(met) > 0, met).otherwise(F.array(F.lit(-1))))).repartition("cell")


def rtree_boxes(points: list[tuple[float, float]], n: int) -> list[tuple[float, float, float, float]]:
    """Envelopes of about equally many points: slices by x, cut by y."""
    if not points:
        return []
    slices = max(1, math.ceil(math.sqrt(n)))
    points = sorted(points)
    per = math.ceil(len(points) / slices)
    out = []
    for a in range(0, len(points), per):
        part = sorted(points[a : a + per], key=lambda p: p[1])
        size = math.ceil(len(part) / slices)
        for b in range(0, len(part), size):
            box = part[b : b + size]
            out.append((min(p[0] for p in box), box[0][1], max(p[0] for p in box), box[-1][1]))
    return out


# joins by place


def box_point_join(boxes: DataFrame, points: DataFrame, box: tuple[str, str, str, str], lon: str, lat: str, *, size: float = 10.0, salt: int = 1, how: str = "inner") -> DataFrame:
    """Rows of boxes and points where the closed box holds the point. Boxes are dealt to all
    grid cells they touch, a point is in one, so no pair comes twice. ``salt`` splits the
    points of a cell among so many partitions, at the cost of as many copies of the boxes."""
    dealt = boxes.withColumn("__cell", F.explode(cells_of(*map(F.col, box), size)))
    dealt = dealt.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(salt)])))
    keyed = points.withColumn("__cell", F.struct(F.floor(F.col(lon) / size).cast("int").alias("i"), F.floor(F.col(lat) / size).cast("int").alias("j")))
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(lon, lat, *[c for c in points.columns[:1]]), F.lit(salt)).cast("int"))
    exact = native.in_box(keyed[lon], keyed[lat], *[dealt[c] for c in box])
    on = (dealt["__cell"] == keyed["__cell"]) & (dealt["__salt"] == keyed["__salt"]) & exact
    left, right = (keyed, dealt) if how in ("left_semi", "left_anti") else (dealt, keyed)
    return left.join(right, on, how).drop("__cell", "__salt")


def spatial_join(left: DataFrame, right: DataFrame, left_box: tuple, right_box: tuple, predicate: Column, *, size: float = 10.0, salt: int = 1) -> DataFrame:
    """Inner join of two tables with bounds columns by any predicate that implies that the bounds
    meet. Both sides are dealt to the cells they touch; a pair is kept in the cell of the upper
    of the two lower corners only, so once. ``salt`` splits the left rows of a cell among so many
    partitions, at the cost of as many copies of the right ones."""
    a = left.withColumn("__a", F.explode(cells_of(*map(F.col, left_box), size))).withColumn("__sa", F.pmod(F.xxhash64(*left_box), F.lit(salt)).cast("int"))
    b = right.withColumn("__b", F.explode(cells_of(*map(F.col, right_box), size))).withColumn("__sb", F.explode(F.array(*[F.lit(k) for k in range(salt)])))
    home_i = F.floor(F.greatest(a[left_box[0]], b[right_box[0]]) / size).cast("int")
    home_j = F.floor(F.greatest(a[left_box[1]], b[right_box[1]]) / size).cast("int")
    on = (a["__a"] == b["__b"]) & (a["__sa"] == b["__sb"]) & native.boxes_meet(tuple(a[c] for c in left_box), tuple(b[c] for c in right_box)) & (a["__a.i"] == home_i) & (a["__a.j"] == home_j)
    return a.join(b, on).where(predicate).drop("__a", "__b", "__sa", "__sb")


#: Levels of cells for nearest rows: each halves the reach of the one before.
LEVELS = 12


def _reach_cells(metres: float, level: Column | int = 0) -> tuple[Callable[[Column], Column], Callable[[Column, Column], Column], Callable[[Column, Column], Column]]:
    """Rows of cells by latitude, columns of a row by longitude, and the number of cells about a row,
    so that all within ``metres`` / 2^level lies in the 3 x 3 cells about a point. A row of cells is cut so
    that its cells are at least as wide as the reach anywhere in it; at a pole it is one cell."""
    size = F.lit(max(math.degrees(metres / native.EARTH_RADIUS) * 1.001, 1e-6)) / (F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(float(2**level)))

    def count(row: Column) -> Column:
        far = F.greatest(F.abs(row * size), F.abs((row + 1) * size)) + size
        return F.when(far < 89.9, F.greatest(F.lit(1.0), F.floor(360.0 * F.cos(F.radians(far)) / size))).otherwise(F.lit(1.0))

    return (lambda lat: F.floor(lat / size).cast("int")), (lambda lon, row: F.pmod(F.floor((lon + 180.0) * count(row) / 360.0), count(row)).cast("int")), count


def _cell(lon: Column, lat: Column, metres: float, level: Column | int = 0) -> Column:
    row, column, _ = _reach_cells(metres, level)
    return F.struct(row(lat).alias("r"), column(lon, row(lat)).alias("c"))


def _cells_about(lon: Column, lat: Column, metres: float, level: Column | int = 0) -> Column:
    row, column, count = _reach_cells(metres, level)
    about = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.flatten(F.transform(F.transform(about, lambda k: row(lat) + k), lambda r: F.array_distinct(F.transform(about, lambda k: F.struct(r.alias("r"), F.pmod(column(lon, r) + k, count(r)).cast("int").alias("c"))))))


def _places(df: DataFrame, at: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """The different places of the rows, so that what many rows share is computed once."""
    return df.select(F.col(at[0]).alias(names[0]), F.col(at[1]).alias(names[1])).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).distinct()


def _at_places(df: DataFrame, at: tuple[str, str], places: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Rows of df with those of places that have their place."""
    return df.join(places, (df[at[0]] == places[names[0]]) & (df[at[1]] == places[names[1]])).drop(*names)


def _dealt(df: DataFrame, cell: str, *more: str) -> DataFrame:
    return spread(df.select("*", F.col(f"{cell}.r").alias(f"{cell}r"), F.col(f"{cell}.c").alias(f"{cell}c")).drop(cell), f"{cell}r", f"{cell}c", *more)


def _near_places(queries: DataFrame, data: DataFrame, metres: float) -> DataFrame:
    """All pairs within the distance, of places (__qx, __qy) and (__dx, __dy), with ``distance_m``."""
    a = _dealt(queries.withColumn("__q", F.explode(_cells_about(F.col("__qx"), F.col("__qy"), metres))), "__q")
    b = _dealt(data.withColumn("__d", _cell(F.col("__dx"), F.col("__dy"), metres)), "__d")
    pairs = a.join(b, (a["__qr"] == b["__dr"]) & (a["__qc"] == b["__dc"]))
    pairs = pairs.withColumn("distance_m", native.distance_sphere("__qx", "__qy", "__dx", "__dy"))
    return pairs.where(F.col("distance_m") <= metres).drop("__qr", "__qc", "__dr", "__dc")


def within_distance(queries: DataFrame, data: DataFrame, q: tuple[str, str], d: tuple[str, str], metres: float) -> DataFrame:
    """All pairs within the distance, with column ``distance_m``; both sides' names must differ. Distances
    are those of different places; the rows come to them by equi-joins."""
    near = _near_places(_places(queries, q, ("__qx", "__qy")), _places(data, d, ("__dx", "__dy")), metres)
    return _at_places(queries, q, spread(_at_places(data, d, near, ("__dx", "__dy")), "__qx", "__qy"), ("__qx", "__qy"))


def _near_any(data: DataFrame, queries: DataFrame, metres: float, reach: float | None = None) -> DataFrame:
    """Rows of data (__dx, __dy, with reach also __dt) within the distance, and the reach in time, of any
    row of queries (__qx, __qy, __qt): a semi-join, which makes no pairs and stops at the first."""
    a = queries.withColumn("__q", F.explode(_cells_about(F.col("__qx"), F.col("__qy"), metres)))
    b = data.withColumn("__d", _cell(F.col("__dx"), F.col("__dy"), metres))
    if reach is not None:
        of = lambda c: F.floor(F.col(c) / max(reach, 1e-9)).cast("long")
        a, b = a.withColumn("__qb", F.explode(F.sequence(of("__qt") - 1, of("__qt") + 1))), b.withColumn("__db", of("__dt"))
    a, b = (_dealt(t, k, *([k + "b"] if reach is not None else [])) for t, k in ((a, "__q"), (b, "__d")))
    on = (a["__qr"] == b["__dr"]) & (a["__qc"] == b["__dc"]) & (native.distance_sphere(a["__qx"], a["__qy"], b["__dx"], b["__dy"]) <= metres)
    if reach is not None:
        on = on & (a["__qb"] == b["__db"]) & (F.abs(b["__dt"] - a["__qt"]) < reach)
    return b.join(a, on, "left_semi").drop("__dr", "__dc", "__db")


def proximity(data: DataFrame, queries: DataFrame, key: str, d: tuple[str, str], q: tuple[str, str], metres: float) -> DataFrame:
    """Rows of data within the distance of any query point, each once."""
    near = _near_any(_places(data, d, ("__dx", "__dy")), _places(queries, q, ("__qx", "__qy")), metres)
    return data.join(near, (data[d[0]] == near["__dx"]) & (data[d[1]] == near["__dy"]), "left_semi")


def _nearest_of_places(queries: DataFrame, data: DataFrame, q: tuple[str, str], d: tuple[str, str], data_key: str, k: int, metres: float) -> DataFrame:
    """For each different place (__qx, __qy) of queries its k nearest rows of data within the distance,
    with ``distance_m``. Of a place of data only the k first keys can be among them. Each place of queries
    is compared with cells of the smallest reach (``metres`` halved again and again) that is sure to
    hold k rows: those in a cell of its own whose diagonal is no longer than the reach."""
    first = data.where(F.col(d[0]).isNotNull() & F.col(d[1]).isNotNull())
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy(*d).orderBy(data_key))).where(F.col("__n") <= k).drop("__n")
    first = first.withColumns({"__dx": F.col(d[0]), "__dy": F.col(d[1])})
    places = _places(queries, q, ("__qx", "__qy"))
    levels = [n for n in range(LEVELS + 1) if not n or metres / 2**n >= 1.0]
    leveled = lambda df: df.withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    # own cells: sides of half the reach at most, measured where the row is widest
    half = F.lit(max(math.degrees(metres / native.EARTH_RADIUS), 1e-6) * 0.499) / F.pow(F.lit(2.0), F.col("__level"))

    def own(x: str, y: str) -> list[Column]:
        row = F.floor(F.col(y) / half)
        n = F.greatest(F.lit(1.0), F.ceil(360.0 * F.cos(F.radians(F.least(F.abs(row * half), F.abs((row + 1) * half)))) / half))
        return [row.alias("__r"), F.least(F.floor((F.col(x) + 180.0) * n / 360.0), n - 1).cast("long").alias("__c")]

    full = leveled(first.select("__dx", "__dy")).groupBy("__level", *own("__dx", "__dy")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k).select("__level", "__r", "__c", F.col("__level").alias("__full"))
    places = leveled(places).select("__qx", "__qy", "__level", *own("__qx", "__qy")).join(full, ["__level", "__r", "__c"], "left")
    places = places.groupBy("__qx", "__qy").agg(F.coalesce(F.max("__full"), F.lit(0)).alias("__ql"))
    a = _dealt(places.withColumn("__q", F.explode(_cells_about(F.col("__qx"), F.col("__qy"), metres, F.col("__ql")))), "__q", "__ql")
    b = leveled(first).withColumnRenamed("__level", "__dl")
    b = _dealt(b.withColumn("__d", _cell(F.col("__dx"), F.col("__dy"), metres, F.col("__dl"))), "__d", "__dl")
    pairs = a.join(b, (a["__qr"] == b["__dr"]) & (a["__qc"] == b["__dc"]) & (a["__ql"] == b["__dl"]))
    pairs = pairs.withColumn("distance_m", native.distance_sphere("__qx", "__qy", "__dx", "__dy"))
    pairs = pairs.where((F.col("distance_m") <= metres) & (F.col("distance_m") <= metres * 1.000001 / F.pow(F.lit(2.0), F.col("__ql"))))
    near = pairs.select("__qx", "__qy", *data.columns, "distance_m")
    w = Window.partitionBy("__qx", "__qy").orderBy("distance_m", data_key)
    return near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def k_nearest(queries: DataFrame, data: DataFrame, q: tuple[str, str], d: tuple[str, str], query_key: str, data_key: str, k: int, metres: float) -> DataFrame:
    """The k nearest rows of data for each query point within the distance, with ``rank`` and
    ``distance_m``; ties go by the data's key. Exact."""
    pairs = _at_places(queries, q, _nearest_of_places(queries, data, q, d, data_key, k, metres), ("__qx", "__qy"))
    w = Window.partitionBy(query_key).orderBy("distance_m", data_key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_set(queries: DataFrame, data: DataFrame, q: tuple[str, str], d: tuple[str, str], query_key: str, data_key: str, k: int, metres: float) -> DataFrame:
    """The rows of data that are among the k nearest of any query point, each once."""
    return data.join(_nearest_of_places(queries, data, q, d, data_key, k, metres).select(data_key).distinct(), data_key, "left_semi")


def route_search(points: DataFrame, route: list[tuple[float, float]], lon: str, lat: str, heading: str, *, buffer_m: float, threshold: float, bidirectional: bool = False) -> DataFrame:
    """Points within the buffer of the route whose heading differs from that of the nearest
    segment by at most ``threshold`` degrees (or from the opposite one). Distances are planar
    about the point; the route is a short literal."""
    segs = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*a, *b), ("x0", "y0", "x1", "y1"), strict=True)]) for a, b in zip(route, route[1:])])

    def reach(s: Column) -> Column:
        scale = F.cos(F.radians(F.col(lat)))
        ax, ay = (s["x0"] - F.col(lon)) * scale, s["y0"] - F.col(lat)
        dx, dy = (s["x1"] - s["x0"]) * scale, s["y1"] - s["y0"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-30))))
        return F.radians(F.hypot(ax + t * dx, ay + t * dy)) * native.EARTH_RADIUS

    best = F.array_min(F.transform(segs, lambda s: F.struct(reach(s).alias("d"), native.heading(s["x0"], s["y0"], s["x1"], s["y1"]).alias("h"))))
    got = points.withColumn("__near", best).where(F.col("__near.d") <= buffer_m)
    turn = F.pmod(F.abs(F.col(heading) - F.col("__near.h")), F.lit(360.0))
    turn = F.least(turn, 360.0 - turn)
    ok = turn <= threshold
    return got.where(ok | (180.0 - turn <= threshold) if bidirectional else ok).drop("__near")


def tube_select(data: DataFrame, track: DataFrame, key: str, d: tuple[str, str, str], t: tuple[str, str, str], *, buffer_m: float, max_time_s: float, gap_fill: str = "nofill", max_speed: float = 0.0, step_s: float = 60.0) -> DataFrame:
    """Rows of data near a track in place and time, each once. d and t: (lon, lat, time). With
    gap_fill "line" or "interpolated", positions between the track's points are put in at equal
    times, at most ``step_s`` apart. A buffer of 0 becomes speed times time."""
    metres = buffer_m or max_speed * max_time_s
    pts = track.select(F.col(t[0]).alias("__x"), F.col(t[1]).alias("__y"), F.unix_millis(F.col(t[2]).cast("timestamp")).alias("__t"))
    if gap_fill != "nofill":
        w = Window.orderBy("__t", "__x", "__y")  # one track, which is small
        nxt = lambda c: F.lead(c).over(w)
        gaps = pts.withColumns({"__x1": nxt("__x"), "__y1": nxt("__y"), "__t1": nxt("__t")})
        n = F.greatest(F.lit(1), F.ceil((F.col("__t1") - F.col("__t")) / (1000.0 * step_s)).cast("int"))
        share = F.coalesce(F.transform(F.sequence(F.lit(0), n - 1), lambda k: k / n), F.array(F.lit(0.0)))
        at = lambda a, b: F.col(a) + F.coalesce((F.col(b) - F.col(a)) * F.col("__s"), F.lit(0.0))
        pts = gaps.withColumn("__s", F.explode(share)).select(at("__x", "__x1").alias("__x"), at("__y", "__y1").alias("__y"), at("__t", "__t1").cast("long").alias("__t"))
    pts = pts.select(F.col("__x").alias("__qx"), F.col("__y").alias("__qy"), F.col("__t").alias("__qt")).distinct()
    rows = data.select(key, F.col(d[0]).alias("__dx"), F.col(d[1]).alias("__dy"), F.unix_millis(F.col(d[2]).cast("timestamp")).alias("__dt"))
    hit = _near_any(rows, pts, metres, 1000.0 * max_time_s).select(key).distinct()
    return data.join(hit, key, "left_semi")


# joins by key and time


def lookup_join(primary: DataFrame, secondary: DataFrame, primary_key: str, secondary_key: str, order: list[str], most: int = 128) -> DataFrame:
    """Each row of secondary with the first row (by ``order``) of primary that has its key. The
    primary side is a bounded one: more than ``most`` rows raise an error."""
    from pyspark.errors import PySparkException

    if primary.limit(most + 1).count() > most:
        raise PySparkException(f"the primary side of a lookup has over {most} rows")
    w = Window.partitionBy(primary_key).orderBy(*order)
    first = primary.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return secondary.join(F.broadcast(first), F.col(secondary_key) == F.col(primary_key))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """left with the values of the last row of right at or before its time, by key. One sort of
    the union, no pairs; times must have one type, and ``tie`` orders rows of right of equal time."""
    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__v"))
    b = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("__tie"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col("__v")[v].alias(v) for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, size: float, *, key: str | None = None) -> DataFrame:
    """Rows where start <= at <= end (numbers), and equal keys if given: intervals go to all bins
    of ``size`` that they touch."""
    dealt = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    binned = points.withColumn("__bin", F.floor(F.col(at) / size))
    on = (binned["__bin"] == dealt["__bin"]) & (binned[at] >= dealt[start]) & (binned[at] <= dealt[end])
    if key:
        on = on & (binned[key] == dealt[key])
    return binned.join(dealt, on).drop("__bin")
