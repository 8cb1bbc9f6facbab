"""Forms over plain numbers that stay in the JVM: points as lon and lat, boxes as four numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..geom.measure import EARTH_RADIUS, WGS84_A
from .geohash import ALPHABET

C = Column | str | float


def col(v: C) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def in_box(lon: C, lat: C, x0: C, y0: C, x1: C, y1: C) -> Column:
    """The closed box holds the point; ranges on plain columns reach the Parquet scan."""
    lon, lat = col(lon), col(lat)
    return (lon >= col(x0)) & (lon <= col(x1)) & (lat >= col(y0)) & (lat <= col(y1))


def polygon_location(lon: C, lat: C, polygons: list[list[list[tuple[float, ...]]]], eps: float, shift: float = 0.0) -> Column:
    """Where a point lies in fixed polygons (rings of corners), moved by ``shift`` degrees of longitude:
    1 inside, 0 on an edge (as near as eps), -1 outside, null without a place. Edges are one constant
    array; a ray to the east counts crossings."""
    x, y = col(lon), col(lat)

    def one(rings: list[list[tuple[float, ...]]]) -> Column:
        flat = [v for r in rings for a, b in zip(r, r[1:]) if a[:2] != b[:2] for v in (a[0] - shift, a[1], b[0] - shift, b[1])]
        edges = F.expr("cast(split('" + ",".join(map(repr, map(float, flat))) + "', ',') as array<double>)")

        def see(state: Column, k: Column) -> Column:
            ax, ay, bx, by = (F.get(edges, 4 * k + i) for i in range(4))
            dx, dy = bx - ax, by - ay
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            near = (y >= F.least(ay, by) - eps) & (y <= F.greatest(ay, by) + eps) & (x >= F.least(ax, bx) - eps) & (x <= F.greatest(ax, bx) + eps)
            on = near & (F.abs(x - ax - t * dx) <= eps) & (F.abs(y - ay - t * dy) <= eps)
            over = F.when((ay > y) != (by > y), x < dx * (y - ay) / dy + ax).otherwise(F.lit(False))
            return F.when(on, F.lit(2)).when(over & (state < 2), 1 - state).otherwise(state)

        last = F.aggregate(F.sequence(F.lit(0), F.lit(len(flat) // 4 - 1)), F.lit(0), see)
        return F.when(last == 2, 0).when(last == 1, 1).otherwise(-1)

    found = [one(rings) for rings in polygons]
    return F.when(x.isNotNull() & y.isNotNull(), found[0] if len(found) == 1 else F.greatest(*found))


def boxes_meet(a: tuple, b: tuple) -> Column:
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(col, (*a, *b))
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def distance(x0: C, y0: C, x1: C, y1: C) -> Column:
    return F.hypot(col(x1) - col(x0), col(y1) - col(y0))


def distance_sphere(x0: C, y0: C, x1: C, y1: C) -> Column:
    """Metres along a great circle."""
    la, lb = F.radians(col(y0)), F.radians(col(y1))
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(col(x1) - col(x0)) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def heading(x0: C, y0: C, x1: C, y1: C) -> Column:
    """Azimuth in degrees, 0 to 360, clockwise from north."""
    la, lb, d = F.radians(col(y0)), F.radians(col(y1)), F.radians(col(x1) - col(x0))
    a = F.degrees(F.atan2(F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d)))
    return F.pmod(a + 360.0, F.lit(360.0))


def mercator(lon: C, lat: C) -> tuple[Column, Column]:
    """EPSG:3857 of longitude and latitude."""
    return F.radians(col(lon)) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2)) * WGS84_A


def normalised(v: C, low: float, high: float, bits: int) -> Column:
    """Cell number of a value, 2^bits cells over the range; the upper end falls in the last cell."""
    n = float(1 << bits)
    return F.least(F.floor((col(v) - low) * n / (high - low)), F.lit((1 << bits) - 1)).cast("long")


#: Fixed values of the usual bit-spreading steps: (shift, mask).
_SPREAD2 = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_SPREAD3 = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(v: Column, steps: tuple) -> Column:
    for shift, mask in steps:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z2(lon: C, lat: C, bits: int = 31) -> Column:
    """Interleaved cell numbers, longitude in the low bit."""
    x, y = normalised(lon, -180, 180, bits), normalised(lat, -90, 90, bits)
    return _spread(x, _SPREAD2).bitwiseOR(F.shiftleft(_spread(y, _SPREAD2), 1))


def z3(lon: C, lat: C, part: Column, whole: float, bits: int = 21) -> Column:
    """As z2, with the place in the time bin as third dimension."""
    x, y, t = normalised(lon, -180, 180, bits), normalised(lat, -90, 90, bits), normalised(part, 0, whole, bits)
    return _spread(x, _SPREAD3).bitwiseOR(F.shiftleft(_spread(y, _SPREAD3), 1)).bitwiseOR(F.shiftleft(_spread(t, _SPREAD3), 2))


def _gather(z: Column, first: int, dims: int, bits: int) -> Column:
    """Every dims-th bit of z from the given one, side by side."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, dims * k + first).bitwiseAND(F.lit(1)), k))
    return out


def z2_cell(z: C, bits: int = 31) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a z2 cell."""
    x, y = (_gather(col(z), i, 2, bits) for i in range(2))
    return (x + 0.5) * (360.0 / (1 << bits)) - 180, (y + 0.5) * (180.0 / (1 << bits)) - 90


def z3_cell(z: C, whole: float, bits: int = 21) -> tuple[Column, Column, Column]:
    """Longitude, latitude and offset in the time bin of the middle of a z3 cell."""
    x, y, t = (_gather(col(z), i, 3, bits) for i in range(3))
    return (x + 0.5) * (360.0 / (1 << bits)) - 180, (y + 0.5) * (180.0 / (1 << bits)) - 90, (t + 0.5) * (whole / (1 << bits))


def z_ranges(low: tuple[int, ...], high: tuple[int, ...], bits: int, most: int = 200) -> list[tuple[int, int]]:
    """Closed ranges of interleaved numbers that hold all cells from low to high (cell numbers of each
    dimension); at most about ``most``, so the last may hold other cells too."""
    dims, out = len(low), []
    level = [(0, 0, tuple([0] * dims))]  # z prefix, bits done, corner
    while level:
        nxt = []
        for prefix, done, corner in level:
            size = 1 << (bits - done)
            if all(a <= c and c + size - 1 <= b for a, b, c in zip(low, high, corner)) or done == bits or len(out) + len(level) + len(nxt) >= most:
                width = dims * (bits - done)
                out.append((prefix << width, (prefix + 1 << width) - 1))
                continue
            half = size >> 1
            for k in range(1 << dims):
                child = tuple(c + half * (k >> i & 1) for i, c in enumerate(corner))
                if all(c <= b and c + half - 1 >= a for a, b, c in zip(low, high, child)):
                    nxt.append((prefix << dims | k, done + 1, child))
        level = nxt
    out.sort()
    joined: list[tuple[int, int]] = []
    for a, b in out:
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def z2_ranges(box: tuple[float, float, float, float], bits: int = 31, most: int = 200) -> list[tuple[int, int]]:
    """Ranges of z2 that hold all points of a box."""
    cell = lambda v, lo, hi: min((1 << bits) - 1, max(0, math.floor((v - lo) * (1 << bits) / (hi - lo))))
    return z_ranges((cell(box[0], -180, 180), cell(box[1], -90, 90)), (cell(box[2], -180, 180), cell(box[3], -90, 90)), bits, most)


def z3_ranges(box: tuple[float, float, float, float], offsets: tuple[float, float], whole: float, bits: int = 21, most: int = 200) -> list[tuple[int, int]]:
    """Ranges of z3 that hold all points of a box at the offsets within one time bin."""
    cell = lambda v, lo, hi: min((1 << bits) - 1, max(0, math.floor((v - lo) * (1 << bits) / (hi - lo))))
    return z_ranges((cell(box[0], -180, 180), cell(box[1], -90, 90), cell(offsets[0], 0, whole)), (cell(box[2], -180, 180), cell(box[3], -90, 90), cell(offsets[1], 0, whole)), bits, most)


def in_ranges(z: C, ranges: list[tuple[int, int]]) -> Column:
    """The number is in one of the ranges; on a plain column they reach the Parquet scan."""
    tests = [(col(z) >= F.lit(a)) & (col(z) <= F.lit(b)) for a, b in ranges] or [F.lit(False)]
    while len(tests) > 1:  # a flat tree
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def time_bin(ts: Column, period: str) -> tuple[Column, Column, float]:
    """(bin since 1970 in UTC, offset within it, length of the longest bin): day in milliseconds,
    week and month in seconds, year in minutes."""
    days = F.datediff(ts, F.lit("1970-01-01"))
    sec = F.unix_timestamp(ts)
    if period == "day":
        return days, F.unix_millis(ts) - days.cast("long") * 86_400_000, 86_400_000.0
    if period == "week":
        week = F.floor(days / 7).cast("int")
        return week, sec - week.cast("long") * 604_800, 604_800.0
    if period == "month":
        bin_ = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
        return bin_, sec - F.unix_timestamp(F.trunc(ts, "month").cast("timestamp")), 31 * 86_400.0
    if period == "year":
        start = F.trunc(ts, "year").cast("timestamp")
        return F.year(ts) - 1970, F.floor((sec - F.unix_timestamp(start)) / 60).cast("long"), 366 * 1440.0
    raise ValueError(f"no such period: {period}")


def geohash(lon: C, lat: C, bits: int) -> Column:
    """Same as st_geoHash of the point: bits alternate, longitude first."""
    x, y = normalised(lon, -180, 180, (bits + 1) // 2), normalised(lat, -90, 90, bits // 2)
    pad = -bits % 5
    nx, ny = (bits + 1) // 2, bits // 2
    chars = []
    for c in range((bits + pad) // 5):
        five = F.lit(0).cast("long")
        for k in range(5 * c, 5 * c + 5):
            bit = F.lit(0).cast("long") if k >= bits else F.shiftright(x, nx - 1 - k // 2).bitwiseAND(F.lit(1)) if k % 2 == 0 else F.shiftright(y, ny - 1 - k // 2).bitwiseAND(F.lit(1))
            five = five * 2 + bit
        chars.append(F.substring(F.lit(ALPHABET), five.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def grid_cell(v: C, low: float, high: float, n: int) -> Column:
    """Cell of n over a closed range; the upper edge falls in the last, what is outside is null."""
    v = col(v)
    return F.when((v >= low) & (v <= high), F.least(F.floor((v - low) * n / (high - low)), F.lit(n - 1)).cast("int"))


def point_wkt(lon: C, lat: C) -> Column:
    def num(v: Column) -> Column:
        return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))

    return F.concat(F.lit("POINT ("), num(col(lon)), F.lit(" "), num(col(lat)), F.lit(")"))


def point_geojson(lon: C, lat: C) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(col(lon), col(lat)).alias("coordinates")))


def point_wkb(lon: C, lat: C) -> Column:
    """Big-endian WKB by arithmetic on the doubles is not expressible; the Arrow form is used."""
    from .st import column_function

    return column_function("st_makepoint")(col(lon), col(lat))


def buffer_bounds(lat: C, metres: C) -> tuple[Column, Column]:
    """Half width and half height in degrees of a box that holds all within ``metres``."""
    h = F.degrees(col(metres) / EARTH_RADIUS)
    widest = F.cos(F.radians(F.least(F.lit(89.9), F.abs(col(lat)) + h)))
    return F.least(F.lit(360.0), h / F.greatest(widest, F.lit(1e-6))), h
