"""The st_* functions, as SQL functions and as Column builders.

Geometries are WKB in binary columns. Functions here run over Arrow batches with
the kernel in ``terraflux.geom``; a null argument gives null. For points and boxes
held as numbers, ``terraflux.functions.native`` has forms that stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import copysign

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..geom import measure as M
from ..geom import model as G
from ..geom import relate as R
from . import geohash as H

GEOM, TEXT, NUM, INT, BOOL, GEOMS = "geom", "text", "num", "int", "bool", "geoms"
_SPARK = {GEOM: T.BinaryType(), TEXT: T.StringType(), NUM: T.DoubleType(), INT: T.IntegerType(), BOOL: T.BooleanType(), "float": T.FloatType(), "bytes": T.BinaryType()}
_ARROW = {GEOM: pa.binary(), TEXT: pa.string(), NUM: pa.float64(), INT: pa.int32(), BOOL: pa.bool_(), "float": pa.float32(), "bytes": pa.binary()}

#: name -> (function, argument kinds, result kind)
FUNCTIONS: dict[str, tuple[Callable, tuple[str, ...], str]] = {}
ALIASES: dict[str, str] = {}


@lru_cache(maxsize=4096)
def _parsed(data: bytes) -> G.Geometry:
    return G.from_wkb(data)


def define(name: str, args: tuple[str, ...], result: str, *aliases: str) -> Callable:
    def keep(f: Callable) -> Callable:
        FUNCTIONS[name] = (f, args, result)
        for a in aliases:
            ALIASES[a] = name
        return f

    return keep


def _decode(kind: str, v):
    if kind == GEOM:
        return _parsed(bytes(v))
    return [_parsed(bytes(x)) for x in v if x is not None] if kind == GEOMS else v


def column_function(name: str) -> Callable[..., Column]:
    f, args, result = FUNCTIONS[ALIASES.get(name, name)]

    def one(row: tuple):
        got = f(*(_decode(k, v) for k, v in zip(args, row, strict=True)))
        return G.to_wkb(got) if isinstance(got, G.Geometry) else got

    def run(*cols: pa.Array) -> pa.Array:
        out, seen = [], {}  # equal arguments in a batch are computed once
        for row in zip(*(c.to_pylist() for c in cols), strict=True):
            if any(v is None for v in row):
                out.append(None)
            elif GEOMS in args:  # lists are no keys
                out.append(one(row))
            else:  # zeros of either sign are equal, and differ by their signs
                key = (row, *[copysign(1.0, v) for v in row if v == 0.0]) if 0.0 in row else row
                if key not in seen:
                    seen[key] = one(row)
                out.append(seen[key])
        return pa.array(out, _ARROW[result])

    run.__name__ = name
    return F.arrow_udf(run, _SPARK[result])


def __getattr__(name: str) -> Callable[..., Column]:
    if name in FUNCTIONS or name in ALIASES:
        return column_function(name)
    raise AttributeError(name)


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to SQL; returns their names."""
    names = [*FUNCTIONS, *ALIASES]
    for n in names:
        spark.udf.register(n, column_function(n))
    return names


# literals


def _literal(kinds: tuple[str, ...]) -> Callable[[G.Geometry | str], Column]:
    def lit(g: G.Geometry | str) -> Column:
        g = G.from_wkt(g) if isinstance(g, str) else g
        if kinds and g.kind not in kinds:
            raise TypeError(f"a {g.kind} is no {' or '.join(kinds)}")
        return F.lit(G.to_wkb(g))

    return lit


geomLit, pointLit, lineLit, polygonLit = _literal(()), _literal(("Point",)), _literal(("LineString",)), _literal(("Polygon",))
mPointLit, mLineLit, mPolygonLit, geomCollLit = _literal(("MultiPoint",)), _literal(("MultiLineString",)), _literal(("MultiPolygon",)), _literal(("GeometryCollection",))


# constructors


def _of_kind(kind: str, read: Callable) -> Callable:
    def go(v):
        g = read(v)
        if g.kind != kind:
            raise ValueError(f"a {g.kind} is no {kind}")
        return g

    return go


define("st_geomfromwkt", (TEXT,), GEOM, "st_geomfromtext", "st_geometryfromtext")(G.from_wkt)
define("st_geomfromwkb", ("bytes",), GEOM)(G.from_wkb)
define("st_geomfromgeojson", (TEXT,), GEOM)(G.from_geojson)
define("st_pointfromwkb", ("bytes",), GEOM)(_of_kind("Point", G.from_wkb))
for _name, _kind in (("point", "Point"), ("line", "LineString"), ("polygon", "Polygon"), ("mpoint", "MultiPoint"), ("mline", "MultiLineString"), ("mpoly", "MultiPolygon")):
    define(f"st_{_name}fromtext", (TEXT,), GEOM)(_of_kind(_kind, G.from_wkt))
define("st_makepoint", (NUM, NUM), GEOM, "st_point")(G.point)
define("st_makepointm", (NUM, NUM, NUM), GEOM)(lambda x, y, m: G.Geometry("Point", (x, y, m)))


def _bbox(x0: float, y0: float, x1: float, y1: float) -> G.Geometry:
    """A box; edges of over 120 degrees get way-points."""
    corners, ring = G.box(x0, y0, x1, y1).coords[0], []
    for a, b in zip(corners, corners[1:]):
        n = max(1, -(-abs(b[0] - a[0]) // 120)) if a[1] == b[1] else 1
        ring += [(a[0] + (b[0] - a[0]) * k / n, a[1]) if k else a for k in range(int(n))]
    return G.Geometry("Polygon", [[*ring, corners[-1]]])


define("st_makebbox", (NUM,) * 4, GEOM)(_bbox)
define("st_makebox2d", (GEOM, GEOM), GEOM)(lambda a, b: _bbox(*a.coords[:2], *b.coords[:2]))
define("st_makeline", (GEOMS,), GEOM)(lambda ps: G.Geometry("LineString", [p.coords for p in ps]))
define("st_makepolygon", (GEOM,), GEOM, "st_polygon")(lambda line: G.Geometry("Polygon", [line.coords]))
define("st_geomfromgeohash", (TEXT, INT), GEOM, "st_box2dfromgeohash")(lambda h, bits: G.box(*H.bounds(h, bits)))


def _geohash_centre(h: str, bits: int) -> G.Geometry:
    b = H.bounds(h, bits)
    return G.point((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)


define("st_pointfromgeohash", (TEXT, INT), GEOM)(_geohash_centre)

# accessors


def _nth(items: list, n: int, negative: bool = False):
    if negative and n < 0:
        n += len(items) + 1
    return items[n - 1] if 1 <= n <= len(items) else None


define("st_boundary", (GEOM,), GEOM)(M.boundary)
define("st_coorddim", (GEOM,), INT)(lambda g: 3 if len(next(g.points(), (0, 0))) > 2 and (z := next(g.points())[2]) == z else 2)
define("st_dimension", (GEOM,), INT)(lambda g: g.dimension)
define("st_envelope", (GEOM,), GEOM)(M.envelope)
define("st_exteriorring", (GEOM,), GEOM)(lambda g: G.Geometry("LineString", g.coords[0]) if g.kind == "Polygon" and g.coords else None)
define("st_interiorringn", (GEOM, INT), GEOM)(lambda g, n: G.Geometry("LineString", r) if g.kind == "Polygon" and (r := _nth(g.coords[1:], n)) else None)
define("st_geometryn", (GEOM, INT), GEOM)(lambda g, n: _nth(g.children(), n))
define("st_geometrytype", (GEOM,), TEXT)(lambda g: g.kind)
define("st_isclosed", (GEOM,), BOOL)(lambda g: all(p.coords[0] == p.coords[-1] for p in g.parts() if p.kind == "LineString" and p.coords))
define("st_iscollection", (GEOM,), BOOL)(lambda g: g.kind.startswith("Multi") or g.kind == "GeometryCollection")
define("st_isempty", (GEOM,), BOOL)(lambda g: g.is_empty)
define("st_isring", (GEOM,), BOOL)(lambda g: M.is_simple(g) and (g.kind != "LineString" or not g.coords or g.coords[0] == g.coords[-1]))
define("st_issimple", (GEOM,), BOOL)(M.is_simple)
define("st_isvalid", (GEOM,), BOOL)(M.is_valid)
define("st_numgeometries", (GEOM,), INT)(lambda g: len(g.children()))
define("st_numpoints", (GEOM,), INT)(lambda g: sum(1 for _ in g.points()))
define("st_pointn", (GEOM, INT), GEOM)(lambda g, n: G.Geometry("Point", p) if g.kind == "LineString" and (p := _nth(g.coords, n, True)) else None)
define("st_x", (GEOM,), "float")(lambda g: g.coords[0] if g.kind == "Point" and g.coords else None)
define("st_y", (GEOM,), "float")(lambda g: g.coords[1] if g.kind == "Point" and g.coords else None)
define("st_xd", (GEOM,), NUM)(lambda g: g.coords[0] if g.kind == "Point" and g.coords else None)
define("st_yd", (GEOM,), NUM)(lambda g: g.coords[1] if g.kind == "Point" and g.coords else None)

# casts

for _name, _kind in (("point", "Point"), ("polygon", "Polygon"), ("linestring", "LineString")):
    define(f"st_castto{_name}", (GEOM,), GEOM)(_of_kind(_kind, lambda g: g))
define("st_casttogeometry", (GEOM,), GEOM)(lambda g: g)
define("st_bytearray", (TEXT,), "bytes")(lambda s: s.encode())

# outputs


def _dms(v: float, marks: str) -> str:
    """Degrees by floor, as they have always been printed: 77 for -76.5."""
    deg = int(v // 1)
    rest = abs(v) % 1 * 60
    minutes = int(rest)
    return f"{abs(deg)}°{minutes}'{(rest - minutes) * 60:.3f}\"{marks[v < 0]}"


define("st_asbinary", (GEOM,), "bytes")(G.to_wkb)
define("st_asgeojson", (GEOM,), TEXT)(G.to_geojson)
define("st_astext", (GEOM,), TEXT)(G.to_wkt)
define("st_aslatlontext", (GEOM,), TEXT)(lambda g: f"{_dms(g.coords[1], 'NS')} {_dms(g.coords[0], 'EW')}" if g.kind == "Point" else None)
define("st_geohash", (GEOM, INT), TEXT)(lambda g, bits: H.encode(*M.centroid(g).coords[:2], bits))

# processing

define("st_antimeridiansafegeom", (GEOM,), GEOM, "st_idlsafegeom")(M.antimeridian_safe)
define("st_bufferpoint", (GEOM, NUM), GEOM)(M.buffer_point)
define("st_translate", (GEOM, NUM, NUM), GEOM)(M.translate)
define("st_intersection", (GEOM, GEOM), GEOM)(M.intersection)
define("st_difference", (GEOM, GEOM), GEOM)(M.difference)
define("st_transform", (GEOM, TEXT, TEXT), GEOM)(M.transform)
define("st_convexhull", (GEOM,), GEOM)(lambda g: M.convex_hull(list(g.points())))

# relations and measures

for _f in (R.contains, R.covers, R.crosses, R.disjoint, R.equals, R.intersects, R.overlaps, R.touches, R.within):
    define(f"st_{_f.__name__}", (GEOM, GEOM), BOOL)(_f)
define("st_relate", (GEOM, GEOM), TEXT)(R.relate)
define("st_relatebool", (GEOM, GEOM, TEXT), BOOL)(lambda a, b, p: R.matches(R.relate(a, b), p))
define("st_area", (GEOM,), NUM)(M.area)
define("st_centroid", (GEOM,), GEOM)(M.centroid)
define("st_closestpoint", (GEOM, GEOM), GEOM)(lambda a, b: G.point(*got[0]) if (got := M.closest_points(a, b)) else None)
define("st_distance", (GEOM, GEOM), NUM)(M.distance)
define("st_length", (GEOM,), NUM)(M.length)
define("st_lengthsphere", (GEOM,), NUM)(lambda g: M.along(g, M.sphere_distance))
define("st_lengthspheroid", (GEOM,), NUM)(lambda g: M.along(g, M.spheroid_distance))
_first = lambda g: next(g.points())
define("st_distancesphere", (GEOM, GEOM), NUM)(lambda a, b: M.sphere_distance(_first(a), _first(b)))
define("st_distancespheroid", (GEOM, GEOM), NUM)(lambda a, b: M.spheroid_distance(_first(a), _first(b)))
_pair = lambda f: lambda gs: f(_first(gs[0]), _first(gs[1])) if len(gs) > 1 else None
define("st_aggregatedistancesphere", (GEOMS,), NUM)(_pair(M.sphere_distance))
define("st_aggregatedistancespheroid", (GEOMS,), NUM)(_pair(M.spheroid_distance))


def convex_hull(df, geom: str, *keys: str):
    """Hull of a geometry column, by keys: each batch sends only its partial hulls."""

    def partial(batches):
        for b in batches:
            rows = b.to_pylist()
            groups: dict = {}
            for r in rows:
                if r[geom] is not None:
                    groups.setdefault(tuple(r[k] for k in keys), []).extend(p[:2] for p in _parsed(bytes(r[geom])).points())
            out = [{**dict(zip(keys, k, strict=True)), geom: G.to_wkb(M.convex_hull(p))} for k, p in groups.items()]
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    @F.arrow_udf(T.BinaryType())
    def hull(c: pa.Array) -> bytes:
        return G.to_wkb(M.convex_hull([p for v in c.to_pylist() for p in _parsed(bytes(v)).points()]))

    cols = df.select(*keys, geom)
    return cols.mapInArrow(partial, cols.schema).groupBy(*keys).agg(hull(geom).alias("convexHull"))
