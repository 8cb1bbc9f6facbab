"""ECQL filters and transforms as Columns.

A recursive-descent parser makes Columns directly, so Catalyst sees plain
comparisons and pushes them to the scan. Where the geometry is held as a point in
two number columns, boxes become ranges on them; else a geometry is a WKB column,
and a predicate on it is a check of the bounds, if there are columns for them, and
the exact one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native
from ..functions.st import column_function
from ..geom import model as G
from ..geom.relate import tolerance
from ..types import FID

_TOKEN = re.compile(
    r"""\s*(?:(?P<time>\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?Z?)|(?P<period>P(?=[\dT])(?:\d+[YMWD])*(?:T(?:\d+(?:\.\d+)?[HMS])+)?)(?![A-Za-z0-9_])"""
    r"""|(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>'(?:[^']|'')*')|(?P<name>"[^"]*"|[A-Za-z_$][\w$.]*)|(?P<op><>|<=|>=|!=|[-+*/=<>(),]))"""
)
_UNITS = {"meters": 1.0, "metre": 1.0, "metres": 1.0, "m": 1.0, "kilometers": 1000.0, "km": 1000.0, "feet": 0.3048, "statute miles": 1609.347, "nautical miles": 1852.0}
_SPATIAL = ("INTERSECTS", "CONTAINS", "WITHIN", "OVERLAPS", "CROSSES", "TOUCHES", "DISJOINT", "EQUALS")
_TEMPORAL = ("BEFORE", "AFTER", "DURING", "TEQUALS", "BEGINS", "BEGUNBY", "ENDS", "ENDEDBY", "MEETS", "METBY", "TOVERLAPS", "OVERLAPPEDBY", "TCONTAINS", "ANYINTERACTS")
_GEOMETRY_WORDS = {k.upper() for k in G.KINDS}


@dataclass
class Layout:
    """Where a feature table keeps its geometry and date. points: geometry -> (lon, lat)
    columns; bounds: geometry -> (xmin, ymin, xmax, ymax) columns beside the WKB."""

    schema: T.StructType
    points: dict[str, tuple[str, str]] = field(default_factory=dict)
    bounds: dict[str, tuple[str, str, str, str]] = field(default_factory=dict)
    fid: str = FID
    loose: bool = False  # predicates of points and boxes by bounds alone
    functions: dict = field(default_factory=dict)


@dataclass
class _Geom:
    name: str | None = None
    value: G.Geometry | None = None


def seconds_of(period: str) -> timedelta:
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", period)
    y, mo, w, d, h, mi, s = (float(x or 0) for x in m.groups())
    return timedelta(days=y * 365 + mo * 30 + w * 7 + d, hours=h, minutes=mi, seconds=s)


class Parser:
    def __init__(self, text: str, layout: Layout, now: datetime | None = None):
        self.text, self.layout, self.now = text, layout, now or datetime.now(UTC)
        self.toks: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not a filter: {text[at : at + 40]!r}")
            self.toks.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0

    # tokens

    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k][1].upper() if self.i + k < len(self.toks) and self.toks[self.i + k][0] != "str" else ""

    def take(self, *want: str) -> str:
        if self.i >= len(self.toks) or (want and self.peek() not in want):
            raise ValueError(f"expected {' or '.join(want) or 'more'} in {self.text!r}")
        self.i += 1
        return self.toks[self.i - 1][1]

    def has(self, *want: str) -> bool:
        if self.peek() in want:
            self.i += 1
            return True
        return False

    # filters

    def filter(self) -> Column:
        out = self.either()
        if self.i < len(self.toks):
            raise ValueError(f"can't read {self.toks[self.i][1]!r} in {self.text!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.has("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.has("AND"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.has("NOT"):
            return ~self.one()
        word = self.peek()
        if word == "INCLUDE":
            self.take()
            return F.lit(True)
        if word == "EXCLUDE":
            self.take()
            return F.lit(False)
        if word == "IN" and self.peek(1) == "(":
            self.take()
            return F.col(self.layout.fid).isin([str(v) for v in self.values()])
        if word == "BBOX" and self.peek(1) == "(":
            return self.bbox()
        if word in _SPATIAL and self.peek(1) == "(":
            return self.spatial()
        if word in ("DWITHIN", "BEYOND") and self.peek(1) == "(":
            return self.dwithin()
        if word == "(":
            mark = self.i
            try:
                self.take()
                out = self.either()
                self.take(")")
                if self.peek() in ("", "AND", "OR", ")"):
                    return out
            except ValueError:
                pass
            self.i = mark
        return self.comparison()

    def comparison(self) -> Column:
        left, kind = self.expression()
        no = self.has("NOT")
        word = self.peek()
        if word in ("LIKE", "ILIKE"):
            self.take()
            pattern = self.string()
            out = F.ilike(left, F.lit(pattern)) if word == "ILIKE" else left.like(pattern)
        elif word == "IN":
            self.take()
            values = self.values()
            if isinstance(kind, T.ArrayType):
                out = F.arrays_overlap(left, F.array(*[F.lit(v) for v in values]))
            else:
                out = left.isin([self.bound(v, kind) for v in values])
        elif word == "BETWEEN":
            self.take()
            low = self.expression()[0]
            self.take("AND")
            high = self.expression()[0]
            out = (left >= self.cast(low, kind)) & (left <= self.cast(high, kind))
        elif word == "IS":
            self.take()
            not_null = self.has("NOT")
            self.take("NULL")
            out = left.isNotNull() if not_null else left.isNull()
        elif word in _TEMPORAL:
            out = self.temporal(left)
        else:
            op = self.take("=", "<>", "!=", "<", "<=", ">", ">=")
            right, other = self.expression()
            right = self.cast(right, kind) if kind is not None and other is None else right
            out = {"=": lambda: left == right, "<>": lambda: left != right, "!=": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right}[op]()
        return ~out if no else out

    def temporal(self, left: Column) -> Column:
        """An instant against an instant or a period, whose ends are its begin and end."""
        op = self.take().upper()
        if self.peek() == "OR" and self.peek(1) in ("DURING", "AFTER"):
            self.take()
            op += " OR " + self.take().upper()
        period = op not in ("BEFORE", "AFTER", "TEQUALS") or self.peek(1) == "/"
        if not period:
            a = self.instant()
            return left < a if op == "BEFORE" else left > a if op == "AFTER" else left == a
        a, b = self.interval()
        tests = {
            "BEFORE": lambda: left < a, "AFTER": lambda: left > b, "DURING": lambda: (left > a) & (left < b), "BEFORE OR DURING": lambda: left < b, "DURING OR AFTER": lambda: left > a,
            "BEGINS": lambda: left == a, "MEETS": lambda: left == a, "ENDS": lambda: left == b, "METBY": lambda: left == b, "ANYINTERACTS": lambda: (left >= a) & (left <= b), "TEQUALS": lambda: (left == a) & (left == b),
            # what only periods can be to each other
            "TOVERLAPS": lambda: F.lit(False), "OVERLAPPEDBY": lambda: F.lit(False), "TCONTAINS": lambda: F.lit(False), "BEGUNBY": lambda: F.lit(False), "ENDEDBY": lambda: F.lit(False),
        }
        return tests[op]()

    def instant(self) -> Column:
        return F.lit(self.time(self.take()))

    @staticmethod
    def time(text: str) -> datetime:
        return datetime.fromisoformat(text.strip("'").replace("Z", "+00:00")).replace(tzinfo=UTC)

    def interval(self) -> tuple[Column, Column]:
        a = self.take()
        self.take("/")
        b = self.take()
        if a[0] == "P":
            end = self.time(b)
            return F.lit(end - seconds_of(a)), F.lit(end)
        start = self.time(a)
        return F.lit(start), F.lit(start + seconds_of(b) if b[0] == "P" else self.time(b))

    def values(self) -> list:
        self.take("(")
        out = [self.plain()]
        while self.has(","):
            out.append(self.plain())
        self.take(")")
        return out

    def plain(self):
        sign = -1 if self.has("-") else 1
        kind, v = self.toks[self.i]
        self.i += 1
        if kind == "num":
            return sign * (float(v) if re.search(r"[.eE]", v) else int(v))
        if kind == "str":
            return v[1:-1].replace("''", "'")
        if v.upper() in ("TRUE", "FALSE"):
            return v.upper() == "TRUE"
        return v

    def string(self) -> str:
        v = self.plain()
        if not isinstance(v, str):
            raise ValueError(f"expected a string in {self.text!r}")
        return v

    @staticmethod
    def bound(v, kind: T.DataType | None):
        return v if kind is None else F.lit(v).cast(kind)

    @staticmethod
    def cast(c: Column, kind: T.DataType | None) -> Column:
        return c if kind is None or isinstance(kind, T.ArrayType | T.MapType) else c.cast(kind)

    # expressions

    def expression(self) -> tuple[Column, T.DataType | None]:
        """(column, its type if it is an attribute)."""
        left, kind = self.term()
        while self.peek() in ("+", "-"):
            op, (right, _) = self.take(), self.term()
            left, kind = (left + right if op == "+" else left - right), None
        return left, kind

    def term(self) -> tuple[Column, T.DataType | None]:
        left, kind = self.factor()
        while self.peek() in ("*", "/"):
            op, (right, _) = self.take(), self.factor()
            left, kind = (left * right if op == "*" else left / right), None
        return left, kind

    def factor(self) -> tuple[Column, T.DataType | None]:
        if self.has("("):
            out = self.expression()
            self.take(")")
            return out
        if self.i >= len(self.toks):
            raise ValueError(f"{self.text!r} ends too early")
        kind, v = self.toks[self.i]
        if kind == "time":
            return self.instant(), None
        if kind == "name" and v.upper() not in ("TRUE", "FALSE"):
            if self.peek(1) == "(":
                return self.call(), None
            self.take()
            return self.attribute(v.strip('"'))
        return F.lit(self.plain()), None

    def attribute(self, name: str) -> tuple[Column, T.DataType | None]:
        if name.startswith("$."):  # a path into a JSON attribute
            at, _, path = name[2:].partition(".")
            return F.get_json_object(F.col(at), "$." + path), T.StringType()
        for f in self.layout.schema:
            if f.name == name:
                return F.col(name), f.dataType
        raise ValueError(f"no attribute {name!r}")

    def call(self) -> Column:
        name = self.take()
        self.take("(")
        args: list[Column] = []
        raw: list = []
        while self.peek() != ")":
            raw.append(self.toks[self.i][1])
            args.append(self.expression()[0])
            if not self.has(","):
                break
        self.take(")")
        low = name.lower()
        if low in self.layout.functions:
            return self.layout.functions[low](*args)
        if low == "jsonpath":
            at, _, path = raw[0].strip("'\"")[2:].partition(".")
            return F.get_json_object(F.col(at), "$." + path)
        if low == "currentdate":
            return F.lit(self.now + (seconds_of(raw[0].strip("'")) if raw else timedelta()))
        known = {
            "strconcat": F.concat, "concatenate": F.concat, "strtolowercase": F.lower, "strtouppercase": F.upper, "strtrim": F.trim, "strlength": F.length, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round,
            "sqrt": F.sqrt, "min": F.least, "max": F.greatest, "datetolong": F.unix_millis, "isnull": F.isnull, "strsubstring": lambda s, a, b: F.substring(s, a + 1, b - a), "strreplace": F.replace, "area": None, "proxyid": F.hash,
        }
        if known.get(low) is None:
            return column_function(low if low.startswith("st_") else f"st_{low}")(*args)
        return known[low](*args)

    # geometry

    def geometry(self) -> _Geom:
        word = self.peek()
        if word not in _GEOMETRY_WORDS:
            return _Geom(name=self.take().strip('"'))
        depth, parts = 0, []
        while True:
            t = self.take()
            parts.append(t)
            depth += (t == "(") - (t == ")")
            if not depth and len(parts) > 1:
                break
        return _Geom(value=G.from_wkt(re.sub(r"- ", "-", " ".join(parts))))

    def bbox(self) -> Column:
        self.take()
        self.take("(")
        name = self.take().strip('"')
        v = []
        while self.has(","):
            v.append(self.plain())
        self.take(")")
        return self.in_geometry("INTERSECTS", name, G.box(*map(float, v[:4])), rectangle=tuple(map(float, v[:4])))

    def spatial(self) -> Column:
        op = self.take().upper()
        self.take("(")
        a = self.geometry()
        self.take(",")
        b = self.geometry()
        self.take(")")
        if a.name is None and b.name is None:
            raise ValueError("a spatial predicate needs an attribute")
        if a.name is None:
            a, b = b, a
            op = {"CONTAINS": "WITHIN", "WITHIN": "CONTAINS"}.get(op, op)
        if b.name is not None:
            return column_function(f"st_{op.lower()}")(F.col(a.name), F.col(b.name))
        return self.in_geometry(op, a.name, b.value)

    def in_geometry(self, op: str, name: str, value: G.Geometry, rectangle: tuple | None = None) -> Column:
        """A predicate of an attribute against a fixed geometry, trimmed to the world."""
        x0, y0, x1, y1 = value.bounds()
        if rectangle is None and value.kind == "Polygon" and len(value.coords) == 1 and len(value.coords[0]) == 5 and {p[:2] for p in value.coords[0]} == {(x0, y0), (x0, y1), (x1, y0), (x1, y1)}:
            rectangle = (x0, y0, x1, y1)
        if rectangle and op == "INTERSECTS":
            if x0 <= -180 and y0 <= -90 and x1 >= 180 and y1 >= 90:
                return F.lit(True)
            if x0 > 180 or x1 < -180:  # all of it beyond the antimeridian
                k = 360.0 * ((x0 + 180) // 360)
                return self.in_geometry(op, name, G.box(x0 - k, y0, x1 - k, y1), (x0 - k, y0, x1 - k, y1))
            if x1 > 180 or x0 < -180:  # the part beyond it comes in on the other side
                inner, over = (max(x0, -180.0), y0, min(x1, 180.0), y1), ((-180.0, y0, x1 - 360, y1) if x1 > 180 else (x0 + 360, y0, 180.0, y1))
                return self.in_geometry(op, name, G.box(*inner), inner) | self.in_geometry(op, name, G.box(*over), over)
        at = self.layout.points.get(name)
        if at:
            lon, lat = map(F.col, at)
            # the world has one longitude for those beyond the antimeridian
            shifts = [0.0, *([360.0] if x1 > 180 else []), *([-360.0] if x0 < -180 else [])]
            any_of = lambda f: reduce(Column.__or__, map(f, shifts))
            inside = any_of(lambda s: native.in_box(lon, lat, x0 - s, y0, x1 - s, y1))
            if (rectangle and op == "INTERSECTS") or (self.layout.loose and op != "DISJOINT"):
                return inside
            if rectangle and op in ("WITHIN", "DISJOINT"):
                return any_of(lambda s: (lon > x0 - s) & (lon < x1 - s) & (lat > y0) & (lat < y1)) if op == "WITHIN" else ~inside
            areas = [p.coords for p in value.parts() if p.kind == "Polygon" and p.coords]
            if areas and len(areas) == len(value.parts()) and op in ("INTERSECTS", "WITHIN", "DISJOINT", "TOUCHES"):
                found = [native.polygon_location(lon, lat, areas, tolerance(value), s) for s in shifts]
                found = found[0] if len(found) == 1 else F.greatest(*found)
                return ~(inside & (found >= 0)) if op == "DISJOINT" else inside & {"INTERSECTS": found >= 0, "WITHIN": found == 1, "TOUCHES": found == 0}[op]
            exact = any_of(lambda s: column_function(f"st_{op.lower()}")(column_function("st_makepoint")(lon + s, lat), F.lit(G.to_wkb(value)))) if op != "DISJOINT" else ~any_of(lambda s: column_function("st_intersects")(column_function("st_makepoint")(lon + s, lat), F.lit(G.to_wkb(value))))
            return exact if op == "DISJOINT" else inside & exact
        exact = column_function(f"st_{op.lower()}")(F.col(name), F.lit(G.to_wkb(value)))
        bounds = self.layout.bounds.get(name)
        if self.layout.loose and bounds and op != "DISJOINT":
            return native.boxes_meet(bounds, (x0, y0, x1, y1))
        return exact if op == "DISJOINT" or not bounds else native.boxes_meet(bounds, (x0, y0, x1, y1)) & exact

    def dwithin(self) -> Column:
        op = self.take().upper()
        self.take("(")
        a = self.geometry()
        self.take(",")
        b = self.geometry()
        self.take(",")
        metres = float(self.plain())
        self.take(",")
        unit = self.take().strip("'\"").lower()
        while self.peek() != ")":
            unit += " " + self.take().lower()
        self.take(")")
        name, value = (a.name, b.value) if a.name else (b.name, a.value)
        metres *= _UNITS.get(unit, 1.0)
        at = self.layout.points.get(name)
        if at and value.kind == "Point":
            lon, lat = map(F.col, at)
            x, y = value.coords[:2]
            high = metres / native.EARTH_RADIUS * 180 / 3.141592653589793 * 1.000001
            near = (lat >= y - high) & (lat <= y + high)
            if abs(y) + high < 90:  # no pole is within reach, so longitudes have bounds
                wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(high)) / math.cos(math.radians(y))))) * 1.000001
                near = near & reduce(Column.__or__, [(lon >= x - wide + s) & (lon <= x + wide + s) for s in (0.0, *([-360.0] if x + wide > 180 else []), *([360.0] if x - wide < -180 else []))])
            near = near & (native.distance_sphere(lon, lat, x, y) <= metres)
        else:
            g = column_function("st_makepoint")(*map(F.col, at)) if at else F.col(name)
            nearest = column_function("st_closestpoint")
            near = column_function("st_distancesphere")(nearest(g, F.lit(G.to_wkb(value))), nearest(F.lit(G.to_wkb(value)), g)) <= metres
        return ~near if op == "BEYOND" else near


def ecql(text: str, layout: Layout, now: datetime | None = None) -> Column:
    """The filter as a boolean Column."""
    return Parser(text, layout, now).filter()


def transform(text: str, layout: Layout) -> Column:
    """``name``, ``new=old`` or ``new=expression`` as a named Column."""
    name, eq, rest = text.partition("=")
    p = Parser(rest if eq else name, layout)
    out = p.expression()[0]
    if p.i < len(p.toks):
        raise ValueError(f"can't read {text!r}")
    return out.alias(name.strip())


def mongo(query: dict, layout: Layout) -> Column:
    """A query object: {} all, equality, $lt $lte $gt $gte, $bbox $intersects $within $contains
    $dwithin on a geometry, and $or over a list."""
    import json

    out = F.lit(True)
    p = Parser("", layout)
    for key, want in query.items():
        if key == "$or":
            any_of = F.lit(False)
            for q in want:
                any_of = any_of | mongo(q, layout)
            out = out & any_of
            continue
        if not isinstance(want, dict):
            out = out & (p.attribute(key if "." not in key else "$." + key)[0] == F.lit(want))
            continue
        for op, v in want.items():
            if op == "$bbox":
                out = out & p.in_geometry("INTERSECTS", key, G.box(*map(float, v)), tuple(map(float, v)))
            elif op in ("$intersects", "$within", "$contains"):
                out = out & p.in_geometry(op[1:].upper(), key, G.from_geojson(json.dumps(v["$geometry"])))
            elif op == "$dwithin":
                g = G.to_wkt(G.from_geojson(json.dumps(v["$geometry"])))
                out = out & ecql(f"DWITHIN({key}, {g}, {float(v['$dist'])}, {v.get('$unit', 'meters')})", layout)
            else:
                a = p.attribute(key if "." not in key else "$." + key)[0]
                out = out & {"$lt": a.__lt__, "$lte": a.__le__, "$gt": a.__gt__, "$gte": a.__ge__}[op](F.lit(v))
    return out


def visible(label: str | None, auths: set[str]) -> bool:
    """Whether a visibility label, of names with & (binding tighter), | and brackets, is met;
    no label is visible."""
    if not label or not label.strip():
        return True
    toks, at = re.findall(r'"[^"]*"|[\w.:/-]+|[&|()]', label), 0

    def any_of() -> bool:
        nonlocal at
        out = all_of()
        while at < len(toks) and toks[at] == "|":
            at += 1
            out = all_of() or out
        return out

    def all_of() -> bool:
        nonlocal at
        out = one()
        while at < len(toks) and toks[at] == "&":
            at += 1
            out = one() and out
        return out

    def one() -> bool:
        nonlocal at
        t = toks[at]
        at += 1
        if t == "(":
            out = any_of()
            at += 1
            return out
        return t.strip('"') in auths

    return any_of()


def visibility(column: str, auths: set[str]) -> Column:
    """Rows whose label the authorisations meet; a null label is visible. Each distinct label of a task
    is judged once."""
    allowed = frozenset(auths)
    judged: dict[str, bool] = {}

    @F.arrow_udf(T.BooleanType())
    def met(labels: pa.Array) -> pa.Array:
        plain = labels.dictionary_encode()
        names = plain.dictionary.to_pylist()
        for x in names:
            if x not in judged:
                if len(judged) > 100_000:
                    judged.clear()
                judged[x] = visible(x, allowed)
        return pa.array([judged[x] for x in names], pa.bool_()).take(plain.indices)

    return F.col(column).isNull() | F.coalesce(met(F.col(column)), F.lit(True))
