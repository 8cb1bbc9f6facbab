"""Geometry values and their text, binary and JSON forms.

A geometry has a kind and coordinates: for a Point a tuple (empty: None), for a
LineString a list of tuples, for a Polygon a list of rings; multi-geometries hold a
list of these, a GeometryCollection a list of geometries. A third ordinate may
follow x and y; it takes part in no computation.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
_NAMES = {k.upper(): k for k in KINDS}
_PART = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


@dataclass(frozen=True, eq=False)
class Geometry:
    kind: str
    coords: Any

    def parts(self) -> list[Geometry]:
        """The simple geometries it is made of."""
        if self.kind == "GeometryCollection":
            return [p for g in self.coords for p in g.parts()]
        if self.kind in _PART:
            return [Geometry(_PART[self.kind], c) for c in self.coords]
        return [self]

    def children(self) -> list[Geometry]:
        """Members of a collection, one level down; else itself."""
        return list(self.coords) if self.kind == "GeometryCollection" else self.parts()

    def points(self) -> Iterator[tuple[float, ...]]:
        for p in self.parts():
            if p.kind == "Point":
                if p.coords is not None:
                    yield p.coords
            elif p.kind == "LineString":
                yield from p.coords
            else:
                for ring in p.coords:
                    yield from ring

    @property
    def is_empty(self) -> bool:
        return next(self.points(), None) is None

    def bounds(self) -> tuple[float, float, float, float] | None:
        pts = list(self.points())
        if not pts:
            return None
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def dimension(self) -> int:
        return max((("Point", "LineString", "Polygon").index(p.kind) for p in self.parts()), default=0)


def point(x: float, y: float) -> Geometry:
    return Geometry("Point", (float(x), float(y)))


def box(x0: float, y0: float, x1: float, y1: float) -> Geometry:
    return Geometry("Polygon", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])


# text

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def from_wkt(text: str) -> Geometry:
    at = 0
    text = re.sub(r"^\s*SRID=\d+;", "", text)

    def take() -> str:
        nonlocal at
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not WKT: {text[:60]!r}")
        at = m.end()
        return m.group(1)

    def peek() -> str:
        nonlocal at
        old = at
        out = take() if text[at:].strip() else ""
        at = old
        return out

    def listed(item) -> list:
        if peek().upper() == "EMPTY":
            take()
            return []
        if take() != "(":
            raise ValueError(f"not WKT: {text[:60]!r}")
        out = [item()]
        while (t := take()) == ",":
            out.append(item())
        if t != ")":
            raise ValueError(f"not WKT: {text[:60]!r}")
        return out

    def position() -> tuple[float, ...]:
        out = []
        while re.match(r"[-+.\d]", peek()):
            out.append(float(take()))
        if len(out) < 2:
            raise ValueError(f"not WKT: {text[:60]!r}")
        return tuple(out)

    def maybe_wrapped() -> Any:
        if peek() == "(":
            return listed(position)[0]
        return position()

    def tagged() -> Geometry:
        kind = _NAMES.get(take().upper())
        if kind is None:
            raise ValueError(f"not WKT: {text[:60]!r}")
        if peek().upper() in ("Z", "M", "ZM"):
            take()
        if kind == "Point":
            got = listed(position)
            return Geometry(kind, got[0] if got else None)
        if kind == "GeometryCollection":
            return Geometry(kind, listed(tagged))
        if kind == "LineString":
            return Geometry(kind, listed(position))
        if kind == "MultiPoint":
            return Geometry(kind, listed(maybe_wrapped))
        if kind == "MultiPolygon":
            return Geometry(kind, listed(lambda: listed(lambda: listed(position))))
        return Geometry(kind, listed(lambda: listed(position)))

    out = tagged()
    if text[at:].strip():
        raise ValueError(f"not WKT: {text[:60]!r}")
    return out


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


def to_wkt(g: Geometry) -> str:
    def pos(p: tuple) -> str:
        return " ".join(number(v) for v in p)

    def seq(c: list) -> str:
        return "(" + ", ".join(pos(p) for p in c) + ")"

    def rings(c: list) -> str:
        return "(" + ", ".join(seq(r) for r in c) + ")"

    name = g.kind.upper()
    if not g.coords:
        return f"{name} EMPTY"
    body = {
        "Point": lambda c: f"({pos(c)})",
        "LineString": seq,
        "Polygon": rings,
        "MultiPoint": lambda c: "(" + ", ".join(f"({pos(p)})" for p in c) + ")",
        "MultiLineString": rings,
        "MultiPolygon": lambda c: "(" + ", ".join(rings(p) for p in c) + ")",
        "GeometryCollection": lambda c: "(" + ", ".join(to_wkt(p) for p in c) + ")",
    }[g.kind](g.coords)
    return f"{name} {body}"


# binary


def from_wkb(data: bytes) -> Geometry:
    data, at = bytes(data), 0

    def read() -> Geometry:
        nonlocal at
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & 0x20000000:  # with an SRID
            at += 4
        n = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        n = max(n, (2, 3, 3, 4)[code // 1000])
        kind = KINDS[code % 1000 - 1]

        def count() -> int:
            nonlocal at
            (k,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return k

        def pos() -> tuple:
            nonlocal at
            v = struct.unpack_from(order + "d" * n, data, at)
            at += 8 * n
            return v

        if kind == "Point":
            v = pos()
            return Geometry(kind, None if v[0] != v[0] else v)
        if kind == "LineString":
            return Geometry(kind, [pos() for _ in range(count())])
        if kind == "Polygon":
            return Geometry(kind, [[pos() for _ in range(count())] for _ in range(count())])
        parts = [read() for _ in range(count())]
        return Geometry(kind, parts if kind == "GeometryCollection" else [p.coords for p in parts])

    return read()


def to_wkb(g: Geometry) -> bytes:
    n = max((len(p) for p in g.points()), default=2)
    head = lambda kind: struct.pack("<BI", 1, KINDS.index(kind) + 1 + (1000 if n > 2 else 0))
    fill = lambda p: (*p, *[float("nan")] * n)[:n]

    def seq(c: list) -> bytes:
        return struct.pack("<I", len(c)) + b"".join(struct.pack("<" + "d" * n, *fill(p)) for p in c)

    def write(g: Geometry) -> bytes:
        if g.kind == "Point":
            return head("Point") + struct.pack("<" + "d" * n, *(fill(g.coords) if g.coords else [float("nan")] * n))
        if g.kind == "LineString":
            return head(g.kind) + seq(g.coords)
        if g.kind == "Polygon":
            return head(g.kind) + struct.pack("<I", len(g.coords)) + b"".join(map(seq, g.coords))
        parts = g.children()
        return head(g.kind) + struct.pack("<I", len(parts)) + b"".join(map(write, parts))

    return write(g)


# JSON


def to_geojson(g: Geometry) -> str:
    def plain(g: Geometry) -> dict:
        if g.kind == "GeometryCollection":
            return {"type": g.kind, "geometries": [plain(p) for p in g.coords]}
        return {"type": g.kind, "coordinates": g.coords or []}

    return json.dumps(plain(g), separators=(",", ":"))


def from_geojson(text: str) -> Geometry:
    def deep(c: Any) -> Any:
        return tuple(map(float, c)) if c and isinstance(c[0], int | float) else [deep(x) for x in c]

    def read(d: dict) -> Geometry:
        if d["type"] == "Feature":
            return read(d["geometry"])
        if d["type"] == "GeometryCollection":
            return Geometry(d["type"], [read(x) for x in d["geometries"]])
        return Geometry(d["type"], deep(d["coordinates"]) or (None if d["type"] == "Point" else []))

    return read(json.loads(text))
