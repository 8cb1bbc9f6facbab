"""One query over a feature table: filter, transform, sample, output mode, sort, limit, reprojection."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..geom.model import from_wkt
from ..operators import aggregates, tracks
from .ecql import Layout, ecql, mongo, transform


@dataclass
class Query:
    """Steps run in the order of the fields. density: (lon, lat, bounds, width, height, weight);
    stats: a statistics text; bin: (track, lon, lat, time[, label])."""

    filter: str | dict = "INCLUDE"
    transforms: list[str] | None = None
    sampling: float | None = None
    sample_by: str | None = None
    density: tuple | None = None
    stats: str | None = None
    bin: tuple | None = None
    sort: list[tuple[str, bool]] = field(default_factory=list)  # (name, descending)
    limit: int | None = None
    reproject: tuple[str, str, str] | None = None  # (geometry, from, to)
    interceptors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    guards: list[Callable[[Query, Layout], None]] = field(default_factory=list)
    loose: bool = False  # spatial predicates of points by their bounds alone
    audits: list[Callable[[dict], None]] = field(default_factory=list)  # are told of each query


class Refused(Exception):
    """A guard has refused a query."""


def run(df: DataFrame, query: Query, layout: Layout) -> DataFrame | dict | list:
    for guard in query.guards:
        guard(query, layout)
    for tell in query.audits:
        hints = {k: v for k, v in vars(query).items() if v not in (None, [], False) and k not in ("filter", "transforms", "interceptors", "guards", "audits")}
        tell({"time": datetime.now(UTC).isoformat(), "filter": query.filter, "transforms": query.transforms, "hints": hints})
    layout = replace(layout, loose=True) if query.loose else layout
    for rewrite in query.interceptors:
        df = rewrite(df)
    df = df.where(mongo(query.filter, layout) if isinstance(query.filter, dict) else ecql(query.filter, layout))
    if query.sampling and query.sampling <= 0.5:
        order = [layout.fid] if layout.fid in df.columns else df.columns[:1]
        df = tracks.every_nth(df, query.sampling, order, query.sample_by)
    if query.density:
        return aggregates.density(df, *query.density)
    if query.stats:
        return aggregates.statistics(df, query.stats)
    if query.bin:
        from ..sources.export import bin_records

        return bin_records(df, *query.bin)
    columns: list[Column] | None = None
    if query.transforms is not None:
        columns = [transform(t, layout) for t in query.transforms]
        names = [t.partition("=")[0].strip() for t in query.transforms]
        columns += [F.col(n) for n, _ in query.sort if n and n not in names]  # sort attributes stay in the result
        if layout.fid in df.columns and layout.fid not in names:
            columns.insert(0, F.col(layout.fid))
    if columns is not None:
        df = df.select(*columns)
    if query.sort:
        df = df.orderBy(*[(F.col(n or layout.fid).desc() if down else F.col(n or layout.fid).asc()) for n, down in query.sort])
    if query.limit is not None:
        df = df.limit(query.limit)
    if query.reproject:
        from ..functions.st import column_function

        geom, source, target = query.reproject
        df = df.withColumn(geom, column_function("st_transform")(F.col(geom), F.lit(source), F.lit(target)))
    return df


# guards


def _top_level(text: str, word: str) -> list[str]:
    """The parts of a filter between the words that stand outside brackets and quotes."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    between = False  # after BETWEEN the next AND belongs to it
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif not depth and (m := re.compile(r"\b(and|or|between)\b", re.I).match(text, i)):
            found = m[1].lower()
            if found == word and not (between and found == "and"):
                out.append(text[start:i])
                start = m.end()
            between = found == "between" or (between and found != "and")
            i = m.end()
            continue
        i += 1
    return [*out, text[start:]]


def _bounds(text: str) -> tuple[float | None, timedelta | None]:
    """Area in square degrees and duration that a filter's boxes and intervals bound: of alternatives
    the sum and the longest, where each has one, of conditions together the least; a negated part
    bounds nothing."""
    from .ecql import Parser, seconds_of

    text = text.strip()
    while text.startswith("(") and text.endswith(")") and _closes_last(text):
        text = text[1:-1].strip()
    for word in ("or", "and"):
        parts = _top_level(text, word)
        if len(parts) > 1:
            areas, spans = zip(*map(_bounds, parts))
            if word == "or":
                return None if None in areas else sum(areas), None if None in spans else max(spans)
            return min((a for a in areas if a is not None), default=None), min((s for s in spans if s is not None), default=None)
    if re.match(r"not\b", text, re.I):
        return None, None
    if m := re.match(r"BBOX\s*\(\s*[^,]+,\s*([-\d.eE]+)\s*,\s*([-\d.eE]+)\s*,\s*([-\d.eE]+)\s*,\s*([-\d.eE]+)", text, re.I):
        x0, y0, x1, y1 = map(float, m.groups())
        return max(0.0, x1 - x0) * max(0.0, y1 - y0), None
    if m := re.match(r"(INTERSECTS|WITHIN|CONTAINS|OVERLAPS|CROSSES|TOUCHES|EQUALS)\s*\(\s*\w+\s*,\s*(.*)\)$", text, re.I | re.S):
        b = from_wkt(m[2]).bounds() if re.match(r"(multi)?(polygon|linestring|point)|geometrycollection", m[2], re.I) else None
        return (None if b is None else (b[2] - b[0]) * (b[3] - b[1])), None
    if m := re.match(r"\S+\s+DURING\s+(\S+?)\s*/\s*(\S+)", text, re.I):
        a, b = m[1], m[2].rstrip(")")
        return None, seconds_of(a) if a[0] == "P" else seconds_of(b) if b[0] == "P" else Parser.time(b) - Parser.time(a)
    return None, None


def _closes_last(text: str) -> bool:
    """The first bracket is closed by the last character."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(text) - 1
    return False


def no_full_scan(query: Query, layout: Layout) -> None:
    if isinstance(query.filter, str) and query.filter.strip().upper() in ("INCLUDE", "") and query.limit is None:
        raise Refused("a query over the full table")


def at_most(duration: timedelta) -> Callable[[Query, Layout], None]:
    def guard(query: Query, layout: Layout) -> None:
        span = _bounds(str(query.filter))[1]
        if span is None or span > duration:
            raise Refused(f"a query over more than {duration}")

    return guard


def graduated(steps: list[tuple[float | None, timedelta]]) -> Callable[[Query, Layout], None]:
    """steps: (area in square degrees or None for any, longest duration), by rising area."""

    def guard(query: Query, layout: Layout) -> None:
        area, span = _bounds(str(query.filter))
        area = 360.0 * 180.0 if area is None else area
        for most, duration in steps:
            if most is None or area <= most:
                if span is None or span > duration:
                    raise Refused(f"a query over {area:g} square degrees and more than {duration}")
                return

    return guard


def merged(views: list[tuple[DataFrame, str]], layout: Layout, *, fid: str | None = None, sort: list[tuple[str, bool]] | None = None, limit: int | None = None) -> DataFrame:
    """Union of several tables, each under a filter of its own. With ``fid`` a row that several of them
    have comes once, from the first; with ``sort`` they are merged in its order."""
    parts = [df.where(ecql(text, layout)).withColumn("__rank", F.lit(k)) for k, (df, text) in enumerate(views)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if fid:
        names = [c for c in out.columns if c not in (fid, "__rank")]
        first = out.groupBy(fid).agg(F.min_by(F.struct(*names), "__rank").alias("r"))
        out = first.select(*[F.col(fid) if c == fid else F.col(f"r.{c}").alias(c) for c in out.columns if c != "__rank"])
    else:
        out = out.drop("__rank")
    if sort:
        out = out.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in sort])
    return out if limit is None else out.limit(limit)


def routed(views: dict[frozenset, DataFrame], attributes: set[str], default: DataFrame) -> DataFrame:
    """The table that is registered for a set of attributes that the query uses, else the default."""
    return next((df for names, df in views.items() if names <= attributes), default)


def explain(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
