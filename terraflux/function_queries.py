"""Registered queries that apply the st_* and converter functions to whole tables, with SQL twins.

Shapes are made from integer keys with whole-number corners, so that each result has
a closed form that SQL computes from the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.st import column_function as st
from .operators.joins import spread
from .queries import query
from .sources.convert import Converter, convert_features
from .sources.tables import read


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _keys(spark: SparkSession, d: str, table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """(k, a, b): a key, and two whole numbers of it, in many tasks, since shapes are much work."""
    k = F.col(key)
    return spread(read(spark, d, table).select(key)).select(k.alias("k"), (k % 60).alias("a"), (k % 25).alias("b"))


_K = "(SELECT s_suppkey AS k, s_suppkey % 60 AS a, s_suppkey % 25 AS b FROM supplier)"
_wkt = lambda g: st("st_astext")(g)
_of = lambda *parts: st("st_geomfromwkt")(_text(*parts))
_box = lambda x0, y0, x1, y1: st("st_makebbox")(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in (x0, y0, x1, y1)])
_point = lambda x, y: st("st_makepoint")(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in (x, y)])

_RING = "0 0, {a} 0, {a} 10, 0 10, 0 0"


@query(
    "SELECT k, 'POINT (' || a || ' ' || b || ')' AS point, 'POINT (' || a || ' ' || b || ')' AS point_text, 'POINT (' || a || ' ' || b || ')' AS point_wkb, 'POINT (' || a || ' ' || b || ')' AS wkb, 'POINT (' || a || ' ' || b || ')' AS json, "
    "'LINESTRING (0 0, ' || a || ' ' || b || ')' AS line_text, 'LINESTRING (0 0, ' || a || ' ' || b || ')' AS line, 'MULTIPOINT (0 0, ' || a || ' ' || b || ')' AS mpoint, 'MULTILINESTRING ((0 0, 1 1), (2 2, ' || a || ' ' || b || '))' AS mline, "
    "'MULTIPOLYGON (((0 0, ' || (a + 1) || ' 0, ' || (a + 1) || ' 10, 0 0)))' AS mpoly, 'POLYGON ((0 0, ' || (a + 1) || ' 0, ' || (a + 1) || ' 10, 0 0))' AS poly_text, 'POLYGON ((0 0, ' || (a + 1) || ' 0, ' || (a + 1) || ' 10, 0 0))' AS poly, "
    "((a + 1.0) * (b + 1.0))::DOUBLE AS bbox_area, ((a + 1.0) * (b + 1.0))::DOUBLE AS box2d_area, 3 AS m_dim FROM " + _K
)
def st_constructors(spark: SparkSession, d: str) -> DataFrame:
    A, B = F.col("a"), F.col("b")
    p, t = _text("POINT (", A, " ", B, ")"), _text("POLYGON ((0 0, ", A + 1, " 0, ", A + 1, " 10, 0 0))")
    line = _text("LINESTRING (0 0, ", A, " ", B, ")")
    point = _point(A, B)
    return _keys(spark, d).select(
        "k", _wkt(point).alias("point"), _wkt(st("st_pointfromtext")(p)).alias("point_text"), _wkt(st("st_pointfromwkb")(st("st_asbinary")(point))).alias("point_wkb"), _wkt(st("st_geomfromwkb")(st("st_asbinary")(point))).alias("wkb"),
        _wkt(st("st_geomfromgeojson")(_text('{"type":"Point","coordinates":[', A, ",", B, "]}"))).alias("json"), _wkt(st("st_linefromtext")(line)).alias("line_text"), _wkt(st("st_makeline")(F.array(_point(0, 0), point))).alias("line"),
        F.replace(F.replace(F.replace(_wkt(st("st_mpointfromtext")(_text("MULTIPOINT ((0 0), (", A, " ", B, "))"))), F.lit("(("), F.lit("(")), F.lit("))"), F.lit(")")), F.lit("), ("), F.lit(", ")).alias("mpoint"),
        _wkt(st("st_mlinefromtext")(_text("MULTILINESTRING ((0 0, 1 1), (2 2, ", A, " ", B, "))"))).alias("mline"), _wkt(st("st_mpolyfromtext")(F.concat(F.replace(t, F.lit("POLYGON"), F.lit("MULTIPOLYGON (")), F.lit(")")))).alias("mpoly"),
        _wkt(st("st_polygonfromtext")(t)).alias("poly_text"), _wkt(st("st_makepolygon")(st("st_linefromtext")(_text("LINESTRING (0 0, ", A + 1, " 0, ", A + 1, " 10, 0 0)")))).alias("poly"),
        st("st_area")(_box(0, 0, A + 1, B + 1)).alias("bbox_area"), st("st_area")(st("st_makebox2d")(_point(-1, -1), _point(A, B))).alias("box2d_area"),
        st("st_coorddim")(st("st_makepointm")(A.cast("double"), B.cast("double"), F.lit(7.0))).alias("m_dim"),
    )


@query(
    "SELECT k, 'LINESTRING (0 0, ' || (a + 1) || ' 0, ' || (a + 1) || ' 10, 0 0)' AS boundary, 2 AS coord_dim, 2 AS dim_polygon, 1 AS dim_line, 0 AS dim_point, ((a + 1.0) * 10)::DOUBLE AS envelope_area, "
    "'LINESTRING (0 0, 90 0, 90 90, 0 90, 0 0)' AS exterior, 'LINESTRING (1 1, ' || (a + 2) || ' 1, ' || (a + 2) || ' 30, 1 1)' AS interior, CASE WHEN b % 3 = 0 THEN 'POINT (0 0)' WHEN b % 3 = 1 THEN 'POINT (' || a || ' ' || b || ')' END AS nth, "
    "CASE WHEN b % 2 = 0 THEN 'Point' ELSE 'LineString' END AS kind, b % 2 = 0 AS closed, b % 2 = 1 AS collection, b % 3 = 0 AS empty, b % 2 = 0 AS ring, b % 2 = 0 AS simple, b % 2 = 0 AS valid, 2 + (b % 2)::INT AS n_geoms, 5 + (b % 2)::INT AS n_points, "
    "CASE WHEN b % 4 = 0 THEN NULL WHEN b % 4 = 3 THEN 'POINT (5 6)' ELSE 'POINT (' || CASE b % 4 WHEN 1 THEN a || ' ' || b ELSE '3 4' END || ')' END AS point_n, a::FLOAT AS x, b::FLOAT AS y FROM " + _K
)
def st_accessors(spark: SparkSession, d: str) -> DataFrame:
    A, B = F.col("a"), F.col("b")
    tri = _of("POLYGON ((0 0, ", A + 1, " 0, ", A + 1, " 10, 0 0))")
    holed = _of("POLYGON ((0 0, 90 0, 90 90, 0 90, 0 0), (1 1, ", A + 2, " 1, ", A + 2, " 30, 1 1))")
    line = _of("LINESTRING (", A, " ", B, ", 3 4, 5 6)")
    end = F.when(B % 2 == 0, "0 0").otherwise("0 5")
    crossed = F.when(B % 2 == 0, "0 0, 4 0, 4 4, 0 4, 0 0").otherwise("0 0, 4 4, 4 0, 0 4, 0 0")
    extra = F.when(B % 2 == 1, ", 7 7").otherwise("")
    n = (B % 4).cast("int")
    return _keys(spark, d).select(
        "k", _wkt(st("st_boundary")(tri)).alias("boundary"), st("st_coorddim")(tri).alias("coord_dim"), st("st_dimension")(tri).alias("dim_polygon"), st("st_dimension")(line).alias("dim_line"), st("st_dimension")(_point(A, B)).alias("dim_point"),
        st("st_area")(st("st_envelope")(tri)).alias("envelope_area"), _wkt(st("st_exteriorring")(holed)).alias("exterior"), _wkt(st("st_interiorringn")(holed, F.lit(1))).alias("interior"),
        _wkt(st("st_geometryn")(_of("MULTIPOINT ((0 0), (", A, " ", B, "))"), (B % 3 + 1).cast("int"))).alias("nth"), st("st_geometrytype")(_of(F.when(B % 2 == 0, "POINT (1 2)").otherwise("LINESTRING (0 0, 1 1)"))).alias("kind"),
        st("st_isclosed")(_of("LINESTRING (0 0, 4 0, 4 ", A + 1, ", ", end, ")")).alias("closed"), st("st_iscollection")(_of(F.when(B % 2 == 0, "POINT (1 2)").otherwise("MULTIPOINT ((0 0), (1 1))"))).alias("collection"),
        st("st_isempty")(_of(F.when(B % 3 == 0, "POINT EMPTY").otherwise("POINT (1 2)"))).alias("empty"), st("st_isring")(_of("LINESTRING (0 0, 4 0, 4 ", A + 1, ", ", end, ")")).alias("ring"),
        st("st_issimple")(_of("LINESTRING (", crossed, ")")).alias("simple"), st("st_isvalid")(_of("POLYGON ((", crossed, "))")).alias("valid"), st("st_numgeometries")(_of("MULTIPOINT (0 0, 1 1", extra, ")")).alias("n_geoms"),
        st("st_numpoints")(_of("LINESTRING (0 0, 1 1, 2 3, 4 4, 5 9", extra, ")")).alias("n_points"), _wkt(st("st_pointn")(line, n)).alias("point_n"), st("st_x")(_point(A, B)).alias("x"), st("st_y")(_point(A, B)).alias("y"),
    )


@query(
    "SELECT k, 'POINT (' || a || ' ' || b || ')' AS as_point, 'LINESTRING (0 0, ' || a || ' ' || b || ')' AS as_line, ((a + 1.0) * 5)::DOUBLE AS polygon_area, 'POINT (' || a || ' ' || b || ')' AS as_geometry, hex(encode('k' || k)) AS bytes, "
    "'{{\"type\":\"Point\",\"coordinates\":[' || a || ',' || b || ']}}' AS json, b || '°30''0.000\"N ' || a || '°15''0.000\"E' AS lat_lon, (360.0 * 180.0 / 1024)::DOUBLE AS cell_area, true AS inside, true AS near FROM " + _K
)
def st_casts_and_outputs(spark: SparkSession, d: str) -> DataFrame:
    A, B = F.col("a"), F.col("b")
    p = _point(A, B)
    short = st("st_geohash")(p, F.lit(10))
    json = F.regexp_replace(F.regexp_replace(st("st_asgeojson")(p), r"\s", ""), r"\.0+(?=[,\]])", "")
    return _keys(spark, d).select(
        "k", _wkt(st("st_casttopoint")(p)).alias("as_point"), _wkt(st("st_casttolinestring")(_of("LINESTRING (0 0, ", A, " ", B, ")"))).alias("as_line"), st("st_area")(st("st_casttopolygon")(_of("POLYGON ((0 0, ", A + 1, " 0, ", A + 1, " 10, 0 0))"))).alias("polygon_area"),
        _wkt(st("st_casttogeometry")(p)).alias("as_geometry"), F.hex(st("st_bytearray")(_text("k", F.col("k")))).alias("bytes"), json.alias("json"), st("st_aslatlontext")(_point(A + 0.25, B + 0.5)).alias("lat_lon"),
        st("st_area")(st("st_geomfromgeohash")(short, F.lit(10))).alias("cell_area"), st("st_covers")(st("st_box2dfromgeohash")(short, F.lit(10)), p).alias("inside"),
        (st("st_distance")(st("st_pointfromgeohash")(st("st_geohash")(p, F.lit(40)), F.lit(40)), p) < 0.001).alias("near"),
    )


@query(
    "SELECT k, 'POINT (' || (a + 5) || ' ' || (b - 7) || ')' AS moved, (least(a + 1, 30.0) * least(b + 1, 10.0))::DOUBLE AS shared, ((a + 1.0) * (b + 1) - least(a + 1, 30.0) * least(b + 1, 10.0))::DOUBLE AS rest, round(radians(a) * 6378137.0, 2) AS mx, "
    "round(ln(tan(pi() / 4 + radians(b) / 2)) * 6378137.0, 2) AS my, round((a + 2.0) * 10, 6)::DOUBLE AS safe_area, true AS split, true AS disc FROM " + _K
)
def st_processing(spark: SparkSession, d: str) -> DataFrame:
    A, B = F.col("a"), F.col("b")
    a, b = _box(0, 0, A + 1, B + 1), _box(0, 0, 30, 10)
    merc = st("st_transform")(_point(A, B), F.lit("EPSG:4326"), F.lit("EPSG:3857"))
    safe = st("st_antimeridiansafegeom")(_of("POLYGON ((179 0, ", A + 181, " 0, ", A + 181, " 10, 179 10, 179 0))"))
    disc = st("st_bufferpoint")(_point(A, B), F.lit(100_000.0))
    return _keys(spark, d).select(
        "k", _wkt(st("st_translate")(_point(A, B), F.lit(5.0), F.lit(-7.0))).alias("moved"), F.round(st("st_area")(st("st_intersection")(a, b)), 6).alias("shared"), F.round(F.coalesce(st("st_area")(st("st_difference")(a, b)), F.lit(0.0)), 6).alias("rest"),
        F.round(st("st_xd")(merc), 2).alias("mx"), F.round(st("st_yd")(merc), 2).alias("my"), F.round(st("st_area")(safe), 6).alias("safe_area"), st("st_iscollection")(st("st_idlsafegeom")(safe)).alias("split"),
        (st("st_covers")(disc, _point(A + 0.5, B)) & ~st("st_covers")(disc, _point(A, B + 1.0))).alias("disc"),
    )


@query(
    "SELECT k, x > 0 AND x < 10 AS contains, x >= 0 AND x <= 10 AS covers, NOT (x >= 0 AND x <= 10) AS disjoint, x >= 0 AND x <= 10 AS intersects, x = 0 OR x = 10 AS touches, x > 0 AND x < 10 AS within, x = 5 AS equals, "
    "x > -10 AND x < 5 AS crosses, (x > -10 AND x < 0) OR (x > 0 AND x < 10) AS overlaps, CASE WHEN x > 0 AND x < 10 THEN '0F2FF1FF2' WHEN x = 0 OR x = 10 THEN 'FF20F1FF2' ELSE 'FF2FF10F2' END AS relate, x <> 0 AND x <> 10 AS relate_bool, "
    "x > -10 AND x < 10 AND true AS box_meets FROM (SELECT k, a % 25 - 12 AS x FROM " + _K + ")"
)
def st_relations(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("a") % 25 - 12
    box, p = _box(0, 0, 10, 10), _point(x, 5)
    line = _of("LINESTRING (", x, " -5, ", x + 10, " 5, ", x + 10, " -5)")  # goes into the box by its upper part
    moved = _box(x, 0, x + 10, 10)
    return _keys(spark, d).select(
        "k", st("st_contains")(box, p).alias("contains"), st("st_covers")(box, p).alias("covers"), st("st_disjoint")(box, p).alias("disjoint"), st("st_intersects")(box, p).alias("intersects"), st("st_touches")(p, box).alias("touches"), st("st_within")(p, box).alias("within"),
        st("st_equals")(_point(5, 5), p).alias("equals"), st("st_crosses")(line, box).alias("crosses"), st("st_overlaps")(box, moved).alias("overlaps"), st("st_relate")(box, p).alias("relate"), st("st_relatebool")(box, p, F.lit("***F*****")).alias("relate_bool"),
        (st("st_intersects")(box, moved) & ~st("st_touches")(box, moved)).alias("box_meets"),
    )


@query(
    "SELECT k, (a + b)::DOUBLE AS length, round(6371008.7714 * radians(a), 2) AS sphere_m, round(6378137.0 * radians(a), 2) AS spheroid_m, round(6378137.0 * radians(a), 2) AS between_m, round(6371008.7714 * radians(a), 2) AS agg_sphere_m, round(6378137.0 * radians(a), 2) AS agg_spheroid_m, "
    "'POINT (10 ' || least(b, 10) || ')' AS closest, (10.0 * (b + 1))::DOUBLE AS area, 5.0::DOUBLE AS cx, ((b + 1) / 2.0)::DOUBLE AS cy, sqrt(pow(greatest(b - 10, 0), 2) + pow(a + 1, 2)) AS distance FROM " + _K
)
def st_lengths(spark: SparkSession, d: str) -> DataFrame:
    A, B = F.col("a"), F.col("b")
    equator = _of("LINESTRING (0 0, ", A, " 0)")
    ends = F.array(_point(0, 0), _point(A, 0))
    box, p = _box(0, 0, 10, 10), _point(A + 11, B)
    c = st("st_centroid")(_box(0, 0, 10, B + 1))
    return _keys(spark, d).select(
        "k", st("st_length")(_of("LINESTRING (0 0, ", A, " 0, ", A, " ", B, ")")).alias("length"), F.round(st("st_lengthsphere")(equator), 2).alias("sphere_m"), F.round(st("st_lengthspheroid")(equator), 2).alias("spheroid_m"), F.round(st("st_distancespheroid")(_point(0, 0), _point(A, 0)), 2).alias("between_m"),
        F.round(st("st_aggregatedistancesphere")(ends), 2).alias("agg_sphere_m"), F.round(st("st_aggregatedistancespheroid")(ends), 2).alias("agg_spheroid_m"), _wkt(st("st_closestpoint")(box, p)).alias("closest"), st("st_area")(_box(0, 0, 10, B + 1)).alias("area"),
        st("st_xd")(c).alias("cx"), st("st_yd")(c).alias("cy"), st("st_distance")(box, p).alias("distance"),
    )


# converter functions


#: Columns that the expressions need beside those of the tables.
MORE = {
    "supplier": {"s_parity": "s_suppkey % 2", "s_seven": "s_suppkey % 7", "s_a": "s_suppkey % 60", "s_a1": "s_suppkey % 60 + 1", "s_b": "s_suppkey % 25", "s_xy": "struct(array(0, s_suppkey % 60) AS x, array(0, s_suppkey % 25) AS y)", "s_pt": "struct(s_suppkey % 60 AS x, s_suppkey % 25 AS y)", "s_rings": "struct(array(array(0, s_suppkey % 60 + 1, s_suppkey % 60 + 1, 0)) AS x, array(array(0, 0, 10, 0)) AS y)", "s_parts": "struct(array(array(array(0, s_suppkey % 60 + 1, s_suppkey % 60 + 1, 0))) AS x, array(array(array(0, 0, 10, 0))) AS y)", "s_when": "timestamp'2024-01-05 10:00:00'"},
    "part": {"p_odd": "p_size % 2"},
}


def _convert(name: str, table: str, sql: str, fields: list[tuple[str, str]], finish=None, shapes: bool = False) -> None:
    """Register a query that converts a whole table, with the columns of MORE; fields: name and
    expression, the first one the key. Rows that become shapes are dealt to many tasks, as in _keys."""

    def go(spark: SparkSession, d: str) -> DataFrame:
        rows = read(spark, d, table)
        df = (spread(rows) if shapes else rows).withColumns({k: F.expr(v) for k, v in MORE.get(table, {}).items()})
        caches = {"names": ("k", {"1": {"k": "1", "name": "one"}})}
        conv = Converter("parquet", fields, id=f"toString(${fields[0][0]})", caches=caches)
        good, _ = convert_features(df, conv)
        got = good.select(*[n for n, _ in fields])
        return finish(got) if finish else got

    go.__name__ = name
    query(sql)(go)


_convert(
    "convert_trimming",
    "supplier",
    "SELECT s_suppkey, 'x' || s_suppkey AS quotes, s_suppkey::VARCHAR AS stripped, s_suppkey || 'bb' AS prefix, 'aa' || s_suppkey AS suffix, replace(s_name, '#', '') AS removed, s_suppkey::VARCHAR AS trimmed, CASE WHEN s_suppkey % 2 = 0 THEN 'even' END AS empty_null, "
    "regexp_replace(s_name, '[0-9]+', 'N', 'g') AS regex, s_suppkey::VARCHAR || s_name AS joined, s_suppkey::VARCHAR || s_name AS joined2, substr(s_name, 3, 4) AS part, length(s_name)::INT AS n, length(s_name)::INT AS n2, 'no ' || lpad(s_suppkey::VARCHAR, 5, '0') AS printed FROM supplier",
    [
        ("s_suppkey", "$s_suppkey"), ("quotes", "stripQuotes(concat('\"x', $s_suppkey, '\"'))"), ("stripped", "strip(concat('--', $s_suppkey, '--'), '-')"), ("prefix", "stripPrefix(concat('aa', $s_suppkey, 'bb'), 'a')"), ("suffix", "stripSuffix(concat('aa', $s_suppkey, 'bb'), 'b')"),
        ("removed", "remove($s_name, '#')"), ("trimmed", "trim(concat('  ', $s_suppkey, ' '))"), ("empty_null", "emptyToNull(mapValue(parseMap('String->String', '0->even,1-> '), mkstring('', toString($s_parity))))"), ("regex", "regexReplace('[0-9]+', 'N', $s_name)"),
        ("joined", "concat($s_suppkey, $s_name)"), ("joined2", "concatenate($s_suppkey, $s_name)"), ("part", "substring($s_name, 2, 6)"), ("n", "length($s_name)"), ("n2", "stringLength($s_name)"), ("printed", "printf('no %05d', $s_suppkey)"),
    ],
)

_D = "o_orderdate"
_MS = f"(epoch_us(date_trunc('day', {_D})) // 1000)"
_AT = f"(epoch_us({_D}) // 1000)"
_convert(
    "convert_dates",
    "orders",
    f"SELECT o_orderkey, {_AT} AS millis, {_AT} // 1000 * 1000 AS secs, {_MS} AS basic, {_MS} AS basic2, {_MS} AS iso_day, {_MS} AS local_day, {_AT} // 1000 * 1000 AS local_time, {_AT} // 1000 * 1000 - 3600000 AS offset_time, {_AT} // 1000 * 1000 AS iso, {_AT} // 1000 * 1000 AS iso2, {_AT} // 1000 * 1000 AS basic_time, "
    f"{_AT} // 1000 * 1000 AS basic_no_ms, {_AT} // 1000 * 1000 AS with_ms, {_MS} AS formed, strftime({_D}, '%d.%m.%Y') AS shown, true AS now FROM orders",
    [
        ("o_orderkey", "$o_orderkey"), ("ms", "dateToMillis($o_orderdate)"), ("millis", "dateToMillis(millisToDate($ms))"), ("whole", "dateToString('yyyy-MM-dd HH:mm:ss', $o_orderdate)"), ("secs", "dateToMillis(secsToDate(toLong(divide(dateToMillis(date('yyyy-MM-dd HH:mm:ss', $whole)), 1000))))"),
        ("basic", "dateToMillis(basicIsoDate(dateToString('yyyyMMdd', $o_orderdate)))"), ("basic2", "dateToMillis(basicDate(dateToString('yyyyMMdd', $o_orderdate)))"), ("iso_day", "dateToMillis(isoDate(dateToString('yyyy-MM-dd', $o_orderdate)))"), ("local_day", "dateToMillis(isoLocalDate(dateToString('yyyy-MM-dd', $o_orderdate)))"),
        ("local_time", "dateToMillis(isoLocalDateTime(replace($whole, ' ', 'T')))"), ("offset_time", "dateToMillis(isoOffsetDateTime(concat(replace($whole, ' ', 'T'), '+01:00')))"), ("iso", "dateToMillis(isoDateTime(concat(replace($whole, ' ', 'T'), 'Z')))"), ("iso2", "dateToMillis(dateTime(concat(replace($whole, ' ', 'T'), 'Z')))"),
        ("basic_time", "dateToMillis(basicDateTime(concat(dateToString('yyyyMMdd', $o_orderdate), 'T', dateToString('HHmmss', $o_orderdate), '.000Z')))"), ("basic_no_ms", "dateToMillis(basicDateTimeNoMillis(concat(dateToString('yyyyMMdd', $o_orderdate), 'T', dateToString('HHmmss', $o_orderdate), 'Z')))"),
        ("with_ms", "dateToMillis(dateHourMinuteSecondMillis(concat(replace($whole, ' ', 'T'), '.000')))"), ("formed", "dateToMillis(date('dd/MM/yyyy', dateToString('dd/MM/yyyy', $o_orderdate)))"), ("shown", "dateToString('dd.MM.yyyy', $o_orderdate)"), ("now", "dateToMillis(now()) > 0"),
    ],
    lambda df: df.drop("ms", "whole"),
)

_convert(
    "convert_arithmetic",
    "part",
    "SELECT p_partkey, (p_size * 3.0)::DOUBLE AS times, (p_size - 1.0)::DOUBLE AS less, round((p_size + p_partkey) / 2.0, 6)::DOUBLE AS mean, least(p_size, 20)::DOUBLE AS low, greatest(p_size, 20)::DOUBLE AS high, p_size::INT AS i, p_partkey::BIGINT AS l, p_size::FLOAT AS f, p_size::DOUBLE AS d, -1 AS fallback, "
    "p_size % 2 = 1 AS flag, true AS yes, p_size::INT AS cast_int, p_size::VARCHAR AS s, p_size > 10 AND p_size < 40 AS compared, NOT (p_size = 7) AS other FROM part",
    [
        ("p_partkey", "$p_partkey"), ("times", "multiply($p_size, 3)"), ("less", "subtract($p_size, 1)"), ("mean", "mean($p_size, $p_partkey)"), ("low", "min($p_size, 20)"), ("high", "max($p_size, 20)"), ("i", "toInt(toString($p_size))"), ("l", "toLong(toString($p_partkey))"),
        ("f", "toFloat(toString($p_size))"), ("d", "toDouble(toString($p_size))"), ("fallback", "toInt('no number', -1)"), ("flag", "intToBoolean($p_odd)"), ("yes", "toBool('true')"), ("cast_int", "toString($p_size)::int"), ("s", "toString($p_size)"), ("compared", "$p_size > 10 && $p_size < 40"), ("other", "!($p_size == 7)"),
    ],
    lambda df: df.withColumn("mean", F.round("mean", 6)),
)

_convert(
    "convert_collections",
    "supplier",
    "SELECT s_suppkey, s_suppkey % 7 AS item, 3 AS n, (s_suppkey % 7 + 1)::INT AS next, s_suppkey::INT AS of_map, upper(s_name) || '!' AS items, s_suppkey AS required, base64(encode(s_name)) AS b64, md5(s_name) AS hash, '{{\"a\":' || s_suppkey || '}}' AS json, s_suppkey::INT AS json_item, s_suppkey::INT AS json_value, "
    "s_suppkey::VARCHAR AS json_path, s_name AS xml, s_name AS xml_text, 36 AS uuid_length, CASE WHEN s_suppkey % 7 = 1 THEN 'one' END AS cached FROM supplier",
    [
        ("s_suppkey", "$s_suppkey"), ("l", "list($s_suppkey, 2, 3)"), ("seven", "parseList('int', mkstring(';', $s_seven, $s_suppkey), ';')"), ("item", "listItem($seven, 0)::long"), ("moved", "transformListItems($seven, add($0, 1))"), ("m", "parseMap('String->Int', mkstring('', 'a->', $s_suppkey, ',b->2'))"), ("of_map", "mapValue($m, 'a')"),
        ("words", "list($s_name, 'b')"), ("items", "mkstring('', listItem(transformListItems($words, uppercase($0)), 0), '!')"), ("required", "require($s_suppkey)"), ("b64", "base64(string2bytes($s_name))"), ("hash", "md5(stringToBytes($s_name))"), ("json", "mapToJson(parseMap('String->Int', mkstring('', 'a->', $s_suppkey)))"),
        ("json_item", "listItem(jsonList('int', mkstring('', '[', $s_suppkey, ',2]')), 0)"), ("json_value", "mapValue(jsonMap('String->Int', $json), 'a')"), ("json_path", "jsonPath('$.a', jsonToString($json))"), ("xml", "xpath('/r/n', mkstring('', '<r><n>', $s_name, '</n></r>'))"), ("xml_text", "xmlToString($s_name)"),
        ("uuid_length", "strlen(uuid())"), ("cached", "cacheLookup('names', toString($s_seven), 'name')"),
    ],
    lambda df: df.withColumns({"n": F.size("l"), "next": F.element_at("moved", 1).cast("int")}).drop("l", "seven", "moved", "m", "words"),
)

_convert(
    "convert_geometries",
    "supplier",
    "SELECT s_suppkey, 'POINT (' || a || ' ' || b || ')' AS point, 'POINT (' || a || ' ' || b || ')' AS point2, 3 AS m, 2 AS multipoint, 'LINESTRING (0 0, ' || a || ' ' || b || ')' AS line, 2 AS lines, (a + 1.0) * 5 AS polygon, (a + 1.0) * 5 AS polygons, 'POINT (' || a || ' ' || b || ')' AS geometry, 2 AS collection, "
    "round(degrees(a * 1000.0 / 6378137.0), 6) AS projected, (a + b)::DOUBLE AS cql, 'LINESTRING (0 0, ' || a || ' ' || b || ')' AS p_line, 'POINT (' || a || ' ' || b || ')' AS p_point, 2 AS p_points, ((a + 1.0) * 5)::DOUBLE AS p_area, 1 AS p_lines, ((a + 1.0) * 5)::DOUBLE AS p_areas, 72 AS uuids FROM (SELECT s_suppkey, s_suppkey % 60 AS a, s_suppkey % 25 AS b FROM supplier)".replace("(a + 1.0) * 5 AS", "((a + 1.0) * 5)::DOUBLE AS"),
    [
        ("s_suppkey", "$s_suppkey"), ("p", "point($s_a, $s_b)"), ("p2", "point(mkstring('', 'POINT (', $s_a, ' ', $s_b, ')'))"), ("pm", "pointM($s_a, $s_b, 5)"), ("mp", "multipoint(mkstring('', 'MULTIPOINT (0 0, ', $s_a, ' ', $s_b, ')'))"), ("ls", "linestring(mkstring('', 'LINESTRING (0 0, ', $s_a, ' ', $s_b, ')'))"),
        ("mls", "multilinestring(mkstring('', 'MULTILINESTRING ((0 0, 1 1), (2 2, ', $s_a, ' ', $s_b, '))'))"), ("pg", "polygon(mkstring('', 'POLYGON ((0 0, ', $s_a1, ' 0, ', $s_a1, ' 10, 0 0))'))"), ("mpg", "multipolygon(mkstring('', 'MULTIPOLYGON (((0 0, ', $s_a1, ' 0, ', $s_a1, ' 10, 0 0)))'))"),
        ("g", "geometry(mkstring('', 'POINT (', $s_a, ' ', $s_b, ')'))"), ("gc", "geometrycollection(mkstring('', 'GEOMETRYCOLLECTION (POINT (', $s_a, ' ', $s_b, '), LINESTRING (0 0, 1 1))'))"), ("pr", "projectFrom('EPSG:3857', point(multiply($s_a, 1000), 0))"), ("pl", "parquetLineString($s_xy)"), ("pp", "parquetPoint($s_pt)"), ("pmp", "parquetMultiPoint($s_xy)"), ("ppg", "parquetPolygon($s_rings)"), ("pml", "parquetMultiLineString($s_rings)"), ("pmg", "parquetMultiPolygon($s_parts)"), ("uz", "strlen(uuidZ3($p, $s_when, 'week'))"), ("uc", "strlen(uuidZ3Centroid($ls, $s_when, 'week'))"), ("cq", "cql:length(linestring(mkstring('', 'LINESTRING (0 0, ', $s_a, ' 0, ', $s_a, ' ', $s_b, ')')))"),
    ],
    lambda df: df.select(
        "s_suppkey", _wkt(F.col("p")).alias("point"), _wkt(F.col("p2")).alias("point2"), st("st_coorddim")("pm").alias("m"), st("st_numgeometries")("mp").alias("multipoint"), _wkt(F.col("ls")).alias("line"), st("st_numgeometries")("mls").alias("lines"), st("st_area")("pg").alias("polygon"), st("st_area")("mpg").alias("polygons"),
        _wkt(F.col("g")).alias("geometry"), st("st_numgeometries")("gc").alias("collection"), F.round(st("st_xd")("pr"), 6).alias("projected"), F.col("cq").alias("cql"),
        _wkt(F.col("pl")).alias("p_line"), _wkt(F.col("pp")).alias("p_point"), st("st_numgeometries")("pmp").alias("p_points"), st("st_area")("ppg").alias("p_area"), st("st_numgeometries")("pml").alias("p_lines"), st("st_area")("pmg").alias("p_areas"), (F.col("uz") + F.col("uc")).alias("uuids"),
    ),
    shapes=True,
)
