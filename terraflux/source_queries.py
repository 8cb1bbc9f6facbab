"""Registered queries that write whole tables in some form and read them back, or stream them."""

from __future__ import annotations

import uuid
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native, s2, sql
from .functions.st import column_function as st
from .functions.st import register
from .operators import aggregates, joins, tracks
from .plans.query import merged, Query, routed, run
from .queries import _cust, _ev, _EV, _hav, _messages, _MSG, _supp, query
from .sources import convert as conv
from .sources import export, relation, storage
from .sources.documents import GeoJsonIndex
from .sources.shared import shared_dir
from .sources.tables import layout, nation_boxes, read
from .streaming import live


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, d: str, scheme: str = "daily", **place: str) -> str:
    path = _folder(spark, "stored")
    storage.write(_ev(spark, d).select("event_id", "user_id", "event_type", "ts", "value", "lon", "lat"), path, scheme, time="ts", **place)
    return path


def _partition(df: DataFrame) -> DataFrame:
    return df.withColumn("partition", F.replace(storage.partition_value("daily", time="ts"), F.lit("/"), F.lit("_")))


# stored tables


@query("SELECT event_id, strftime(ts, '%Y_%m_%d') AS partition FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def storage_pruned_read(spark: SparkSession, d: str) -> DataFrame:
    return storage.read(spark, _stored(spark, d), days=(datetime(2024, 1, 5), datetime(2024, 1, 11))).select("event_id", "partition")


@query("SELECT event_id, CASE WHEN user_id < 100 THEN 'moved' ELSE event_type END AS event_type, strftime(CASE WHEN user_id < 100 THEN ts + INTERVAL 1 DAY ELSE ts END, '%Y_%m_%d') AS partition FROM events WHERE NOT (user_id >= 100 AND user_id < 200) UNION ALL SELECT -event_id, 'new', strftime(ts, '%Y_%m_%d') FROM events WHERE user_id = 300")
def storage_update(spark: SparkSession, d: str) -> DataFrame:
    """Rows move to other partitions, come new and go, then files are merged."""
    path = _stored(spark, d)
    rows = storage.read(spark, path)
    moved = rows.where("user_id < 100").withColumns({"ts": F.col("ts") + F.expr("interval 1 day"), "event_type": F.lit("moved")})
    new = rows.where("user_id = 300").withColumns({"event_id": -F.col("event_id"), "event_type": F.lit("new")})
    storage.update(spark, path, _partition(moved.unionByName(new)), "event_id")
    storage.update(spark, path, rows.where("user_id >= 100 and user_id < 200").select("event_id"), "event_id", delete=True)
    return storage.read(spark, path).select("event_id", "event_type", "partition")


@query("SELECT event_id FROM " + _EV.replace("{", "{{").replace("}", "}}") + " WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN -10 AND 30")
def storage_z2(spark: SparkSession, d: str) -> DataFrame:
    path = _stored(spark, d, "z2-6bits", lon="lon", lat="lat")
    storage.compact(spark, path, storage.z2_cells((0.0, 0.0, 1.0, 1.0), 6)[0])
    return storage.read(spark, path, box=((-20.0, -10.0, 40.0, 30.0), 6)).where(native.in_box("lon", "lat", -20.0, -10.0, 40.0, 30.0)).select("event_id")


@query("SELECT n_nationkey FROM (SELECT n_nationkey, -180.0 + (n_nationkey % 5) * 72.0 AS x0, -90.0 + (n_nationkey // 5) * 36.0 AS y0 FROM nation) WHERE x0 <= 10 AND x0 + 72 >= -10 AND y0 <= 60 AND y0 + 36 >= 20")
def storage_xz2(spark: SparkSession, d: str) -> DataFrame:
    path, box = _folder(spark, "xz2"), (-10.0, 20.0, 10.0, 60.0)
    storage.write(nation_boxes(spark, d), path, "xz2-8bits", bounds=("x0", "y0", "x1", "y1"))
    return storage.read(spark, path, meets=(box, 8)).where(native.boxes_meet(("x0", "y0", "x1", "y1"), box)).select("n_nationkey")


@query("SELECT event_id, user_id FROM events WHERE user_id < 200 OR event_type = 'click' ORDER BY user_id DESC, event_id LIMIT 50")
def merged_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Two stores that share rows, each row once, in one order."""
    ev = _ev(spark, d).select("event_id", "user_id", "event_type", "fid")
    return merged([(ev, "user_id < 200"), (ev, "event_type = 'click'")], layout(ev), fid="event_id", sort=[("user_id", True), ("event_id", False)], limit=50).select("event_id", "user_id")


@query("SELECT n_nationkey, count(*) AS n FROM {CU} JOIN (SELECT n_nationkey, -180.0 + (n_nationkey % 5) * 72.0 AS x0, -90.0 + (n_nationkey // 5) * 36.0 AS y0 FROM nation) ON lon BETWEEN x0 AND x0 + 72 AND lat BETWEEN y0 AND y0 + 36 GROUP BY 1")
def join_cover(spark: SparkSession, d: str) -> DataFrame:
    """Boxes dealt out by the cells of the points' grid."""
    points = joins.grid_partition(_cust(spark, d), "lon", "lat", 16, "earth")[0]
    boxes = joins.cover(nation_boxes(spark, d), ("x0", "y0", "x1", "y1"), joins.grid_boxes((-180.0, -90.0, 180.0, 90.0), 4))
    return points.join(boxes, "cell").where(native.in_box("lon", "lat", "x0", "y0", "x1", "y1")).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM {EV} WHERE lon BETWEEN 0 AND 60 AND lat BETWEEN 0 AND 60")
def query_loose(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return run(ev, Query("INTERSECTS(geom, POLYGON((0 0, 60 0, 0 60, 0 0)))", loose=True), layout(ev)).select("event_id")


@query("SELECT 'count' AS key, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
def stats_merged(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(spark, aggregates.merged_statistics([read(spark, d, "customer"), read(spark, d, "supplier")], "Count()"))


@query("SELECT c_custkey, c_mktsegment AS segment FROM {CU} WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -45 AND 45 AND c_mktsegment = 'BUILDING' AND c_custkey > 20")
def documents_by_example(spark: SparkSession, d: str) -> DataFrame:
    """GeoJSON documents added, updated, deleted and queried."""
    index = GeoJsonIndex(spark, _folder(spark, "documents"))
    place, props = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")), F.struct("c_mktsegment", "c_custkey")
    docs = _cust(spark, d).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").cast("string").alias("id"), place.alias("geometry"), props.alias("properties"))).alias("json"), "c_custkey")
    index.add(docs.select(F.when(F.col("c_custkey") <= 100, F.replace("json", F.lit("BUILDING"), F.lit("OTHER"))).otherwise(F.col("json")).alias("json")))
    index.update(docs.where("c_custkey <= 100").select("json"))
    index.delete(docs.where("c_custkey <= 20").select(F.col("c_custkey").cast("string").alias("id")))
    example = {"geom": {"$bbox": [-60, -45, 60, 45]}, "properties.c_mktsegment": "BUILDING"}
    return index.query(example, {"segment": "$.properties.c_mktsegment"}).select(F.col("id").cast("long").alias("c_custkey"), "segment")


@query("SELECT event_id, user_id FROM events WHERE user_id = 7")
def storage_attribute_index(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "stored")
    storage.write(_ev(spark, d).select("event_id", "user_id", "ts"), path, "monthly", time="ts", index="user_id")
    return storage.read(spark, path).where("user_id = 7").select("event_id", "user_id")


@query("SELECT event_id FROM {EV} WHERE lon BETWEEN -20 AND 35 AND lat BETWEEN 10 AND 50 AND ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-13'")
def storage_z3_index(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "stored")
    storage.write(_ev(spark, d).select("event_id", "ts", "lon", "lat"), path, "flat", time="ts", lon="lon", lat="lat", index="z3")
    near = native.in_box("lon", "lat", -20.0, 10.0, 35.0, 50.0) & (F.col("ts") >= "2024-01-11") & (F.col("ts") < "2024-01-13")
    return storage.read(spark, path).where(near).select("event_id")


@query("SELECT event_type AS partition, count(*) AS n, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM {EV} GROUP BY 1")
def storage_metadata(spark: SparkSession, d: str) -> DataFrame:
    return storage.metadata(spark, _stored(spark, d, "attribute:event_type"), "lon", "lat")


@query("SELECT strftime(ts, '%G') || '/W' || strftime(ts, '%V') AS week, strftime(ts, '%Y/%j') AS julian, strftime(ts, '%Y/%m/%d/%H') AS hour, strftime(ts, '%Y/%m/%d/%H/%M') AS minute, count(*) AS n FROM events GROUP BY ALL")
def storage_layouts(spark: SparkSession, d: str) -> DataFrame:
    of = lambda scheme, name: storage.partition_value(scheme, time="ts").alias(name)
    return _ev(spark, d).groupBy(of("weekly", "week"), of("julian-daily", "julian"), of("hourly", "hour"), of("minute", "minute")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 20")
def storage_orc(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "orc")
    export.write(read(spark, d, "part"), path, "orc")
    return spark.read.orc(path).where("p_size > 20").select("p_partkey", "p_brand")


# converters of files


def _converted_file(spark: SparkSession, lines: DataFrame, converter: conv.Converter) -> DataFrame:
    path = _folder(spark, "lines")
    lines.write.text(path)
    return conv.convert(spark, converter, path)[0]


@query("SELECT c_custkey, c_name AS name, round(c_acctbal, 2) AS balance, c_custkey::VARCHAR AS fid FROM customer WHERE c_custkey > 3")
def convert_csv_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    export.write(read(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).cast("string").alias("c_acctbal")), path, "csv")
    c = conv.Converter("delimited-text", [("c_custkey", "$1::long"), ("name", "$2"), ("balance", "$3::double")], id="$1", options={"skip-lines": "1"}, filter="$c_custkey > 3")
    return conv.convert(spark, c, path)[0].withColumnRenamed("__fid__", "fid")


@query("SELECT s_suppkey, s_name AS name, 'POINT (' || (s_suppkey % 60) || ' 5)' AS wkt FROM supplier")
def convert_json_file(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "supplier").select(F.to_json(F.struct("s_suppkey", F.struct("s_name").alias("p"), F.expr("array(s_suppkey % 60, 5)").alias("xy"))))
    fields = [("s_suppkey", "jsonPath('$.s_suppkey', $0)::long"), ("name", "jsonPath('$.p.s_name', $0)"), ("geom", "point(jsonPath('$.xy[0]', $0), jsonPath('$.xy[1]', $0))")]
    got = _converted_file(spark, lines, conv.Converter("json", fields, id="$s_suppkey", validators=["has-geo"]))
    return got.select("s_suppkey", "name", st("st_astext")("geom").alias("wkt"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def convert_xml_file(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "supplier").select(F.concat(F.lit("<r><row id=\""), F.col("s_suppkey").cast("string"), F.lit("\"><n>"), F.col("s_name"), F.lit("</n></row></r>")))
    c = conv.Converter("xml", [("s_suppkey", "xpath('/row/@id', $0)::long"), ("name", "xpath('/row/n', $0)")], id="$s_suppkey", feature_path="row", options={"line-mode": "single"})
    return _converted_file(spark, lines, c).select("s_suppkey", "name")


@query("SELECT s_suppkey, substr(s_name, 1, 8) AS name FROM supplier")
def convert_fixed_width_file(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "supplier").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.rpad(F.col("s_name"), 40, " ")))
    c = conv.Converter("fixed-width", [("s_suppkey", "$1::long"), ("name", "trim($2)")], id="$s_suppkey", widths=[(0, 6), (6, 8)])
    return _converted_file(spark, lines, c).select("s_suppkey", "name")


@query("SELECT p_partkey, upper(p_brand) AS brand FROM part")
def convert_parquet_file(spark: SparkSession, d: str) -> DataFrame:
    return conv.convert(spark, conv.Converter("parquet", [("p_partkey", "$p_partkey"), ("brand", "uppercase($p_brand)")], id="toString($p_partkey)"), f"{d}/part.parquet")[0].select("p_partkey", "brand")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' END AS state FROM orders WHERE o_orderstatus IN ('F', 'O')")
def convert_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("value"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    of = lambda state: conv.Converter("delimited-text", [("o_orderkey", "$1"), ("state", f"toString('{state}')")], id="toString($1)")
    good, _ = conv.composite(rows, [F.col("value"), F.col("k"), F.col("s")], [("$2 == 'F'", of("done")), ("$2 == 'O'", of("open"))])
    return good.select("o_orderkey", "state")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state FROM orders WHERE o_orderstatus IN ('F', 'O')")
def convert_composite_json(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("value"))
    of = lambda state: conv.Converter("json", [("o_orderkey", "jsonPath('$.k', $0)::long"), ("state", f"toString('{state}')")], id="jsonPath('$.k', $0)")
    good, _ = conv.composite(rows, [F.col("value")], [("jsonPath('$.s', $0) == 'F'", of("done")), ("jsonPath('$.s', $0) == 'O'", of("open"))])
    return good.select("o_orderkey", "state")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'low' ELSE 'high' END AS half FROM nation")
def convert_composite_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select(F.concat(F.lit("<n><k>"), F.col("n_nationkey").cast("string"), F.lit("</k></n>")).alias("value"))
    of = lambda half: conv.Converter("xml", [("n_nationkey", "xpath('/n/k', $0)::int"), ("half", f"toString('{half}')")], id="xpath('/n/k', $0)")
    good, _ = conv.composite(rows, [F.col("value")], [("xpath('/n/k', $0)::int < 10", of("low")), ("xpath('/n/k', $0)::int >= 10", of("high"))])
    return good.select("n_nationkey", "half")


@query("SELECT DISTINCT s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY m, s_suppkey) AS r FROM (SELECT c_custkey, s_suppkey, " + _hav("c.lat", "s.lat", "s.lon - c.lon") + " AS m FROM {CU} c JOIN {SU} s ON true) WHERE m <= 1500000) WHERE r <= 2")
def join_nearest_set(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_set(_cust(spark, d), _supp(spark, d), ("lon", "lat"), ("s_lon", "s_lat"), "c_custkey", "s_suppkey", 2, 1_500_000.0).select("s_suppkey")


@query("SELECT f AS format, count(*) AS n, count(CASE WHEN s_suppkey % 2 = 0 THEN 1 END) AS noted FROM supplier, (SELECT unnest(['csv', 'default', 'excel', 'rfc4180', 'quoted', 'quote_escape', 'quoted_with_quote_escape', 'quoted_minimal', 'tdf', 'tsv', 'tab', 'tsv_quoted_minimal', 'mysql']) AS f) GROUP BY 1")
def convert_named_formats(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come back from each named form, with separators and quotes within values."""
    out = None
    for name, (sep, quote, _, none) in conv.FORMATS.items():
        text = F.concat(F.lit("a" + (sep if none is None else " ") + "\"b\" "), F.col("s_name"))
        put = F.concat(F.lit(quote), F.replace(text, F.lit('"'), F.lit('""')), F.lit(quote)) if none is None else text
        note = F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise(none or "")
        lines = read(spark, d, "supplier").select(F.concat_ws(sep, F.col("s_suppkey").cast("string"), put, note))
        fields = [("s_suppkey", "$1::long"), ("said", "$2"), ("note", "emptyToNull($3)")]
        got = _converted_file(spark, lines, conv.Converter("delimited-text", fields, id="$1", options={"format": name.upper()}))
        same = got.join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("want")), F.col("s_suppkey") == F.col("k")).where("said = want")
        part = same.agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("noted")).select(F.lit(name).alias("format"), "n", "noted")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT line AS n, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS line FROM customer)")
def convert_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    read(spark, d, "customer").select("c_custkey").orderBy("c_custkey").coalesce(1).write.csv(path)
    return conv.convert(spark, conv.Converter("delimited-text", [("n", "lineNo()"), ("c_custkey", "$1::long")], id="$1"), path)[0].select("n", "c_custkey")


# exports


@query("SELECT event_id, (((list_reduce(list_prepend(0, list_transform(string_split(user_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) + 2147483648) % 4294967296) - 2147483648)::INT AS track, (epoch_us(ts) // 1000000)::INT AS t, round(lat::FLOAT::DOUBLE, 4) AS y, round(lon::FLOAT::DOUBLE, 4) AS x FROM {EV}")
def export_bin_labelled(spark: SparkSession, d: str) -> DataFrame:
    records = export.bin_records(_ev(spark, d), "user_id", "lon", "lat", "ts", "event_id")

    def decode(batches):
        for b in batches:
            rows = [export.read_bin(r, True)[0] for r in b.column("record").to_pylist()]
            yield pa.RecordBatch.from_pylist([{"event_id": r[4], "track": r[0], "t": r[1], "y": r[2], "x": r[3]} for r in rows], schema=pa.schema([("event_id", pa.int64()), ("track", pa.int32()), ("t", pa.int32()), ("y", pa.float64()), ("x", pa.float64())]))

    return records.mapInArrow(decode, "event_id long, track int, t int, y double, x double").withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query("SELECT event_id, user_id, event_type, round(lon, 2) AS x, round(lat, 2) AS y FROM {EV}")
def export_geojson_fields(spark: SparkSession, d: str) -> DataFrame:
    text = export.geojson(_ev(spark, d), "event_id", native.point_geojson("lon", "lat"), ["user_id", "event_type"])
    f = F.from_json("feature", "type string, id string, geometry struct<type: string, coordinates: array<double>>, properties struct<user_id: long, event_type: string>")
    got = text.select(f.alias("f")).where("f.type = 'Feature' and f.geometry.type = 'Point'")
    return got.select(F.col("f.id").cast("long").alias("event_id"), "f.properties.user_id", "f.properties.event_type", F.round(F.col("f.geometry.coordinates")[0], 2).alias("x"), F.round(F.col("f.geometry.coordinates")[1], 2).alias("y"))


@query("SELECT event_id, event_type FROM events")
def export_gml(spark: SparkSession, d: str) -> DataFrame:
    m = export.gml(_ev(spark, d), "event_id", "lon", "lat", ["event_type"])
    plain = F.regexp_replace("member", "gml:", "")
    return m.select(F.xpath_long(plain, F.lit("/featureMember/feature/@id")).alias("event_id"), F.xpath_string(plain, F.lit("/featureMember/feature/event_type")).alias("event_type"))


@query("SELECT event_id, user_id FROM events")
def export_arrow(spark: SparkSession, d: str) -> DataFrame:
    def decode(batches):
        for b in batches:
            for data in b.column("batch").to_pylist():
                yield from pa.ipc.open_stream(data)

    return export.arrow_batches(_ev(spark, d).select("event_id", "user_id")).mapInArrow(decode, "event_id long, user_id long")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def export_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "json")
    export.write(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "json")
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path)


# queries, curves and statistics


@query("SELECT c_custkey, 'POINT (' || (c_custkey % 60) || ' 5)' AS wkt, c_custkey % 60 BETWEEN 10 AND 20 AS inside FROM customer")
def st_in_sql(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    read(spark, d, "customer").createOrReplaceTempView("terraflux_customer")
    return spark.sql("SELECT c_custkey, st_asText(p) AS wkt, st_covers(st_makeBBOX(10d, 0d, 20d, 10d), p) AS inside FROM (SELECT c_custkey, st_makePoint(double(c_custkey % 60), 5d) AS p FROM terraflux_customer)")


@query("SELECT c_custkey FROM {CU} WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45 AND " + _hav("10.0", "lat", "lon - 20.0") + " <= 5000000")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    _cust(spark, d).createOrReplaceTempView("terraflux_points")
    return spark.sql("SELECT c_custkey FROM terraflux_points WHERE tf_in_box(lon, lat, -90, -45, 90, 45) AND tf_within(lon, lat, 20, 10, 5000000) AND tf_distance(lon, lat, 20, 10) <= 5000000 AND tf_heading(lon, lat, 20, 10) < 360")


@query("SELECT event_id, user_id, NULL::VARCHAR AS note, least(floor((lon + 180) * 4 / 360), 3)::INT * 4 + least(floor((lat + 90) * 4 / 180), 3)::INT AS cell FROM {EV} WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30 AND user_id < 700")
def relation_load(spark: SparkSession, d: str) -> DataFrame:
    """Saved and loaded by options."""
    path = _folder(spark, "relation")
    relation.save(_ev(spark, d).select("event_id", "user_id", "ts", "lon", "lat"), path, scheme="daily", time="ts")
    schema = "event_id bigint, user_id bigint, note string, lon double, lat double"
    return relation.load(spark, path, schema, lon="lon", lat="lat", query="BBOX(geom, -60, -30, 60, 30) AND user_id < 700", spatial="true", strategy="earth", cells="16").select("event_id", "user_id", "note", "cell")


@query("SELECT event_id FROM events WHERE user_id < 20 AND value > 10")
def query_interceptor(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return run(ev, Query("user_id < 20", interceptors=[lambda df: df.where("value > 10")]), layout(ev)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 3")
def query_routed(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    none = ev.where("false")
    return routed({frozenset({"value"}): none, frozenset({"user_id"}): ev}, {"user_id"}, none).where("user_id = 3").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events WHERE user_id < 500) WHERE k % 10 = 0")
def query_sampled(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).withColumn("fid", F.format_string("%012d", "event_id"))
    return run(ev, Query("user_id < 500", sampling=0.1, sample_by="event_type"), layout(ev)).select("event_id")


@query("SELECT c_custkey, (floor((lon + 180) * 1024 / 360) + 0.5) * 360 / 1024 - 180 AS x, (floor((lat + 90) * 1024 / 180) + 0.5) * 180 / 1024 - 90 AS y FROM {CU}")
def curve_z2_cell(spark: SparkSession, d: str) -> DataFrame:
    x, y = native.z2_cell(native.z2("lon", "lat", 10), 10)
    return _cust(spark, d).select("c_custkey", x.alias("x"), y.alias("y"))


@query("SELECT c_custkey FROM {CU} WHERE lon BETWEEN -20 AND 35 AND lat BETWEEN 10 AND 50")
def curve_z2_ranges(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "z2")
    _cust(spark, d).withColumn("z", native.z2("lon", "lat", 16)).sort("z").write.parquet(path)
    box = (-20.0, 10.0, 35.0, 50.0)
    return spark.read.parquet(path).where(native.in_ranges("z", native.z2_ranges(box, 16, 40)) & native.in_box("lon", "lat", *box)).select("c_custkey")


@query("SELECT event_id FROM {EV} WHERE lon BETWEEN -20 AND 35 AND lat BETWEEN 10 AND 50 AND ts >= TIMESTAMP '2024-01-11 01:00:00' AND ts <= TIMESTAMP '2024-01-13 01:00:00'")
def curve_z3_ranges(spark: SparkSession, d: str) -> DataFrame:
    week, offset, whole = native.time_bin(F.col("ts"), "week")
    path = _folder(spark, "z3")
    _ev(spark, d).select("event_id", "ts", "lon", "lat", week.alias("week"), native.z3("lon", "lat", offset, whole).alias("z")).write.parquet(path)
    box, start, end = (-20.0, 10.0, 35.0, 50.0), 1704934800, 1705107600  # within one week from Thursday, 11 January
    first = start // 604800 * 604800
    ranges = native.z3_ranges(box, (start - first, end - first), whole, most=60)
    near = (F.col("week") == start // 604800) & native.in_ranges("z", ranges)
    return spark.read.parquet(path).where(near & native.in_box("lon", "lat", *box) & F.unix_micros("ts").between(start * 1_000_000, end * 1_000_000)).select("event_id")


def _as_rows(spark: SparkSession, values: dict, key: str = "key") -> DataFrame:
    return spark.createDataFrame([(str(k), v) for k, v in values.items()], f"{key} string, n long")


@query("SELECT 'count' AS key, count(*) AS n FROM events UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1")
def stats_sequence(spark: SparkSession, d: str) -> DataFrame:
    count, values = aggregates.statistics(_ev(spark, d), "Count();Enumeration(event_type)")
    return _as_rows(spark, count | values)


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def stats_frequency(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    sketch = bytes.fromhex(aggregates.statistics(ev, "Frequency(event_type)")["sketch"])
    kinds = [r[0] for r in ev.select("event_type").distinct().collect()]  # a few kinds
    return _as_rows(spark, {k: aggregates.count_min_estimate(sketch, k) for k in kinds})


@query("SELECT (epoch_ms(ts) // 604800000)::VARCHAR AS key, count(*) AS n FROM events GROUP BY 1")
def stats_z3_histogram(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.statistics(_ev(spark, d), "Z3Histogram(geom,ts,week,64)", lon="lon", lat="lat")
    return _as_rows(spark, {k: sum(v) for k, v in got.items()})


@query("SELECT (epoch_ms(ts) // 604800000)::VARCHAR AS key, count(*) AS n FROM events GROUP BY 1")
def stats_z3_frequency(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.statistics(_ev(spark, d), "Z3Frequency(geom,ts,week,25)", lon="lon", lat="lat")
    return _as_rows(spark, {k: v["size"] for k, v in got.items()})


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def stats_group_by_counts(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.statistics(_ev(spark, d), "GroupBy(event_type,Count();MinMax(user_id);Histogram(value,4,0,100))")
    assert all(sum(v[2]["bins"]) <= v[0]["count"] for v in got.values())
    return _as_rows(spark, {k: v[0]["count"] for k, v in got.items()})


_TEXT36 = " + ".join(f"CASE WHEN length(s) >= {k} THEN greatest(position(lower(substr(s, {k}, 1)) IN '0123456789abcdefghijklmnopqrstuvwxyz') - 1, 0) ELSE 0 END * pow(36.0, -{k})" for k in range(1, 9))


@query("WITH v AS (SELECT " + _TEXT36 + " AS v FROM (SELECT p_type AS s FROM part)), b AS (SELECT least(0.0, min(v)) AS lo, greatest(35 / 36.0, max(v)) AS hi FROM v) SELECT least(floor((v - lo) * 10 / (hi - lo)), 9)::INT AS bin, count(*) AS n FROM v, b GROUP BY 1")
def stats_histogram_text(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(read(spark, d, "part"), "p_type", 10, aggregates.text_bound("0"), aggregates.text_bound("z"))


@query("SELECT (CASE WHEN lon >= 0 THEN 1 ELSE 0 END + CASE WHEN lat >= 0 THEN 2 ELSE 0 END)::INT AS bin, count(*) AS n FROM {CU} GROUP BY 1")
def stats_histogram_places(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.place_histogram(_cust(spark, d), "lon", "lat", 4)


@query("SELECT epoch_ms(l_shipdate) // 86400000 // 100 AS part, count(*) AS n FROM lineitem GROUP BY 1")
def stats_histogram_dates(spark: SparkSession, d: str) -> DataFrame:
    """A histogram over dates whose bins are 100 days."""
    got = aggregates.histogram(read(spark, d, "lineitem"), "l_shipdate", 400, 0.0, 400 * 8_640_000_000.0)
    return got.select(F.col("bin").cast("long").alias("part"), "n")


@query("SELECT i::INT AS i, j::INT AS j, 1.0::DOUBLE AS weight FROM range(0, 72) a(i), range(0, 36) b(j)")
def density_areas(spark: SparkSession, d: str) -> DataFrame:
    boxes = nation_boxes(spark, d).withColumn("box", st("st_makebbox")("x0", "y0", "x1", "y1"))
    return aggregates.density_lines(boxes, "box", (-180.0, -90.0, 180.0, 90.0), 72, 36)


@query("SELECT i::INT AS i, (2 * n_nationkey)::INT AS j, 1.0::DOUBLE AS weight FROM nation, range(0, 100) a(i) WHERE i <= n_nationkey + 3")
def density_of_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "nation").select(st("st_geomfromwkt")(F.format_string("LINESTRING (0.5 %s.5, %s.5 %s.5)", 2 * F.col("n_nationkey"), F.col("n_nationkey") + 3, 2 * F.col("n_nationkey"))).alias("g"))
    return aggregates.density_lines(lines, "g", (0.0, 0.0, 100.0, 100.0), 100, 100)


@query(
    "WITH g AS (SELECT least(floor((lon + 180) * 36 / 360), 35)::INT AS i, least(floor((lat + 90) * 18 / 180), 17)::INT AS j, count(*)::DOUBLE AS w FROM {EV} GROUP BY 1, 2), t AS (SELECT * FROM (VALUES (0, 0, 1.0), (1, 0, 0.5), (-1, 0, 0.5), (0, 1, 0.5), (0, -1, 0.5)) t(a, b, k)) SELECT (i + a)::INT AS i, (j + b)::INT AS j, round(sum(w * k), 4)::DOUBLE AS weight FROM g, t GROUP BY 1, 2"
)
def density_smoothed(spark: SparkSession, d: str) -> DataFrame:
    grid = aggregates.density(_ev(spark, d), "lon", "lat", (-180.0, -90.0, 180.0, 90.0), 36, 18)
    return aggregates.smoothed(grid, 1).withColumn("weight", F.round("weight", 4))


@query("SELECT 'weighted' AS how, count(*) AS n FROM customer UNION ALL SELECT 'rtree', count(*) FROM customer")
def grid_partition_by_data(spark: SparkSession, d: str) -> DataFrame:
    parts = [joins.grid_partition(_cust(spark, d), "lon", "lat", 9, how)[0].groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n")).select(F.lit(how).alias("how"), "n") for how in ("weighted", "rtree")]
    return parts[0].unionByName(parts[1])


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 4)::INT AS bin FROM supplier")
def track_time_bins(spark: SparkSession, d: str) -> DataFrame:
    return tracks.time_bins(read(spark, d, "supplier"), ["s_suppkey"], 4).select("s_suppkey", "bin")


@query("SELECT event_id, epoch_ms(ts) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05'")
def track_playback(spark: SparkSession, d: str) -> DataFrame:
    parts = live.playback(_ev(spark, d).select("event_id", "ts"), "ts", "2024-01-03T00:00:00Z", "2024-01-05T00:00:00Z", 43_200.0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("event_id", F.unix_millis("ts").alias("t"))


# streams


@query("WITH m AS (SELECT * FROM " + _MSG + "), c AS (SELECT coalesce(max(seq), -1) AS c FROM m WHERE op = 'clear'), g AS (SELECT id, max(seq) AS g FROM m WHERE op = 'delete' GROUP BY 1) SELECT id, seq, value FROM (SELECT m.*, row_number() OVER (PARTITION BY m.id ORDER BY ts DESC, seq DESC) AS r FROM m JOIN c ON true LEFT JOIN g ON m.id = g.id WHERE op = 'change' AND seq > c AND (g IS NULL OR seq > g)) WHERE r = 1")
def live_stream(spark: SparkSession, d: str) -> DataFrame:
    """All messages through a stream into a live table."""
    path = _folder(spark, "live")
    _messages(spark, d).write.parquet(f"{path}/in")
    messages = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    table = live.LiveTable(spark, f"{path}/state")
    table.start(messages, f"{path}/checkpoint").awaitTermination()
    return table.query().select("id", "seq", "value")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts of a stream; the last state of each window is kept."""
    path = _folder(spark, "windows")
    _ev(spark, d).select("ts", "event_type").write.parquet(f"{path}/in")
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{path}/in")
    counts = live.windowed_counts(events, "ts", "event_type", "1 day", "40 days")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return last.select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


_LIFE = "SELECT id, seq FROM (SELECT user_id AS id, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND "


def _with_ingest(spark: SparkSession, d: str) -> DataFrame:
    late = F.make_dt_interval((F.col("event_id") % 5).cast("int"))
    return _ev(spark, d).select(F.col("user_id").alias("id"), F.lit("change").alias("op"), "ts", F.col("event_id").alias("seq"), (F.col("ts") + late).alias("came"))


@query(_LIFE + "epoch_ms(ts) + (seq % 5) * 86400000 + 432000000 > epoch_ms(TIMESTAMP '2024-01-30')")
def live_ingest_expiry(spark: SparkSession, d: str) -> DataFrame:
    return live.latest_state(_with_ingest(spark, d), now=F.lit("2024-01-30").cast("timestamp"), ttl=F.lit(432_000_000).cast("long"), since="came").select("id", "seq")


@query(_LIFE + "NOT epoch_ms(ts) + 604800000 > epoch_ms(TIMESTAMP '2024-02-06')")
def live_expired_rows(spark: SparkSession, d: str) -> DataFrame:
    return live.latest_state(_with_ingest(spark, d), now=F.lit("2024-02-06").cast("timestamp"), ttl=F.lit(604_800_000).cast("long"), expired=True).select("id", "seq")


@query("SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view'")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "join")
    ev = _ev(spark, d)
    ev.where("event_type = 'click'").select("user_id", "event_id", "ts").write.parquet(f"{path}/a")
    ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("near_id"), F.col("ts").alias("seen")).write.parquet(f"{path}/b")
    a, b = (spark.readStream.schema(spark.read.parquet(f"{path}/{x}").schema).parquet(f"{path}/{x}") for x in "ab")
    both = live.stream_join(a, b, "user_id", "ts", "seen", within="2 hours", late="60 days").select("event_id", "near_id")
    both.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, near_id long").parquet(f"{path}/out")


_XYZ = "(SELECT c_custkey, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {CU})"


@query(
    "WITH f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM " + _XYZ + "), "
    "q AS (SELECT *, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END >= -1e-16 AS i, CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END >= -1e-16 AS j FROM f), "
    "p AS (SELECT *, CASE WHEN face % 2 = 0 THEN CASE WHEN NOT i AND NOT j THEN 0 WHEN NOT i THEN 1 WHEN j THEN 2 ELSE 3 END ELSE CASE WHEN NOT i AND NOT j THEN 0 WHEN NOT j THEN 1 WHEN i THEN 2 ELSE 3 END END AS place FROM q) "
    "SELECT c_custkey, ((face % 4)::HUGEINT * 2305843009213693952 + place::HUGEINT * 576460752303423488 + 288230376151711744 - CASE WHEN face >= 4 THEN 9223372036854775808::HUGEINT ELSE 0 END)::BIGINT AS cell FROM p"
)
def curve_s2(spark: SparkSession, d: str) -> DataFrame:
    """The quarter of a cube's face that holds each point."""
    return _cust(spark, d).select("c_custkey", s2.s2("lon", "lat", 1).alias("cell"))
