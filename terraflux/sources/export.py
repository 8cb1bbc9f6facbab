"""Output forms: BIN records, GeoJSON, delimited text, Arrow, GML, map pages."""

from __future__ import annotations

import html
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def java_hash(text: str) -> int:
    """Hash code of a string as the JVM computes it."""
    h = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (31 * h + (data[i] << 8 | data[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def bin_records(df: DataFrame, track: str, lon: str, lat: str, time: str, label: str | None = None, *, sort: bool = False) -> DataFrame:
    """(record): 16 bytes each, or 24 with a label: track's hash, seconds, latitude, longitude,
    and the label as a number or its first eight bytes; little-endian."""
    rows = df.select(F.col(track).cast("string").alias("track"), F.unix_timestamp(F.col(time).cast("timestamp")).alias("t"), F.col(lat).cast("float").alias("lat"), F.col(lon).cast("float").alias("lon"), *([F.col(label).cast("string").alias("label")] if label else []))
    if sort:
        rows = rows.orderBy("t")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                rec = struct.pack("<iiff", java_hash(r["track"] or ""), r["t"] or 0, r["lat"] or 0.0, r["lon"] or 0.0)
                if label:
                    v = r["label"] or ""
                    rec += struct.pack("<q", int(v)) if v.lstrip("-").isdigit() else v.encode()[:8].ljust(8, b"\0")
                out.append(rec)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def read_bin(data: bytes, labelled: bool = False) -> list[tuple]:
    size = 24 if labelled else 16
    return [struct.unpack("<iiff" + ("q" if labelled else ""), data[i : i + size]) for i in range(0, len(data), size)]


def geojson(df: DataFrame, fid: str, geometry: Column, properties: list[str]) -> DataFrame:
    """(feature): a GeoJSON text for each row; geometry: a Column of GeoJSON text."""
    head = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(F.col(fid).cast("string"))))
    return df.select(F.concat(F.regexp_replace(head, r'\["(.*)"\]$', '"$1"'), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("feature"))


def arrow_stream(df: DataFrame, dictionaries: list[str] | None = None, sort: str | None = None) -> bytes:
    """A result that fits the driver as an Arrow stream, the named columns as dictionaries."""
    t = (df.orderBy(sort) if sort else df).toArrow()
    for c in dictionaries or []:
        t = t.set_column(t.schema.get_field_index(c), c, t.column(c).dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def arrow_batches(df: DataFrame) -> DataFrame:
    """(batch): each Arrow batch as a self-contained stream, made on the executors."""

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    return df.mapInArrow(run, "batch binary")


def gml(df: DataFrame, fid: str, lon: str, lat: str, properties: list[str], name: str = "feature") -> DataFrame:
    """(member): a GML 3 feature member for each row."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    props = [F.concat(F.lit(f"<{p}>"), esc(F.coalesce(F.col(p).cast("string"), F.lit(""))), F.lit(f"</{p}>")) for p in properties]
    point = F.concat(F.lit('<geom><gml:Point srsName="EPSG:4326"><gml:pos>'), F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"), F.lit("</gml:pos></gml:Point></geom>"))
    return df.select(F.concat(F.lit(f'<gml:featureMember><{name} gml:id="'), esc(F.col(fid).cast("string")), F.lit('">'), *props, point, F.lit(f"</{name}></gml:featureMember>")).alias("member"))


def leaflet(features: list[str], title: str = "features") -> str:
    """A page that shows GeoJSON features (already few) on a map."""
    return f'<!doctype html><title>{html.escape(title)}</title><div id="map" style="height:100vh"></div><script>const data=[{",".join(features)}];</script>'


def records(df: DataFrame, form: str = "dicts", lon: str | None = None, lat: str | None = None) -> Iterator:
    """Rows one after another on the driver, a partition at a time: "values" (of the first column),
    "tuples", "dicts", or "geojson" (features as dictionaries, of the point in lon and lat)."""
    if form not in ("values", "tuples", "dicts", "geojson"):
        raise ValueError(f"no such form: {form}")
    for r in df.toLocalIterator():
        d = r.asDict(recursive=True)
        if form == "geojson":
            place = None if d.get(lon) is None or d.get(lat) is None else {"type": "Point", "coordinates": [d[lon], d[lat]]}
            yield {"type": "Feature", "geometry": place, "properties": {k: v for k, v in d.items() if k not in (lon, lat)}}
        else:
            yield r[0] if form == "values" else tuple(r) if form == "tuples" else d


def write(df: DataFrame, path: str, form: str, mode: str = "overwrite") -> None:
    """csv, tsv, json, parquet, orc, or null (which runs the query and keeps nothing)."""
    if form in ("csv", "tsv"):
        df.write.mode(mode).option("header", True).option("sep", "," if form == "csv" else "\t").csv(path)
    elif form == "null":
        df.write.format("noop").mode("overwrite").save()
    elif form in ("json", "parquet", "orc"):
        getattr(df.write.mode(mode), form)(path)
    else:
        raise ValueError(f"no such form: {form}")


