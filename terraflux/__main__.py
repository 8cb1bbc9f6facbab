"""Command line over stored tables: python -m terraflux COMMAND PATH ... (see --help)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native
from .operators import aggregates
from .plans.ecql import Layout, ecql
from .sources import convert, export, storage
from .sources.relation import load, save


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terraflux", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *more: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=what)
        c.add_argument("path", help="folder of a stored table")
        for m in more:
            c.add_argument(m)
        return c

    def filtered(c: argparse.ArgumentParser) -> None:
        c.add_argument("--filter", default="INCLUDE", help="ECQL")
        c.add_argument("--lon", default="lon")
        c.add_argument("--lat", default="lat")

    command("describe", "columns and types")
    command("partitions", "rows of each partition")
    filtered(command("count", "rows that a filter keeps"))
    c = command("stats", "statistics as JSON", "stats")
    filtered(c)
    c = command("export", "write rows in some form", "out")
    filtered(c)
    c.add_argument("--format", default="csv", choices=("csv", "tsv", "json", "parquet", "orc", "geojson", "null"))
    c.add_argument("--columns", help="by comma")
    c.add_argument("--limit", type=int)
    c = command("ingest", "convert a file and append it", "file", "converter")
    c.add_argument("--scheme", default="flat")
    for name in ("time", "lon", "lat"):
        c.add_argument(f"--{name}")
    filtered(command("delete", "delete the rows that a filter keeps", "key"))
    c = command("compact", "merge files")
    c.add_argument("--partition")
    command("vacuum", "delete files that are no longer used")
    return p


def _rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    df = load(spark, a.path)
    point = {"geom": (a.lon, a.lat)} if {a.lon, a.lat} <= set(df.columns) else {}
    return df.where(ecql(a.filter, Layout(df.schema, points=point)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("terraflux").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "describe":
            for f in load(spark, a.path).schema:
                print(f"{f.name}\t{f.dataType.simpleString()}")
        elif a.command == "partitions":
            for r in storage.read(spark, a.path).groupBy("partition").agg(F.count(F.lit(1)).alias("n")).orderBy("partition").toLocalIterator():
                print(f"{r.partition}\t{r.n}")
        elif a.command == "count":
            print(_rows(spark, a).count())
        elif a.command == "stats":
            print(aggregates.to_json(aggregates.statistics(_rows(spark, a), a.stats, lon=a.lon, lat=a.lat)))
        elif a.command == "export":
            df = _rows(spark, a)
            names = a.columns.split(",") if a.columns else [c for c in df.columns if c != "partition"]
            if a.format == "geojson":
                rest = [c for c in names if c not in (a.lon, a.lat)]
                df = export.geojson(df, names[0], native.point_geojson(a.lon, a.lat), rest)
            else:
                df = df.select(*names)
            df = df if a.limit is None else df.limit(a.limit)
            df.write.text(a.out) if a.format == "geojson" else export.write(df, a.out, a.format, "error")
        elif a.command == "ingest":
            with open(a.converter, encoding="utf-8") as f:
                conf = json.load(f)
            conf["fields"] = [tuple(x) for x in conf["fields"]]
            good, bad = convert.convert(spark, convert.Converter(**conf), a.file)
            options = {k: v for k in ("time", "lon", "lat") if (v := getattr(a, k))}
            save(good, a.path, scheme=a.scheme, **options)
            print(f"{bad.count()} rows refused", file=sys.stderr)
        elif a.command == "delete":
            storage.update(spark, a.path, _rows(spark, a).select(a.key), a.key, delete=True)
        elif a.command == "compact":
            storage.compact(spark, a.path, a.partition)
        elif a.command == "vacuum":
            print(storage.vacuum(spark, a.path))
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
