"""Feature tables by options: where they are, what to read of them, how to deal them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..operators import joins
from ..plans.ecql import Layout, ecql
from ..types import FeatureType
from . import storage


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A stored table, or a folder of Parquet or ORC files, as a DataFrame.

    schema: fields to read (a subset, or more, which are null), or a feature type's declaration.
    Options: ``format`` (stored, parquet, orc; stored where there is a manifest), ``lon`` and ``lat`` (the columns of the
    point ``geom``), ``fid``; ``query`` (ECQL, pushed to the scan); ``days`` or ``partitions`` by
    comma; ``cache`` true; ``spatial`` true deals rows out by ``strategy`` (equal, earth, weighted,
    rtree) to ``cells`` cells in a column ``cell``, rtree from a share ``sampleSize`` of rows.
    """
    if isinstance(schema, str) and ":" in schema:
        schema = FeatureType.parse("t", schema).schema()
    kind = options.get("format") or ("stored" if storage.manifest(spark, path) else "parquet")
    if kind == "stored":
        names = options["partitions"].split(",") if "partitions" in options else None
        df = storage.read(spark, path, partitions=names)
        if schema is not None:
            want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            have = set(df.columns)
            df = df.selectExpr(*[f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in want])
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = getattr(reader, kind)(path)
    point = {"geom": (options["lon"], options["lat"])} if "lon" in options else {}
    if "query" in options:
        df = df.where(ecql(options["query"], Layout(df.schema, points=point, fid=options.get("fid", "__fid__"))))
    if options.get("spatial", "false").lower() == "true":
        df = joins.grid_partition(df, options["lon"], options["lat"], int(options.get("cells", "16")), options.get("strategy", "equal"), float(options.get("sampleSize", "0.1")))[0]
    return df.persist(StorageLevel.MEMORY_AND_DISK) if options.get("cache", "false").lower() == "true" else df


def save(df: DataFrame, path: str, **options: str) -> None:
    """Append to (or, with ``mode`` overwrite, replace) a stored table: ``scheme`` and the columns
    ``time``, ``lon`` and ``lat`` that it needs; ``records`` a file at most."""
    storage.write(df, path, options.get("scheme", "flat"), time=options.get("time"), lon=options.get("lon"), lat=options.get("lat"), records=int(options.get("records", "0")), mode=options.get("mode", "append"))
