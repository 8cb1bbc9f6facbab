"""Directory layouts by date, attribute and place; writing, pruning, updates and compaction, by versions."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native
from ..functions.xz import XZ
from .shared import filesystem

#: Date patterns of the named layouts.
DATE_LAYOUTS = {"minute": "yyyy/MM/dd/HH/mm", "hourly": "yyyy/MM/dd/HH", "daily": "yyyy/MM/dd", "monthly": "yyyy/MM", "yearly": "yyyy", "julian-minute": "yyyy/DDD/HH/mm", "julian-hourly": "yyyy/DDD/HH", "julian-daily": "yyyy/DDD"}


#: Layouts of one's own: name to a function of the names of the time, lon and lat columns.
LAYOUTS: dict[str, Callable[[str | None, str | None, str | None], Column]] = {}


def partition_value(scheme: str, *, time: str | None = None, lon: str | None = None, lat: str | None = None, bounds: tuple[str, str, str, str] | None = None) -> Column:
    """Column of a layout: a date layout, ``weekly``, ``z2-8bits``, ``xz2-8bits`` (of the bounds columns of
    extended shapes), ``attribute:name``, ``flat``, one of LAYOUTS, or several of them joined by commas."""
    parts = []
    for s in scheme.split(","):
        if s == "flat":
            parts.append(F.lit("all"))
        elif s == "weekly":
            t = F.col(time)
            monday = F.date_trunc("week", t)
            parts.append(F.concat(F.year(F.date_add(monday, 3)).cast("string"), F.lit("/W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0")))
        elif s in DATE_LAYOUTS:
            parts.append(F.date_format(time, DATE_LAYOUTS[s]))
        elif s.startswith("z2-") and s.endswith("bits"):
            bits = int(s[3:-4])
            width = len(str(4 ** (bits // 2) - 1))
            parts.append(F.lpad(native.z2(lon, lat, bits // 2).cast("string"), width, "0"))
        elif s.startswith("xz2-") and s.endswith("bits"):
            parts.append(XZ.two(int(s[4:-4]) // 2).column(*map(F.col, bounds)).cast("string"))
        elif s in LAYOUTS:
            parts.append(LAYOUTS[s](time, lon, lat))
        elif s.startswith("attribute:"):
            parts.append(F.coalesce(F.col(s.partition(":")[2]).cast("string"), F.lit("")))
        else:
            raise ValueError(f"no such layout: {s}")
    return parts[0] if len(parts) == 1 else F.concat_ws("/", *parts)


def z2_cells(bounds: tuple[float, float, float, float], bits: int) -> list[str]:
    """Values of a z2 layout that a box touches, for pruning."""
    half = bits // 2
    n = 1 << half
    at = lambda v, lo, hi: min(n - 1, max(0, math.floor((v - lo) * n / (hi - lo))))
    width = len(str(4**half - 1))
    out = []
    for i in range(at(bounds[0], -180, 180), at(bounds[2], -180, 180) + 1):
        for j in range(at(bounds[1], -90, 90), at(bounds[3], -90, 90) + 1):
            z = sum((i >> k & 1) << 2 * k | (j >> k & 1) << 2 * k + 1 for k in range(half))
            out.append(str(z).zfill(width))
    return out


#: Of a stored table: path/gen=<write>/partition=<value>/ has the files, path/_manifest/<version>.json says
#: for each partition in which gens its current files are. A change writes a new gen and then a new version.
_MANIFEST = "_manifest"


@dataclass
class Manifest:
    """The current state of a stored table. partitions: folder name to gens, schema: Spark's, as JSON."""

    version: int = 0
    schema: str | None = None
    partitions: dict[str, list[str]] = field(default_factory=dict)


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest version, None where there is no table."""
    fs, make = filesystem(spark, path)
    where = make(f"{path}/{_MANIFEST}")
    if not fs.exists(where):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    version = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
    if not version:
        return None
    text = spark.read.text(f"{path}/{_MANIFEST}/{version}.json", wholetext=True).first()[0]
    return Manifest(version, **json.loads(text))


def _switch(spark: SparkSession, path: str, old: Manifest | None, new: Manifest) -> None:
    """Make ``new`` the newest version, in one rename; an error if another writer was first."""
    fs, make = filesystem(spark, path)
    version = (old.version if old else 0) + 1
    draft, final = make(f"{path}/{_MANIFEST}/.{uuid.uuid4().hex}"), make(f"{path}/{_MANIFEST}/{version}.json")
    out = fs.create(draft, False)
    out.write(json.dumps({"schema": new.schema, "partitions": new.partitions}).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"{path} has been changed by another writer")


def _written(df: DataFrame, path: str, records: int = 0, bloom: str | None = None) -> tuple[str, list[str]]:
    """Write rows with a column ``partition`` as a new gen; its name and the folders it has."""
    gen = uuid.uuid4().hex
    w = df.write.partitionBy("partition")
    if bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    (w.option("maxRecordsPerFile", records) if records else w).parquet(f"{path}/gen={gen}")
    fs, make = filesystem(df.sparkSession, path)
    return gen, sorted(n for f in fs.listStatus(make(f"{path}/gen={gen}")) if (n := f.getPath().getName()).startswith("partition="))


def write(df: DataFrame, path: str, scheme: str, *, time: str | None = None, lon: str | None = None, lat: str | None = None, bounds: tuple[str, str, str, str] | None = None, records: int = 0, mode: str = "append", sort: bool = True, index: str | None = None) -> None:
    """Write by layout, rows of a partition in z-order, files of at most ``records`` rows. mode:
    append, or overwrite for a table of these rows only. index: "z3" orders the rows of a partition by
    week and z3, a column's name by it, with a Bloom filter for equality; so filters skip row groups."""
    spark, path = df.sparkSession, path.rstrip("/")
    out = df.withColumn("partition", F.replace(partition_value(scheme, time=time, lon=lon, lat=lat, bounds=bounds), F.lit("/"), F.lit("_")))
    if index:
        keys = [F.col(index)]
        if index == "z3":
            week, offset, whole = native.time_bin(F.col(time), "week")
            keys = [week, native.z3(lon, lat, offset, whole)]
        names = [f"__k{i}" for i in range(len(keys))]
        out = out.withColumns(dict(zip(names, keys))).repartitionByRange("partition", *names).sortWithinPartitions("partition", *names).drop(*names)
    elif lon and lat and sort:
        # partitions in parallel by place too: a hot partition is cut by its z-order
        out = out.withColumn("__z", native.z2(lon, lat)).repartitionByRange("partition", "__z").sortWithinPartitions("partition", "__z").drop("__z")
    old = manifest(spark, path)
    gen, folders = _written(out, path, records, index if index and index != "z3" else None)
    partitions = {} if mode == "overwrite" or old is None else {k: list(v) for k, v in old.partitions.items()}
    for f in folders:
        partitions.setdefault(f, []).append(gen)
    _switch(spark, path, old, Manifest(schema=out.schema.json(), partitions=partitions))


def _folder_value(folder: str) -> str | None:
    value = unquote(folder.partition("=")[2])
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def _read(spark: SparkSession, path: str, at: Manifest, keep: Callable[[str | None], bool] | None = None) -> DataFrame:
    folders = [f"{path}/gen={g}/{p}" for p, gens in at.partitions.items() if keep is None or keep(_folder_value(p)) for g in gens]
    schema = T.StructType.fromJson(json.loads(at.schema))
    if not folders:
        return spark.createDataFrame([], schema)
    fields = T.StructType([*schema, T.StructField("gen", T.StringType())])
    return spark.read.schema(fields).option("basePath", path).parquet(*folders).select(*schema.names)


def read(spark: SparkSession, path: str, *, days: tuple[datetime, datetime] | None = None, box: tuple[tuple, int] | None = None, meets: tuple[tuple, int] | None = None, partitions: list[str] | None = None) -> DataFrame:
    """Read back the newest version; ``days`` (of a daily layout), ``box`` (bounds, bits; of a z2 layout),
    ``meets`` (the same of an xz2 layout) or a list of partitions prune the folders that are listed and read."""
    path = path.rstrip("/")
    at = manifest(spark, path)
    if at is None:
        raise FileNotFoundError(f"no stored table at {path}")
    tests: list[Callable[[str], bool]] = []
    if days:
        low, high = (d.strftime("%Y_%m_%d") for d in days)
        tests.append(lambda v: low <= v <= high)
    if box:
        cells = set(z2_cells(*box))
        tests.append(cells.__contains__)
    if meets:
        (x0, y0, x1, y1), bits = meets
        ranges = XZ.two(bits // 2).ranges((x0, y0), (x1, y1))
        tests.append(lambda v: any(a <= int(v) <= b for a, b in ranges))
    if partitions is not None:
        tests.append(set(partitions).__contains__)
    return _read(spark, path, at, (lambda v: v is not None and all(t(v) for t in tests)) if tests else None)


def update(spark: SparkSession, path: str, changes: DataFrame, key: str, *, delete: bool = False) -> None:
    """Replace or insert (or delete) rows by key. Changes have the table's columns, with ``partition``,
    and a key once; of them only the key is needed to delete. Rewritten are the partitions that hold
    a key and those that the changes go to; readers see the old version until all is written."""
    path = path.rstrip("/")
    old = manifest(spark, path)
    rows = _read(spark, path, old)
    keys = changes.select(key).distinct()
    held = rows.join(keys, key, "left_semi").select("partition")
    touched = {r[0] for r in (held if delete else held.unionByName(changes.select("partition"))).distinct().collect()}  # folders, few beside rows
    inside = lambda v: v in touched
    kept = _read(spark, path, old, inside).join(keys, key, "left_anti")
    new = kept if delete else kept.unionByName(changes.select(*rows.columns))
    gen, folders = _written(new, path)
    partitions = {k: v for k, v in old.partitions.items() if not inside(_folder_value(k))} | {f: [gen] for f in folders}
    _switch(spark, path, old, Manifest(schema=old.schema, partitions=partitions))


def compact(spark: SparkSession, path: str, partition: str | None = None, *, files: int | None = None, file_bytes: int = 128 << 20) -> None:
    """Merge the files of a partition, or of each, to ``files``, by default to about file_bytes each."""
    path = path.rstrip("/")
    old = manifest(spark, path)
    fs, make = filesystem(spark, path)
    partitions = dict(old.partitions)
    for folder, gens in old.partitions.items():
        if partition is not None and _folder_value(folder) != partition:
            continue
        size = sum(fs.getContentSummary(make(f"{path}/gen={g}/{folder}")).getLength() for g in gens)
        n = files or max(1, -(-size // file_bytes))
        rows = _read(spark, path, old, lambda v, of=_folder_value(folder): v == of)
        gen, folders = _written(rows.coalesce(n), path)
        partitions[folder] = [gen] if folders else []
    _switch(spark, path, old, Manifest(schema=old.schema, partitions={k: v for k, v in partitions.items() if v}))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files that the newest version doesn't have, once nobody reads an older one; how many folders went."""
    path = path.rstrip("/")
    at = manifest(spark, path)
    fs, make = filesystem(spark, path)
    live = {f"gen={g}/{p}" for p, gens in at.partitions.items() for g in gens}
    gone = 0
    for gen in (f.getPath().getName() for f in fs.listStatus(make(path))):
        if not gen.startswith("gen="):
            continue
        inside = [f.getPath().getName() for f in fs.listStatus(make(f"{path}/{gen}"))]
        dead = [p for p in inside if p.startswith("partition=") and f"{gen}/{p}" not in live]
        gone += len(dead)
        for p in [""] if len(dead) == sum(p.startswith("partition=") for p in inside) else dead:
            fs.delete(make(f"{path}/{gen}/{p}".rstrip("/")), True)
    return gone


def metadata(spark: SparkSession, path: str, lon: str, lat: str) -> DataFrame:
    """Rows and bounds of each partition."""
    return read(spark, path).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min(lon).alias("x0"), F.min(lat).alias("y0"), F.max(lon).alias("x1"), F.max(lat).alias("y1"))
