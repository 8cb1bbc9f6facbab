"""Density grids and the statistics language."""

from __future__ import annotations

import json
import math
import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native

# density


def density(df: DataFrame, lon: str, lat: str, bounds: tuple[float, float, float, float], width: int, height: int, weight: Column | str | None = None) -> DataFrame:
    """(i, j, weight): sum of weights in each cell of a grid over the closed bounds. The upper
    edges fall in the last cells, what is outside is dropped. A text weight that is no number
    counts 1, a null one 0."""
    if weight is None:
        w = F.lit(1.0)
    else:
        w = F.col(weight) if isinstance(weight, str) else weight
        is_text = isinstance(df.select(w.alias("w")).schema["w"].dataType, T.StringType)
        w = F.when(w.isNull(), F.lit(0.0)).otherwise(F.coalesce(w.try_cast("double"), F.lit(1.0)) if is_text else w.cast("double"))
    x0, y0, x1, y1 = bounds
    cells = df.where(native.in_box(lon, lat, *bounds)).select(native.grid_cell(lon, x0, x1, width).alias("i"), native.grid_cell(lat, y0, y1, height).alias("j"), w.alias("w"))
    return cells.groupBy("i", "j").agg(F.sum("w").alias("weight"))


def density_lines(df: DataFrame, geom: str, bounds: tuple[float, float, float, float], width: int, height: int, weight: str | None = None) -> DataFrame:
    """As density, for geometries of any kind: lines weigh on each cell that Bresenham's line
    passes, areas on each cell whose centre they hold."""
    from ..geom.model import from_wkb
    from ..geom.relate import in_ring

    x0, y0, x1, y1 = bounds

    def at(x: float, y: float) -> tuple[int, int] | None:
        if not (x0 <= x <= x1 and y0 <= y <= y1):
            return None
        return min(width - 1, int((x - x0) * width / (x1 - x0))), min(height - 1, int((y - y0) * height / (y1 - y0)))

    def cells(g) -> set[tuple[int, int]]:
        out: set = set()
        for p in g.parts():
            if p.kind == "Point" and p.coords:
                out.add(at(*p.coords[:2]))
            elif p.kind == "LineString":
                for a, b in zip(p.coords, p.coords[1:]):
                    i0, j0, i1, j1 = (int((v - lo) * n // (hi - lo)) for v, lo, hi, n in ((a[0], x0, x1, width), (a[1], y0, y1, height), (b[0], x0, x1, width), (b[1], y0, y1, height)))
                    n = max(abs(i1 - i0), abs(j1 - j0))
                    for k in range(n + 1):
                        i, j = round(i0 + (i1 - i0) * k / n) if n else i0, round(j0 + (j1 - j0) * k / n) if n else j0
                        if 0 <= i < width and 0 <= j < height:
                            out.add((i, j))
            elif p.kind == "Polygon" and p.coords:
                b = p.bounds()
                for i in range(max(0, int((b[0] - x0) * width // (x1 - x0))), min(width - 1, int((b[2] - x0) * width // (x1 - x0))) + 1):
                    for j in range(max(0, int((b[1] - y0) * height // (y1 - y0))), min(height - 1, int((b[3] - y0) * height // (y1 - y0))) + 1):
                        c = (x0 + (i + 0.5) * (x1 - x0) / width, y0 + (j + 0.5) * (y1 - y0) / height)
                        if in_ring(c, p.coords[0]) and not any(in_ring(c, h) for h in p.coords[1:]):
                            out.add((i, j))
        return out - {None}

    import pyarrow as pa

    def run(batches):
        for b in batches:
            i, j, w = [], [], []
            for g, k in zip(b.column("g").to_pylist(), b.column("w").to_pylist(), strict=True):
                for c in cells(from_wkb(g)) if g is not None else ():
                    i.append(c[0])
                    j.append(c[1])
                    w.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(w, pa.float64())], ["i", "j", "w"])

    rows = df.select(F.col(geom).alias("g"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    return rows.mapInArrow(run, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("weight"))


def smoothed(grid: DataFrame, radius: int) -> DataFrame:
    """A density grid with each cell's weight spread over the cells within ``radius``, falling linearly."""
    taps = [(a, b, 1 - math.hypot(a, b) / (radius + 1)) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if math.hypot(a, b) <= radius]
    kernel = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for a, b, k in taps])
    spread = grid.withColumn("t", F.explode(kernel)).select((F.col("i") + F.col("t.a")).alias("i"), (F.col("j") + F.col("t.b")).alias("j"), (F.col("weight") * F.col("t.k")).alias("w"))
    return spread.groupBy("i", "j").agg(F.sum("w").alias("weight"))


# statistics

_STAT = re.compile(r"\s*(\w+)\s*\(")


def parse_stats(text: str) -> list[tuple[str, list]]:
    """[(name, arguments)] of a ;-separated list; an argument that is itself a list of stats is parsed."""
    out, at = [], 0
    while text[at:].strip():
        m = _STAT.match(text, at)
        if not m:
            raise ValueError(f"not a statistic: {text[at:]!r}")
        depth, i, start, args, quote = 1, m.end(), m.end(), [], ""
        while depth:
            if i >= len(text):
                raise ValueError(f"unclosed bracket in {text!r}")
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            if (c == "," and depth == 1 and not quote) or not depth:
                args.append(text[start:i].strip())
                start = i + 1
            i += 1
        name = m[1]
        args = [a for a in args if a]
        args = [parse_stats(a) if _STAT.match(a) and name == "GroupBy" else a.strip("\"'") for a in args]
        if name == "GroupBy" and len(args) > 1 and isinstance(args[1], list):
            args = [args[0], [s for a in args[1:] for s in a]]
        out.append((name, args))
        at = i
        rest = re.match(r"\s*;?", text[at:])
        at += rest.end()
    return out


def property_names(text: str) -> list[str]:
    """The attributes that a list of statistics uses, in order, each once."""
    out: list[str] = []
    for name, args in parse_stats(text):
        if name == "GroupBy":
            out.append(args[0])
            out += [a for n, inner in args[1] for a in _attributes(n, inner)]
        else:
            out += _attributes(name, args)
    return list(dict.fromkeys(out))


def _attributes(name: str, args: list) -> list[str]:
    used = {"Count": 0, "IteratorStackCount": 0, "DescriptiveStats": len(args), "Z3Histogram": 2, "Z3Frequency": 2}.get(name, 1)
    return [a for a in args[:used] if isinstance(a, str)]


_DIGITS36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def text_number(c: Column) -> Column:
    """A text's place between 0 and 1: its first eight characters as digits to the base of 36, small and
    capital letters alike; others count 0."""
    digit = lambda k: F.greatest(F.instr(F.lit(_DIGITS36), F.lower(F.substring(c, k, 1))) - 1, F.lit(0))
    return sum((F.when(F.length(c) >= k, digit(k)).otherwise(0) * F.lit(36.0**-k) for k in range(1, 9)), F.lit(0.0)) + F.when(c.isNull(), F.lit(None).cast("double")).otherwise(0.0)


def text_bound(text: str) -> float:
    return sum(max(0, _DIGITS36.find(x)) * 36.0**-k for k, x in enumerate(text.lower()[:8], 1))


def _number(c: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text_number(F.col(c))
    return F.unix_millis(F.col(c).cast("timestamp")).cast("double") if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(c).cast("double")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) or math.isinf(v) else v
    if isinstance(v, datetime | date):
        return v.isoformat()
    return v


def widened(df: DataFrame, column: str, low: float, high: float) -> tuple[float, float]:
    """The range, widened to the data's own bounds."""
    v = _number(column, df.schema[column].dataType)
    seen = df.select(v.alias("v")).where("v is not null and not isnan(v)").agg(F.min("v"), F.max("v")).first()
    return (low, high) if seen[0] is None else (min(low, seen[0]), max(high, seen[1]))


def place_histogram(df: DataFrame, lon: str, lat: str, bins: int, bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """(bin, n) of points over ranges of equal width of z2 between the corners of bounds."""
    cell = lambda v, size: min((1 << 31) - 1, int(v / size * (1 << 31)))
    corner = lambda x, y: sum((cell(x + 180, 360) >> k & 1) << 2 * k | (cell(y + 90, 180) >> k & 1) << 2 * k + 1 for k in range(31))
    low, high = corner(*bounds[:2]), corner(*bounds[2:])
    width = (high - low) // bins + 1
    z = native.z2(lon, lat)
    at = F.least(F.greatest(F.floor((z - F.lit(low)) / F.lit(float(width))), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, n) over bins of equal width. Values outside widen the range to the data's own
    bounds first (the result doesn't depend on order); nulls are skipped."""
    keys = keys or []
    v = _number(column, df.schema[column].dataType)
    rows = df.select(*keys, v.alias("v")).where("v is not null and not isnan(v)")
    low, high = widened(df, column, low, high)
    cell = F.least(F.floor((F.col("v") - low) * bins / (high - low)), F.lit(bins - 1)).cast("int") if high > low else F.lit(0)
    return rows.groupBy(*keys, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def descriptive(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Moments of the columns over rows in which none is null or NaN: count, and for each
    column min, max, sum, mean, population and sample variance and standard deviation, skewness
    and kurtosis (population; sample); for each pair covariance and correlation."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(good).select(*(keys or []), *[F.col(c).cast("double").alias(c) for c in columns])
    n = F.count(F.lit(1))
    out = [n.alias("count")]
    for c in columns:
        k = F.kurtosis(c) + 3
        sample = ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6) + 3)
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean"), F.var_pop(c).alias(f"{c}_var_pop"), F.stddev_pop(c).alias(f"{c}_sd_pop"), F.var_samp(c).alias(f"{c}_var_samp"), F.stddev_samp(c).alias(f"{c}_sd_samp"), F.skewness(c).alias(f"{c}_skew"), k.alias(f"{c}_kurtosis"), F.when(n > 3, sample).alias(f"{c}_kurtosis_samp")]
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out += [F.covar_pop(a, b).alias(f"{a}_{b}_cov_pop"), F.covar_samp(a, b).alias(f"{a}_{b}_cov_samp"), F.corr(a, b).alias(f"{a}_{b}_corr")]
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


def top_k(df: DataFrame, column: str, k: int = 10, keys: list[str] | None = None) -> DataFrame:
    """The k most frequent values with counts; ties go by the value."""
    from pyspark.sql import Window

    counts = df.where(F.col(column).isNotNull()).groupBy(*(keys or []), column).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), column).limit(k)
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), column)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def statistics(df: DataFrame, text: str, *, lon: str | None = None, lat: str | None = None) -> dict | list:
    """The statistics of a DataFrame as plain values, ready for JSON; a list for several.

    Count(), MinMax(a), Enumeration(a), TopK(a), Frequency(a,precision),
    Histogram(a,bins,low,high), Z3Histogram(lon|geom,date,period,length),
    Z3Frequency(..), DescriptiveStats(a,...), GroupBy(a,stats), IteratorStackCount().
    """
    got = [_one(df, name, args, lon, lat) for name, args in parse_stats(text)]
    return got[0] if len(got) == 1 else got


def merged_statistics(stores: list[DataFrame], text: str, **place: str) -> dict | list:
    """The statistics of several tables together; of each only the attributes that are used."""
    names = [*property_names(text), *place.values()]
    parts = [df.select(*[c for c in dict.fromkeys(names) if c in df.columns] or [F.lit(1).alias("one")]) for df in stores]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return statistics(out, text, **place)


def _z_bins(df: DataFrame, args: list, lon: str | None, lat: str | None) -> DataFrame:
    part, offset, whole = native.time_bin(F.col(args[1]), args[2])
    return df.select(part.alias("bin"), native.z3(lon, lat, offset, whole).alias("z")).where("z is not null")


def _one(df: DataFrame, name: str, args: list, lon: str | None, lat: str | None):
    if name == "Count":
        return {"count": df.count()}
    if name == "IteratorStackCount":
        return {"count": df.select(F.spark_partition_id().alias("p")).distinct().count()}
    if name == "MinMax":
        r = df.agg(F.min(args[0]), F.max(args[0]), F.approx_count_distinct(args[0])).first()
        return {"min": _plain(r[0]), "max": _plain(r[1]), "cardinality": r[2]}
    if name == "Enumeration":
        rows = df.where(F.col(args[0]).isNotNull()).groupBy(args[0]).count().collect()
        return {str(_plain(r[0])): r[1] for r in sorted(rows, key=lambda r: str(r[0]))}
    if name == "TopK":
        return {str(i): {"value": _plain(r[0]), "count": r[1]} for i, r in enumerate(top_k(df, args[0]).collect())}
    if name == "Frequency":
        eps = float(args[-1]) if len(args) > 1 and re.fullmatch(r"0?\.\d+", args[-1]) else 0.005
        r = df.where(F.col(args[0]).isNotNull()).agg(F.count_min_sketch(F.col(args[0]).cast("string"), F.lit(eps), F.lit(0.95), F.lit(1)), F.count(F.lit(1))).first()
        return {"eps": eps, "confidence": 0.95, "size": r[1], "sketch": bytes(r[0]).hex() if r[0] is not None else ""}
    if name == "Histogram":
        text = isinstance(df.schema[args[0]].dataType, T.StringType)
        bins, low, high = int(args[1]), *[text_bound(x) if text else float(x) if re.fullmatch(r"[-+.\deE]+", x) else datetime.fromisoformat(x.replace("Z", "+00:00")).timestamp() * 1000 for x in args[2:4]]
        low, high = widened(df, args[0], low, high)
        counts = {r["bin"]: r["n"] for r in histogram(df, args[0], bins, low, high).collect()}
        return {"lower-bound": low, "upper-bound": high, "bins": [counts.get(i, 0) for i in range(bins)]}
    if name == "Z3Histogram":
        n = int(args[3])
        rows = _z_bins(df, args, lon, lat).groupBy("bin", F.floor(F.col("z") / ((1 << 63) / n)).cast("int").alias("k")).count().collect()
        return {str(b): [next((r["count"] for r in rows if r["bin"] == b and r["k"] == k), 0) for k in range(n)] for b in sorted({r["bin"] for r in rows})}
    if name == "Z3Frequency":
        rows = _z_bins(df, args, lon, lat).groupBy("bin").agg(F.count_min_sketch(F.shiftright("z", 63 - int(args[3])), F.lit(0.005), F.lit(0.95), F.lit(1)).alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return {str(r["bin"]): {"size": r["n"], "sketch": bytes(r["s"]).hex()} for r in rows}
    if name == "DescriptiveStats":
        return {k: _plain(v) for k, v in descriptive(df, args).first().asDict().items()}
    if name == "GroupBy":
        return _by_group(df, args[0], args[1], lon, lat)
    raise ValueError(f"no such statistic: {name}")


def _by_group(df: DataFrame, key: str, stats: list[tuple[str, list]], lon: str | None, lat: str | None) -> dict:
    """Plain values of each group, for an export: one aggregation for each statistic over all groups.
    Histograms have the range of all rows."""
    rows = df.where(F.col(key).isNotNull())
    per_key: dict = {r[0]: [] for r in rows.groupBy(key).agg(F.count(F.lit(1))).collect()}

    def put(make, found: dict) -> None:
        for k, v in per_key.items():
            v.append(make(found.get(k)))

    for name, args in stats:
        if name == "Count":
            put(lambda n: {"count": n or 0}, {r[0]: r[1] for r in rows.groupBy(key).agg(F.count(F.lit(1))).collect()})
        elif name == "MinMax":
            got = rows.groupBy(key).agg(F.min(args[0]), F.max(args[0]), F.approx_count_distinct(args[0])).collect()
            put(lambda r: {"min": _plain(r[1]), "max": _plain(r[2]), "cardinality": r[3]}, {r[0]: r for r in got})
        elif name == "Enumeration":
            values: dict = {}
            for k, v, n in rows.where(F.col(args[0]).isNotNull()).groupBy(key, args[0]).count().collect():
                values.setdefault(k, []).append((str(_plain(v)), n))
            put(lambda x: dict(sorted(x or [])), values)
        elif name == "TopK":
            best: dict = {}
            for r in sorted(top_k(rows, args[0], keys=[key]).collect(), key=lambda r: (-r["n"], str(r[args[0]]))):
                best.setdefault(r[key], []).append({"value": _plain(r[args[0]]), "count": r["n"]})
            put(lambda x: {str(i): v for i, v in enumerate(x or [])}, best)
        elif name == "Histogram":
            bins, (low, high) = int(args[1]), widened(rows, args[0], *map(float, args[2:4]))
            counts: dict = {}
            for r in histogram(rows, args[0], bins, low, high, [key]).collect():
                counts.setdefault(r[key], {})[r["bin"]] = r["n"]
            put(lambda c: {"lower-bound": low, "upper-bound": high, "bins": [(c or {}).get(i, 0) for i in range(bins)]}, counts)
        elif name == "DescriptiveStats":
            got = descriptive(rows, args, [key]).collect()
            put(lambda r: {k: _plain(v) for k, v in r.asDict().items() if k != key} if r else {}, {r[key]: r for r in got})
        elif name == "GroupBy":
            raise ValueError("groups within groups are not supported")
        else:  # sketches, one for each of the few keys of an export
            for k, v in per_key.items():
                v.append(_one(rows.where(F.col(key) == F.lit(k)), name, args, lon, lat))
    return {str(_plain(k)): v for k, v in sorted(per_key.items(), key=lambda x: str(x[0]))}


def grouped_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Count, MinMax and DescriptiveStats of each group, in one aggregation."""
    out: list[Column] = []
    for name, args in parse_stats(text):
        if name == "Count":
            out.append(F.count(F.lit(1)).alias("count"))
        elif name == "MinMax":
            out += [F.min(args[0]).alias(f"{args[0]}_min"), F.max(args[0]).alias(f"{args[0]}_max"), F.approx_count_distinct(args[0]).alias(f"{args[0]}_cardinality")]
        elif name == "DescriptiveStats":
            out += [f(a).alias(f"{a}_{n}") for a in args for f, n in ((F.sum, "sum"), (F.avg, "mean"), (F.var_pop, "var_pop"), (F.stddev_samp, "sd_samp"))]
        else:
            raise ValueError(f"{name} isn't a single row")
    return df.groupBy(key).agg(*out)


def to_json(stats: dict | list) -> str:
    return json.dumps(stats, separators=(",", ":"))


def unique(df: DataFrame, column: str, by: str = "value", descending: bool = False) -> DataFrame:
    """Distinct values with counts, in the order of the value's text or of the count."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    key = F.col(column).cast("string") if by == "value" else F.col("count")
    return counts.orderBy(key.desc() if descending else key.asc(), F.col(column).cast("string"))


def count_min_estimate(sketch: bytes, item: str) -> int:
    """Estimate for one item from Spark's count-min sketch of strings, read on the driver."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.active().sparkContext._jvm
    return jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(sketch)).estimateCount(bytearray(item.encode()))
