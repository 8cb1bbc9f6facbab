"""Declarative file conversion: a small expression language compiled to Columns.

A converter has options, an optional id expression and fields, each a name with an
expression. In expressions ``$0`` is the whole record, ``$n`` the n-th column,
``$name`` an earlier field; ``try(e, fallback)`` takes the fallback where a cast in e fails, ``e::type`` casts; functions are
called by name. Rows that a validator refuses, or whose conversion failed, go to a
side result or raise, as the error mode says.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes, native
from ..functions.st import column_function

_TOKEN = re.compile(r"""\s*(?:(?P<num>-?\d+\.?\d*(?:[eE][-+]?\d+)?[lLfFdD]?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<ref>\$\{[^}]*\}|\$\w+)|(?P<name>[A-Za-z_][\w.:-]*?(?=::|[^\w.:-]|$))|(?P<op>::|==|!=|<=|>=|&&|\|\||[<>!(),-]))""")
_TYPES = {"int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "boolean": "boolean", "bool": "boolean"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _numbers(args: tuple[Column, ...]) -> list[Column]:
    return [a.cast("double") for a in args]


def _fold(op: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def go(*args: Column) -> Column:
        first, *rest = _numbers(args)
        for a in rest:
            first = op(first, a)
        return first

    return go


def _with_default(kind: str) -> Callable[..., Column]:
    return lambda s, *d: F.coalesce(s.try_cast(kind), *[x.cast(kind) for x in d])


def _time(fmt: str) -> Callable[[Column], Column]:
    return lambda s: F.to_timestamp(s, fmt)


def _literal(c: Column, what: str) -> str:
    """The text of a literal argument; some functions need one."""
    text = getattr(c, "_plain", None)
    if text is None:
        raise ValueError(f"{what} must be a literal")
    return text


def _parse_map(kinds: Column, s: Column, kv: Column | None = None, pair: Column | None = None) -> Column:
    k, _, v = _literal(kinds, "the map's types").partition("->")
    split = F.str_to_map(s, F.lit(re.escape(_literal(pair, "the pair delimiter") if pair is not None else ",")), F.lit(re.escape(_literal(kv, "the key delimiter") if kv is not None else "->")))
    return F.transform_values(F.transform_keys(split, lambda a, b: F.trim(a).cast(_TYPES[k.strip().lower()])), lambda a, b: F.trim(b).cast(_TYPES[v.strip().lower()]))


def _parse_list(kind: Column, s: Column, sep: Column | None = None) -> Column:
    t = _TYPES[_literal(kind, "the list's type").lower()]
    parts = F.split(s, re.escape(_literal(sep, "the delimiter") if sep is not None else ","))
    return F.transform(parts, lambda x: F.trim(x).cast(t))


def _require(v: Column) -> Column:
    return F.when(v.isNull(), F.raise_error(F.lit("a required value is missing"))).otherwise(v)


def _st(name: str) -> Callable[..., Column]:
    return lambda *a: column_function(name)(*a)


def _coordinates(kind: str, x: Column, y: Column, depth: int) -> Column:
    """WKT of coordinates that are held as two arrays, nested to a depth."""

    def text(a: Column, b: Column, depth: int) -> Column:
        if not depth:
            return F.concat(a.cast("string"), F.lit(" "), b.cast("string"))
        inner = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: text(z["a"], z["b"], depth - 1))
        return F.concat(F.lit("("), F.array_join(inner, ", "), F.lit(")"))

    return F.concat(F.lit(kind + " "), text(x, y, depth))


def _point(*a: Column) -> Column:
    return _st("st_makepoint")(*_numbers(a)) if len(a) == 2 else _st("st_pointfromtext")(a[0])


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "tostring": lambda c: c.cast("string"),
    "stripquotes": lambda s: F.regexp_replace(s, "^['\"]+|['\"]+$", ""),
    "strip": lambda s, c=None: F.trim(s) if c is None else F.btrim(s, c),
    "stripprefix": lambda s, c: F.ltrim(s, c),
    "stripsuffix": lambda s, c: F.rtrim(s, c),
    "replace": F.replace,
    "remove": lambda s, x: F.replace(s, x, F.lit("")),
    "trim": F.trim,
    "capitalize": lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))),
    "lowercase": F.lower,
    "uppercase": F.upper,
    "concat": lambda *a: F.concat(*map(_text, a)),
    "mkstring": lambda sep, *a: F.concat_ws(_literal(sep, "the separator"), *map(_text, a)),
    "emptytonull": lambda s: F.when(F.trim(s) != "", s),
    "regexreplace": lambda regex, to, s: F.regexp_replace(s, regex, to),
    "substr": lambda s, a, b: F.substring(s, a + 1, b - a),
    "strlen": lambda s: F.coalesce(F.length(s), F.lit(0)),
    "printf": lambda fmt, *a: F.format_string(_literal(fmt, "the format"), *a),
    "now": F.current_timestamp,
    "millistodate": F.timestamp_millis,
    "secstodate": F.timestamp_seconds,
    "datetime": lambda s: F.to_timestamp(s),
    "isodatetime": lambda s: F.to_timestamp(s),
    "isodate": lambda s: F.to_timestamp(F.substring(s, 1, 10)),
    "isolocaldate": lambda s: F.to_timestamp(s),
    "isolocaldatetime": lambda s: F.to_timestamp(s),
    "isooffsetdatetime": lambda s: F.to_timestamp(s),
    "basicisodate": _time("yyyyMMdd"),
    "basicdatetime": _time("yyyyMMdd'T'HHmmss.SSSX"),
    "basicdatetimenomillis": _time("yyyyMMdd'T'HHmmssX"),
    "datehourminutesecondmillis": _time("yyyy-MM-dd'T'HH:mm:ss.SSS"),
    "date": lambda fmt, s: F.to_timestamp(s, _literal(fmt, "the date format")),
    "datetostring": lambda fmt, d: F.date_format(d, _literal(fmt, "the date format")),
    "datetomillis": F.unix_millis,
    "add": _fold(lambda a, b: a + b),
    "multiply": _fold(lambda a, b: a * b),
    "subtract": _fold(lambda a, b: a - b),
    "divide": _fold(lambda a, b: a / b),
    "mean": lambda *a: _fold(lambda x, y: x + y)(*a) / len(a),
    "min": lambda *a: F.least(*_numbers(a)) if len(a) > 1 else a[0].cast("double"),
    "max": lambda *a: F.greatest(*_numbers(a)) if len(a) > 1 else a[0].cast("double"),
    "toint": _with_default("int"),
    "tolong": _with_default("bigint"),
    "tofloat": _with_default("float"),
    "todouble": _with_default("double"),
    "toboolean": _with_default("boolean"),
    "inttoboolean": lambda c: c.cast("boolean"),
    "list": F.array,
    "parselist": _parse_list,
    "parsemap": _parse_map,
    "mapvalue": lambda m, k: F.try_element_at(m, k),
    "listitem": lambda c, i: F.element_at(c, i.cast("int") + 1),
    "point": _point,
    "pointm": lambda x, y, m: _st("st_makepointm")(*_numbers((x, y, m))),
    "multipoint": _st("st_mpointfromtext"),
    "linestring": _st("st_linefromtext"),
    "multilinestring": _st("st_mlinefromtext"),
    "polygon": _st("st_polygonfromtext"),
    "multipolygon": _st("st_mpolyfromtext"),
    "geometry": _st("st_geomfromwkt"),
    "geometrycollection": _st("st_geomfromwkt"),
    "projectfrom": lambda epsg, g: _st("st_transform")(g, epsg, F.lit("EPSG:4326")),
    "stringtobytes": lambda s: F.encode(s, "UTF-8"),
    "uuid": F.uuid,
    "uuidz3": lambda g, d, period: uuid_z3(_st("st_xd")(g), _st("st_yd")(g), d, _literal(period, "the period")),
    "uuidz3centroid": lambda g, d, period: uuid_z3(_st("st_xd")(_st("st_centroid")(g)), _st("st_yd")(_st("st_centroid")(g)), d, _literal(period, "the period")),
    "murmur3_32": lambda s: hashes.hex_32(s.cast("string")),
    "murmur3_128": lambda s: hashes.long_128(s.cast("string")),
    "parquetpoint": lambda c: _st("st_makepoint")(c["x"].cast("double"), c["y"].cast("double")),
    "parquetlinestring": lambda c: _st("st_linefromtext")(_coordinates("LINESTRING", c["x"], c["y"], 1)),
    "parquetmultipoint": lambda c: _st("st_mpointfromtext")(_coordinates("MULTIPOINT", c["x"], c["y"], 1)),
    "parquetpolygon": lambda c: _st("st_polygonfromtext")(_coordinates("POLYGON", c["x"], c["y"], 2)),
    "parquetmultilinestring": lambda c: _st("st_mlinefromtext")(_coordinates("MULTILINESTRING", c["x"], c["y"], 2)),
    "parquetmultipolygon": lambda c: _st("st_mpolyfromtext")(_coordinates("MULTIPOLYGON", c["x"], c["y"], 3)),
    "base64": lambda b: F.regexp_replace(F.translate(F.base64(b), "+/", "-_"), "[=\\s]", ""),
    "md5": F.md5,
    "withdefault": F.coalesce,
    "require": _require,
    "jsontostring": lambda c: c if c is not None else F.lit(None),
    "jsonpath": lambda path, c: F.get_json_object(c, _literal(path, "the path")),
    "jsonlist": lambda kind, c: F.from_json(c, f"array<{_TYPES[_literal(kind, 'the type').lower()]}>"),
    "jsonmap": lambda kinds, c: F.from_json(c, "map<{},{}>".format(*[_TYPES[x.strip().lower()] for x in _literal(kinds, "the types").split("->")])),
    "maptojson": F.to_json,
    "xmltostring": lambda c: c,
    "xpath": lambda path, c: F.xpath_string(c, path),
    "transformlistitems": lambda c, f: F.transform(c, f),
}
for _name, _of in {"concatenate": "concat", "substring": "substr", "length": "strlen", "stringlength": "strlen", "basicdate": "basicisodate", "tointeger": "toint", "stringtoint": "toint", "tobool": "toboolean", "string2bytes": "stringtobytes", "map2json": "maptojson", "murmur3_64": "murmur3_128"}.items():
    FUNCTIONS[_name] = FUNCTIONS[_of]


def register_function(name: str, f: Callable[..., Column]) -> None:
    FUNCTIONS[name.lower()] = f


#: The name under which text files give the number of a row's line, for lineNo().
LINE = "\x00line"


def _numbered(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of spark.read.text with their line's number in the file, from 1: places within a
    block of a file, and the sizes of the blocks before it."""
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    placed = lines.select("*", *block, F.monotonically_increasing_id().alias("__id"))
    blocks = placed.groupBy("__file", "__block").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__n"))  # a row for each block
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("__file").alias("__of"), F.col("__block").alias("__at"), "__low", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = placed.join(starts, (F.col("__file") == F.col("__of")) & (F.col("__block") == F.col("__at")))
    return joined, F.col("__id") - F.col("__low") + F.col("__before") + 1


class Expression:
    """Compiles one expression. columns: by position from 0, names: fields so far."""

    def __init__(self, text: str, columns: list[Column], names: dict[str, Column], caches: dict[str, tuple[str, dict]] | None = None):
        self.text, self.columns, self.names, self.caches, self.i = text, columns, names, caches or {}, 0
        self.special = {"line": names[LINE]} if LINE in names else {}
        self.toks: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not an expression: {text[at:]!r}")
            self.toks.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()

    def column(self) -> Column:
        out = self.either()
        if self.i < len(self.toks):
            raise ValueError(f"can't read {self.toks[self.i][1]!r} in {self.text!r}")
        return out

    def peek(self) -> str:
        return self.toks[self.i][1] if self.i < len(self.toks) and self.toks[self.i][0] != "str" else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.i >= len(self.toks) or (want and self.toks[self.i][1] != want):
            raise ValueError(f"expected {want} in {self.text!r}")
        self.i += 1
        return self.toks[self.i - 1]

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.compared()
        while self.peek() == "&&":
            self.take()
            out = out & self.compared()
        return out

    def compared(self) -> Column:
        if self.peek() == "!":
            self.take()
            return ~self.compared()
        a = self.value()
        op = self.peek()
        if op in ("==", "!=", "<", "<=", ">", ">="):
            self.take()
            b = self.value()
            return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
        return a

    def value(self) -> Column:
        out = self.atom()
        while self.peek() == "::":
            self.take()
            kind = self.take()[1].lower()
            out = _require(out) if kind == "r" else out.try_cast(_TYPES[kind])
        return out

    def atom(self) -> Column:
        kind, v = self.take()
        if kind == "op" and v == "(":
            out = self.either()
            self.take(")")
            return out
        if kind == "num":
            body = v.rstrip("lLfFdD")
            x = float(body) if re.search(r"[.eE]", body) or v[-1] in "fFdD" else int(body)
            return F.lit(x).cast({"l": "bigint", "f": "float", "d": "double"}.get(v[-1].lower(), "double" if isinstance(x, float) else "int"))
        if kind == "str":
            text = re.sub(r"\\(.)", r"\1", v[1:-1])
            out = F.lit(text)
            out._plain = text
            return out
        if kind == "ref":
            name = v[2:-1] if v.startswith("${") else v[1:]
            if name.isdigit():
                return self.columns[int(name)]
            if name in self.names:
                return self.names[name]
            raise ValueError(f"no field {name!r} in {self.text!r}")
        if v.lower() in ("true", "false", "null") and self.peek() != "(":
            return F.lit({"true": True, "false": False, "null": None}[v.lower()])
        return self.call(v)

    def call(self, name: str) -> Column:
        self.take("(")
        low = name.lower()
        if low == "transformlistitems":
            over = self.either()
            self.take(",")
            start = self.i
            depth = 0
            while depth or self.peek() != ")":
                depth += (self.peek() == "(") - (self.peek() == ")")
                self.take()
            body = self.toks[start : self.i]
            self.take(")")

            def each(x: Column) -> Column:
                inner = Expression("", [x, *self.columns[1:]], self.names, self.caches)
                inner.toks, inner.text = body, self.text
                return inner.column()

            return F.transform(over, each)
        args = []
        while self.peek() != ")":
            args.append(self.either())
            if self.peek() == ",":
                self.take()
        self.take(")")
        if low == "try":
            return F.coalesce(args[0], args[1])
        if low == "cachelookup":
            key, table = self.caches[_literal(args[0], "the cache's name")]
            what = _literal(args[2], "the cache's field")
            pairs = [F.lit(x) for k, row in table.items() for x in (k, row.get(what))]
            return F.try_element_at(F.create_map(*pairs), args[1].cast("string")) if pairs else F.lit(None)
        if low == "lineno":
            if "line" not in self.special:
                raise ValueError("only text files have line numbers")
            return self.special["line"]
        if low in ("and", "or"):
            out = args[0]
            for a in args[1:]:
                out = out & a if low == "and" else out | a
            return out
        if low == "not":
            return ~args[0]
        if low in FUNCTIONS:
            return FUNCTIONS[low](*args)
        if low.startswith("cql:") or low.startswith("st:"):
            return column_function("st_" + low.partition(":")[2])(*args)
        raise ValueError(f"no function {name!r}")


@dataclass
class Converter:
    type: str
    fields: list[tuple[str, str]]
    id: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    filter: str | None = None
    validators: list[str] = field(default_factory=list)  # has-geo, has-dtg, index, none, or "cql: ..."
    errors: str = "skip-bad-records"
    caches: dict[str, tuple[str, dict]] = field(default_factory=dict)
    feature_path: str | None = None
    widths: list[tuple[int, int]] = field(default_factory=list)  # fixed width: (start, length)


_COMMA, _TAB = (",", '"', '"', None), ("\t", '"', '"', None)
#: Named forms of delimited text: separator, quote, escape, mark of a null.
FORMATS = {
    **dict.fromkeys(("csv", "default", "excel", "rfc4180", "quoted", "quote_escape", "quoted_with_quote_escape", "quoted_minimal"), _COMMA),
    **dict.fromkeys(("tdf", "tsv", "tab", "tsv_quoted_minimal"), _TAB),
    "mysql": ("\t", "\0", "\\", "\\N"),
}


def _rows(spark: SparkSession, conv: Converter, path: str) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """(rows, columns by position, columns by name)."""
    opt = conv.options
    if conv.type == "delimited-text":
        sep, quote, escape, none = FORMATS[opt.get("format", "csv").lower()]
        sep, quote, escape = opt.get("delimiter", sep), opt.get("quote", quote), opt.get("escape", escape)
        lines, skip, named = spark.read.text(path), int(opt.get("skip-lines", "0")), {}
        if skip or any("lineno(" in e.lower().replace(" ", "") for e in (conv.id or "", conv.filter or "", *(f[1] for f in conv.fields))):
            lines, number = _numbered(lines)
            # the first lines of each file go; they are null before, since what is read of a line may be tested first
            lines = lines.where(number > skip).withColumns({"value": F.when(number > skip, F.col("value")), "__line": number})
            named = {LINE: F.col("__line")}
        n = int(opt.get("columns", "64"))
        names = [f"_c{i}" for i in range(n)]
        parsed = lines.withColumn("r", F.from_csv("value", ", ".join(f"{c} string" for c in names), {"sep": sep, "quote": quote, "escape": escape, "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", **({"nullValue": none} if none else {})}))
        return parsed, [F.col("value"), *[F.col(f"r.{c}") for c in names]], named
    if conv.type == "fixed-width":
        df = spark.read.text(path)
        return df, [F.col("value"), *[F.substring("value", a + 1, n) for a, n in conv.widths]], {}
    if conv.type == "json":
        df = spark.read.option("wholetext", opt.get("line-mode", "single") == "multi").text(path)
        if conv.feature_path:
            at = conv.feature_path.removesuffix("[*]")
            df = df.select(F.explode(F.from_json(F.get_json_object("value", at), "array<string>")).alias("value"))
        return df, [F.col("value")], {}
    if conv.type == "xml":
        df = spark.read.option("wholetext", opt.get("line-mode", "multi") == "multi").text(path)
        if conv.feature_path:
            tag = re.escape(conv.feature_path.rpartition("/")[2])
            df = df.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("value"))
        return df, [F.col("value")], {}
    if conv.type in ("parquet", "orc"):
        df = getattr(spark.read, conv.type)(path)
        return df, [F.to_json(F.struct(*df.columns)), *[F.col(c) for c in df.columns]], {c: F.col(c) for c in df.columns}
    if conv.type == "jdbc":  # path: a query
        df = spark.read.format("jdbc").option("url", opt["connection"]).option("query", path).load()
        return df, [F.to_json(F.struct(*df.columns)), *[F.col(c) for c in df.columns]], {c: F.col(c) for c in df.columns}
    raise ValueError(f"no such converter: {conv.type}")


def convert_features(df: DataFrame, conv: Converter) -> tuple[DataFrame, DataFrame]:
    """As convert, from features to features: $name is an attribute, $n the n-th, $0 the row as JSON."""
    return convert_rows(df, [F.to_json(F.struct(*df.columns)), *[F.col(c) for c in df.columns]], {c: F.col(c) for c in df.columns}, conv)


def convert(spark: SparkSession, conv: Converter, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, refused rows with the reason)."""
    rows, columns, names = _rows(spark, conv, path)
    return convert_rows(rows, columns, names, conv)


def convert_rows(rows: DataFrame, columns: list[Column], names: dict[str, Column], conv: Converter) -> tuple[DataFrame, DataFrame]:
    made: dict[str, Column] = dict(names)
    for name, text in conv.fields:
        made[name] = Expression(text, columns, made, conv.caches).column()
    if conv.filter:
        rows = rows.where(Expression(conv.filter, columns, made, conv.caches).column())
    fid = Expression(conv.id, columns, made, conv.caches).column() if conv.id else F.uuid()
    out = rows.select(fid.cast("string").alias("__fid__"), *[made[n].alias(n) for n, _ in conv.fields])
    reason = F.lit(None).cast("string")
    for v in reversed(conv.validators):
        if v == "none":
            continue
        if v in ("has-geo", "index", "has-dtg"):
            kinds = {"has-geo": ("binary",), "has-dtg": ("timestamp",), "index": ("binary", "timestamp")}[v]
            missing = F.lit(False)
            for kind in kinds:
                first = next((c for c, t in out.dtypes if t == kind), None)
                missing = missing | (F.col(first).isNull() if first else F.lit(True))
            reason = F.when(missing, F.lit(v)).otherwise(reason)
        elif v.startswith("cql:"):
            from ..plans.ecql import Layout, ecql

            reason = F.when(~F.coalesce(ecql(v[4:], Layout(out.schema)), F.lit(False)), F.lit(v)).otherwise(reason)
        else:
            raise ValueError(f"no such validator: {v}")
    judged = out.withColumn("__why", reason)
    if conv.errors == "raise-errors":
        checked = judged.withColumn("__why", F.when(F.col("__why").isNotNull(), F.raise_error(F.concat(F.lit("refused: "), "__why"))))
        return checked.where("__why is null").drop("__why"), judged.where("false")
    return judged.where("__why is null").drop("__why"), judged.where("__why is not null")


def composite(rows: DataFrame, columns: list[Column], delegates: list[tuple[str, Converter]]) -> tuple[DataFrame, DataFrame]:
    """Each row goes to the first delegate whose predicate holds (an error counts as false); rows of
    none are refused."""
    route = F.lit(-1)
    for k, (predicate, _) in reversed(list(enumerate(delegates))):
        route = F.when(F.coalesce(Expression(predicate, columns, {}).column(), F.lit(False)), F.lit(k)).otherwise(route)
    routed = rows.withColumn("__route", route)
    good = bad = None
    for k, (_, conv) in enumerate(delegates):
        a, b = convert_rows(routed.where(F.col("__route") == k), columns, {}, conv)
        good = a if good is None else good.unionByName(a, allowMissingColumns=True)
        bad = b if bad is None else bad.unionByName(b, allowMissingColumns=True)
    return good, bad.unionByName(routed.where("__route = -1").select(F.lit("no delegate").alias("__why")), allowMissingColumns=True)


def infer(rows: list[list[str]], names: list[str] | None = None) -> list[tuple[str, str]]:
    """Types of delimited rows' columns, and a point where columns are named like lat and lon."""
    import datetime

    def kind(values: list[str]) -> str:
        values = [v for v in values if v]
        tests = (("Integer", lambda v: re.fullmatch(r"-?\d{1,9}", v)), ("Long", lambda v: re.fullmatch(r"-?\d{1,18}", v)), ("Double", lambda v: re.fullmatch(r"-?\d*\.?\d+([eE]-?\d+)?", v)), ("Boolean", lambda v: v.lower() in ("true", "false")), ("Date", lambda v: datetime.datetime.fromisoformat(v)), ("Point", lambda v: re.match(r"POINT\s*\(", v, re.I)))
        for name, test in tests:
            try:
                if values and all(test(v) for v in values):
                    return name
            except ValueError:
                continue
        return "String"

    n = max(map(len, rows), default=0)
    names = names or [f"a{i}" for i in range(n)]
    out = [(names[i], kind([r[i] for r in rows if i < len(r)])) for i in range(n)]
    lat = next((a for a, t in out if a.lower() in ("lat", "latitude") and t != "String"), None)
    lon = next((a for a, t in out if a.lower() in ("lon", "long", "longitude") and t != "String"), None)
    if lat and lon and not any(t == "Point" for _, t in out):
        out.append(("geom", "Point"))
    return out


def uuid_z3(lon: Column, lat: Column, time: Column, period: str = "week") -> Column:
    """A random UUID that begins with the time bin and the place's leading z3 bits."""
    part, offset, whole = native.time_bin(time, period)
    head = F.concat(F.lpad(F.hex(part.cast("long")), 4, "0"), F.lpad(F.hex(F.shiftright(native.z3(lon, lat, offset, whole), 47)), 4, "0"))
    return F.concat(F.lower(head), F.substring(F.uuid(), 9, 28))
