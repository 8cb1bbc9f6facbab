"""Feature types: the declaration string, and its Spark schema.

``name:Type[:option=value...],*geom:Point:srid=4326[;key=value,...]``; ``*`` marks
the default geometry. Geometries are WKB in binary columns; what they are stands in
the field's metadata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .geom.model import KINDS

FID = "__fid__"
_BASIC = {
    "string": T.StringType(), "integer": T.IntegerType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.TimestampType(), "timestamp": T.TimestampType(), "uuid": T.StringType(), "bytes": T.BinaryType(), "byte[]": T.BinaryType(),
}
_GEOMETRIES = {k.lower(): k for k in (*KINDS, "Geometry")}
_ATTRIBUTE = re.compile(r"\s*(\*?)([^:,;]+):((?:List|Map)\[[^\]]*\]|[^:,;]+)((?::[^:,;=]+=(?:'[^']*'|[^:,;]*))*)\s*(?=,|;|$)")


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    options: dict[str, str] = field(default_factory=dict)
    default: bool = False

    @property
    def is_geometry(self) -> bool:
        return self.type.lower() in _GEOMETRIES

    def spark(self) -> T.DataType:
        low = self.type.lower()
        if low in _GEOMETRIES:
            return T.BinaryType()
        if m := re.fullmatch(r"list(?:\[(\w+)\])?", low):
            return T.ArrayType(_basic(m[1] or "string"))
        if m := re.fullmatch(r"map(?:\[(\w+),\s*(\w+)\])?", low):
            return T.MapType(_basic(m[1] or "string"), _basic(m[2] or "string"))
        return _basic(low)


def _basic(name: str) -> T.DataType:
    if name not in _BASIC:
        raise ValueError(f"no such attribute type: {name}")
    return _BASIC[name]


@dataclass(frozen=True)
class FeatureType:
    name: str
    attributes: tuple[Attribute, ...]
    user_data: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, name: str, spec: str) -> FeatureType:
        body, _, tail = spec.partition(";")
        attributes, at = [], 0
        while body[at:].strip():
            m = _ATTRIBUTE.match(body, at)
            if not m:
                raise ValueError(f"not a feature type: {spec[at:]!r}")
            options = dict(x.split("=", 1) for x in m[4].split(":")[1:])
            attributes.append(Attribute(m[2].strip(), m[3].strip(), options, bool(m[1])))
            at = m.end() + 1
        for a in attributes:
            a.spark()
        data = dict(x.strip().split("=", 1) for x in tail.split(",") if x.strip())
        return cls(name, tuple(attributes), data)

    def encode(self) -> str:
        one = lambda a: ("*" if a.default else "") + ":".join([a.name, a.type, *(f"{k}={v}" for k, v in a.options.items())])
        return ",".join(map(one, self.attributes)) + (";" + ",".join(f"{k}={v}" for k, v in self.user_data.items()) if self.user_data else "")

    @property
    def geometry(self) -> Attribute | None:
        """The marked one, else the first."""
        own = [a for a in self.attributes if a.is_geometry]
        return next((a for a in own if a.default), own[0] if own else None)

    @property
    def date(self) -> Attribute | None:
        """The one that the user data name, else the first date."""
        named = self.user_data.get("index.dtg")
        own = [a for a in self.attributes if a.type.lower() in ("date", "timestamp")]
        return next((a for a in own if a.name == named), own[0] if own else None)

    def schema(self) -> T.StructType:
        out = [T.StructField(FID, T.StringType(), False)]
        for a in self.attributes:
            meta = {"type": a.type, "default": a.default, **({"geometry": _GEOMETRIES[a.type.lower()], "srid": int(a.options.get("srid", 4326))} if a.is_geometry else {}), "options": dict(a.options)}
            out.append(T.StructField(a.name, a.spark(), True, meta))
        return T.StructType(out)

    @classmethod
    def of(cls, name: str, schema: T.StructType) -> FeatureType:
        """The feature type of a DataFrame's schema; metadata say what its types alone don't."""
        names = {"StringType": "String", "IntegerType": "Integer", "ShortType": "Integer", "ByteType": "Integer", "LongType": "Long", "FloatType": "Float", "DoubleType": "Double", "BooleanType": "Boolean", "TimestampType": "Date", "TimestampNTZType": "Date", "DateType": "Date", "BinaryType": "Bytes"}

        def kind(t: T.DataType) -> str:
            if isinstance(t, T.ArrayType):
                return f"List[{kind(t.elementType)}]"
            if isinstance(t, T.MapType):
                return f"Map[{kind(t.keyType)},{kind(t.valueType)}]"
            if type(t).__name__ not in names:
                raise ValueError(f"no attribute type holds {t.simpleString()}")
            return names[type(t).__name__]

        return cls(name, tuple(Attribute(f.name, f.metadata.get("type") or kind(f.dataType), dict(f.metadata.get("options", {})), bool(f.metadata.get("default"))) for f in schema if f.name != FID))

    def accepts(self, df: DataFrame) -> bool:
        """As many columns, of the same names and types, in any order."""
        mine = {f.name: f.dataType for f in self.schema() if f.name != FID}
        return {f.name: f.dataType for f in df.schema if f.name != FID} == mine

    def with_attribute(self, spec: str) -> FeatureType:
        return FeatureType(self.name, self.attributes + FeatureType.parse(self.name, spec).attributes, self.user_data)

    def renamed(self, old: str, new: str) -> FeatureType:
        return FeatureType(self.name, tuple(Attribute(new if a.name == old else a.name, a.type, a.options, a.default) for a in self.attributes), self.user_data)
