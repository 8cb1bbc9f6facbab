"""The public-domain murmur3 hashes over bytes, as plain functions and as Columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M32, _M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _turn(x: int, by: int, bits: int) -> int:
    return (x << by | x >> bits - by) & ((1 << bits) - 1)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    def stir(k: int) -> int:
        return _turn(k * 0xCC9E2D51 & _M32, 15, 32) * 0x1B873593 & _M32

    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h = (_turn(h ^ stir(int.from_bytes(data[i : i + 4], "little")), 13, 32) * 5 + 0xE6546B64) & _M32
    if whole < len(data):
        h ^= stir(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & _M32
    return h ^ h >> 16


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Two numbers of 64 bits."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    a = b = seed
    first = lambda k: _turn(k * c1 & _M64, 31, 64) * c2 & _M64
    second = lambda k: _turn(k * c2 & _M64, 33, 64) * c1 & _M64
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        a = ((_turn(a ^ first(int.from_bytes(data[i : i + 8], "little")), 27, 64) + b) * 5 + 0x52DCE729) & _M64
        b = ((_turn(b ^ second(int.from_bytes(data[i + 8 : i + 16], "little")), 31, 64) + a) * 5 + 0x38495AB5) & _M64
    rest = data[whole:]
    if len(rest) > 8:
        b ^= second(int.from_bytes(rest[8:], "little"))
    if rest:
        a ^= first(int.from_bytes(rest[:8], "little"))
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & _M64
    b = (b + a) & _M64

    def last(k: int) -> int:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ k >> 33) * factor & _M64
        return k ^ k >> 33

    a, b = last(a), last(b)
    a = (a + b) & _M64
    return a, (b + a) & _M64


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> bits - 1 else x


def _over(f: Callable[[str], object], kind: T.DataType, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A Column function; each distinct value of a batch is hashed once."""

    def run(c: pa.Array) -> pa.Array:
        values = c.dictionary_encode()
        return pa.array([None if x is None else f(x) for x in values.dictionary.to_pylist()], arrow).take(values.indices)

    return F.arrow_udf(run, kind)


#: Of a text's UTF-8: hexadecimal, little-endian; and the first half of 128 bits as a long.
hex_32 = _over(lambda s: murmur3_32(s.encode()).to_bytes(4, "little").hex(), T.StringType(), pa.string())
long_128 = _over(lambda s: _signed(murmur3_128(s.encode())[0], 64), T.LongType(), pa.int64())

#: Fixed value: the seed of the attribute hash.
ATTRIBUTE_SEED = 0x3C074A61
#: Of a text's UTF-16, little-endian, as a signed number.
attribute_hash = _over(lambda s: _signed(murmur3_32(s.encode("utf-16-le"), ATTRIBUTE_SEED), 32), T.IntegerType(), pa.int32())
