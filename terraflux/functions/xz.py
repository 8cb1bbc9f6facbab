"""XZ curves: one number for an extended object, in two or three dimensions.

An object belongs to the smallest cell of a quadtree (octree) that, doubled in each
direction from its lower corner, holds it. Cells are numbered depth first: of g
levels, child q of a cell at level i adds 1 + q * (B^(g - i) - 1) / (B - 1), B being
4 or 8. A query gives ranges of numbers, of cells whose doubled extent it meets.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[float, float]


class XZ:
    def __init__(self, g: int, extents: tuple[Span, ...]):
        self.g, self.extents = g, extents
        self.fan = 1 << len(extents)

    @classmethod
    def two(cls, g: int = 12) -> XZ:
        return cls(g, ((-180.0, 180.0), (-90.0, 90.0)))

    @classmethod
    def three(cls, whole: float, g: int = 12) -> XZ:
        return cls(g, ((-180.0, 180.0), (-90.0, 90.0), (0.0, whole)))

    def _unit(self, lows: tuple[float, ...], highs: tuple[float, ...]) -> tuple[list[float], list[float]]:
        put = lambda v, e: min(1.0, max(0.0, (v - e[0]) / (e[1] - e[0])))
        return [put(v, e) for v, e in zip(lows, self.extents, strict=True)], [put(v, e) for v, e in zip(highs, self.extents, strict=True)]

    def _below(self, level: int) -> int:
        """Numbers in the subtree of a cell at ``level``, itself included."""
        return (self.fan ** (self.g - level + 1) - 1) // (self.fan - 1)

    def index(self, lows: tuple[float, ...], highs: tuple[float, ...]) -> int:
        lo, hi = self._unit(lows, highs)
        size = max(b - a for a, b in zip(lo, hi))
        level = self.g if size <= 0 else min(self.g, max(0, math.floor(math.log2(1 / size))))
        if level < self.g:  # one level deeper, if twice such a cell still holds it
            w = 0.5 ** (level + 1)
            level += all(b <= math.floor(a / w) * w + 2 * w for a, b in zip(lo, hi))
        return self._code(lo, level)

    def _code(self, at: list[float], level: int) -> int:
        code, low, width = 0, [0.0] * len(at), 1.0
        for i in range(level):
            width /= 2
            q = 0
            for d, v in enumerate(at):
                if v >= low[d] + width:
                    q |= 1 << d
                    low[d] += width
            code += 1 + q * self._below(i + 1)
        return code

    def ranges(self, lows: tuple[float, ...], highs: tuple[float, ...], most: int = 2000) -> list[tuple[int, int]]:
        """Sorted, merged ranges that hold the number of every object that meets the query; at most
        about ``most`` before merging, by then coarser ones."""
        lo, hi = self._unit(lows, highs)
        out: list[tuple[int, int]] = []
        todo = [(0, 0, [0.0] * len(lo))]
        while todo:
            level, code, low = todo.pop(0)
            w = 0.5**level
            if any(a > x + 2 * w or b < x for a, b, x in zip(lo, hi, low)):
                continue
            inside = all(a <= x and x + 2 * w <= b for a, b, x in zip(lo, hi, low))
            if inside or level == self.g or len(out) + len(todo) >= most:
                out.append((code, code + self._below(level) - 1))
                continue
            out.append((code, code))
            for q in range(self.fan):
                todo.append((level + 1, code + 1 + q * self._below(level + 1), [x + w / 2 * (q >> d & 1) for d, x in enumerate(low)]))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(out):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return merged

    def column(self, *bounds: Column | str) -> Column:
        """Number of each row's box: all lower bounds, then all upper ones."""

        def run(*cols: pa.Array) -> pa.Array:
            n = len(self.extents)
            return pa.array([None if None in r else self.index(r[:n], r[n:]) for r in zip(*(c.to_pylist() for c in cols), strict=True)], pa.int64())

        return F.arrow_udf(run, T.LongType())(*bounds)

    def meets(self, column: Column | str, lows: tuple[float, ...], highs: tuple[float, ...], most: int = 200) -> Column:
        """Rows whose number lies in the query's ranges: a prefilter on a sorted column."""
        c = F.col(column) if isinstance(column, str) else column
        out = F.lit(False)
        for a, b in self.ranges(lows, highs, most):
            out = out | c.between(a, b)
        return out
