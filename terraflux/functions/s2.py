"""S2 cell ids of points: a cube's six faces, each cut into quarters along a Hilbert curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import native

LEVELS = 30
U = np.uint64
#: Fixed values of the curve: place of each quarter (i * 2 + j) by orientation, and the turn that each place makes.
PLACE = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]], np.int64)
TURN = np.array([1, 0, 0, 3], np.int64)


def cell_ids(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """The ids (as unsigned numbers) of the smallest cells."""
    a, b = np.radians(lon), np.radians(lat)
    p = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])
    axis = np.abs(p).argmax(0)
    main = np.take_along_axis(p, axis[None], 0)[0]
    face = axis + 3 * (main < 0)
    x, y, z = p
    with np.errstate(divide="ignore", invalid="ignore"):  # of the faces that are not chosen
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z], mode="clip")
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z], mode="clip")
    side = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.maximum(w, 0)), 1 - 0.5 * np.sqrt(1 - 3 * np.minimum(w, 0)))
    i, j = (np.clip(np.floor(side(w) * (1 << LEVELS)), 0, (1 << LEVELS) - 1).astype(np.int64) for w in (u, v))
    turn, at = face & 1, np.zeros(len(face), U)
    for k in range(LEVELS - 1, -1, -1):
        place = PLACE[turn, (i >> k & 1) << 1 | (j >> k & 1)]
        at = at << U(2) | place.astype(U)
        turn = turn ^ TURN[place]
    return face.astype(U) << U(61) | at << U(1) | U(1)


def s2(lon: native.C, lat: native.C, level: int = LEVELS) -> Column:
    """The id, as a signed long, of the cell of a level that holds the point; null without a place."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        a, b = x.to_numpy(zero_copy_only=False).astype(float), y.to_numpy(zero_copy_only=False).astype(float)
        none = np.isnan(a) | np.isnan(b)
        got = cell_ids(np.where(none, 0, a), np.where(none, 0, b))
        return pa.array(got.view(np.int64), pa.int64(), mask=none)

    leaf = F.arrow_udf(run, T.LongType())(native.col(lon), native.col(lat))
    return parent(leaf, level) if level < LEVELS else leaf


def parent(cell: Column, level: int) -> Column:
    """The cell of a lower level that holds a cell; in the JVM."""
    low = 1 << 2 * (LEVELS - level)
    return cell.bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


def children_range(cell: Column, level: int) -> tuple[Column, Column]:
    """First and last id of the smallest cells within a cell of the level."""
    low = 1 << 2 * (LEVELS - level)
    return cell - F.lit(low - 1), cell + F.lit(low - 1)


def s3(lon: native.C, lat: native.C, time: Column, period: str = "week", level: int = LEVELS) -> tuple[Column, Column]:
    """Time bin and cell id."""
    return native.time_bin(time, period)[0], s2(lon, lat, level)
