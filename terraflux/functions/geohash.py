"""Geohashes by number of bits: longitude first, bits alternating, five to a character."""

from __future__ import annotations

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def encode(lon: float, lat: float, bits: int) -> str:
    """The hash of ``bits`` bits, filled up with zero bits to whole characters."""
    lo, hi = [-180.0, -90.0], [180.0, 90.0]
    value = 0
    for k in range(bits):
        axis, v = k % 2, (lon, lat)[k % 2]
        mid = (lo[axis] + hi[axis]) / 2
        value = value << 1 | (v >= mid)
        if v >= mid:
            lo[axis] = mid
        else:
            hi[axis] = mid
    pad = -bits % 5
    value <<= pad
    return "".join(ALPHABET[value >> s & 31] for s in range(bits + pad - 5, -1, -5))


def bounds(text: str, bits: int | None = None) -> tuple[float, float, float, float]:
    """(west, south, east, north) of the cell of the first ``bits`` bits."""
    stream = "".join(f"{ALPHABET.index(c):05b}" for c in text.lower())
    lo, hi = [-180.0, -90.0], [180.0, 90.0]
    for k, b in enumerate(stream[: len(stream) if bits is None else bits]):
        mid = (lo[k % 2] + hi[k % 2]) / 2
        (lo if b == "1" else hi)[k % 2] = mid
    return lo[0], lo[1], hi[0], hi[1]
