"""Column functions of the measurement model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the packed bin ids: (q + OFFSET) * STRIDE + (r + OFFSET).
OFFSET = 1_000_000
STRIDE = 2_000_001


def finite(value: Column) -> Column:
    """value as a double, or null where it is no finite number."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def pack(q: Column, r: Column) -> Column:
    return (q.cast("bigint") + OFFSET) * STRIDE + (r.cast("bigint") + OFFSET)


def unpack(bin_id: Column) -> tuple[Column, Column]:
    """Packed ids are positive, so integer division is exact here."""
    q = F.floor(bin_id / STRIDE)
    return q - OFFSET, bin_id - q * STRIDE - OFFSET


def square_bin(x: Column, y: Column, radius: float) -> Column:
    return pack(F.floor(x / (2 * radius)), F.floor(y / (2 * radius)))


def hex_axial(x: Column, y: Column, radius: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon that holds (x, y), by cube rounding (half to even)."""
    q = (F.lit(math.sqrt(3.0) / 3.0) * x - F.lit(1.0 / 3.0) * y) / radius
    r = F.lit(2.0 / 3.0) * y / radius
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    return F.when(fix_q, -rr - rs).otherwise(rq), F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr)


def hex_bin(x: Column, y: Column, radius: float) -> Column:
    return pack(*hex_axial(x, y, radius))


def square_center(bin_id: Column, radius: float) -> tuple[Column, Column]:
    ix, iy = unpack(bin_id)
    return (ix + 0.5) * (2 * radius), (iy + 0.5) * (2 * radius)


def hex_center(bin_id: Column, radius: float) -> tuple[Column, Column]:
    q, r = unpack(bin_id)
    return (F.lit(math.sqrt(3.0)) * q + F.lit(math.sqrt(3.0) / 2.0) * r) * radius, F.lit(1.5) * r * radius


def square_polygon(cx: Column, cy: Column, radius: float) -> Column:
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*(F.struct((cx + sx * radius).alias("x"), (cy + sy * radius).alias("y")) for sx, sy in corners))


def shape_mask(x: Column, y: Column, shape: str, eps: float = 1e-9) -> Column:
    """Whether (x, y) of the unit square lies in the shape."""
    inside = (x >= -eps) & (x <= 1 + eps) & (y >= -eps) & (y <= 1 + eps)
    circle = (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) <= 0.25 + eps
    return {
        "square": inside,
        "circle": circle,
        "semicircle": circle & (y >= 0.5 - eps),
        "triangle": inside & (y <= 1 - 2 * F.abs(x - 0.5) + eps),
        "cutout": inside & ~((F.abs(x - 0.5) < 0.25 - eps) & (F.abs(y - 0.5) < 0.25 - eps)),
    }[shape]


def safe_name(name: Column) -> Column:
    return F.translate(name, " /", "__")
