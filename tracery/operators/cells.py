"""Places by cells: the world halved again and again by longitude and latitude, so that shapes near each other share a key.

A cell of level n is one of 2^n columns and 2^n rows. The cells of a row follow from its extent by arithmetic, so a stored
table needs no index but its extents. A shape that others are compared with gets a cover of at most ``CELLS`` cells at even
levels; those that lie within it settle a comparison without geometry.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import let
from .planar import classify_boxes, parts_of

DEEPEST = 12
#: Most cells of a cover; a shape with a long border has larger ones, and no fewer matches.
CELLS = 256
EXTENT = ("min_lon", "min_lat", "max_lon", "max_lat")
_EVEN = range(0, DEEPEST + 1, 2)
# more than the tolerance of the exact tests
_PAD = 2e-9


def cell(level, x, y):
    """The number of a cell; numbers and columns alike."""
    return level * (1 << 48) + x * (1 << 24) + y


def _step(share: Column, level: int) -> Column:
    n = 1 << level
    return F.least(F.greatest(F.floor(share * float(n)), F.lit(0)), F.lit(n - 1)).cast("bigint")


def _shares(names: tuple[str, ...]) -> Column:
    """An extent as shares of the world, a little wider."""
    c = [F.col(n).cast("double") for n in names]
    known = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in c])
    u = lambda x, pad: (x + (pad + 180)) / 360
    v = lambda y, pad: (y + (pad + 90)) / 180
    return F.when(known, F.struct(u(c[0], -_PAD).alias("u0"), v(c[1], -_PAD).alias("v0"), u(c[2], _PAD).alias("u1"), v(c[3], _PAD).alias("v1")))


def _level(e: Column) -> Column:
    """The deepest level at which an extent is in at most two columns and two rows."""
    span = F.greatest(e["u1"] - e["u0"], e["v1"] - e["v0"])
    return reduce(lambda found, n: F.when(span <= 2.0**-n, F.lit(n)).otherwise(found), range(1, DEEPEST + 1), F.lit(0))


def _corners(e: Column, level: int) -> list[Column]:
    return [cell(level, _step(e[u], level), _step(e[v], level)) for v in ("v0", "v1") for u in ("u0", "u1")]


def inside_world(names: tuple[str, ...] = EXTENT) -> Column:
    c = [F.col(n) for n in names]
    return (c[0] >= -180 + _PAD) & (c[1] >= -90 + _PAD) & (c[2] <= 180 - _PAD) & (c[3] <= 90 - _PAD)


def row_keys(names: tuple[str, ...] = EXTENT) -> Column:
    """array of struct(key, mask) by which a row meets covers: its cells and the cells of even levels around them (these
    meet cells of covers), and its cells as negative numbers (these meet cells around those of covers). ``mask`` has a bit
    for each of four cells of the row that a key stands for. NULL without an extent."""

    def merged(codes: list[Column]) -> Column:
        bits = lambda c: reduce(lambda a, b: a + b, [F.when(k == c, 1 << i).otherwise(0) for i, k in enumerate(codes)])
        return F.transform(F.array_distinct(F.array(*codes)), lambda c: F.struct(c.alias("key"), bits(c).alias("mask")))

    none = F.array().cast("array<struct<key:bigint,mask:int>>")

    def keys(e: Column, level: Column) -> Column:
        around = [F.when(level >= n, merged(_corners(e, n))).otherwise(none) for n in _EVEN]
        own = reduce(lambda found, n: F.when(level == n, merged([-1 - c for c in _corners(e, n)])).otherwise(found), range(DEEPEST), none)
        return F.concat(*around, own)

    return let(_shares(names), lambda e: F.when(e.isNotNull(), let(_level(e), lambda n: keys(e, n))))


def home_keys(names: tuple[str, ...] = EXTENT) -> Column:
    """array of keys by which a row meets ``meeting_keys`` once at most: the cell of its lower left corner at each even level at which
    it is in at most two columns and two rows, and the deepest of these as a negative number. NULL without an extent."""

    def keys(e: Column, level: Column) -> Column:
        corner = lambda n: cell(n, _step(e["u0"], n), _step(e["v0"], n))
        own = reduce(lambda found, n: F.when(level >= n, -1 - corner(n)).otherwise(found), _EVEN[1:], -1 - corner(0))
        return F.filter(F.array(*[F.when(level >= n, corner(n)) for n in _EVEN], own), lambda k: k.isNotNull())

    return let(_shares(names), lambda e: F.when(e.isNotNull(), let(_level(e), lambda n: keys(e, n))))


def meeting_keys(names: tuple[str, ...] = EXTENT) -> Column:
    """array of the keys of all rows whose extents meet that of a shape: at the deepest even level at which the shape is in at most five
    columns and five rows those of rows that are in two of each or less, and at the levels above, as negative numbers, those of
    rows that are too large for it. NULL without an extent."""

    def block(e: Column, n: int) -> Column:
        # a row may begin in the cell before
        side = lambda low, high: F.sequence(F.greatest(_step(e[low], n) - 1, F.lit(0).cast("bigint")), _step(e[high], n))
        return F.flatten(F.transform(side("u0", "u1"), lambda x: F.transform(side("v0", "v1"), lambda y: cell(n, x, y))))

    def keys(e: Column, span: Column) -> Column:
        level = reduce(lambda found, n: F.when(span <= 4 * 2.0**-n, F.lit(n)).otherwise(found), _EVEN[1:], F.lit(0))
        none = F.array().cast("array<bigint>")
        fine = reduce(lambda found, n: F.when(level == n, block(e, n)).otherwise(found), _EVEN[1:], block(e, 0))
        return F.concat(fine, *[F.when(level > n, F.transform(block(e, n), lambda k: -1 - k)).otherwise(none) for n in _EVEN[:-1]])

    return let(_shares(names), lambda e: F.when(e.isNotNull(), keys(e, F.greatest(e["u1"] - e["u0"], e["v1"] - e["v0"]))))


def extent_of(location: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of a GeoJSON shape; NULL for what is no shape."""

    def one(v):
        try:
            points = np.concatenate([r for _, rings in parts_of(json.loads(v)) for r in rings])
            return dict(zip(EXTENT, [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()], strict=True))
        except (ValueError, KeyError, TypeError, IndexError):
            return dict.fromkeys(EXTENT)

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in EXTENT])
    return F.pandas_udf(lambda s: pd.DataFrame([one(v) for v in s], columns=list(EXTENT), dtype=float), kind)(location)


def cover(parts: list, most: int = CELLS) -> list[tuple[int, int, int, bool]]:
    """Cells (level, column, row, lies within the shape) that together hold all of a shape within the world: cells at its
    border are cut in 16 until there would be too many."""
    level, edge, inner = 0, np.zeros((1, 2), dtype=np.int64), []
    while level < DEEPEST and len(edge):
        steps = np.stack(np.meshgrid(np.arange(4), np.arange(4)), axis=-1).reshape(-1, 2)
        finer = (edge[:, None] * 4 + steps).reshape(-1, 2)
        # cells at the world's edge stand for all that lies beyond it
        n = 1 << (level + 2)
        size = np.array([360.0, 180.0]) / n
        low = finer * size - np.array([180.0, 90.0])
        boxes = np.concatenate([np.where(finer == 0, -1e6, low), np.where(finer == n - 1, 1e6, low + size)], axis=1)
        kinds = classify_boxes(boxes, parts)
        if len(inner) + int((kinds > 0).sum()) > most and level > 0:
            break
        level += 2
        inner += [(level, int(x), int(y), True) for x, y in finer[kinds == 2]]
        edge = finer[kinds == 1]
    return inner + [(level, int(x), int(y), False) for x, y in edge]


def cover_keys(location: Column, most: int = CELLS) -> Column:
    """array of struct(key, inner, and the shape's extent x0, y0, x1, y1) by which a GeoJSON shape meets ``row_keys``; empty
    for what is no shape."""

    def one(v):
        try:
            parts = parts_of(json.loads(v)) if v is not None else []
            found = cover(parts, most) if parts else []
        except (ValueError, KeyError, TypeError, IndexError):
            return []
        own = {int(cell(n, x, y)): inner for n, x, y, inner in found}
        around = {-1 - int(cell(n - k, x >> k, y >> k)) for n, x, y, _ in found for k in range(1, n + 1)}
        if not own:
            return []
        points = np.concatenate([r for _, rings in parts for r in rings])
        extent = dict(zip(("x0", "y0", "x1", "y1"), [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()], strict=True))
        return [{"key": k, "inner": i} | extent for k, i in own.items()] + [{"key": k, "inner": False} | extent for k in around]

    sides = [T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")]
    kind = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("inner", T.BooleanType()), *sides]))
    return F.pandas_udf(lambda s: pd.Series([one(v) for v in s]), kind)(location)


def surely_within(parts: list, names: tuple[str, ...] = EXTENT, most: int = CELLS) -> Column:
    """Whether all cells of a row's extent lie in cells within one given shape; then the row does too."""
    inner: dict[int, list[int]] = {}
    for n, x, y, within in cover(parts, most):
        if within:
            inner.setdefault(n, []).append(int(cell(n, x, y)))
    if not inner:
        return F.lit(False)

    e = _shares(names)
    span = F.greatest(e["u1"] - e["u0"], e["v1"] - e["v0"])
    at = {n: _corners(e, n) for n in inner}
    each = [reduce(lambda a, b: a | b, [(span <= 2.0**-n) & at[n][i].isin(inner[n]) for n in inner]) for i in range(4)]
    return F.coalesce(inside_world(names) & reduce(lambda a, b: a & b, each), F.lit(False))


def circle_level(reach: float) -> int:
    """The deepest level at which a circle that reaches so many degrees north and south is in at most two rows."""
    return max((n for n in range(DEEPEST + 1) if 2 * (reach + _PAD) * (1 << n) <= 180), default=0)


def point_key(lon: Column, lat: Column, level: int) -> Column:
    return cell(level, F.pmod(F.floor((lon + 180) / 360 * float(1 << level)), F.lit(1 << level)), _step((lat + 90) / 180, level))


def circle_keys(lon: Column, lat: Column, reach: float, level: int) -> Column:
    """The cells of one level that a circle on the globe may touch, also across the line of 180 degrees and over a pole."""
    n, r = 1 << level, reach + _PAD
    wide = F.degrees(F.asin(F.least(F.lit(1.0), float(np.sin(np.radians(min(r, 90.0)))) / F.cos(F.radians(lat))))) + _PAD
    column = lambda x: F.floor((x + 180) / 360 * float(n)).cast("bigint")
    all_round = (F.abs(lat) + r >= 90) | (wide >= 179)
    columns = F.when(all_round, F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(
        F.array_distinct(F.transform(F.sequence(column(lon - wide), column(lon + wide)), lambda x: F.pmod(x, F.lit(n))))
    )
    rows = F.array_distinct(F.array(_step((lat - r + 90) / 180, level), _step((lat + r + 90) / 180, level)))
    return F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: cell(level, x, y))))
