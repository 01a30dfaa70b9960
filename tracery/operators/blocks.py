"""Rows and shapes of a cell in blocks that are compared as a whole: a geometry is read once a cell, not once a pair, and numpy
settles all pairs but those that touch within a tolerance. No pair exists before it is found."""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .planar import parts_of, relate_parts

ROWS, SHAPES = 2048, 256
_KINDS = ("Point", "LineString", "Polygon")
_OTHER = len(_KINDS)
# what is nearer than this to a border is left to the exact test, whose own tolerance is much smaller
_NEAR = 1e-7
# most points times sides that are looked at together
_AT_ONCE = 1 << 19


def pack(shapes: list[list]) -> bytes:
    """Shapes as one array of points; those of several parts or with holes are kept as they are besides."""
    kinds, sizes, rest = [], [], {}
    for i, parts in enumerate(shapes):
        kind, ring = _KINDS.index(parts[0][0]), parts[0][1][0]
        if len(parts) > 1 or len(parts[0][1]) > 1 or (kind == 2 and (len(ring) < 4 or (ring[0] != ring[-1]).any())):
            kind, rest[i] = _OTHER, parts
        kinds.append(kind)
        sizes.append(sum(len(r) for _, rings in parts for r in rings))
    points = np.concatenate([r for parts in shapes for _, rings in parts for r in rings])
    return pickle.dumps((np.array(kinds, dtype=np.int8), np.array(sizes, dtype=np.int64), points, rest), protocol=5)


class Block:
    def __init__(self, data: bytes) -> None:
        self.kinds, self.sizes, self.points, self.rest = pickle.loads(data)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)

    def parts(self, i: int) -> list:
        return self.rest[i] if i in self.rest else [(_KINDS[self.kinds[i]], [self.points[self.starts[i] : self.starts[i] + self.sizes[i]]])]


def _read(text: str | None) -> list | None:
    """A shape's parts; None for what is no shape or has no points."""
    try:
        parts = parts_of(json.loads(text)) if text is not None else []
        good = parts and all(kind in _KINDS and rings and all(r.ndim == 2 and r.shape[1] == 2 and len(r) for r in rings) and np.isfinite(rings[0]).all() for kind, rings in parts)
        return parts if good else None
    except (ValueError, KeyError, TypeError, IndexError, AttributeError):
        return None


def in_blocks(df: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """(_k, {name}_id, {name}_keys, {name}_data): rows (key, location, _k) that lie together by ``_k``, in blocks of at most so many."""
    schema = T.StructType([T.StructField("_k", T.LongType()), T.StructField(f"{name}_id", T.LongType()), T.StructField(f"{name}_keys", T.ArrayType(df.schema[key].dataType)), T.StructField(f"{name}_data", T.BinaryType())])

    def one(cell: int, held: list[pa.RecordBatch], into: list) -> None:
        table = pa.Table.from_batches(held)
        shapes = [_read(v) for v in table["location"].to_pylist()]
        good = [i for i, s in enumerate(shapes) if s is not None]
        if good:
            data = pack([shapes[i] for i in good])
            number = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
            into.append((cell, number, table[key].combine_chunks().take(pa.array(good)), data))

    def batch(ready: list) -> pa.RecordBatch:
        lengths = np.cumsum([0, *[len(k) for _, _, k, _ in ready]])
        keys = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays([k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for _, _, k, _ in ready]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), keys, pa.array([r[3] for r in ready], pa.binary())], schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, cell, ready = [], 0, None, []
        for b in batches:
            k = b.column(b.schema.get_field_index("_k")).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                while start < end:
                    if n and (cell != k[start] or n >= most):
                        one(cell, held, ready)
                        held, n = [], 0
                    cell, take = int(k[start]), min(end - start, most - n)
                    held.append(b.slice(start, take))
                    n, start = n + take, start + take
            if sum(len(r[3]) for r in ready) > 1 << 20:
                yield batch(ready)
                ready = []
        if n:
            one(cell, held, ready)
        if ready:
            yield batch(ready)

    return df.select(key, "location", "_k").mapInArrow(build, schema)


def compare(pairs: DataFrame, relation: str, key: str, shape_key: str) -> DataFrame:
    """(key, shape_key) of all related pairs of blocks that meet, a pair as often as they hold it."""
    schema = T.StructType([T.StructField(key, pairs.schema["_r_keys"].dataType.elementType), T.StructField(shape_key, pairs.schema["_s_keys"].dataType.elementType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in ("_r_keys", "_r_data", "_s_keys", "_s_data")]
            for i in range(len(b)):
                own, given = columns[0][i].values, columns[2][i].values
                for rows, shapes in related(relation, Block(columns[1][i].as_py()), Block(columns[3][i].as_py())):
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(rows)), given.take(pa.array(shapes))], schema.names)

    return pairs.select("_r_keys", "_r_data", "_s_keys", "_s_data").mapInArrow(run, schema)


def related(relation: str, rows: Block, shapes: Block, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows and shapes that are related, in chunks."""
    found: list[tuple[np.ndarray, int]] = []
    n = 0
    for s in range(len(shapes.kinds)):
        low, high = shapes.low[s] - 1e-9, shapes.high[s] + 1e-9
        at = np.flatnonzero((rows.high[:, 0] >= low[0]) & (rows.low[:, 0] <= high[0]) & (rows.high[:, 1] >= low[1]) & (rows.low[:, 1] <= high[1]))
        if not len(at):
            continue
        query = shapes.parts(s)
        known = np.full(len(at), -1, dtype=np.int8)
        if shapes.kinds[s] == 2:
            plain = np.flatnonzero(rows.kinds[at] < _OTHER)
            sides = len(query[0][1][0]) - 1
            # so many rows that their points times the sides stay bounded
            parted = np.flatnonzero(np.diff(np.cumsum(rows.sizes[at[plain]]) * sides // _AT_ONCE)) + 1
            for part in np.split(plain, parted):
                if len(part):
                    known[part] = settle(relation, rows, at[part], query[0][1][0])
        for i in np.flatnonzero(known < 0):
            known[i] = relate_parts(relation, rows.parts(int(at[i])), query)
        hit = at[known == 1]
        if len(hit):
            found.append((hit, s))
            n += len(hit)
        if n >= most:
            yield np.concatenate([h for h, _ in found]), np.repeat([k for _, k in found], [len(h) for h, _ in found])
            found, n = [], 0
    if found:
        yield np.concatenate([h for h, _ in found]), np.repeat([k for _, k in found], [len(h) for h, _ in found])


def _convex(side: np.ndarray) -> bool:
    """Whether the sides of a ring turn one way, and once around."""
    after = np.roll(side, -1, axis=0)
    turn = np.arctan2(side[:, 0] * after[:, 1] - side[:, 1] * after[:, 0], (side * after).sum(axis=1))
    return bool(((turn > -1e-9).all() or (turn < 1e-9).all()) and abs(abs(turn.sum()) - 2 * np.pi) < 1e-6)


def settle(relation: str, rows: Block, at: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """For rows of one part without holes and a closed ring: 1 if they are related, 0 if not, -1 if points are so near to borders that
    tolerances count. Points tell most; sides are compared for the rest."""
    sizes = rows.sizes[at]
    starts = np.cumsum(sizes) - sizes
    p = rows.points[np.arange(sizes.sum()) + np.repeat(rows.starts[at] - starts, sizes)]
    kept = np.flatnonzero((ring[1:] != ring[:-1]).any(axis=1))
    if len(kept) < 3:
        return np.full(len(at), -1, dtype=np.int8)
    a, b = ring[:-1][kept], ring[1:][kept]
    d = b - a
    length = np.hypot(d[:, 0], d[:, 1])
    x, y = p[:, :1], p[:, 1:]
    off = (d[:, 0] * (y - a[:, 1]) - d[:, 1] * (x - a[:, 0])) / length
    least, most = np.minimum(a, b) - _NEAR, np.maximum(a, b) + _NEAR
    near = ((np.abs(off) <= _NEAR) & (x >= least[:, 0]) & (x <= most[:, 0]) & (y >= least[:, 1]) & (y <= most[:, 1])).any(axis=1)
    # a side is crossed by the ray to the right if its ends are above and below, and the point is to the left of it
    rises = b[:, 1] > a[:, 1]
    crosses = ((a[:, 1] > y) != (b[:, 1] > y)) & ((off > 0) == rises)
    inside = crosses.sum(axis=1) % 2 == 1
    unclear = np.logical_or.reduceat(near, starts)
    out = np.full(len(at), -1, dtype=np.int8)
    if relation == "coveredBy":
        out[np.logical_or.reduceat(~inside & ~near, starts)] = 0
        open_ = np.flatnonzero((out < 0) & ~unclear)
        if len(open_) and _convex(d):
            out[open_] = 1
            return out
    else:
        out[np.logical_or.reduceat(inside & ~near, starts)] = 1
        open_ = np.flatnonzero(out < 0)
    return _by_sides(relation, rows.kinds[at], sizes, starts, p, off, (a, b), unclear, open_, out) if len(open_) else out


def _by_sides(relation, kinds, sizes, starts, p, off, ends, unclear, open_, out) -> np.ndarray:
    """The rows of ``open_``: all their points are on one side of the ring, so they are related or not by what their sides do."""
    a, b = ends
    count = sizes[open_] - 1
    owner = np.repeat(np.arange(len(open_)), count)
    first = np.arange(count.sum()) + np.repeat(starts[open_] - (np.cumsum(count) - count), count)
    moved = (p[first] != p[first + 1]).any(axis=1)
    owner, first = owner[moved], first[moved]
    q, r = p[first], p[first + 1]
    e = r - q
    size = np.hypot(e[:, 0], e[:, 1])[:, None]
    here, there = off[first], off[first + 1]
    of = lambda c: (e[:, :1] * (c[:, 1] - q[:, 1:]) - e[:, 1:] * (c[:, 0] - q[:, :1])) / size
    one, other = of(a), of(b)
    apart = lambda u, v: (np.minimum(u, v) > _NEAR) | (np.maximum(u, v) < -_NEAR)
    low, high, least, most = np.minimum(q, r), np.maximum(q, r), np.minimum(a, b) - _NEAR, np.maximum(a, b) + _NEAR
    boxes = (low[:, :1] > most[:, 0]) | (high[:, :1] < least[:, 0]) | (low[:, 1:] > most[:, 1]) | (high[:, 1:] < least[:, 1])
    away = boxes | apart(here, there) | apart(one, other)
    cuts = (here * there < 0) & (one * other < 0) & (np.minimum(np.abs(here), np.abs(there)) > _NEAR) & (np.minimum(np.abs(one), np.abs(other)) > _NEAR)
    n = len(open_)
    cut = np.bincount(owner, cuts.any(axis=1), n) > 0
    doubtful = (np.bincount(owner, (~(away | cuts)).any(axis=1), n) > 0) | unclear[open_]
    if relation == "coveredBy":
        out[open_] = np.where(cut, 0, np.where(doubtful, -1, 1))
        return out
    # nothing meets: a polygon may still hold the whole ring
    c = a[0]
    around = ((q[:, 1] > c[1]) != (r[:, 1] > c[1])) & ((one[:, 0] > 0) == (r[:, 1] > q[:, 1]))
    holds = (kinds[open_] == 2) & (np.bincount(owner, around, n) % 2 == 1)
    out[open_] = np.where(cut, 1, np.where(doubtful, -1, holds))
    return out
