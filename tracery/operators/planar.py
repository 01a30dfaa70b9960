"""Plane geometry of GeoJSON shapes on numpy: parts, points in rings, meetings, covers, canonical forms; no Spark."""

from __future__ import annotations

import numpy as np


def parts_of(shape: dict) -> list[tuple[str, list[np.ndarray]]]:
    """A GeoJSON shape as points, lines and polygons; a polygon is its outer ring and then its holes."""
    kind, c = shape["type"], shape.get("coordinates")
    ring = lambda points: np.array([p[:2] for p in points], dtype=float)
    if kind == "Feature":
        return parts_of(shape["geometry"])
    if kind in ("GeometryCollection", "FeatureCollection"):
        return [p for g in shape["geometries" if kind == "GeometryCollection" else "features"] for p in parts_of(g)]
    if kind.startswith("Multi"):
        return [p for one in c for p in parts_of({"type": kind[5:], "coordinates": one})]
    return [(kind, [ring([c])] if kind == "Point" else [ring(c)] if kind == "LineString" else [ring(r) for r in c])]


def _on_segment(p, a, b) -> bool:
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    scale = max(np.hypot(*(b - a)), 1e-12)
    return abs(cross) <= 1e-9 * scale and bool(np.all(p >= np.minimum(a, b) - 1e-9) and np.all(p <= np.maximum(a, b) + 1e-9))


def _turns(ring: list[tuple]) -> list[tuple]:
    """A closed ring's points, the first not repeated, without those that lie between their neighbours on one line."""
    points = [p for k, p in enumerate(ring) if p != ring[k - 1]] or ring[:1]
    changed = True
    while changed and len(points) > 2:
        kept = [p for k, p in enumerate(points) if not _between(points[k - 1], p, points[(k + 1) % len(points)])]
        changed, points = len(kept) < len(points), kept or points
    return points


def _between(a: tuple, p: tuple, b: tuple) -> bool:
    return a != b and _on_segment(np.array(p), np.array(a), np.array(b))


def _ring_form(points: list[tuple]) -> tuple:
    """From the smallest point on, in the direction that comes first."""
    turned = _turns(points)
    return min(tuple(way[k:] + way[:k]) for way in (turned, turned[::-1]) for k in [way.index(min(way))])


def canonical_form(parts: list[tuple[str, list[np.ndarray]]]) -> tuple:
    """The same for parts that cover the same points: without repeated points and ones between their neighbours, rings and lines in
    one direction, rings from their smallest point, holes and parts in order and once. Lines that only together make up another
    line are told apart from it."""
    out = set()
    for kind, rings in parts:
        plain = [[tuple(p) for p in (np.round(r, 9) + 0.0).tolist()] for r in rings]
        own = plain[0]
        if kind == "Polygon":
            out.add((kind, _ring_form(own[:-1]), tuple(sorted(_ring_form(r[:-1]) for r in plain[1:]))))
        elif kind == "LineString" and len(own) > 3 and own[0] == own[-1]:
            out.add((kind, _ring_form(own[:-1]), True))
        elif kind == "LineString":
            line = [p for k, p in enumerate(own) if k == 0 or p != own[k - 1]]
            line = [p for k, p in enumerate(line) if k in (0, len(line) - 1) or not _between(line[k - 1], p, line[k + 1])]
            out.add((kind, min(tuple(line), tuple(line[::-1]))))
        else:
            out.add((kind, own[0]))
    return tuple(sorted(out, key=repr))


def _on_border(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which points lie on the segments of a line."""
    a, b = line[:-1] if len(line) > 1 else line, line[1:] if len(line) > 1 else line
    d, v = b - a, points[:, None, :] - a
    far = np.abs(d[:, 0] * v[..., 1] - d[:, 1] * v[..., 0]) > 1e-9 * np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)
    within = (points[:, None, :] >= np.minimum(a, b) - 1e-9) & (points[:, None, :] <= np.maximum(a, b) + 1e-9)
    return (within.all(axis=2) & ~far).any(axis=1)


def _in_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie in a closed ring, its border included."""
    x, y, py = ring[:, 0], ring[:, 1], points[:, 1:]
    rise = np.where(y[1:] == y[:-1], 1, y[1:] - y[:-1])
    crosses = ((y[:-1] > py) != (y[1:] > py)) & (points[:, :1] < (x[1:] - x[:-1]) * (py - y[:-1]) / rise + x[:-1])
    return (crosses.sum(axis=1) % 2 == 1) | _on_border(points, ring)


def _cut(line: np.ndarray, border: np.ndarray) -> np.ndarray:
    """A line's points, and the middle of each part into which its segments are cut where they meet a border."""
    c, e = border[:-1], border[1:] - border[:-1]
    out = [line]
    for a, b in zip(line[:-1], line[1:], strict=True):
        d = b - a
        turn, w = d[0] * e[:, 1] - d[1] * e[:, 0], c - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / turn
        # along the same line a border's ends cut; elsewhere they are harmless
        ends = (border - a) @ d / max(float(d @ d), 1e-24)
        t = np.concatenate([[0.0, 1.0], t[np.isfinite(t)], ends])
        t = np.unique(t[(t >= 0) & (t <= 1)])
        out.append(a + ((t[:-1] + t[1:]) / 2)[:, None] * d)
    return np.concatenate(out)


def _in_polygon_all(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Which points lie in a polygon, its borders included; what lies within a hole is outside."""
    found = _in_ring(points, rings[0])
    for hole in rings[1:]:
        found &= ~_in_ring(points, hole) | _on_border(points, hole)
    return found


def _point_within(ring: np.ndarray) -> np.ndarray | None:
    """A point inside a ring and not on its border; none if the ring has no inside."""
    heights = np.unique(ring[:, 1])
    x, y = ring[:, 0], ring[:, 1]
    for level in (heights[:-1] + heights[1:]) / 2:
        k = np.flatnonzero((y[:-1] > level) != (y[1:] > level))
        at = np.unique(x[k] + (level - y[k]) / (y[k + 1] - y[k]) * (x[k + 1] - x[k]))
        if len(at) > 1:
            return np.array([[(at[0] + at[1]) / 2, level]])
    return None


def _covered(kind: str, rings: list[np.ndarray], query_kind: str, query: list[np.ndarray]) -> bool:
    """Every segment is cut at all meetings with the query; then each part lies on one side of it, and its middle tells which.
    A polygon lies in one with holes if its border keeps out of the holes and no hole is in its inside."""
    own = rings[0]
    if query_kind == "Point":
        return kind != "Polygon" and bool(np.allclose(own, query[0][0]))
    if query_kind == "LineString":
        return kind != "Polygon" and bool(_on_border(_cut(own, query[0]), query[0]).all())
    borders = rings if len(query) > 1 else rings[:1]
    if not all(_in_polygon_all(np.concatenate([_cut(r, q) for q in query]), query).all() for r in borders):
        return False
    inner = [p for p in map(_point_within, query[1:]) if p is not None] if kind == "Polygon" else []
    return not any(_in_polygon_all(p, rings)[0] for p in inner)


def _lines_meet(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two lines (a point is a line of one point) have a point in common."""
    if _on_border(p, q).any() or _on_border(q, p).any():
        return True
    if len(p) < 2 or len(q) < 2:
        return False

    def sides(line: np.ndarray, points: np.ndarray) -> np.ndarray:
        a, d = line[:-1, None], (line[1:] - line[:-1])[:, None]
        return np.sign(np.round(d[..., 0] * (points[:, 1] - a[..., 1]) - d[..., 1] * (points[:, 0] - a[..., 0]), 12))

    of_q, of_p = sides(p, q), sides(q, p)
    return bool(((of_q[:, :-1] * of_q[:, 1:] < 0) & (of_p[:, :-1] * of_p[:, 1:] < 0).T).any())


def _meets(kind: str, rings: list[np.ndarray], query_kind: str, query: list[np.ndarray]) -> bool:
    if any(_lines_meet(r, q) for r in rings for q in query):
        return True
    return (query_kind == "Polygon" and bool(_in_polygon_all(rings[0][:1], query)[0])) or (kind == "Polygon" and bool(_in_polygon_all(query[0][:1], rings)[0]))


def relate_parts(relation: str, parts: list, query: list) -> bool:
    """Whether the parts of a shape are coveredBy, intersect or equal those of a query; borders belong to shapes, the inside
    of a hole does not. All parts must be covered, each by one part of the query, or any must meet one; shapes are equal
    if they have the same canonical form."""
    if not parts or not query:
        return False
    if relation == "equals":
        return canonical_form(parts) == canonical_form(query)
    test = _covered if relation == "coveredBy" else _meets
    return (all if relation == "coveredBy" else any)(any(test(kind, rings, *q) for q in query) for kind, rings in parts)


def relate(relation: str, shape: dict, query_kind: str, query: np.ndarray) -> bool:
    """``relate_parts`` of a GeoJSON shape and a query of one point, line or ring."""
    return relate_parts(relation, parts_of(shape), [(query_kind, [query])])


def _boxes_touched(boxes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which boxes (x0, y0, x1, y1) a line has a point of, their borders included: each segment is clipped by each box."""
    found = np.zeros(len(boxes), dtype=bool)
    a, d = (line[:-1], line[1:] - line[:-1]) if len(line) > 1 else (line, np.zeros_like(line))
    for start in range(0, len(a), 512):
        low = np.zeros((len(boxes), len(a[start : start + 512])))
        high = np.ones_like(low)
        for axis in (0, 1):
            p, v = a[start : start + 512, axis], d[start : start + 512, axis]
            flat = v == 0
            step = np.where(flat, 1, v)
            t0, t1 = (boxes[:, axis, None] - p) / step, (boxes[:, axis + 2, None] - p) / step
            out = flat & ((p < boxes[:, axis, None]) | (p > boxes[:, axis + 2, None]))
            low = np.maximum(low, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(t0, t1)))
            high = np.minimum(high, np.where(flat, 1.0, np.maximum(t0, t1)))
        found |= (low <= high).any(axis=1)
    return found


def classify_boxes(boxes: np.ndarray, parts: list) -> np.ndarray:
    """For each box 0 if it has no point of a shape, 1 if it may have some, 2 if it lies within a polygon of the shape."""
    middle, out = (boxes[:, :2] + boxes[:, 2:]) / 2, np.zeros(len(boxes), dtype=int)
    # a little wider than the tolerance of the tests above
    wide = boxes + np.array([-4e-9, -4e-9, 4e-9, 4e-9])
    for kind, rings in parts:
        touched = np.any([_boxes_touched(wide, r) for r in rings], axis=0)
        within = ~touched & _in_polygon_all(middle, rings) if kind == "Polygon" else np.zeros(len(boxes), dtype=bool)
        out = np.maximum(out, np.where(within, 2, np.where(touched, 1, 0)))
    return out
