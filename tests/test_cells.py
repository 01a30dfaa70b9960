"""Cell covers and joins of places against all pairs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracery.operators import cells, planar
from tracery.operators import geo as places
from tracery.plans import views

SCHEMA = "entity_id string, location string, min_lon double, min_lat double, max_lon double, max_lat double"


def star(r, lon, lat, size, corners=7):
    angle = np.sort(r.random(corners)) * 2 * np.pi
    ring = np.array([lon, lat]) + np.stack([np.cos(angle), np.sin(angle)], axis=1) * (size * r.uniform(0.3, 1, corners))[:, None]
    return np.concatenate([ring, ring[:1]]).round(6).tolist()


def square(lon, lat, half):
    return [[lon - half, lat - half], [lon + half, lat - half], [lon + half, lat + half], [lon - half, lat + half], [lon - half, lat - half]]


def some_shape(r, k, near):
    lon, lat = near[0] + r.normal() * 4, near[1] + r.normal() * 4
    size = 10.0 ** r.uniform(-3, 1.2)
    if k % 6 == 0:
        return {"type": "Point", "coordinates": [lon, lat]}
    if k % 6 == 1:
        return {"type": "LineString", "coordinates": star(r, lon, lat, size)[:4]}
    if k % 6 == 2:
        return {"type": "MultiPoint", "coordinates": star(r, lon, lat, size)[:3]}
    if k % 6 == 3:
        return {"type": "Polygon", "coordinates": [square(lon, lat, size), square(lon, lat, size * 0.6)]}
    if k % 6 == 4:
        return {"type": "MultiPolygon", "coordinates": [[star(r, lon, lat, size)], [star(r, lon + 3 * size, lat, size)]]}
    return {"type": "Polygon", "coordinates": [star(r, lon, lat, size)]}


def row(key, shape):
    points = np.concatenate([ring for _, rings in planar.parts_of(shape) for ring in rings])
    return (key, json.dumps(shape), *points.min(axis=0).tolist(), *points.max(axis=0).tolist())


def test_covers_hold_all_points_and_inner_cells_only_points():
    r = np.random.default_rng(3)
    decided = 0
    for k in range(60):
        parts = planar.parts_of(some_shape(r, k, (r.uniform(-170, 170), r.uniform(-80, 80))))
        found = {(n, x, y): inner for n, x, y, inner in cells.cover(parts)}
        assert 0 < len(found) <= max(cells.CELLS, 16)
        lines = np.concatenate([np.concatenate([a + r.random((40, 1)) * (b - a) for a, b in zip(ring[:-1], ring[1:], strict=True)] or [ring]) for _, rings in parts for ring in rings])
        corner = lines.min(axis=0)
        spread = corner + r.random((400, 2)) * (lines.max(axis=0) - corner)
        within = np.any([planar._in_polygon_all(spread, rings) for kind, rings in parts if kind == "Polygon"] or [np.zeros(400, bool)], axis=0)
        for lon, lat in np.concatenate([lines, spread[within]]):
            u, v = np.clip((lon + 180) / 360, 0, 1 - 1e-12), np.clip((lat + 90) / 180, 0, 1 - 1e-12)
            assert any((n, int(u * 2**n), int(v * 2**n)) in found for n in range(0, 13, 2))
        for (n, x, y), inner in found.items():
            if inner:
                decided += 1
                box = (np.array([x, y]) + r.random((20, 2))) * np.array([360, 180]) / 2**n - np.array([180, 90])
                assert np.any([planar._in_polygon_all(box, rings) for kind, rings in parts if kind == "Polygon"], axis=0).all()
    assert decided > 100


@pytest.fixture(scope="module")
def shapes():
    r = np.random.default_rng(5)
    # the corner of four large cells, the line of 180 degrees, a pole, and anywhere
    near = [(0, 0), (178, 10), (20, 88), (-100, 40)]
    rows = [row(f"e{k}", some_shape(r, k, near[k % 4])) for k in range(160)]
    rows += [rows[3], ("e4", *rows[11][1:]), ("none", None, None, None, None, None), ("bad", "{", 0.0, 0.0, 1.0, 1.0), ("flat", rows[0][1], None, 0.0, 0.0, 0.0)]
    given = [row(f"s{k}", some_shape(r, k, near[(k // 6) % 4])) for k in range(60)]
    given += [row("s60", {"type": "Polygon", "coordinates": [square(0, 0, 12), square(1, 1, 0.5)]}), ("s1", *given[9][1:]), given[5], ("s61", None, None, None, None, None), ("s62", "[]", 0, 0, 0, 0)]
    return rows, [(k, v) for k, v, *_ in given]


@pytest.mark.parametrize("relation", ["coveredBy", "intersects"])
def test_join_against_all_pairs(spark, shapes, relation):
    rows, given = shapes
    df, others = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(given, "shape_id string, location string")
    found = places.geo_join(df.withColumn("key", F.lit(1)), others.withColumn("_c", F.lit(2)), relation)
    ours = [tuple(x) for x in found.collect()]
    parsed = [(k, planar.parts_of(json.loads(v))) for k, v, x0, *_ in rows if v and v != "{" and x0 is not None]
    queries = [(k, planar.parts_of(json.loads(v))) for k, v in given if v and v != "[]"]
    want = {(k, s) for k, parts in parsed for s, query in queries if planar.relate_parts(relation, parts, query)}
    assert len(ours) == len(set(ours)) and set(ours) == want and len(want) > 40
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_join_of_empty_tables(spark, shapes):
    df, others = spark.createDataFrame(shapes[0], SCHEMA), spark.createDataFrame(shapes[1], "shape_id string, location string")
    assert places.geo_join(df.limit(0), others, "intersects").count() == 0
    assert places.geo_join(df, others.limit(0), "coveredBy").count() == 0
    with pytest.raises(ValueError):
        places.geo_join(df, others, "equals")


@pytest.mark.parametrize(("kind", "ring", "holes", "covered"), [
    # a ring around a hole, one beside it, one with the same hole, one with a larger hole, one with a smaller hole
    ("Polygon", square(0, 0, 3), [], False), ("Polygon", square(3.5, 3.5, 0.5), [], True), ("Polygon", square(0, 0, 3), [square(0, 0, 2)], True),
    ("Polygon", square(0, 0, 3), [square(0, 0, 2.5)], True), ("Polygon", square(0, 0, 3), [square(0, 0, 1)], False), ("Polygon", square(0, 0, 2), [], False),
    ("LineString", square(0, 0, 2), [], True), ("LineString", [[-3, 0], [3, 0]], [], False), ("LineString", [[-3, -2], [3, -2]], [], True),
])
def test_covered_by_a_shape_with_a_hole(kind, ring, holes, covered):
    query = [("Polygon", [np.array(square(0, 0, 4), float), np.array(square(0, 0, 2), float)])]
    own = [(kind, [np.array(x, float) for x in [ring, *holes]])]
    assert planar.relate_parts("coveredBy", own, query) is covered


def test_near_join_against_all_pairs(spark):
    r = np.random.default_rng(9)
    lon = np.concatenate([r.uniform(-180, 180, 150), r.uniform(178, 180, 40), r.uniform(-180, -178, 40), [180.0, -180.0]])
    lat = np.concatenate([r.uniform(-90, 90, 150), r.uniform(-3, 3, 80), [0.0, 0.0]])
    lat[:20], lat[20:30] = r.uniform(88, 90, 20), -90
    df = spark.createDataFrame(pd.DataFrame({"entity_id": [f"e{i}" for i in range(len(lon))], "x": lon, "y": lat})).select("entity_id", F.struct(F.col("x").alias("lon"), F.col("y").alias("lat")).alias("centroid"))
    df = df.union(spark.createDataFrame([("none", None)], "entity_id string, centroid struct<lon:double,lat:double>"))
    at = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(lon[::3], lat[::3], strict=True))] + [(999, None, 1.0)], "point_id int, lon double, lat double")
    for metres in (0.0, 30_000.0, 400_000.0, 6_000_000.0, 20_100_000.0):
        found = {(a, b) for a, b, _ in places.geo_near_join(df, at, metres).collect()}
        a, b = np.radians(np.stack([lon, lat])), np.radians(np.stack([lon[::3], lat[::3]]))
        h = np.sin((a[1][:, None] - b[1]) / 2) ** 2 + np.cos(a[1])[:, None] * np.cos(b[1]) * np.sin((a[0][:, None] - b[0]) / 2) ** 2
        away = 2 * places.EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(h)))
        assert found == {(f"e{i}", j) for i, j in zip(*np.nonzero(away <= metres), strict=True)}, metres


def test_few_rows_reach_geometry(spark):
    df = views.geo_series(spark, "/root/testdata/sf0.01")
    total = df.count()
    box = places.parse_geo_query("intersects", "box", "-30,-60;40,80")
    hit = df.where(places._overlaps_extent(box)).withColumn("sure", cells.surely_within([("Polygon", [np.array(box["points"], float)])]))
    assert hit.count() > total / 10 and hit.where("not sure").count() <= total / 10
    ring = {"type": "Polygon", "coordinates": [square(10, 5, 60)]}
    pairs = places.candidate_pairs(df, spark.createDataFrame([("s", json.dumps(ring))], "shape_id string, location string"))
    assert pairs.count() > total / 10 and pairs.where("not sure").count() <= total / 10
