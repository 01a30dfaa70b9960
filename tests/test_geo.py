import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracery.functions import geo
from tracery.operators import geo as places
from tracery.operators import planar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(*points):
    return F.array(*[F.lit(p) for p in points])


@pytest.mark.parametrize(
    ("kind", "points", "expected"),
    [
        ("geo:point", ["1, 2"], {"type": "Point", "coordinates": [2.0, 1.0]}),
        ("geo:line", ["1, 2", "3,4"], {"type": "LineString", "coordinates": [[2.0, 1.0], [4.0, 3.0]]}),
        ("geo:box", ["1,2", "3,4"], {"type": "Polygon", "coordinates": [[[2.0, 1.0], [4.0, 1.0], [4.0, 3.0], [2.0, 3.0], [2.0, 1.0]]]}),
        ("geo:polygon", ["0,0", "0,1", "1,1", "0,0"], {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}),
        ("geo:line", ["1, 2"], None), ("geo:polygon", ["0,0", "0,1", "1,1"], None), ("geo:point", ["x"], None), ("geo:polygon", ["0,0", "0,1", "1,1", "2,2"], None),
    ],
)
def test_simple_formats(spark, kind, points, expected):
    found = one(spark, geo.slf_to_geojson(F.lit(kind), geo.slf_parse(F.lit(kind), texts(*points))))
    assert (found and json.loads(found)) == expected


def test_normalized_location(spark):
    n = one(spark, geo.normalize_location(F.lit('["0,0", "2,2"]'), F.lit("geo:line")))
    assert (n["centroid"]["lon"], n["centroid"]["lat"]) == (1.0, 1.0)
    assert one(spark, geo.normalize_location(F.lit("bad"), F.lit("geo:point"))) == (None, None)
    assert one(spark, geo.normalize_location(F.lit("1,2"), F.lit("geo:point")))["location"] is not None


SHAPES = [
    {"type": "Point", "coordinates": [1.5, 2.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 2.0]]}, {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]},
    {"type": "MultiPoint", "coordinates": [[0.0, 0.0], [1.0, 1.0]]}, {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 5.0]]]]},
]


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([(json.dumps(s),) for s in SHAPES], "g string")
    for column in (geo.wkt_to_geojson(geo.geojson_to_wkt(F.col("g"))), geo.wkb_to_geojson(geo.geojson_to_wkb(F.col("g"))), geo.wkb_to_geojson(F.hex(geo.geojson_to_wkb(F.col("g"), False)))):
        assert [json.loads(r[0]) for r in df.select(column).collect()] == SHAPES
    bad = spark.createDataFrame([("nonsense",), (None,)], "g string")
    assert [r[0] for r in bad.select(geo.geojson_to_wkt(F.col("g"))).collect()] == [None, None]


SQUARE = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], dtype=float)


@pytest.mark.parametrize(
    ("shape", "covered", "meets"),
    [
        ([[1, 1], [2, 2]], True, True), ([[0, 0], [4, 0]], True, True), ([[-1, 2], [5, 2]], False, True), ([[5, 5], [6, 6]], False, False), ([[4, 4], [5, 5]], False, True), ([[2, 2], [9, 2]], False, True),
    ],
)
def test_relations(shape, covered, meets):
    line = {"type": "LineString", "coordinates": shape}
    assert places.relate("coveredBy", line, "Polygon", SQUARE) is covered
    assert places.relate("intersects", line, "Polygon", SQUARE) is meets


def test_equal_rings():
    turned = {"type": "Polygon", "coordinates": [[[4, 4], [0, 4], [0, 0], [4, 0], [4, 4]]]}
    assert places.relate("equals", turned, "Polygon", SQUARE)
    assert not places.relate("equals", {"type": "LineString", "coordinates": SQUARE.tolist()}, "Polygon", SQUARE)


@pytest.mark.parametrize("bad", [("near", "point", "1,2"), ("near;maxDistance:x", "point", "1,2"), ("over", "point", "1,2"), ("intersects", "polygon", "1,2"), ("intersects", None, "1,2")])
def test_bad_geo_queries(bad):
    with pytest.raises(ValueError):
        places.parse_geo_query(*bad)


def test_no_geo_query():
    assert places.parse_geo_query(None, None, None) is None


def test_near(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 3.0, 0.0)], "id string, lon double, lat double").select("id", F.struct("lon", "lat").alias("centroid"))
    assert [r["id"] for r in places.geo_near(df, 0, 0, max_metres=120_000).orderBy("id").collect()] == ["a", "b"]
    assert [r["id"] for r in places.geo_near(df, 0, 0, min_metres=100_000).orderBy("id").collect()] == ["b", "c"]


def test_gazetteer(spark):
    address = "struct<street:string,number:string,locality:string,region:string,country:string>"
    rows = [(1, ("Main", "5", "Rome", None, "IT"), None), (2, ("Main", None, None, None, "IT"), None), (3, None, None), (4, (None, None, "Rome", None, "IT"), "kept")]
    df = spark.createDataFrame(rows, f"id int, address {address}, location string")
    known = spark.createDataFrame([("main, 5, rome, it", "here"), ("main, 5, rome, it", "there")], "key string, location string")
    found = {r["id"]: r["location"] for r in geo.add_location(df, known).collect()}
    assert found == {1: "here", 2: None, 3: None, 4: "kept"}


RING = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]]
FAR = [[20, 20], [22, 20], [22, 22], [20, 20]]


@pytest.mark.parametrize("relation, shape, kind, points, expected", [
    ("intersects", {"type": "Polygon", "coordinates": [RING, HOLE]}, "Point", [[5, 5]], False),
    ("intersects", {"type": "Polygon", "coordinates": [RING, HOLE]}, "Point", [[3, 5]], True),
    ("intersects", {"type": "Polygon", "coordinates": [RING, HOLE]}, "Point", [[1, 1]], True),
    ("intersects", {"type": "Polygon", "coordinates": [RING, HOLE]}, "Polygon", [[4, 4], [6, 4], [6, 6], [4, 4]], False),
    ("intersects", {"type": "Polygon", "coordinates": [RING, HOLE]}, "Polygon", [[-5, -5], [50, -5], [50, 50], [-5, 50], [-5, -5]], True),
    ("intersects", {"type": "MultiPolygon", "coordinates": [[RING, HOLE], [FAR]]}, "Point", [[21.5, 20.5]], True),
    ("intersects", {"type": "MultiPolygon", "coordinates": [[RING, HOLE], [FAR]]}, "Point", [[15, 15]], False),
    ("coveredBy", {"type": "MultiPoint", "coordinates": [[1, 1], [2, 2]]}, "Polygon", RING, True),
    ("coveredBy", {"type": "MultiPoint", "coordinates": [[1, 1], [12, 2]]}, "Polygon", RING, False),
    ("coveredBy", {"type": "MultiLineString", "coordinates": [[[1, 1], [2, 2]], [[3, 3], [9, 9]]]}, "Polygon", RING, True),
    ("coveredBy", {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": [HOLE]}]}, "Polygon", RING, True),
    ("equals", {"type": "Polygon", "coordinates": [RING]}, "Polygon", [*RING[1:], RING[1]], True),
    ("equals", {"type": "Polygon", "coordinates": [RING, HOLE]}, "Polygon", RING, False),
    ("equals", {"type": "MultiPolygon", "coordinates": [[RING]]}, "Polygon", RING, True),
    ("equals", {"type": "MultiPolygon", "coordinates": [[RING], [FAR]]}, "Polygon", RING, False),
])
def test_shapes_with_holes_and_parts(relation, shape, kind, points, expected):
    assert places.relate(relation, shape, kind, np.array(points, dtype=float)) is expected


def test_centroids_of_all_kinds(spark):
    multi = {"type": "MultiPolygon", "coordinates": [[[[30, 20], [45, 40], [10, 40], [30, 20]]], [[[15, 5], [40, 10], [10, 20], [5, 10], [15, 5]]]]}
    feature = lambda g: {"type": "Feature", "geometry": g, "properties": {"a": [1]}}
    shapes = {
        "multi": (multi, [p for part in multi["coordinates"] for ring in part for p in ring]), "holes": ({"type": "Polygon", "coordinates": [RING, HOLE]}, RING + HOLE),
        "points": ({"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, [[1, 2], [3, 4]]), "lines": ({"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6], [7, 9]]]}, [[1, 2], [3, 4], [5, 6], [7, 9]]),
        "collection": ({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "LineString", "coordinates": [[2, 2], [4, 4]]}]}, [[1, 1], [2, 2], [4, 4]]),
        "features": ({"type": "FeatureCollection", "features": [feature({"type": "Point", "coordinates": [1, 1]}), feature({"type": "Polygon", "coordinates": [RING]})]}, [[1, 1], *RING]),
        "feature": (feature({"type": "Point", "coordinates": [1, 1]}), [[1, 1]]),
    }
    df = spark.createDataFrame([(k, json.dumps(g)) for k, (g, _) in shapes.items()] + [("bad", "{"), ("none", None), ("odd", '{"type": "Point", "coordinates": ["x"]}')], "k string, g string")
    found = {r["k"]: r["c"] for r in df.select("k", geo.centroid(geo.geojson_coordinates(F.col("g"))).alias("c")).collect()}
    for k, (_, points) in shapes.items():
        assert tuple(found[k]) == pytest.approx(tuple(np.mean(points, axis=0)))
    assert found["bad"] is found["none"] is found["odd"] is None


U_SHAPE = np.array([[0, 0], [3, 0], [3, 3], [2, 3], [2, 1], [1, 1], [1, 3], [0, 3], [0, 0]], float)
BENT = np.array([[0, 0], [1, 0], [1, 1]], float)


@pytest.mark.parametrize(
    ("line", "kind", "query", "covered"),
    [
        ([[0, 0], [1, 1]], "LineString", BENT, False), ([[0.2, 0], [1, 0], [1, 0.5]], "LineString", BENT, True), ([[0.5, 0], [0.7, 0]], "LineString", BENT, True),
        ([[1, 3], [2, 3]], "Polygon", U_SHAPE, False), ([[0.5, 3], [2.5, 3]], "Polygon", U_SHAPE, False), ([[0, 3], [3, 3]], "Polygon", U_SHAPE, False),
        ([[0, 3], [1, 3]], "Polygon", U_SHAPE, True), ([[0, 1], [3, 1]], "Polygon", U_SHAPE, True), ([[0.5, 0.5], [2.5, 0.5]], "Polygon", U_SHAPE, True), ([[0.5, 2], [2.5, 2]], "Polygon", U_SHAPE, False),
    ],
)
def test_covered_by_concave_shapes_and_lines(line, kind, query, covered):
    assert places.relate("coveredBy", {"type": "LineString", "coordinates": line}, kind, query) is covered


def inside_slowly(p, ring):
    """By the sum of angles that the ring's sides are seen under; a point on a side sees it under half a turn."""
    turn = 0.0
    for a, b in zip(ring[:-1] - p, ring[1:] - p, strict=True):
        angle = np.arctan2(a[0] * b[1] - a[1] * b[0], a @ b)
        if np.pi - abs(angle) < 1e-7:
            return True
        turn += angle
    return abs(turn) > np.pi


def test_covered_by_against_dense_points():
    r = np.random.default_rng(8)
    seen = set()
    for _ in range(300):
        angle = np.sort(r.random(9) * 2 * np.pi)
        star = np.stack([np.cos(angle), np.sin(angle)], axis=1) * r.uniform(0.2, 1, 9)[:, None]
        ring = np.concatenate([star, star[:1]])
        line = r.uniform(-0.5, 0.5, (3, 2))
        dense = np.concatenate([a + np.linspace(0, 1, 4001)[:, None] * (b - a) for a, b in zip(line[:-1], line[1:], strict=True)])
        want = all(inside_slowly(p, ring) for p in dense[::40]) and bool(planar._in_ring(dense, ring).all())
        seen.add(want)
        assert places.relate("coveredBy", {"type": "LineString", "coordinates": line.tolist()}, "Polygon", ring) is want
    assert seen == {True, False}


def test_equality_is_of_points_not_of_vertices(spark):
    plain = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    same = [[[0, 0], [1, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[2, 2], [0, 2], [0, 1], [0, 0], [2, 0], [2, 2]], plain[::-1], [[1, 0], [2, 0], [2, 2], [0, 2], [0, 0], [1, 0]], [[0, 0], [0, 0], *plain[1:]]]
    for ring in same:
        assert places.relate("equals", {"type": "Polygon", "coordinates": [ring]}, "Polygon", np.array(plain, float)), ring
        assert places.relate("equals", {"type": "MultiPolygon", "coordinates": [[ring], [plain]]}, "Polygon", np.array(plain, float))
    assert not places.relate("equals", {"type": "Polygon", "coordinates": [plain, [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]]}, "Polygon", np.array(plain, float))
    assert not places.relate("equals", {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}, "Polygon", np.array(plain, float))
    assert places.relate("equals", {"type": "LineString", "coordinates": [[2, 2], [1, 1], [0, 0]]}, "LineString", np.array([[0, 0], [2, 2]], float))
    shapes = [("a", {"type": "Polygon", "coordinates": [plain]}), *[(f"s{k}", {"type": "Polygon", "coordinates": [x]}) for k, x in enumerate(same)], ("n", None), ("p", {"type": "Point", "coordinates": [1, 1]}), ("bad", "x")]
    df = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in shapes], "entity_id string, location string")
    found = {(r["entity_id"], r["other"]) for r in places.geo_equal_pairs(df.where("entity_id in ('a', 'p', 'n', 'bad')"), df).collect()}
    assert found == {("a", "a"), ("p", "p"), *[("a", f"s{k}") for k in range(len(same))]}


@pytest.mark.parametrize(("text", "shape"), [
    ("MULTIPOINT (1 2, 3 4)", {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}), ("multipoint((1 2),(3 4))", {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}),
    ("POINT EMPTY", {"type": "Point", "coordinates": []}), ("POLYGON EMPTY", {"type": "Polygon", "coordinates": []}), ("GEOMETRYCOLLECTION EMPTY", {"type": "GeometryCollection", "geometries": []}),
    ("POINT Z (1 2 3)", {"type": "Point", "coordinates": [1, 2, 3]}), ("LINESTRING(-1.5e1 +2,.5 4.)", {"type": "LineString", "coordinates": [[-15, 2], [0.5, 4]]}),
    ("SRID=4326;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))",
     {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5.1, 5.1], [5.2, 5.1], [5.2, 5.2], [5.1, 5.1]]]], "meta": {"srid": 4326}}),
    ("GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (LINESTRING (1 2, 3 4)))",
     {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[1, 2], [3, 4]]}]}]}),
    ("POINT (1)", None), ("POINT (1 2, 3 4)", None), ("POINT (1 2) x", None), ("LINESTRING (1 2", None), ("CIRCLE (1 2)", None), ("", None), ("POINT (1 2;3)", None),
])
def test_wkt_of_all_kinds(spark, text, shape):
    found = one(spark, geo.wkt_to_geojson(F.lit(text)))
    assert (found and json.loads(found)) == shape
    if shape:
        plain = {k: v for k, v in shape.items() if k != "meta"}
        assert json.loads(one(spark, geo.wkt_to_geojson(geo.geojson_to_wkt(F.lit(json.dumps(shape)), 3)))) == plain
        flat = {"type": "Point", "coordinates": [1, 2]} if text.startswith("POINT Z") else plain
        for big in (True, False):
            assert json.loads(one(spark, geo.wkb_to_geojson(geo.geojson_to_wkb(F.lit(json.dumps(shape)), big)))) == flat
