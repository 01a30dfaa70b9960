"""Locations: simple location formats, GeoJSON, WKT, WKB, centroids and addresses.

A shape inside an expression is an array of structs (lon, lat). Simple formats are "lat, lon" texts;
GeoJSON has lon before lat. What can't be read is NULL.
"""

from __future__ import annotations

import json
import math
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .casts import let

#: Least number of points of the simple formats.
LEAST_POINTS = {"geo:point": 1, "geo:line": 2, "geo:polygon": 4, "geo:box": 2}
POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _point(text: Column) -> Column:
    parts = F.split(text, ",")
    ok = text.rlike(rf"^\s*{_NUMBER}\s*,\s*{_NUMBER}\s*$")
    return F.when(ok, F.struct(F.trim(parts[1]).try_cast("double").alias("lon"), F.trim(parts[0]).try_cast("double").alias("lat")))


def slf_parse(ngsi_type: Column, texts: Column) -> Column:
    """"lat, lon" texts as points, if all are points and there are enough for the type; a polygon must close."""
    points = F.transform(texts, _point)
    least = F.element_at(F.create_map(*[F.lit(x) for item in LEAST_POINTS.items() for x in item]), ngsi_type)
    ok = (F.size(points) >= least) & ~F.exists(points, lambda p: p.isNull()) & ((ngsi_type != "geo:point") | (F.size(points) == 1))
    closed = (ngsi_type != "geo:polygon") | (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(ok & closed, points)


def box_to_polygon(points: Column) -> Column:
    """The ring of five points of a box given by two opposite corners."""
    a, b = F.element_at(points, 1), F.element_at(points, 2)
    corner = lambda p, q: F.struct(p["lon"].alias("lon"), q["lat"].alias("lat"))
    return F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))


def _pairs(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def slf_to_geojson(ngsi_type: Column, points: Column) -> Column:
    """GeoJSON text of points, lon before lat."""
    def form(name, coordinates):
        return F.to_json(F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates")))

    found = (
        F.when(ngsi_type == "geo:point", form("Point", F.element_at(_pairs(points), 1))).when(ngsi_type == "geo:line", form("LineString", _pairs(points)))
        .when(ngsi_type == "geo:polygon", form("Polygon", F.array(_pairs(points)))).when(ngsi_type == "geo:box", form("Polygon", F.array(_pairs(box_to_polygon(points)))))
    )
    return F.when(points.isNotNull(), found)


def _good(pairs: Column) -> Column:
    """Pairs of numbers as points; NULL if one is not such a pair."""
    points = F.transform(pairs, lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("lon"), F.try_element_at(p, F.lit(2)).alias("lat")))
    return let(points, lambda ps: F.when(~F.exists(ps, lambda p: p["lon"].isNull() | p["lat"].isNull()), ps))


def geojson_points(geojson: Column) -> Column:
    """The points of a Point, LineString or Polygon (its outer ring); other kinds are NULL."""

    def read(v: Column) -> Column:
        get = lambda path, type_: F.try_variant_get(v, path, type_)
        kind = get("$.type", "string")
        return (
            F.when(kind == "Point", F.array(get("$.coordinates", "array<double>"))).when(kind == "LineString", get("$.coordinates", "array<array<double>>"))
            .when(kind == "Polygon", get("$.coordinates[0]", "array<array<double>>"))
        )

    return _good(let(F.try_parse_json(geojson), read))


def geojson_coordinates(geojson: Column) -> Column:
    """All points of a shape, of whatever kind: of its lines, rings and parts, of the geometries of a collection, of a
    feature or of the features of a collection."""

    def part(v: Column) -> Column:
        get = lambda type_: F.try_variant_get(v, "$.coordinates", type_)
        kind = F.try_variant_get(v, "$.type", "string")
        return (
            F.when(kind == "Point", F.array(get("array<double>"))).when(kind.isin("LineString", "MultiPoint"), get("array<array<double>>"))
            .when(kind.isin("Polygon", "MultiLineString"), F.flatten(get("array<array<array<double>>>")))
            .when(kind == "MultiPolygon", F.flatten(F.flatten(get("array<array<array<array<double>>>>"))))
        )

    def shape(v: Column) -> Column:
        parts = F.try_variant_get(v, "$.geometries", "array<variant>")
        return F.when(parts.isNotNull(), F.flatten(F.filter(F.transform(parts, part), lambda p: p.isNotNull()))).otherwise(part(v))

    def read(v: Column) -> Column:
        kind = F.try_variant_get(v, "$.type", "string")
        features = F.transform(F.try_variant_get(v, "$.features", "array<variant>"), lambda f: shape(F.try_variant_get(f, "$.geometry", "variant")))
        return (
            F.when(kind == "FeatureCollection", F.flatten(F.filter(features, lambda p: p.isNotNull())))
            .when(kind == "Feature", shape(F.try_variant_get(v, "$.geometry", "variant"))).otherwise(shape(v))
        )

    return _good(let(F.try_parse_json(geojson), read))


def geojson_to_slf(geojson: Column, ngsi_type: Column) -> Column:
    """"lat, lon" texts of GeoJSON for a wanted type; a box is the opposite corners of a polygon."""
    points = geojson_points(geojson)
    corners = F.array(F.element_at(points, 1), F.try_element_at(points, F.lit(3)))
    text = F.transform(F.when(ngsi_type == "geo:box", corners).otherwise(points), geopoint_to_text)
    fits = F.try_variant_get(F.try_parse_json(geojson), "$.type", "string") == F.element_at(
        F.create_map(*[F.lit(x) for x in ("geo:point", "Point", "geo:line", "LineString", "geo:polygon", "Polygon", "geo:box", "Polygon")]), ngsi_type
    )
    return F.when(fits, text)


def geopoint_to_text(point: Column) -> Column:
    return F.concat(point["lat"].cast("string"), F.lit(", "), point["lon"].cast("string"))


def centroid(points: Column) -> Column:
    """The mean of all points that have both numbers."""

    def mean(good: Column) -> Column:
        of = lambda k: F.aggregate(good, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(good)
        return F.when(F.size(good) > 0, F.struct(of("lon").alias("lon"), of("lat").alias("lat")))

    return let(F.filter(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()), mean)


def slf_to_wkt(ngsi_type: Column, points: Column, srid: int | None = None) -> Column:
    """WKT of points, with SRID=n; in front on demand."""
    text = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ", ")
    ring = F.when(ngsi_type == "geo:box", box_to_polygon(points)).otherwise(points)
    body = (
        F.when(ngsi_type == "geo:point", F.concat(F.lit("POINT ("), text(points), F.lit(")"))).when(ngsi_type == "geo:line", F.concat(F.lit("LINESTRING ("), text(points), F.lit(")")))
        .when(ngsi_type.isin("geo:polygon", "geo:box"), F.concat(F.lit("POLYGON (("), text(ring), F.lit("))")))
    )
    return body if srid is None else F.concat(F.lit(f"SRID={srid};"), body)


def normalize_location(location: Column, ngsi_type: Column) -> Column:
    """struct(location GeoJSON, centroid): GeoJSON as it is, simple formats (JSON text or list) turned into it; both
    NULL for anything else, so that no centroid outlives its location."""
    v = F.try_parse_json(location)
    texts = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.coalesce(F.try_variant_get(v, "$", "string"), location)))
    points = F.when(ngsi_type.isin(*LEAST_POINTS), slf_parse(ngsi_type, texts))
    json_ = F.coalesce(F.when(ngsi_type.isin("geo:json", "GeoProperty") & F.try_variant_get(v, "$.type", "string").isNotNull(), location), slf_to_geojson(ngsi_type, points))
    return F.struct(json_.alias("location"), centroid(geojson_coordinates(json_)).alias("centroid"))


def decode_value(value: Column, ngsi_type: str) -> Column:
    """A stored value in the form of its type: times as ISO text, geometry as "lat, lon" texts, the rest as it is."""
    from .times import iso_timestamp

    if ngsi_type in ("DateTime", "ISO8601"):
        return iso_timestamp(value)
    return geojson_to_slf(value, F.lit(ngsi_type)) if ngsi_type in LEAST_POINTS else value


def address_key(address: Column) -> Column:
    """struct(key, kind) of an address struct (street, number, locality, region, country): point with a number,
    street without, region without a street; NULL without a country or with nothing else."""
    get = lambda k: F.lower(F.trim(address[k]))
    full = lambda k: F.coalesce(get(k), F.lit("")) != ""
    kind = (
        F.when(~full("country"), None).when(full("street") & ~(full("locality") | full("region")), None).when(full("street") & full("number"), "point")
        .when(full("street"), "street").when(full("locality") | full("region"), "region")
    )
    parts = [F.when(full(k), get(k)) for k in ("street", "number", "locality", "region", "country")]
    return F.when(kind.isNotNull(), F.struct(F.concat_ws(", ", *parts).alias("key"), kind.alias("kind")))


def add_location(entities: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Entities with ``address`` and no ``location`` get the one that a gazetteer (key, location) has for their address.

    Gazetteer keys are unique after this join's own reduction; entities keep all rows. Only entities that lack a location are looked up."""
    keyed = entities.withColumn("_key", F.when(F.col("location").isNull(), address_key(F.col("address"))["key"]))
    known = gazetteer.groupBy(F.col("key").alias("_key")).agg(F.min("location").alias("_found"))
    return keyed.join(known, "_key", "left").withColumn("location", F.coalesce("location", "_found")).drop("_key", "_found")


# --- per-row codecs on Arrow batches: no built-in covers them

_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[(),])")


def _wkt(shape: dict, decimals: int) -> str:
    def inner(c, depth):
        if depth == 0:
            return " ".join(f"{float(x):.{decimals}f}" for x in c)
        return ", ".join(f"({inner(x, depth - 1)})" if depth > 1 else inner(x, 0) for x in c)

    kind = shape["type"]
    if kind == "GeometryCollection":
        body = ", ".join(_wkt(g, decimals) for g in shape["geometries"])
    else:
        body = inner(shape["coordinates"], _DEPTH[kind])
    return f"{kind.upper()} ({body})" if body else f"{kind.upper()} EMPTY"


def _from_wkt(text: str) -> dict:
    """A shape; ValueError or IndexError for what is none. Points of a MULTIPOINT may stand in brackets of their own."""
    srid, _, rest = text.partition(";") if text.upper().startswith("SRID=") else ("", "", text)
    tokens, at = [], 0
    rest = rest.strip()
    while at < len(rest):
        m = _TOKEN.match(rest, at)
        if not m:
            raise ValueError(rest[at:])
        tokens.append(m[1])
        at = m.end()
    at = 0

    def take(*expected) -> str:
        nonlocal at
        if expected and tokens[at].upper() not in expected:
            raise ValueError(tokens[at])
        at += 1
        return tokens[at - 1]

    def many(item) -> list:
        take("(")
        out = [item()]
        while take(",", ")") == ",":
            out.append(item())
        return out

    def point() -> list[float]:
        out = []
        while tokens[at] not in "(),":
            out.append(float(take()))
        if len(out) < 2:
            raise ValueError("a point needs two numbers")
        return out

    def bracketed() -> list[float]:
        return many(point)[0] if tokens[at] == "(" else point()

    def shape() -> dict:
        name = take().upper()
        kind = next((k for k in _CODES if k.upper() == name), None)
        if kind is None:
            raise ValueError(name)
        if tokens[at].upper() in ("Z", "M", "ZM"):
            take()
        part = "geometries" if kind == "GeometryCollection" else "coordinates"
        if tokens[at].upper() == "EMPTY":
            take()
            return {"type": kind, part: []}
        if kind == "GeometryCollection":
            return {"type": kind, part: many(shape)}
        item = bracketed if kind == "MultiPoint" else point
        for _ in range(_DEPTH[kind] - 1):
            item = lambda inner=item: many(inner)
        found = many(item)
        if kind == "Point":
            (found,) = found
        return {"type": kind, part: found}

    out = shape()
    if at != len(tokens):
        raise ValueError("more after the shape")
    return out | ({"meta": {"srid": int(srid[5:])}} if srid else {})


def _wkb(shape: dict, order: str) -> bytes:
    kind = shape["type"]
    head = (b"\x00" if order == ">" else b"\x01") + struct.pack(order + "I", _CODES[kind])
    points = lambda ps: struct.pack(order + "I", len(ps)) + b"".join(struct.pack(order + "2d", *p[:2]) for p in ps)
    if kind == "GeometryCollection":
        return head + struct.pack(order + "I", len(shape["geometries"])) + b"".join(_wkb(g, order) for g in shape["geometries"])
    c = shape["coordinates"]
    if kind == "Point":
        # an empty point is written as one without numbers
        return head + struct.pack(order + "2d", *(c[:2] or [math.nan, math.nan]))
    if kind == "LineString":
        return head + points(c)
    if kind == "Polygon":
        return head + struct.pack(order + "I", len(c)) + b"".join(points(r) for r in c)
    return head + struct.pack(order + "I", len(c)) + b"".join(_wkb({"type": kind.removeprefix("Multi"), "coordinates": x}, order) for x in c)


def _from_wkb(data: bytes) -> dict:
    at = 0

    def take(fmt, order):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def shape() -> dict:
        nonlocal at
        order = ">" if data[at] == 0 else "<"
        at += 1
        code = take("I", order)[0]
        if code & 0x20000000:
            take("I", order)
        kind = {v: k for k, v in _CODES.items()}[code & 0xFF]
        point = lambda: list(take("2d", order))
        points = lambda: [point() for _ in range(take("I", order)[0])]
        if kind == "Point":
            found = point()
            return {"type": kind, "coordinates": [] if any(map(math.isnan, found)) else found}
        if kind == "LineString":
            return {"type": kind, "coordinates": points()}
        if kind == "Polygon":
            return {"type": kind, "coordinates": [points() for _ in range(take("I", order)[0])]}
        parts = [shape() for _ in range(take("I", order)[0])]
        return {"type": kind, "geometries": parts} if kind == "GeometryCollection" else {"type": kind, "coordinates": [p["coordinates"] for p in parts]}

    return shape()


def _each(function, values: pd.Series) -> pd.Series:
    def safe(v):
        try:
            return None if v is None else function(v)
        except (ValueError, KeyError, TypeError, IndexError, struct.error):
            return None

    return values.map(safe)


def geojson_to_wkt(geojson: Column, decimals: int = 16, srid: int | None = None) -> Column:
    def text(v):
        shape = json.loads(v)
        return (f"SRID={srid};" if srid is not None else "") + _wkt(shape, decimals)

    return F.pandas_udf(lambda s: _each(text, s), T.StringType())(geojson)


def wkt_to_geojson(text: Column) -> Column:
    return F.pandas_udf(lambda s: _each(lambda v: json.dumps(_from_wkt(v)), s), T.StringType())(text)


def geojson_to_wkb(geojson: Column, big_endian: bool = True) -> Column:
    def data(v):
        return _wkb(json.loads(v), ">" if big_endian else "<")

    return F.pandas_udf(lambda s: _each(data, s), T.BinaryType())(geojson)


def wkb_to_geojson(data: Column) -> Column:
    """GeoJSON of WKB, binary or hex text; an SRID inside is read over."""
    return F.pandas_udf(lambda s: _each(lambda v: json.dumps(_from_wkb(bytes.fromhex(v) if isinstance(v, str) else bytes(v))), s), T.StringType())(data)
