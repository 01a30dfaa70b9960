"""Geographic predicates over rows with a GeoJSON location, its extent and its centroid."""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, cells
from .planar import canonical_form, parts_of, relate
from .shared import modest_batches

EARTH_RADIUS = 6_371_008.8


def parse_geo_query(georel: str | None, geometry: str | None, coords: str | None) -> dict | None:
    """A query from its three texts: all missing is none, a part missing or bad is an error.

    Coordinates are "lat,lon" pairs with semicolons between."""
    if not georel and not geometry and not coords:
        return None
    if not (georel and geometry and coords):
        raise ValueError("georel, geometry and coords go together")
    name, *options = [p.strip() for p in georel.split(";")]
    if name not in ("near", "coveredBy", "intersects", "disjoint", "equals"):
        raise ValueError(f"unknown georel {name!r}")
    out: dict = {"georel": name}
    for option in options:
        m = re.fullmatch(r"(minDistance|maxDistance):(\d+(?:\.\d+)?)", option)
        if not m or name != "near":
            raise ValueError(f"bad option {option!r}")
        out[m[1]] = float(m[2])
    if name == "near" and len(out) == 1:
        raise ValueError("near needs minDistance or maxDistance")
    points = []
    for pair in coords.split(";"):
        lat, lon = (float(x) for x in pair.split(","))
        points.append([lon, lat])
    least = {"point": 1, "line": 2, "polygon": 4, "box": 2}
    if geometry not in least or len(points) < least[geometry]:
        raise ValueError(f"bad geometry {geometry!r}")
    if geometry == "box":
        (a, b), (c, d) = points[:2]
        points = [[a, b], [c, b], [c, d], [a, d], [a, b]]
    return out | {"kind": {"point": "Point", "line": "LineString"}.get(geometry, "Polygon"), "points": points}


def distance(lon: Column, lat: Column, lon0: float | Column, lat0: float | Column) -> Column:
    """Metres along a great circle (haversine)."""
    narrow = F.cos(F.radians(lat0)) if isinstance(lat0, Column) else float(np.cos(np.radians(lat0)))
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * narrow * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_near(df: DataFrame, lon0: float, lat0: float, min_metres: float | None = None, max_metres: float | None = None, centroid: str = "centroid") -> DataFrame:
    """Rows whose centroid is at least and at most so many metres from a point, both included.

    Where rows have their extent (min_lon, min_lat, max_lon, max_lat), which holds the centroid, a box is cut out first; a
    scan can use it."""
    tests = []
    if max_metres is not None:
        reach = float(np.degrees(max_metres / EARTH_RADIUS)) + 1e-9
        tests += [lambda c: c["lat"].between(lat0 - reach, lat0 + reach), lambda c: distance(c["lon"], c["lat"], lon0, lat0) <= max_metres]
        if {"min_lon", "min_lat", "max_lon", "max_lat"} <= set(df.columns):
            df = df.where((F.col("max_lat") >= lat0 - reach) & (F.col("min_lat") <= lat0 + reach))
            if abs(lat0) + reach < 89:
                # on a sphere the longest reach in longitude of a circle
                wide = float(np.degrees(np.arcsin(min(1.0, np.sin(np.radians(reach)) / np.cos(np.radians(lat0)))))) + 1e-9 if reach < 90 else 180.0
                if lon0 - wide >= -180 and lon0 + wide <= 180:
                    df = df.where((F.col("max_lon") >= lon0 - wide) & (F.col("min_lon") <= lon0 + wide))
    if min_metres is not None:
        tests.append(lambda c: distance(c["lon"], c["lat"], lon0, lat0) >= min_metres)
    if not tests:
        return df.where(F.col(centroid).isNotNull())
    # the centroid may be worked out from a shape: it is named once
    return df.where(F.exists(F.array(F.col(centroid)), lambda c: reduce(lambda a, b: a & b, [t(c) for t in tests])))


def _related(relation: str, query: dict) -> Column:
    """The exact test by row; where cells show that the row lies within the query, no geometry is looked at."""
    points = np.array(query["points"], dtype=float)

    def test(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else bool(relate(relation, json.loads(v), query["kind"], points))
            except (ValueError, KeyError, TypeError, IndexError):
                return None

        return values.map(one).astype(object)

    exact = F.pandas_udf(test, T.BooleanType())
    if relation == "equals" or query["kind"] != "Polygon":
        return exact(F.col("location"))
    sure = F.col("location").isNotNull() & cells.surely_within([("Polygon", [points])])
    return sure | exact(F.when(~sure, F.col("location")))


def _overlaps_extent(query: dict) -> Column:
    p = np.array(query["points"], dtype=float)
    (x0, y0), (x1, y1) = p.min(axis=0).tolist(), p.max(axis=0).tolist()
    return (F.col("max_lon") >= x0 - 1e-9) & (F.col("min_lon") <= x1 + 1e-9) & (F.col("max_lat") >= y0 - 1e-9) & (F.col("min_lat") <= y1 + 1e-9)


def geo_covered_by(df: DataFrame, query: dict) -> DataFrame:
    """Rows whose location lies within a shape. Extents (min_lon, min_lat, max_lon, max_lat) are compared first, and must be
    those of the location: a row whose extent lies in cells within the shape is not looked at further."""
    return df.where(_overlaps_extent(query)).where(_related("coveredBy", query))


def geo_intersects(df: DataFrame, query: dict) -> DataFrame:
    """Rows whose location meets a shape; extents as for ``geo_covered_by``."""
    return df.where(_overlaps_extent(query)).where(_related("intersects", query))


def geo_disjoint(df: DataFrame, query: dict) -> DataFrame:
    """Rows with a location that doesn't meet a shape."""
    return df.where("location is not null").where(~_overlaps_extent(query) | ~_related("intersects", query))


def geo_equals(df: DataFrame, query: dict) -> DataFrame:
    return df.where(_overlaps_extent(query)).where(_related("equals", query))


def geometry_key(location: Column) -> Column:
    """A hash of a GeoJSON shape's canonical form: equal for shapes that cover the same points, so equality is a join by key.
    NULL for what is no shape."""

    def form(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                parts = None if v is None else parts_of(json.loads(v))
                return repr(canonical_form(parts)) if parts else None
            except (ValueError, KeyError, TypeError, IndexError):
                return None

        return values.map(one).astype(object)

    return F.sha2(F.pandas_udf(form, T.StringType())(location), 256)


def geo_equal_pairs(df: DataFrame, others: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, other, location): rows of two tables whose shapes are equal, by one join on the hash of their canonical forms."""
    left = df.select(F.col(key), "location", geometry_key(F.col("location")).alias("_form")).where("_form is not null")
    right = others.select(F.col(key).alias("other"), geometry_key(F.col("location")).alias("_form"))
    return left.join(right, "_form").select(key, "other", "location")


def candidate_pairs(df: DataFrame, shapes: DataFrame, key: str = "entity_id", shape_key: str = "shape_id", most: int = cells.CELLS) -> DataFrame:
    """(key, _row, shape_key, _shape, sure): rows and shapes that share a cell, joined by equality, and whose extents meet; ``sure`` if cells show
    that the row lies within the shape. _row and _shape are hashes of the geometries, so that one id may have several."""
    rows = df.where("location is not null").select(F.col(key), F.xxhash64("location").alias("_row"), cells.inside_world().alias("_world"), *cells.EXTENT, F.explode(cells.row_keys()).alias("_k"))
    rows = rows.select(F.col(key), "_row", "_world", *cells.EXTENT, F.col("_k.key").alias("_key"), F.col("_k.mask").alias("_mask"))
    given = shapes.where("location is not null").select(F.col(shape_key), "location")
    # covers are much work for few bytes, so a fixed number of tasks shares it
    given = given.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shape_key)
    covers = given.select(shape_key, F.xxhash64("location").alias("_shape"), F.explode(cells.cover_keys(F.col("location"), most)).alias("_c"))
    covers = covers.select(shape_key, "_shape", F.col("_c.key").alias("_cell"), F.col("_c.inner").alias("_inner"), *[F.col(f"_c.{n}").alias(f"_{n}") for n in ("x0", "y0", "x1", "y1")])
    # the size of covers is not known before they are made, so they may not be taken for small and sent to the driver
    met = rows.hint("merge").join(covers, F.col("_key") == F.col("_cell"))
    met = met.where("max_lon >= _x0 - 1e-9 and min_lon <= _x1 + 1e-9 and max_lat >= _y0 - 1e-9 and min_lat <= _y1 + 1e-9")
    within = F.bit_or(F.when(F.col("_inner"), F.col("_mask")).otherwise(0))
    return met.groupBy(key, "_row", shape_key, "_shape").agg((F.bool_and(F.coalesce("_world", F.lit(False))) & (within == 15)).alias("sure"))


def geo_join(df: DataFrame, shapes: DataFrame, relation: str, key: str = "entity_id", shape_key: str = "shape_id") -> DataFrame:
    """(key, shape_key): rows whose location is coveredBy or intersects a shape of another table, each pair once.

    Both tables have a GeoJSON ``location``, the rows also its extent; the shapes may have holes and several parts (each part
    of a row must lie in one of them). Rows and shapes of a cell are laid in blocks of bounded size and blocks are joined by their
    cell, so that a row meets a shape once at most; numpy compares block with block (``blocks``). Pairs of blocks are dealt out
    evenly, also those of a hot cell. Rows or shapes that are NULL, unreadable or without an extent are in no pair."""
    if relation not in ("coveredBy", "intersects"):
        raise ValueError(f"no join by {relation!r}")
    if key == shape_key:
        raise ValueError("the ids of rows and shapes need names of their own")
    modest_batches(df.sparkSession)
    # comparing is much work for few bytes, so a fixed number of tasks shares it
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = shapes.where("location is not null").select(F.col(shape_key), "location").repartition(n, shape_key).distinct()
    given = given.withColumn("_e", cells.extent_of(F.col("location"))).select(shape_key, "location", *[F.col(f"_e.{c}").alias(f"_{c}") for c in cells.EXTENT])
    given = given.select(shape_key, "location", F.explode(cells.meeting_keys(tuple(f"_{c}" for c in cells.EXTENT))).alias("_k"))
    rows = df.where("location is not null").select(F.col(key), "location", *cells.EXTENT).distinct()
    rows = rows.select(key, "location", F.explode(cells.home_keys()).alias("_k"))
    # sizes are not known before the keys are, so no side may be taken for small and sent to the driver
    rows = rows.hint("merge").join(given.select("_k").distinct(), "_k", "left_semi").sortWithinPartitions("_k")
    own = blocks.in_blocks(rows, key, blocks.ROWS, "_r")
    others = blocks.in_blocks(given.repartition(n, "_k").sortWithinPartitions("_k"), shape_key, blocks.SHAPES, "_s")
    met = own.hint("merge").join(others, "_k").repartition(n, "_r_id", "_s_id")
    return blocks.compare(met, relation, key, shape_key).distinct()


def geo_near_join(df: DataFrame, points: DataFrame, max_metres: float, key: str = "entity_id", point_key: str = "point_id", centroid: str = "centroid") -> DataFrame:
    """(key, point_key, metres): rows whose centroid is at most so far from a point (lon, lat) of another table.

    The distance fixes the level of the cells, so a row has one key and is never multiplied; a point has the few cells that its
    circle touches (a whole ring of them by a pole). NULL places are in no pair; repeated rows give repeated pairs."""
    if key == point_key:
        raise ValueError("the ids of rows and points need names of their own")
    reach = float(np.degrees(max_metres / EARTH_RADIUS))
    level = cells.circle_level(reach)
    known = lambda lon, lat: lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    rows = df.select(F.col(key), F.col(f"{centroid}.lon").alias("_x"), F.col(f"{centroid}.lat").alias("_y")).where(known(F.col("_x"), F.col("_y")))
    rows = rows.withColumn("_cell", cells.point_key(F.col("_x"), F.col("_y"), level))
    given = points.select(F.col(point_key), F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat")).where(known(F.col("_lon"), F.col("_lat")))
    given = given.select("*", F.explode(cells.circle_keys(F.col("_lon"), F.col("_lat"), reach, level)).alias("_cell"))
    metres = distance(F.col("_x"), F.col("_y"), F.col("_lon"), F.col("_lat"))
    return rows.join(given, "_cell").select(key, point_key, metres.alias("metres")).where(F.col("metres") <= max_metres)
