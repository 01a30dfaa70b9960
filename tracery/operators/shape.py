"""Nested results: series of index and values by entity, by type and by attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import iso_timestamp
from .query import KEY, unique
from .shared import stored


def _field(name: str):
    return lambda row: row[name]


def to_series(df: DataFrame, attrs: list[str], tie: tuple[str, ...] = ()) -> DataFrame:
    """One row an entity: index, an array of times, and an array of values for each attribute, NULLs kept.

    A series is one row, so page or aggregate long histories first."""
    attrs = unique(attrs)
    rows = F.array_sort(F.collect_list(F.struct("time_index", *tie, *[a for a in attrs if a not in tie])))
    found = df.groupBy(*KEY).agg(rows.alias("_rows"))
    return found.select(*KEY, F.transform("_rows", lambda r: r["time_index"]).alias("index"), *[F.transform("_rows", _field(a)).alias(a) for a in attrs])


def series_chunks(df: DataFrame, attrs: list[str], tie: tuple[str, ...] = (), size: int = 10_000) -> DataFrame:
    """Series of any length as rows of bounded length: (entity_type, entity_id, start, index, an array for each attribute), where ``start``
    is how many updates of the entity come before. A chunk has ``size`` updates at most, and fewer where ranges meet.

    Rows are sorted by ranges of entity, time and all other columns asked for, so a long series is shared by many tasks, and
    rows that change places are alike. Only the chunks' lengths, not their rows, go by entity to find ``start``. NULL times
    come first, NULL values stay; attributes must have an order (no maps)."""
    attrs = unique(attrs)
    columns = ["time_index", *tie, *[a for a in attrs if a not in tie]]
    rows = df.select(*KEY, *columns).repartitionByRange(*KEY, *columns).sortWithinPartitions(*KEY, *columns).withColumn("_block", F.floor(F.monotonically_increasing_id() / size))
    found = rows.groupBy(*KEY, "_block").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    found = stored(found.select(*KEY, "_block", F.size("_rows").alias("_n"), F.transform("_rows", _field("time_index")).alias("index"), *[F.transform("_rows", _field(a)).alias(a) for a in attrs]))
    before = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("_block")) - F.col("_n")
    starts = found.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("_block").alias("_at"), before.alias("start"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return found.join(starts, [*same, F.col("_block") == F.col("_at")]).select(*KEY, "start", "index", *attrs)


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """The updates of chunks again, each with its ``position`` in the entity's series."""
    attrs = [c for c in chunks.columns if c not in (*KEY, "start", "index")]
    each = chunks.select(*KEY, "start", F.posexplode(F.arrays_zip("index", *attrs)).alias("_k", "_x"))
    return each.select(*KEY, (F.col("start") + F.col("_k")).alias("position"), F.col("_x.index").alias("time_index"), *[F.col(f"_x.{a}").alias(a) for a in attrs])


def series_page(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """Updates ``offset`` to ``offset + limit`` of each series: ``start`` tells which chunks hold them, so no others are opened
    however deep the page is, and nothing is ranked."""
    own = chunks.where((F.col("start") < offset + limit) & (F.col("start") + F.size("index") > offset))
    return flatten_chunks(own).where(F.col("position").between(offset, offset + limit - 1))


def _attributes(attrs: list[str]) -> Column:
    """Attributes as an array of name and values (as text, so that types may differ), names sorted."""
    return F.array(*[F.struct(F.lit(a).alias("attr_name"), F.transform(F.col(a), lambda v: v.cast("string")).alias("values")) for a in sorted(unique(attrs))])


def series_one_attr(df: DataFrame, attr: str, tie: tuple[str, ...] = ()) -> DataFrame:
    return to_series(df, [attr], tie).select(*KEY, F.lit(attr).alias("attr_name"), "index", F.col(attr).alias("values"))


def series_one_entity(df: DataFrame, attrs: list[str], tie: tuple[str, ...] = ()) -> DataFrame:
    return to_series(df, attrs, tie).select(*KEY, "index", _attributes(attrs).alias("attributes"))


def _by_type(series: DataFrame, ids: list[str] | None, keys: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("entity_id")) if ids else F.lit(0)
    place = F.when(place == 0, len(ids or []) + 1).otherwise(place)
    rest = [c for c in series.columns if c not in (*keys, "entity_id")]
    entities = F.array_sort(F.collect_list(F.struct(place.alias("_place"), "entity_id", *rest)))
    return series.groupBy(*keys).agg(F.transform(entities, lambda e: e.dropFields("_place")).alias("entities"))


def series_by_type_one_attr(df: DataFrame, attr: str, ids: list[str] | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    return _by_type(series_one_attr(df, attr, tie), ids, ["entity_type", "attr_name"])


def series_by_type(df: DataFrame, attrs: list[str], ids: list[str] | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    return _by_type(series_one_entity(df, attrs, tie), ids, ["entity_type"])


def series_attr_by_types(df: DataFrame, attr: str, tie: tuple[str, ...] = ()) -> DataFrame:
    types = series_by_type_one_attr(df, attr, tie=tie)
    return types.groupBy("attr_name").agg(F.array_sort(F.collect_list(F.struct("entity_type", "entities"))).alias("types"))


def series_attrs_by_types(df: DataFrame, attrs: list[str], tie: tuple[str, ...] = ()) -> DataFrame:
    """One row: attributes, in each the types, in each the entities with their series (values as text)."""
    names = sorted(unique(attrs))
    series = to_series(df, names, tie)
    long = series.select(*KEY, "index", F.explode(_attributes(names)).alias("a")).select("entity_type", "entity_id", F.col("a.attr_name").alias("attr_name"), "index", F.col("a.values").alias("values"))
    types = _by_type(long, None, ["attr_name", "entity_type"]).groupBy("attr_name").agg(F.array_sort(F.collect_list(F.struct("entity_type", "entities"))).alias("types"))
    return types.agg(F.array_sort(F.collect_list(F.struct("attr_name", "types"))).alias("attrs"))


def values_only(shaped: DataFrame) -> DataFrame:
    """The same shape without id, type and attribute name."""
    return shaped.drop(*KEY, "attr_name")


def last_value_record(df: DataFrame, attrs: dict[str, str]) -> DataFrame:
    """Last values as records: dateModified and each attribute as a struct of value (text) and type."""
    stamp = F.struct(iso_timestamp(F.col("time_index")).alias("value"), F.lit("DateTime").alias("type"))
    return df.select(*KEY, stamp.alias("dateModified"), *[F.struct(F.col(a).cast("string").alias("value"), F.lit(t).alias("type")).alias(a) for a, t in attrs.items()])


def aggregate_index(from_: str | None = None, to: str | None = None) -> Column:
    """The index of an aggregate without a period: empty, or the two times asked for, in UTC."""
    from ..functions.times import parse_date

    if from_ is None or to is None:
        return F.array().cast("array<string>")
    return F.array(iso_timestamp(parse_date(F.lit(from_))), iso_timestamp(parse_date(F.lit(to))))


def lookup_ignore_case(catalog: DataFrame, name: str) -> DataFrame:
    """The columns of a catalog whose attribute has a name in any case."""
    return catalog.where(F.lower("attr_name") == name.lower())


def attach_attr_metadata(long: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attribute rows (entity_type, column, ...) with the original name and type of their column; the catalog has a
    row for each column of each type, so Spark broadcasts it where it is small."""
    return long.join(catalog.select("entity_type", "column", "attr_name", "ngsi_type"), ["entity_type", "column"], "left")
