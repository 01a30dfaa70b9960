"""A registered query for each operator, over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, geo, times
from ..operators import filters, ingest, query, shape
from ..operators import geo as places
from ..operators import telemetry as tele
from ..operators.shared import workspace
from ..sources import store, tables
from ..streaming import jobs
from . import views
from .views import SQL, iso_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, *needed: str, name: str | None = None):
    """Add a query by its function's name; ``needed`` are the views that its SQL reads."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE_SQL[key] = (f"with {', '.join(SQL[n] for n in needed)} " if needed else "") + sql
        return function

    return add


def _iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: times.iso_timestamp(F.col(c)) for c in columns or ("time_index",)})


def _r(column, digits: int = 4):
    return F.round(column, digits)


T = iso_sql("time_index") + " as time_index"

# --- filters


@register(f"select entity_type, entity_id, {T}, round(value, 4) as value, event_id from es where entity_id in ('user:1', 'user:7', 'user:42')", "es")
def filter_entity_ids(spark, sf):
    df = filters.filter_entity_ids(views.events_series(spark, sf), ["user:1", "user:7", "user:42"])
    return _iso(df.select("entity_type", "entity_id", "time_index", _r("value").alias("value"), "event_id"))


_MID = "(select quantile_disc(time_index, 0.{}) from es)"


@register("select count(*) as n, round(sum(value), 2) as total from es where time_index >= timestamp '2024-01-10' and time_index <= timestamp '2024-01-20 12:00:00'", "es")
def filter_time_range(spark, sf):
    df = filters.filter_time_range(views.events_series(spark, sf), "2024-01-10", "'2024-01-20T12:00:00Z'")
    return df.agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))


@register("select fiware_servicepath, count(*) as n from es where lower(fiware_servicepath) = '/g1' or starts_with(lower(fiware_servicepath), '/g1/') group by all", "es")
def filter_service_path(spark, sf):
    return filters.filter_service_path(views.events_series(spark, sf), "/G1").groupBy("fiware_servicepath").agg(F.count("*").alias("n"))


@register("select entity_id, count(*) as n from es where regexp_matches(entity_id, '(?i)USER:1[0-3]$') group by all", "es")
def filter_id_pattern(spark, sf):
    return filters.filter_id_pattern(views.events_series(spark, sf), "USER:1[0-3]$").groupBy("entity_id").agg(F.count("*").alias("n"))


@register("select entity_type, count(*) as n from es where entity_type in ('click', 'view') group by all", "es")
def filter_entity_type(spark, sf):
    return filters.filter_entity_type(views.events_series(spark, sf), "Click,VIEW").groupBy("entity_type").agg(F.count("*").alias("n"))


@register("select 'acme' as tenant, count(*) as n from es union all select 'none', count(*) from os", "es", "os")
def filter_tenant(spark, sf):
    a = filters.filter_tenant(views.events_series(spark, sf), "ACME").agg(F.count("*").alias("n")).select(F.lit("acme").alias("tenant"), "n")
    b = filters.filter_tenant(views.orders_series(spark, sf), None).agg(F.count("*").alias("n")).select(F.lit("none").alias("tenant"), "n")
    return a.unionByName(b)


@register("select entity_id, count(*) as n from ss where quantity > 45 and flag = 'R' group by all", "ss")
def filter_attribute(spark, sf):
    return filters.filter_attribute(views.shipments_series(spark, sf), "quantity > 45 and flag = 'R'").groupBy("entity_id").agg(F.count("*").alias("n"))


@register("select distinct entity_type from es where entity_id = 'user:5'", "es")
def resolve_entity_type(spark, sf):
    return filters.resolve_entity_type(views.events_series(spark, sf), "user:5")


@register("select entity_id, round(sum(total), 2) as total from os group by all", "os")
def validate_query_params(spark, sf):
    filters.validate_query_params(["total"], "sum")
    df = query.aggregate_entities(views.orders_series(spark, sf), ["total"], "sum")
    return df.select("entity_id", _r("total", 2).alias("total"))


# --- aggregates, windows, listings

for _m in filters.METHODS:

    @register(f"select entity_type, entity_id, round({_m}(value), 3)::double as value, round({_m}(k), 3)::double as k from es group by all", "es", name=f"aggregate_entities_{_m}")
    def _aggregate(spark, sf, m=_m):
        df = query.aggregate_entities(views.events_series(spark, sf), ["value", "k", "value"], m)
        return df.select("entity_type", "entity_id", _r(F.col("value").cast("double"), 3).alias("value"), _r(F.col("k").cast("double"), 3).alias("k"))


for _p in times.PERIODS:

    @register(f"select entity_type, entity_id, {iso_sql(f"date_trunc('{_p}', time_index)::timestamp")} as time_index, round(avg(value), 3) as value from es group by entity_type, entity_id, date_trunc('{_p}', es.time_index)".replace("strftime(date_trunc('" + _p + "', time_index)::timestamp", "strftime(date_trunc('" + _p + "', es.time_index)::timestamp"), "es", name=f"aggregate_by_period_{_p}")
    def _by_period(spark, sf, p=_p):
        df = query.aggregate_by_period(views.events_series(spark, sf), ["value"], "avg", p)
        return _iso(df.withColumn("value", _r("value", 3)))


@register(f"select entity_type, entity_id, {iso_sql("date_trunc('day', es.time_index)::timestamp")} as time_index, count(value) as n, round(sum(value), 3) as total from es where time_index >= timestamp '2024-01-05' and time_index <= timestamp '2024-01-25' and (fiware_servicepath = '/g2' or starts_with(fiware_servicepath, '/g2/')) group by entity_type, entity_id, date_trunc('day', es.time_index)", "es")
def period_report(spark, sf):
    """The flagship: a time range and a path, then counts and sums by entity and day."""
    df = filters.filter_service_path(filters.filter_time_range(views.events_series(spark, sf), "2024-01-05", "2024-01-25"), "/g2")
    df = df.groupBy("entity_type", "entity_id", times.period_start("day", F.col("time_index")).alias("time_index")).agg(F.count("value").alias("n"), _r(F.sum("value"), 3).alias("total"))
    return _iso(df)


@register(f"select entity_type, {iso_sql("date_trunc('month', es.time_index)::timestamp")} as time_index, max(value) as value, array_to_string(list_sort(list(distinct entity_id)), ',') as ids from es group by entity_type, date_trunc('month', es.time_index)", "es")
def aggregate_global(spark, sf):
    df = query.aggregate_global(views.events_series(spark, sf), ["value"], "max", "month")
    return _iso(df.select("entity_type", "time_index", "value", F.array_join("entity_ids", ",").alias("ids")))


@register("select entity_id, min(flag) as flag from ss group by all", "ss")
def check_aggregable(spark, sf):
    df = views.shipments_series(spark, sf)
    try:
        query.check_aggregable(df, ["flag"], "sum")
    except ValueError:
        return query.aggregate_entities(df, ["flag"], "min").select("entity_id", "flag")
    raise AssertionError("sum of text must be refused")


@register(f"select entity_type, entity_id, {T} from (select entity_type, entity_id, max(time_index) as time_index from es group by all order by time_index desc, entity_type, entity_id limit 50 offset 10)", "es")
def list_entities(spark, sf):
    return _iso(query.list_entities(views.events_series(spark, sf), 50, 10))


@register("select distinct entity_type from es where fiware_servicepath = '/g3' or starts_with(fiware_servicepath, '/g3/')", "es")
def list_entity_types(spark, sf):
    return query.list_entity_types(filters.filter_service_path(views.events_series(spark, sf), "/g3"))


@register("select instance_id from es where entity_id = 'user:3' order by instance_id limit 100", "es")
def list_instance_ids(spark, sf):
    return query.list_instance_ids(filters.filter_entity_ids(views.events_series(spark, sf), ["user:3"]), 100)


@register(f"select entity_type, entity_id, {T}, total, status from os where entity_id in ('c1', 'c2', 'c4')", "os")
def history(spark, sf):
    df = filters.filter_entity_ids(views.orders_series(spark, sf), ["c1", "c2", "c4"])
    return _iso(query.history(df, ["total", "status", "total"]))


@register(f"select entity_type, entity_id, {T}, event_id from es qualify row_number() over (partition by entity_type order by es.time_index desc, event_id) <= 20", "es")
def last_n(spark, sf):
    return _iso(query.last_n(views.events_series(spark, sf), 20, tie=("event_id",)).select("entity_type", "entity_id", "time_index", "event_id"))


@register(f"select entity_type, entity_id, {T}, event_id from es qualify row_number() over (partition by entity_type, entity_id order by es.time_index desc, event_id) <= 2", "es")
def last_n_per_entity(spark, sf):
    return _iso(query.last_n_per_entity(views.events_series(spark, sf), 2, ("event_id",)).select("entity_type", "entity_id", "time_index", "event_id"))


@register(f"select entity_type, entity_id, {T}, event_id from es qualify row_number() over (partition by entity_type order by es.time_index, event_id) between 11 and 35", "es")
def paginate(spark, sf):
    return _iso(query.paginate(views.events_series(spark, sf), 25, 10, tie=("event_id",)).select("entity_type", "entity_id", "time_index", "event_id"))


@register(f"select entity_id, {T}, o_orderkey from (select * from os where time_index >= timestamp '1996-06-01' order by time_index, entity_id, o_orderkey limit 40)", "os")
def page_after(spark, sf):
    start = {"time_index": datetime(1996, 6, 1), "entity_id": "", "o_orderkey": -1}
    page = query.page_after(views.orders_series(spark, sf), start, 40, ("time_index", "entity_id", "o_orderkey"))
    return _iso(page.select("entity_id", "time_index", "o_orderkey"))


@register(f"select entity_type, entity_id, {T}, event_id, value, k from es qualify row_number() over (partition by entity_type, entity_id order by es.time_index desc, event_id desc) = 1", "es")
def last_value(spark, sf):
    return _iso(query.last_value(views.events_series(spark, sf), ["value", "k", "event_id"], tie=("event_id",)).select("entity_type", "entity_id", "time_index", "event_id", "value", "k"))


_TIES = f"select entity_type, entity_id, {T}, quantity, l_orderkey, l_linenumber from ss qualify rank() over (partition by entity_type, entity_id order by ss.time_index desc) = 1"


@register(_TIES, "ss")
def last_value_ties(spark, sf):
    return _iso(query.last_value(views.shipments_series(spark, sf), ["quantity", "l_orderkey", "l_linenumber"], ties=True))


@register(_TIES, "ss")
def last_value_join(spark, sf):
    return _iso(query.last_value_join(views.shipments_series(spark, sf), ["quantity", "l_orderkey", "l_linenumber"]))


@register(f"select entity_type, entity_id, {T}, o_orderkey, total from os where entity_id in (select 'c' || c_custkey from customer where c_mktsegment = 'BUILDING') qualify row_number() over (partition by entity_id order by os.time_index desc, o_orderkey desc) = 1", "os")
def query_batch_entities(spark, sf):
    asked = views.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("Customer").alias("entity_type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return _iso(query.query_batch_entities(views.orders_series(spark, sf), asked, ["total", "o_orderkey"], tie=("o_orderkey",)).select("entity_type", "entity_id", "time_index", "o_orderkey", "total"))


@register("select entity_type, count(*) as n, count(value) as n_value, count(quantity) as n_quantity from (select entity_type, value, null as quantity from es union all select entity_type, null, quantity from ss) group by all", "es", "ss")
def union_types(spark, sf):
    df = query.union_types([views.events_series(spark, sf), views.shipments_series(spark, sf)])
    return df.groupBy("entity_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.count("quantity").alias("n_quantity"))


@register(f"select entity_type, entity_id, {T}, value from es qualify row_number() over (partition by entity_type order by es.time_index, entity_id) <= 30", "es")
def multi_type_history(spark, sf):
    return _iso(query.multi_type_history(views.events_series(spark, sf), ["value"], 30))


@register("select label, count(*) as n from (select event_type as label from events union all select event_type from events where value > 50) group by all")
def merge_observations(spark, sf):
    t = views.telemetry(spark, sf)
    return query.merge_observations([t, t.where("measurement > 50")]).groupBy("label").agg(F.count("*").alias("n"))


# --- deletes


@register("select 'kept' as part, count(*) as n from es where not (entity_type = 'click' and regexp_matches(entity_id, '(?i)^user:1') and time_index >= timestamp '2024-01-08') union all select 'gone', count(*) from es where entity_type = 'click' and regexp_matches(entity_id, '(?i)^user:1') and time_index >= timestamp '2024-01-08'", "es")
def delete_entities(spark, sf):
    kept, gone = query.delete_entities(views.events_series(spark, sf), entity_type="Click", pattern="^user:1", from_="2024-01-08")
    return kept.select(F.lit("kept").alias("part")).unionByName(gone.select(F.lit("gone").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@register("select entity_id, count(*) as n from os where entity_id <> 'c7' group by all", "os")
def delete_entity(spark, sf):
    kept, _ = query.delete_entity(views.orders_series(spark, sf), "c7")
    return kept.groupBy("entity_id").agg(F.count("*").alias("n"))


@register("select entity_type, entity_id, (time_index::date)::varchar as date, count(*) as n from es where not (entity_type = 'click' and entity_id like 'user:1%' and time_index >= timestamp '2024-01-08') group by all", "es")
def delete_stored_entities(spark, sf):
    """Rows deleted from a stored table, of which only the partitions that held some are written again."""
    folder = workspace(spark)
    tables.write_series(views.events_series(spark, sf), folder, 4)
    tables.rewrite_partitions(spark, folder, (F.col("entity_type") == "click") & F.col("entity_id").like("user:1%") & (F.col("time_index") >= "2024-01-08"))
    return tables.read_series(spark, folder).groupBy("entity_type", "entity_id", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@register("select entity_type, count(*) as n from es where entity_type <> 'view' group by all", "es")
def drop_type(spark, sf):
    return query.drop_type(views.events_series(spark, sf), "View").groupBy("entity_type").agg(F.count("*").alias("n"))


# --- nested results: flattened again, so that SQL can give the same rows

_FLAT = f"select entity_type, entity_id, row_number() over (partition by entity_type, entity_id order by es.time_index, event_id) - 1 as pos, {T}, cast(k as varchar) as k from es"


@register(_FLAT, "es")
def to_series(spark, sf):
    s = shape.to_series(views.events_series(spark, sf), ["k"], ("event_id",))
    s = s.select("entity_type", "entity_id", F.posexplode(F.arrays_zip("index", "k")).alias("pos", "r"))
    return _iso(s.select("entity_type", "entity_id", F.col("pos").cast("long").alias("pos"), F.col("r.index").alias("time_index"), F.col("r.k").cast("string").alias("k")))


def _opened(e, keys, values="values"):
    z = e.select(*keys, F.posexplode(F.arrays_zip("index", values)).alias("pos", "r"))
    return _iso(z.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("r.index").alias("time_index"), F.col(f"r.{values}").cast("string").alias("k")))


_PLACED = "select entity_type, entity_id, row_number() over (partition by entity_type, entity_id order by es.time_index, event_id) - 1 as position, " + T + ", event_id, k from es"


@register(_PLACED, "es")
def series_chunks(spark, sf):
    """Chunks of 64 updates, flattened: every update with its place in the series."""
    return _iso(shape.flatten_chunks(shape.series_chunks(views.events_series(spark, sf), ["event_id", "k"], ("event_id",), size=64)))


@register(f"select * from ({_PLACED}) where position between 3 and 7", "es")
def series_page(spark, sf):
    """Updates 3 to 7 of each series."""
    return _iso(shape.series_page(shape.series_chunks(views.events_series(spark, sf), ["event_id", "k"], ("event_id",)), 3, 5))


@register(_FLAT, "es")
def series_one_attr(spark, sf):
    return _opened(shape.series_one_attr(views.events_series(spark, sf), "k", ("event_id",)), ["entity_type", "entity_id"])


@register(_FLAT.replace("select entity_type", "select 'k' as attr_name, entity_type"), "es")
def series_one_entity(spark, sf):
    s = shape.series_one_entity(views.events_series(spark, sf), ["value", "k"], ("event_id",))
    s = s.select("entity_type", "entity_id", "index", F.explode("attributes").alias("a")).where("a.attr_name = 'k'")
    return _opened(s.select("entity_type", "entity_id", "index", "a.attr_name", "a.values"), ["attr_name", "entity_type", "entity_id"])


def _entities(df, keys):
    return df.select(*keys, F.posexplode("entities").alias("place", "e")).select(*keys, F.col("place").cast("long").alias("place"), "e.*")


_PLACE = "dense_rank() over (partition by entity_type order by case entity_id when 'user:9' then 0 when 'user:2' then 1 else 2 end, entity_id) - 1 as place, "


@register(_FLAT.replace("select entity_type", f"select {_PLACE} entity_type"), "es")
def series_by_type_one_attr(spark, sf):
    s = shape.series_by_type_one_attr(views.events_series(spark, sf), "k", ["user:9", "user:2"], ("event_id",))
    return _opened(_entities(s, ["entity_type"]), ["entity_type", "place", "entity_id"])


@register(_FLAT.replace("select entity_type", "select dense_rank() over (partition by entity_type order by entity_id) - 1 as place, entity_type"), "es")
def series_by_type(spark, sf):
    s = _entities(shape.series_by_type(views.events_series(spark, sf), ["k", "value"], tie=("event_id",)), ["entity_type"])
    s = s.select("entity_type", "place", "entity_id", "index", F.explode("attributes").alias("a")).where("a.attr_name = 'k'")
    return _opened(s.select("entity_type", "place", "entity_id", "index", "a.values"), ["entity_type", "place", "entity_id"])


@register(_FLAT, "es")
def series_attr_by_types(spark, sf):
    s = shape.series_attr_by_types(views.events_series(spark, sf), "k", ("event_id",))
    s = s.select(F.explode("types").alias("t")).select("t.*")
    return _opened(_entities(s, ["entity_type"]), ["entity_type", "entity_id"])


@register(_FLAT, "es")
def series_attrs_by_types(spark, sf):
    s = shape.series_attrs_by_types(views.events_series(spark, sf), ["value", "k"], ("event_id",))
    s = s.select(F.explode("attrs").alias("a")).where("a.attr_name = 'k'").select(F.explode("a.types").alias("t")).select("t.*")
    return _opened(_entities(s, ["entity_type"]), ["entity_type", "entity_id"])


@register("select sum(n)::bigint as n_values, count(*) as n_series from (select count(*) as n from es group by entity_type, entity_id)", "es")
def values_only(spark, sf):
    s = shape.values_only(shape.series_one_attr(views.events_series(spark, sf), "k", ("event_id",)))
    return s.agg(F.sum(F.size("values")).alias("n_values"), F.count("*").alias("n_series"))


@register(f"select entity_id, {iso_sql('time_index')} as modified, 'DateTime' as modified_type, cast(k as varchar) as k, 'Integer' as k_type from es qualify row_number() over (partition by entity_type, entity_id order by es.time_index desc, event_id desc) = 1", "es")
def last_value_record(spark, sf):
    last = query.last_value(views.events_series(spark, sf), ["event_id", "k"], tie=("event_id",))
    r = shape.last_value_record(last, {"k": "Integer"})
    return r.select("entity_id", F.col("dateModified.value").alias("modified"), F.col("dateModified.type").alias("modified_type"), F.col("k.value").alias("k"), F.col("k.type").alias("k_type"))


@register("select entity_type, avg(k) as k, '2024-01-01T00:00:00.000+00:00,2024-02-01T00:00:00.000+00:00' as idx from es group by all", "es")
def aggregate_index(spark, sf):
    df = views.events_series(spark, sf).groupBy("entity_type").agg(F.avg("k").alias("k"))
    return df.withColumn("idx", F.array_join(shape.aggregate_index("2024-01-01", "2024-02-01T00:00:00Z"), ","))


# --- ingest


def _ingested(spark, sf):
    return ingest.ingest(views.notifications(spark, sf))


_GOOD = "event_id % 20 not in (1, 2, 3)"


@register("select event_id, 'user:' || user_id as entity_id, event_type as entity_type from events where event_id % 20 not in (1, 2, 3)")
def read_notifications(spark, sf):
    folder = workspace(spark)
    views.notifications(spark, sf).select("body").write.text(folder)
    rows = tables.read_notifications(spark, folder)
    rows = rows.where("entity_id is not null and entity_type is not null")
    return rows.select(F.try_variant_get("entity", "$.eid.value", "bigint").alias("event_id"), "entity_id", "entity_type")


@register("select case event_id % 20 when 2 then 'missing id' when 3 then 'missing type' end as error, count(*) as n from events where event_id % 20 <> 1 group by all")
def validate_entities(spark, sf):
    return ingest.validate_entities(ingest.parse_bodies(views.notifications(spark, sf))).groupBy("error").agg(F.count("*").alias("n"))


@register("select count(*) as n, count(*) filter (event_id % 20 <> 4) as with_value, count(*) as with_note from events where event_id % 20 <> 1")
def null_missing_values(spark, sf):
    rows = ingest.null_missing_values(ingest.parse_bodies(views.notifications(spark, sf)))
    value = F.try_variant_get(F.element_at("attrs", F.lit("Value")), "$.value", "string")
    note = F.try_variant_get(F.element_at("attrs", F.lit("note")), "$.value", "string")
    return rows.agg(F.count("*").alias("n"), F.count(value).alias("with_value"), F.count(note).alias("with_note"))


@register("select t.col0 as ngsi_type, t.col1 as is_text, count(*) * t.col2 as n from events, (values ('DateTime', false, 1), ('Integer', false, 2), ('Number', false, 1), ('Text', true, 1), (null, true, 2)) t where event_id % 20 <> 1 group by t.col0, t.col1, t.col2")
def is_text_type(spark, sf):
    attrs = ingest.parse_bodies(views.notifications(spark, sf)).select(F.explode("attrs").alias("name", "attr"))
    kinds = attrs.select(F.try_variant_get("attr", "$.type", "string").alias("ngsi_type"))
    return kinds.groupBy("ngsi_type", casts.is_text_type(F.col("ngsi_type")).alias("is_text")).agg(F.count("*").alias("n"))


@register("select count(*) filter (event_id % 2 = 0) as n from events")
def drop_empty_entities(spark, sf):
    e = views.read(spark, sf, "events")
    body = F.concat(F.lit('{"data":[{"id":"a","type":"b","x":{"type":"Number","value":'), F.when(F.col("event_id") % 2 == 0, F.lit("0")).otherwise(F.lit('" "')), F.lit("}}]}"))
    return ingest.drop_empty_entities(ingest.parse_bodies(e.select(body.alias("body")))).agg(F.count("*").alias("n"))


@register("select 'TimeInstant,Value,eid,even,kind,note' as attrs, count(*) as n from events where event_id % 20 <> 1")
def drop_untyped_attrs(spark, sf):
    rows = ingest.drop_untyped_attrs(ingest.parse_bodies(views.notifications(spark, sf)))
    return rows.groupBy(F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attrs")).agg(F.count("*").alias("n"))


@register(f"select event_id, {iso_sql('ts')} as time_index from events where event_id % 20 <> 1")
def select_time_index(spark, sf):
    return _iso(_ingested(spark, sf).select("event_id", "time_index"))


@register("select case when event_id % 3 = 0 then 'paths and entities differ in number' end as path_error, case when event_id % 3 <> 0 then '/a' end as path, count(*) as n from events where event_id % 20 <> 1 group by all")
def assign_service_path(spark, sf):
    return _ingested(spark, sf).groupBy("path_error", F.col("fiware_servicepath").alias("path")).agg(F.count("*").alias("n"))


@register("select lower(case when c_custkey % 2 = 0 then c_mktsegment else c_name end) as tenant, count(*) as n from customer group by all")
def resolve_tenant(spark, sf):
    c = views.read(spark, sf, "customer").withColumn("ld", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return c.groupBy(ingest.resolve_tenant(F.col("ld"), F.col("c_name")).alias("tenant")).agg(F.count("*").alias("n"))


_TYPES = "(values ('TimeInstant', 'DateTime', 'timestamp'), ('Value', 'Number', 'double'), ('eid', 'Integer', 'bigint'), ('even', 'Boolean', 'boolean'), ('kind', 'Integer', 'bigint'), ('note', 'Text', 'string'))"


@register(f"select distinct event_type as entity_type, lower(t.col0) as \"column\", t.col0 as attr_name, t.col1 as ngsi_type, t.col2 as column_type from events, {_TYPES} t where event_id % 20 not in (1, 2, 3)")
def infer_schema(spark, sf):
    return ingest.infer_schema(_ingested(spark, sf).where("error is null"))


@register(f"select t.col0 as attr_name, t.col1 as ngsi_type, count(*) as n from events, {_TYPES} t where event_id % 20 <> 1 group by all")
def infer_attr_type(spark, sf):
    rows = _ingested(spark, sf).select(F.explode("attrs").alias("attr_name", "attr"))
    return rows.groupBy("attr_name", casts.infer_attr_type(F.col("attr")).alias("ngsi_type")).agg(F.count("*").alias("n"))


@register(f"select t.col0 as attr_name, t.col2 as column_type, count(*) as n from events, {_TYPES} t where event_id % 20 <> 1 group by all")
def infer_column_type(spark, sf):
    rows = _ingested(spark, sf).select(F.explode("attrs").alias("attr_name", "attr"))
    kind = casts.infer_column_type(casts.infer_attr_type(F.col("attr")), F.try_variant_get("attr", "$.value", "variant"))
    return rows.groupBy("attr_name", kind.alias("column_type")).agg(F.count("*").alias("n"))


@register(f"select entity_type, count(*) as n from (select distinct event_type as entity_type, t.col0 from events, {_TYPES} t where {_GOOD}) group by all")
def evolve_schema(spark, sf):
    found = ingest.infer_schema(_ingested(spark, sf).where("error is null"))
    known = found.where("column in ('value', 'kind')")
    return ingest.evolve_schema(known, found).groupBy("entity_type").agg(F.count("*").alias("n"))


@register(f"select distinct event_type as entity_type, case t.col0 when 'Value' then 'old' else t.col1 end as ngsi_type, t.col0 as attr_name from events, {_TYPES} t where {_GOOD}")
def series_catalog(spark, sf):
    found = ingest.infer_schema(_ingested(spark, sf).where("error is null"))
    known = found.where("column = 'value'").withColumn("ngsi_type", F.lit("old"))
    return ingest.series_catalog(known, found).select("entity_type", "ngsi_type", "attr_name")


@register("select 'Value' as attr_name, count(distinct event_type) as n from events where event_id % 20 not in (1, 2, 3)")
def lookup_ignore_case(spark, sf):
    catalog = ingest.infer_schema(_ingested(spark, sf).where("error is null"))
    return shape.lookup_ignore_case(catalog, "vALUE").groupBy("attr_name").agg(F.count("*").alias("n"))


@register("select entity_type, 'Value' as attr_name, 'Number' as ngsi_type, count(*) as n from es where entity_type in (select event_type from events where event_id % 20 not in (1, 2, 3)) group by all", "es")
def attach_attr_metadata(spark, sf):
    catalog = ingest.infer_schema(_ingested(spark, sf).where("error is null"))
    long = views.events_series(spark, sf).select("entity_type", F.lit("value").alias("column"), "value")
    return shape.attach_attr_metadata(long, catalog).groupBy("entity_type", "attr_name", "ngsi_type").agg(F.count("*").alias("n"))


_WIDE = [("even", "even", "Boolean"), ("eid", "eid", "Integer"), ("kind", "kind", "Integer"), ("note", "note", "Text"), ("value", "Value", "Number")]


@register(f"select 'user:' || user_id as entity_id, event_type as entity_type, event_id % 2 = 0 as even, event_id as eid, regexp_extract(props, '\"k\"\\s*:\\s*(-?\\d+)', 1)::bigint as kind, '' as note, case when event_id % 20 <> 4 then value end as value from events where {_GOOD}")
def pivot_attributes(spark, sf):
    return ingest.pivot_attributes(_ingested(spark, sf).where("error is null"), _WIDE, ("entity_type", "entity_id"))


@register("select event_id, 'user:' || user_id as id from events where event_id % 20 not in (1, 2)")
def keep_raw_entity(spark, sf):
    rows = ingest.keep_raw_entity(_ingested(spark, sf)).where("entity_id is not null")
    return rows.select("event_id", F.get_json_object("raw_entity", "$.id").alias("id"))


@register("select count(*) as n, count(*) as n_ids, 1 as forms from events where event_id % 20 <> 1")
def assign_instance_id(spark, sf):
    rows = ingest.assign_instance_id(_ingested(spark, sf).select("event_id"))
    form = F.regexp_replace("instance_id", "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "")
    return rows.agg(F.count("*").alias("n"), F.approx_count_distinct("instance_id").alias("a"), F.countDistinct("instance_id").alias("n_ids"), F.countDistinct(form).cast("int").alias("forms")).drop("a")


@register("select case event_id % 20 when 2 then 'missing id' else 'missing type' end as error, 'b7' as failed_batch_id, count(*) as n from events where event_id % 20 in (2, 3) group by all")
def dead_letter_sink(spark, sf):
    folder = workspace(spark)
    _, bad = ingest.split_rejected(_ingested(spark, sf), "b7")
    tables.dead_letter_sink(bad, folder)
    return spark.read.parquet(folder).groupBy("error", "failed_batch_id").agg(F.count("*").alias("n"))


@register("select 'batch-' || (event_id % 3) as failed_batch_id, count(*) as n from events where event_id % 20 in (2, 3) group by all")
def count_failed_batches(spark, sf):
    bad = _ingested(spark, sf).where("error is not null").withColumn("failed_batch_id", F.concat(F.lit("batch-"), (F.col("event_id") % 3).cast("string")))
    return query.count_failed_batches(bad)


@register("""with recursive r as (select 's' || l_suppkey as entity_id, l_orderkey, l_linenumber, l_quantity as quantity,
    row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_quantity) as i from lineitem),
  b(entity_id, i, total, batch) as (select entity_id, i, quantity, 0::bigint from r where i = 1 union all
    select r.entity_id, r.i, case when b.total + r.quantity > 100 then r.quantity else b.total + r.quantity end, b.batch + (b.total + r.quantity > 100)::bigint
    from b join r on r.entity_id = b.entity_id and r.i = b.i + 1)
  select r.entity_id, l_orderkey, l_linenumber, quantity, batch from r join b on r.entity_id = b.entity_id and r.i = b.i""")
def batch_by_cost(spark, sf):
    df = views.shipments_series(spark, sf).select("entity_id", "l_orderkey", "l_linenumber", "quantity")
    return ingest.batch_by_cost(df, ["entity_id"], ["l_orderkey", "l_linenumber", "quantity"], "quantity", 100.0)


@register("select count(*) as n, sum(length('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}'))::bigint as bytes from customer")
def compute_row_size(spark, sf):
    return views.read(spark, sf, "customer").agg(F.count("*").alias("n"), F.sum(ingest.compute_row_size("c_custkey", "c_name")).cast("bigint").alias("bytes"))


@register("select event_id, regexp_extract(props, '\"k\"\\s*:\\s*(-?\\d+)', 1)::bigint as k from events")
def json_path_get(spark, sf):
    e = views.read(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", casts.json_path_get(F.col("v"), "k", "bigint").alias("k"))


# --- casts: the same value as number, text, boolean, list and object

_FORM = "event_id % 6"


def _values(spark, sf):
    e = views.read(spark, sf, "events")
    i, k = F.col("event_id") % 6, F.col("event_id").cast("string")
    j = (
        F.when(i == 0, k).when(i == 1, F.concat(F.lit('"'), k, F.lit('.75"'))).when(i == 2, F.when(F.col("event_id") % 4 == 0, F.lit("true")).otherwise(F.lit("false")))
        .when(i == 3, F.concat(F.lit('["a",'), k, F.lit("]"))).when(i == 4, F.concat(F.lit('{"a":'), k, F.lit("}"))).otherwise(F.concat(F.lit('"2024-03-0'), (F.col("event_id") % 9 + 1).cast("string"), F.lit('T10:20:30Z"')))
    )
    return e.select("event_id", F.try_parse_json(j).alias("v"))


def _cast(name, sql):
    @register(f"select event_id, {sql} as x from events", name=name)
    def run(spark, sf):
        x = getattr(casts, name)(F.col("v"))
        if name == "cast_structured":
            x = F.to_json(x)
        if name == "cast_integer":
            x = x.cast("string")
        if name == "cast_array":
            x = F.array_join(x, "|")
        if name in ("cast_datetime", "cast_ld_datetime"):
            x = times.iso_timestamp(x)
        return _values(spark, sf).select("event_id", x.alias("x"))


_cast("cast_number", f"case {_FORM} when 0 then event_id::double when 1 then event_id + 0.75::double end")
_cast("cast_integer", f"case {_FORM} when 0 then event_id::varchar when 1 then event_id::varchar end")
_cast("cast_boolean", f"case when event_id = 0 then false when {_FORM} = 2 then event_id % 4 = 0 when {_FORM} = 0 and event_id in (0, 1) then event_id = 1 end")
_cast("cast_datetime", f"case {_FORM} when 5 then '2024-03-0' || (event_id % 9 + 1) || 'T10:20:30.000+00:00' else 'NULL' end")
_cast("cast_text", f"case {_FORM} when 0 then event_id::varchar when 1 then event_id || '.75' when 2 then case when event_id % 4 = 0 then 'True' else 'False' end when 3 then '[''a'', ' || event_id || ']' when 4 then '{{''a'': ' || event_id || '}}' else '2024-03-0' || (event_id % 9 + 1) || 'T10:20:30Z' end")
_cast("cast_array", f"case {_FORM} when 3 then 'a|' || event_id end")
_cast("cast_structured", f"case {_FORM} when 4 then '{{\"a\":' || event_id || '}}' end")


@register("select event_id, case when event_id % 2 = 0 then '2024-05-06T07:08:09.000+00:00' else 'NULL' end as x from events")
def cast_ld_datetime(spark, sf):
    e = views.read(spark, sf, "events")
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("DateTime")).otherwise(F.lit("Other"))
    v = F.try_parse_json(F.concat(F.lit('{"@type":"'), kind, F.lit('","@value":"2024-05-06T07:08:09Z"}')))
    return e.select("event_id", v.alias("v")).select("event_id", times.iso_timestamp(casts.cast_ld_datetime(F.col("v"))).alias("x"))


@register("select event_id, case when event_id % 2 = 0 then 'urn:' || user_id else 'obj:' || user_id end as x from events")
def cast_relationship(spark, sf):
    e = views.read(spark, sf, "events")
    field = F.when(F.col("event_id") % 2 == 0, F.lit('{"value":"urn:')).otherwise(F.lit('{"object":"obj:'))
    v = F.try_parse_json(F.concat(field, F.col("user_id").cast("string"), F.lit('"}')))
    return e.select("event_id", v.alias("v")).select("event_id", casts.cast_relationship(F.col("v")).alias("x"))


@register("select event_id, value as number, trunc(value)::bigint as n, regexp_extract(props, '\"k\"\\s*:\\s*(-?\\d+)', 1) as text_form from events")
def cast_attribute(spark, sf):
    e = views.read(spark, sf, "events")
    attr = lambda c: F.try_parse_json(F.concat(F.lit('{"type":"Number","value":'), c.cast("string"), F.lit("}")))
    rows = e.select("event_id", attr(F.col("value")).alias("a"), attr(F.get_json_object("props", "$.k")).alias("b"))
    return rows.select("event_id", casts.cast_attribute(F.col("a"), "Number").alias("number"), casts.cast_attribute(F.col("a"), "Integer").alias("n"), casts.cast_attribute(F.col("b"), "Text").alias("text_form"))


# --- times and names


@register(f"select o_orderkey, {iso_sql('o_orderdate')} as iso from orders")
def iso_timestamp(spark, sf):
    return views.read(spark, sf, "orders").select("o_orderkey", times.iso_timestamp(F.col("o_orderdate").cast("timestamp")).alias("iso"))


@register(f"select o_orderkey, {iso_sql('o_orderdate')} as iso, 'NULL' as bad from orders")
def parse_date(spark, sf):
    o = views.read(spark, sf, "orders").withColumn("t", F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"')))
    return o.select("o_orderkey", times.iso_timestamp(times.parse_date(F.col("t"))).alias("iso"), times.iso_timestamp(times.parse_date(F.concat(F.lit("now "), "t"))).alias("bad"))


@register(f"select o_orderkey, {iso_sql("date_trunc('day', o_orderdate)::timestamp")} as iso from orders")
def parse_time_loose(spark, sf):
    o = views.read(spark, sf, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy/MM/dd"))
    return o.select("o_orderkey", times.iso_timestamp(times.parse_time_loose(F.col("t"))).alias("iso"))


@register(f"select o_custkey, {iso_sql("date_trunc('day', max(o_orderdate))::timestamp")} as iso from orders group by all")
def latest_time(spark, sf):
    o = views.read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))
    return o.select("o_custkey", times.iso_timestamp(times.latest_time(F.array_append("t", F.lit("bad")))).alias("iso"))


@register(f"select o_orderkey, {iso_sql("date_trunc('month', o_orderdate)::timestamp")} as iso from orders")
def period_start(spark, sf):
    return views.read(spark, sf, "orders").select("o_orderkey", times.iso_timestamp(times.period_start("month", F.col("o_orderdate").cast("timestamp"))).alias("iso"))


@register("select distinct 'mt' || lower(c_mktsegment) || '.et' || lower(n_name) as name from customer join nation on c_nationkey = n_nationkey")
def table_name(spark, sf):
    c, n = views.read(spark, sf, "customer"), views.read(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(times.table_name(F.col("c_mktsegment"), F.col("n_name")).alias("name")).distinct()


# --- places

_BOX = places.parse_geo_query("coveredBy", "box", "-30,-60;40,80")


@register("select entity_id from gs where 6371008.8 * 2 * asin(least(1, sqrt(pow(sin(radians(y + case when shape = 2 then 0.4 else 0 end - 10) / 2), 2) + cos(radians(y + case when shape = 2 then 0.4 else 0 end)) * cos(radians(10)) * pow(sin(radians(x + case when shape = 0 then 0 when shape = 1 then 0.5 else 0.4 end - 20) / 2), 2)))) between 500000 and 5000000", "gs")
def geo_near(spark, sf):
    df = views.geo_series(spark, sf).withColumn("centroid", geo.centroid(geo.geojson_points(F.col("location"))))
    return places.geo_near(df, 20.0, 10.0, 500_000, 5_000_000).select("entity_id")


@register("select entity_id from gs where x >= -60 and x1 <= 80 and y >= -30 and y1 <= 40", "gs")
def geo_covered_by(spark, sf):
    return places.geo_covered_by(views.geo_series(spark, sf), _BOX).select("entity_id")


@register("select entity_id from gs where x1 >= -60 and x <= 80 and y1 >= -30 and y <= 40", "gs")
def geo_intersects(spark, sf):
    return places.geo_intersects(views.geo_series(spark, sf), _BOX).select("entity_id")


@register("select entity_id from gs where not (x1 >= -60 and x <= 80 and y1 >= -30 and y <= 40)", "gs")
def geo_disjoint(spark, sf):
    return places.geo_disjoint(views.geo_series(spark, sf), _BOX).select("entity_id")


@register("select entity_id from gs where shape = 2 and abs(x - (2 * 37 / 10.0 - 175)) < 1e-9 and abs(y - (2 * 53 / 10.0 - 80)) < 1e-9", "gs")
def geo_equals(spark, sf):
    lon, lat = round(2 * 37 / 10 - 175, 6), round(2 * 53 / 10 - 80, 6)
    ring = ";".join(f"{y},{x}" for x, y in [(lon, lat), (lon, lat + 1), (lon + 1, lat + 1), (lon + 1, lat), (lon, lat)])
    return places.geo_equals(views.geo_series(spark, sf), places.parse_geo_query("equals", "polygon", ring)).select("entity_id")


@register("select a.entity_id, b.entity_id as other from gs a join gs b on a.shape = b.shape and a.x = b.x and a.y = b.y", "gs")
def geo_equal_pairs(spark, sf):
    """All places against the same places with squares that start elsewhere, turn the other way and have a vertex more."""
    df = views.geo_series(spark, sf)
    x, y, x1, y1 = (F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    ring = F.array(*[F.array(*p) for p in ((x1, y1), (x1, y), (x + 0.5, y), (x, y), (x, y1), (x1, y1))])
    square = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    others = df.withColumn("location", F.when(F.col("c_custkey") % 3 == 2, square).otherwise(F.col("location")))
    return places.geo_equal_pairs(df, others).select("entity_id", "other")


_AREAS = "areas as (select s_suppkey, (s_suppkey * 91 % 3300) / 10.0::double - 165 as cx, (s_suppkey * 67 % 1500) / 10.0::double - 75 as cy, 3.05 + s_suppkey % 5 * 2 as r from supplier)"


def _areas(spark, sf):
    """A diamond around each supplier."""
    i = F.col("s_suppkey")
    cx, cy, r = (i * 91 % 3300) / 10.0 - 165, (i * 67 % 1500) / 10.0 - 75, F.lit(3.05) + i % 5 * 2
    ring = F.array(*[F.array(*p) for p in ((cx - r, cy), (cx, cy - r), (cx + r, cy), (cx, cy + r), (cx - r, cy))])
    return views.read(spark, sf, "supplier").select(i, cx.alias("lon"), cy.alias("lat"), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("location"))


# a box lies in a diamond if its farthest corner does, and meets it if its nearest point does
@register(f"with {SQL['gs']}, {_AREAS} select entity_id, s_suppkey from gs join areas on greatest(abs(x - cx), abs(x1 - cx)) + greatest(abs(y - cy), abs(y1 - cy)) <= r")
def geo_join_covered_by(spark, sf):
    return places.geo_join(views.geo_series(spark, sf), _areas(spark, sf), "coveredBy", shape_key="s_suppkey")


@register(f"with {SQL['gs']}, {_AREAS} select entity_id, s_suppkey from gs join areas on greatest(x - cx, cx - x1, 0) + greatest(y - cy, cy - y1, 0) <= r")
def geo_join_intersects(spark, sf):
    return places.geo_join(views.geo_series(spark, sf), _areas(spark, sf), "intersects", shape_key="s_suppkey")


@register(f"""with {SQL['gs']}, {_AREAS}, means as (select entity_id, x + case shape when 0 then 0 when 1 then 0.5 else 0.4 end as lon, y + case when shape = 2 then 0.4 else 0 end as lat from gs)
  select entity_id, s_suppkey, round(m, 1) as metres from (select entity_id, s_suppkey, 6371008.8 * 2 * asin(least(1, sqrt(pow(sin(radians(lat - cy) / 2), 2)
    + cos(radians(lat)) * cos(radians(cy)) * pow(sin(radians(lon - cx) / 2), 2)))) as m from means, areas) where m <= 250000""")  # fmt: skip
def geo_near_join(spark, sf):
    df = views.geo_series(spark, sf).withColumn("centroid", geo.centroid(geo.geojson_points(F.col("location"))))
    return places.geo_near_join(df, _areas(spark, sf), 250_000, point_key="s_suppkey").withColumn("metres", _r("metres", 1))


@register("select entity_id from gs where x >= -60 and x <= 80 and y >= -30 and y <= 40 and shape = 0", "gs")
def parse_geo_query(spark, sf):
    q = places.parse_geo_query("intersects", "polygon", "-30,-60;-30,80;40,80;40,-60;-30,-60")
    return places.geo_intersects(views.geo_series(spark, sf).where("location like '%Point%'"), q).select("entity_id")


@register("select entity_id, round(x + case when shape = 0 then 0 when shape = 1 then 0.5 else 0.4 end, 6) as lon, round(y + case when shape = 2 then 0.4 else 0 end, 6) as lat from gs", "gs")
def centroid(spark, sf):
    c = views.geo_series(spark, sf).select("entity_id", geo.centroid(geo.geojson_points(F.col("location"))).alias("c"))
    return c.select("entity_id", _r("c.lon", 6).alias("lon"), _r("c.lat", 6).alias("lat"))


def _numbers(text):
    """All numbers of a text with four decimals, apart from an SRID."""
    found = F.regexp_extract_all(F.regexp_replace(text, "^SRID=[0-9]+;", ""), F.lit(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0))
    return F.array_join(F.transform(found, lambda x: F.round(x.cast("double"), 4).cast("decimal(10,4)").cast("string")), " ")


def _numbers_sql(*names: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"cast(round({n}, 4) as decimal(10,4))" for n in names) + ")"


_ALL = f"case shape when 0 then {_numbers_sql('x', 'y')} when 1 then {_numbers_sql('x', 'y', 'x1', 'y')} else {_numbers_sql('x', 'y', 'x1', 'y', 'x1', 'y1', 'x', 'y1', 'x', 'y')} end as numbers"


def _slf(spark, sf):
    g = views.geo_series(spark, sf)
    kind = F.when(F.col("location").contains("Point"), "geo:point").when(F.col("location").contains("Line"), "geo:line").otherwise("geo:polygon")
    return g.select("entity_id", "location", kind.alias("kind"), geo.geojson_to_slf(F.col("location"), kind).alias("texts"), "min_lon", "min_lat", "max_lon", "max_lat")


@register("select entity_id, case shape when 0 then 1 when 1 then 2 else 5 end as n, round(x, 6) as lon, round(y, 6) as lat from gs", "gs")
def slf_parse(spark, sf):
    p = _slf(spark, sf).select("entity_id", geo.slf_parse(F.col("kind"), F.col("texts")).alias("p"))
    return p.select("entity_id", F.size("p").alias("n"), _r(F.col("p")[0]["lon"], 6).alias("lon"), _r(F.col("p")[0]["lat"], 6).alias("lat"))


@register(f"select entity_id, case shape when 0 then 'Point' when 1 then 'LineString' else 'Polygon' end as kind, {_ALL} from gs", "gs")
def slf_to_geojson(spark, sf):
    g = _slf(spark, sf).select("entity_id", geo.slf_to_geojson(F.col("kind"), geo.slf_parse(F.col("kind"), F.col("texts"))).alias("g"))
    return g.select("entity_id", F.get_json_object("g", "$.type").alias("kind"), _numbers(F.get_json_object("g", "$.coordinates")).alias("numbers"))


@register("select entity_id, case shape when 0 then 1 when 1 then 2 else 5 end as n from gs", "gs")
def geojson_to_slf(spark, sf):
    return _slf(spark, sf).select("entity_id", F.size("texts").alias("n"))


@register("select entity_id, 5 as n, round(x1, 6) as lon, round(y1, 6) as lat from gs", "gs")
def box_to_polygon(spark, sf):
    corner = lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    b = _slf(spark, sf).select("entity_id", geo.box_to_polygon(F.array(corner("min_lon", "min_lat"), corner("max_lon", "max_lat"))).alias("p"))
    return b.select("entity_id", F.size("p").alias("n"), _r(F.col("p")[2]["lon"], 6).alias("lon"), _r(F.col("p")[2]["lat"], 6).alias("lat"))


@register("select entity_id, case shape when 0 then 'SRID=4326;POINT (' when 1 then 'SRID=4326;LINESTRING (' else 'SRID=4326;POLYGON ((' end as head, " + _ALL + " from gs", "gs")
def slf_to_wkt(spark, sf):
    w = geo.slf_to_wkt(F.col("kind"), geo.slf_parse(F.col("kind"), F.col("texts")), 4326)
    return _slf(spark, sf).select("entity_id", F.regexp_extract(w, r"^[^(]*\(+", 0).alias("head"), _numbers(w).alias("numbers"))


@register("select entity_id, case shape when 0 then 'POINT (' when 1 then 'LINESTRING (' else 'POLYGON ((' end as head, " + _ALL + " from gs", "gs")
def geojson_to_wkt(spark, sf):
    w = views.geo_series(spark, sf).select("entity_id", geo.geojson_to_wkt(F.col("location")).alias("w"))
    return w.select("entity_id", F.regexp_extract("w", r"^[^(]*\(+", 0).alias("head"), _numbers(F.col("w")).alias("numbers"))


def _rounded(spark, sf, there):
    back = views.geo_series(spark, sf).select("entity_id", there.alias("g"))
    return back.select("entity_id", F.get_json_object("g", "$.type").alias("kind"), _numbers(F.get_json_object("g", "$.coordinates")).alias("numbers"))


_BACK = f"select entity_id, case shape when 0 then 'Point' when 1 then 'LineString' else 'Polygon' end as kind, {_ALL} from gs"


@register(_BACK, "gs")
def wkt_to_geojson(spark, sf):
    return _rounded(spark, sf, geo.wkt_to_geojson(geo.geojson_to_wkt(F.col("location"), srid=4326)))


@register("select entity_id, case shape when 0 then '0000000001' when 1 then '000000000200000002' else '00000000030000000100000005' end as head, case shape when 0 then 1 when 1 then 2 else 5 end as points from gs", "gs")
def geojson_to_wkb(spark, sf):
    """Order, kind and counts as bytes, and how many points of 16 bytes follow; ``wkb_to_geojson`` shows the numbers."""
    w = views.geo_series(spark, sf).select("entity_id", F.hex(geo.geojson_to_wkb(F.col("location"))).alias("w"), (F.col("c_custkey") % 3).alias("shape"))
    head = F.when(F.col("shape") == 0, 10).when(F.col("shape") == 1, 18).otherwise(26)
    return w.select("entity_id", F.substring("w", F.lit(1), head).alias("head"), ((F.length("w") - head) / 32).cast("int").alias("points"))


@register(_BACK, "gs")
def wkb_to_geojson(spark, sf):
    return _rounded(spark, sf, geo.wkb_to_geojson(F.hex(geo.geojson_to_wkb(F.col("location"), False))))


@register("select entity_id, round(y, 4) as lat, round(x, 4) as lon from gs", "gs")
def geopoint_to_text(spark, sf):
    t = views.geo_series(spark, sf).select("entity_id", F.split(geo.geopoint_to_text(F.struct(F.col("min_lon").alias("lon"), F.col("min_lat").alias("lat"))), ", ").alias("t"))
    return t.select("entity_id", _r(F.col("t")[0].cast("double")).alias("lat"), _r(F.col("t")[1].cast("double")).alias("lon"))


@register(f"select entity_id, case when shape = 0 then {_numbers_sql('y', 'x')} end as point, case when shape = 1 then {_numbers_sql('y', 'x', 'y', 'x1')} end as line from gs", "gs")
def decode_value(spark, sf):
    """Values as "lat, lon" texts; NULL for a shape of another type."""
    text = lambda kind: _numbers(F.array_join(geo.decode_value(F.col("location"), kind), ";"))
    return views.geo_series(spark, sf).select("entity_id", text("geo:point").alias("point"), text("geo:line").alias("line"))


@register("select entity_id, round(x, 6) as lon, round(y, 6) as lat, true as has_location from gs where shape < 2 union all select entity_id, null, null, false from gs where shape = 2", "gs")
def normalize_location(spark, sf):
    g = _slf(spark, sf).withColumn("kind", F.when(F.col("kind") == "geo:polygon", "geo:line2").otherwise(F.col("kind")))
    n = g.select("entity_id", geo.normalize_location(F.to_json("texts"), F.col("kind")).alias("n"))
    first = geo.geojson_points(F.col("n.location"))
    return n.select("entity_id", _r(first[0]["lon"], 6).alias("lon"), _r(first[0]["lat"], 6).alias("lat"), F.col("n.location").isNotNull().alias("has_location"))


def _addresses(spark, sf):
    c, n = views.read(spark, sf, "customer"), views.read(spark, sf, "nation")
    i = F.col("c_custkey")
    c = c.join(n, c.c_nationkey == n.n_nationkey)
    address = F.struct(
        F.when(i % 2 == 0, F.col("c_name")).alias("street"), F.when(i % 4 == 0, i.cast("string")).alias("number"), F.when(i % 3 > 0, F.col("c_mktsegment")).alias("locality"),
        F.lit(None).cast("string").alias("region"), F.col("n_name").alias("country"),
    )
    return c.select("c_custkey", "n_name", address.alias("address"), F.when(i % 5 == 0, F.lit("known")).alias("location"))


_KIND = "case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then null when c_custkey % 4 = 0 then 'point' when c_custkey % 2 = 0 then 'street' when c_custkey % 3 > 0 then 'region' end"
_KEY = f"case when {_KIND} is not null then concat_ws(', ', case when c_custkey % 2 = 0 then lower(c_name) end, case when c_custkey % 4 = 0 then c_custkey::varchar end, case when c_custkey % 3 > 0 then lower(c_mktsegment) end, lower(n_name)) end"


@register(f"select c_custkey, {_KEY} as key, {_KIND} as kind from customer join nation on c_nationkey = n_nationkey")
def address_key(spark, sf):
    k = _addresses(spark, sf).select("c_custkey", geo.address_key(F.col("address")).alias("a"))
    return k.select("c_custkey", "a.key", "a.kind")


_LOCATED = f"select c_custkey, case when c_custkey % 5 = 0 then 'known' when {_KIND} = 'region' then 'at ' || lower(c_mktsegment) || ', ' || lower(n_name) end as location from customer join nation on c_nationkey = n_nationkey"


@register(_LOCATED)
def add_location(spark, sf):
    a = _addresses(spark, sf)
    regions = a.where("c_custkey % 3 > 0").select(F.concat(F.lower("address.locality"), F.lit(", "), F.lower("n_name")).alias("key"))
    return geo.add_location(a, regions.select("key", F.concat(F.lit("at "), "key").alias("location"))).select("c_custkey", "location")


@register(_LOCATED)
def location_enrichment(spark, sf):
    return add_location(spark, sf)


# --- stores and streams


def _stored(spark, sf):
    folder = workspace(spark)
    tables.write_series(views.events_series(spark, sf).select("tenant", "entity_type", "entity_id", "time_index", "value"), folder)
    return folder


@register("select entity_type, cast(time_index as date)::varchar as date, count(*) as n from es group by all", "es")
def write_series(spark, sf):
    return spark.read.parquet(_stored(spark, sf)).groupBy("entity_type", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@register("select entity_id, round(sum(value), 3) as total from es where entity_type = 'click' group by all", "es")
def read_series(spark, sf):
    return tables.read_series(spark, _stored(spark, sf), "ACME", "click").groupBy("entity_id").agg(_r(F.sum("value"), 3).alias("total"))


@register("select 'orders' as table_name, o_orderkey, o_orderpriority, o_totalprice from orders")
def load_csv_series(spark, sf):
    folder = workspace(spark)
    o = views.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    o.write.option("quote", "'").option("quoteAll", True).csv(f"{folder}/orders", header=True)
    df = tables.load_csv_series(spark, f"{folder}/orders", "o_orderkey long, o_orderpriority string, o_totalprice double")
    return df.withColumn("table_name", F.regexp_replace("table_name", "^part-.*$", "orders"))


@register("select o_orderkey, cast(o_totalprice as bigint) as total, null::bigint as status from orders where o_totalprice > 100000".replace("cast(o_totalprice as bigint)", "trunc(o_totalprice)::bigint"))
def migrate_store(spark, sf):
    o = views.read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    folder = workspace(spark)
    tables.migrate_store(o, {"total": "bigint", "status": "bigint"}, folder, "total > 100000")
    return spark.read.parquet(folder)


@register("select event_type as label, user_id % 4 as pid, count(*) as n, round(sum(value), 3) as total from events group by all")
def read_telemetry(spark, sf):
    folder = workspace(spark)
    t = views.telemetry(spark, sf)
    rows = t.select((F.unix_micros("time") * 1000).alias("Timepoint"), F.col("measurement").alias("Measurement"), F.col("label").alias("Label"), F.col("pid").alias("PID"))
    rows.write.csv(folder, header=True)
    return tables.read_telemetry(spark, folder, "part-").groupBy("label", F.col("pid").cast("long").alias("pid")).agg(F.count("*").alias("n"), _r(F.sum("measurement"), 3).alias("total"))


def _arrivals(spark, sf):
    folder = workspace(spark)
    views.notifications(spark, sf).select("body").repartition(3).write.text(folder)
    return folder


@register(f"select event_type as entity_type, count(*) as n from events where {_GOOD} group by all")
def stream_notifications(spark, sf):
    base = workspace(spark)
    rows = jobs.stream_notifications(spark, _arrivals(spark, sf), 1).select("entity_id", "entity_type")
    q = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").where("entity_id is not null and entity_type is not null").groupBy("entity_type").agg(F.count("*").alias("n"))


def _streamed(spark, sf):
    base = workspace(spark)
    jobs.stream_ingest(spark, _arrivals(spark, sf), f"{base}/store", f"{base}/log").awaitTermination()
    return f"{base}/store"


def _all_types(spark, path, columns):
    """The tables of all types that a store has, side by side."""
    return query.union_types([store.read_table(spark, path, t).select(*columns) for t in store.entity_types(spark, path)])


@register(f"select 'user:' || user_id as entity_id, event_type as entity_type, {iso_sql('ts')} as time_index, count(*) as n from events where {_GOOD} group by all")
def stream_ingest(spark, sf):
    return _iso(_all_types(spark, _streamed(spark, sf), ["entity_id", "entity_type", "time_index"])).groupBy("entity_id", "entity_type", "time_index").agg(F.count("*").alias("n"))


@register(f"select 'user:' || user_id as entity_id, event_type as entity_type, {iso_sql('ts')} as time_index, event_id % 2 = 0 as even, event_id as eid, regexp_extract(props, '\"k\"\\s*:\\s*(-?\\d+)', 1)::bigint as kind, '' as note, case when event_id % 20 <> 4 then value end as value from events where {_GOOD}")
def stream_ingest_attributes(spark, sf):
    """The attributes of all updates that a stream stored, as typed columns."""
    return _iso(_all_types(spark, _streamed(spark, sf), ["entity_id", "entity_type", "time_index", "even", "eid", "kind", "note", "value"]))


def _spoilt(spark, sf):
    """Bodies of which some are cut off, have a key twice, no data, or too many paths, by the event's id."""
    i = F.col("event_id")
    bad = F.when(i % 20 == 5, F.expr("left(body, length(body) - 3)")).when(i % 20 == 6, F.regexp_replace("body", '"note":', '"kind":'))
    return views.notifications(spark, sf).withColumn("body", F.coalesce(bad, "body"))


@register("""select case when event_id % 20 = 1 then 'no data' when event_id % 20 = 5 then 'not JSON' when event_id % 20 = 6 then 'a key twice' else 'paths and entities differ in number' end as reason, count(*) as n
from events where event_id % 20 in (1, 5, 6) or event_id % 3 = 0 group by all
union all select case event_id % 20 when 2 then 'missing id' else 'missing type' end, count(*) from events where event_id % 20 in (2, 3) and event_id % 3 <> 0 group by all
union all select 'stored', count(*) from events where event_id % 20 not in (1, 2, 3, 5, 6) and event_id % 3 <> 0""")
def ingest_refusals(spark, sf):
    """Where each body of a batch went: every one is stored, a dead letter or refused, with the reason."""
    path = f"{workspace(spark)}/store"
    store.ingest_bodies(spark, path, _spoilt(spark, sf))
    refused = store.read_refused(spark, path).groupBy(F.col("refusal").alias("reason")).agg(F.count("*").alias("n"))
    dead = store.read_dead_letters(spark, path).groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))
    return refused.unionByName(dead).unionByName(_all_types(spark, path, ["entity_id"]).agg(F.lit("stored").alias("reason"), F.count("*").alias("n")))


@register(f"""select distinct event_type as entity_type, lower(t.col0) as "column", t.col0 as attr_name, t.col1 as ngsi_type,
case when (select count(*) from events b where b.event_type = a.event_type and b.event_id % 2 = 0 and b.event_id % 20 not in (1, 2, 3)) > 0 then 1 else 2 end as since from events a, {_TYPES} t where {_GOOD}""")
def stored_catalog(spark, sf):
    """The catalog of a store after two commits: bodies of even events, then the others."""
    path = f"{workspace(spark)}/store"
    for rest in (0, 1):
        store.ingest_bodies(spark, path, views.notifications(spark, sf).where(F.col("event_id") % 2 == rest).select("body"))
    return store.read_catalog(spark, path).select("entity_type", "column", "attr_name", "ngsi_type", F.col("since").cast("int").alias("since"))


_KEPT = "not (entity_id like 'user:1%' and time_index >= timestamp '2024-01-08') and not (k % 3 = 0 and value > 50)"


@register(f"select entity_id, count(*) as n, round(sum(value), 2) as total from es where {_KEPT} group by all union all select 'all before', count(*), round(sum(value), 2) from es", "es")
def delete_from_store(spark, sf):
    """Two deletes by position from a table without tenants whose type has a colon and a blank, and the version before them."""
    path, kind = f"{workspace(spark)}/store", "ns:Event 1"
    store.append_rows(spark, path, kind, views.events_series(spark, sf).select("entity_id", "fiware_servicepath", "time_index", "value", "k"))
    before = store.snapshot(spark, path)["version"]
    store.delete_rows(spark, path, kind, F.col("entity_id").like("user:1%") & (F.col("date") >= "2024-01-08"))
    store.delete_rows(spark, path, kind, (F.col("k") % 3 == 0) & (F.col("value") > 50))
    found = store.read_table(spark, path, kind).groupBy("entity_id").agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))
    old = store.read_table(spark, path, kind, version=before).agg(F.lit("all before").alias("entity_id"), F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))
    return found.unionByName(old)


@register("select case event_id % 20 when 2 then 'missing id' else 'missing type' end as error, count(*) as n from events where event_id % 20 in (2, 3) group by all")
def stream_dead_letter(spark, sf):
    return store.read_dead_letters(spark, _streamed(spark, sf)).groupBy("error").agg(F.count("*").alias("n"))


def _stream(spark, sf):
    folder = workspace(spark)
    rows = views.events_series(spark, sf).select("entity_type", "entity_id", "time_index", "event_id", "k")
    rows.repartitionByRange(4, "time_index").write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def _run_keyed(spark, start):
    """Run a stream that needs keyed state to its end; the session's state store is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    jobs.needs_keyed_state(spark)
    try:
        start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def _periods(spark, sf, period):
    base = workspace(spark)

    def keep(batch, batch_id):
        batch.withColumn("v", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    found = jobs.stream_period_aggregate(_stream(spark, sf), "k", period, "1000 days" if period == "day" else "1 day")
    _run_keyed(spark, lambda: found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start())
    last = spark.read.parquet(f"{base}/out").groupBy("entity_type", "entity_id", "time_index").agg(F.max(F.struct("v", "n", "total", "least", "most")).alias("r"))
    return _iso(last.select("entity_type", "entity_id", "time_index", "r.n", "r.total", "r.least", "r.most"))


_PERIODS = "select entity_type, entity_id, {} as time_index, count(k) as n, sum(k)::bigint as total, min(k) as least, max(k) as most from es group by entity_type, entity_id, date_trunc('{}', es.time_index)"


@register(_PERIODS.format(iso_sql("date_trunc('day', es.time_index)::timestamp"), "day"), "es")
def stream_period_aggregate(spark, sf):
    return _periods(spark, sf, "day")


@register(_PERIODS.format(iso_sql("date_trunc('month', es.time_index)::timestamp"), "month"), "es")
def stream_period_aggregate_month(spark, sf):
    """Calendar months that timers close once the watermark has passed their ends."""
    return _periods(spark, sf, "month")


@register(f"select entity_type, entity_id, {T}, event_id, k from es qualify row_number() over (partition by entity_type, entity_id order by es.time_index desc, event_id desc) = 1", "es")
def stream_last_value(spark, sf):
    base = workspace(spark)
    _run_keyed(spark, lambda: jobs.stream_last_value(_stream(spark, sf), ["event_id", "k"], f"{base}/last", f"{base}/log"))
    return _iso(jobs.read_last_value(spark, f"{base}/last"))


# --- telemetry


@register(f"select {iso_sql('ts')} as time, value as measurement, event_type as label, (user_id % 4)::int as pid from events where event_type = 'click' and user_id % 4 = 1")
def telemetry_series(spark, sf):
    return _iso(tele.telemetry_series(views.telemetry(spark, sf), "click", 1), "time")


@register("select event_type as label, (user_id % 4)::int as pid, count(*) as n, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(min(value), 4) as min, round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.75), 4) as p75, round(quantile_cont(value, 0.9), 4) as p90, round(quantile_cont(value, 0.95), 4) as p95, round(max(value), 4) as max from events group by all")
def series_summary(spark, sf):
    s = tele.series_summary(views.telemetry(spark, sf), ("label", "pid"))
    return s.select("label", "pid", "n", *[_r(c).alias(c) for c in s.columns[3:]])


@register("with c as (select event_type as label, date_trunc('second', ts) as s, count(*) as n from events group by all), g as (select label, unnest(range(min(s)::timestamp, max(s)::timestamp + interval 1 second, interval 1 second)) as s from c group by label) select g.label, strftime(g.s, '%Y-%m-%d %H') as hour, count(*) as seconds, sum(coalesce(n, 0))::bigint as n, max(coalesce(n, 0)) as most from g left join c on g.label = c.label and g.s = c.s group by all")
def measurements_per_second(spark, sf):
    """Every second of every label, as sums of an hour: the seconds of a month are many more rows than the events."""
    found = tele.measurements_per_second(views.telemetry(spark, sf))
    return found.groupBy("label", F.date_format("second", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("seconds"), F.sum("n").cast("bigint").alias("n"), F.max("n").alias("most"))


_PAIR = "with s as (select date_trunc('second', ts) as s, coalesce(sum(value) filter (event_type = 'click'), 0) as a, coalesce(sum(value) filter (event_type = 'view'), 0) as b from events where event_type in ('click', 'view') group by 1) select " + iso_sql("s::timestamp") + " as second, "


@register(_PAIR + "round(a - b, 4) as difference from s")
def sum_by_second_difference(spark, sf):
    return _iso(tele.sum_by_second_difference(views.telemetry(spark, sf), "click", "view"), "second").withColumn("difference", _r("difference"))


@register(_PAIR + "case when b <> 0 then round(a / b, 4) end as ratio from s")
def sum_by_second_ratio(spark, sf):
    return _iso(tele.sum_by_second_ratio(views.telemetry(spark, sf), "click", "view"), "second").withColumn("ratio", _r("ratio"))


@register("select event_id, round(value - lag(value) over (partition by event_type order by ts, event_id), 4) as delta from events")
def insert_delta(spark, sf):
    return tele.insert_delta(views.telemetry(spark, sf), tie=("event_id",)).select("event_id", _r("delta").alias("delta"))
