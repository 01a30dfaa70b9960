"""The given tables as entity series, notifications and telemetry; the SQL of the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities, event types as types; ``event_id`` orders updates of one time."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("acme").alias("tenant"), F.col("event_type").alias("entity_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"),
        F.concat(F.lit("/g"), (F.col("user_id") % 5).cast("string"), F.lit("/u"), (F.col("user_id") % 25).cast("string")).alias("fiware_servicepath"),
        F.col("ts").cast("timestamp").alias("time_index"), F.concat(F.lit("urn:ngsi-ld:"), F.col("event_id").cast("string")).alias("instance_id"),
        "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id",
    )


def shipments_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities and their shipments as updates."""
    i = read(spark, sf_dir, "lineitem")
    return i.select(
        F.lit("acme").alias("tenant"), F.lit("Supplier").alias("entity_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity_id"), F.lit("").alias("fiware_servicepath"),
        F.col("l_shipdate").cast("timestamp").alias("time_index"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"),
        "l_orderkey", "l_linenumber",
    )


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities, their orders as updates, region and nation as path."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("fiware_servicepath"))
    c = c.join(places, c.c_nationkey == places.n_nationkey).select("c_custkey", "fiware_servicepath")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.lit(None).cast("string").alias("tenant"), F.lit("Customer").alias("entity_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_id"), "fiware_servicepath",
        F.col("o_orderdate").cast("timestamp").alias("time_index"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderkey",
    )


def geo_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a place of their own: a point, a line to the east or a square, as GeoJSON with its extent."""
    c = read(spark, sf_dir, "customer")
    lon, lat = (F.col("c_custkey") * 37 % 3500) / 10.0 - 175, (F.col("c_custkey") * 53 % 1600) / 10.0 - 80
    g = c.select("c_custkey", (F.col("c_custkey") % 3).alias("shape"), lon.alias("lon"), lat.alias("lat"))
    wide, high = F.when(F.col("shape") == 0, 0.0).otherwise(1.0), F.when(F.col("shape") == 2, 1.0).otherwise(0.0)
    p = lambda x, y: F.array(x, y)
    x, y, x1, y1 = F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(p(x, y), p(x1, y)).alias("coordinates")))
    square = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(p(x, y), p(x1, y), p(x1, y1), p(x, y1), p(x, y))).alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), p(x, y).alias("coordinates")))
    return g.select(
        F.lit("Shop").alias("entity_type"), F.concat(F.lit("shop"), F.col("c_custkey").cast("string")).alias("entity_id"), "c_custkey",
        F.when(F.col("shape") == 0, point).when(F.col("shape") == 1, line).otherwise(square).alias("location"),
        x.alias("min_lon"), y.alias("min_lat"), (x + wide).alias("max_lon"), (y + high).alias("max_lat"),
        F.struct((x + wide / 2).alias("lon"), F.when(F.col("shape") == 2, y + 0.4).otherwise(y).alias("lat")).alias("mean"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notification body for each event: fine ones, and by the event's id ones without data, id, type or values."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.concat(
        F.lit('{"subscriptionId":"s1",'), F.when(i % 20 == 1, F.lit('"nodata"')).otherwise(F.lit('"data"')), F.lit(':[{'),
        F.when(i % 20 == 2, F.lit("")).otherwise(F.concat(F.lit('"id":"user:'), F.col("user_id").cast("string"), F.lit('",'))),
        F.when(i % 20 == 3, F.lit("")).otherwise(F.concat(F.lit('"type":"'), "event_type", F.lit('",'))),
        F.lit('"TimeInstant":{"type":"DateTime","value":"'), stamp, F.lit('"},'),
        F.lit('"Value":{"type":"Number","value":'), F.when(i % 20 == 4, F.lit('" "')).otherwise(F.col("value").cast("string")), F.lit("},"),
        F.lit('"kind":{"type":"Integer","value":'), F.get_json_object("props", "$.k"), F.lit("},"),
        F.lit('"even":{"value":'), (i % 2 == 0).cast("string"), F.lit("},"),
        F.lit('"note":{"type":"Text","value":""},"empty":{},"eid":{"type":"Integer","value":'), i.cast("string"), F.lit("}}]}"),
    )
    return e.select("event_id", body.alias("body"), F.when(i % 3 == 0, F.lit("/a,/b")).otherwise(F.lit("/a")).alias("path_header"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: the label is the event type, the process one of four."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("measurement"), F.col("event_type").alias("label"), (F.col("user_id") % 4).cast("int").alias("pid"), "event_id")


#: The same views in SQL.
SQL = {
    "es": """es as (select 'acme' as tenant, event_type as entity_type, 'user:' || user_id as entity_id, '/g' || (user_id % 5) || '/u' || (user_id % 25) as fiware_servicepath,
  ts as time_index, 'urn:ngsi-ld:' || event_id as instance_id, value, regexp_extract(props, '"k"\\s*:\\s*(-?\\d+)', 1)::bigint as k, event_id, user_id from events)""",
    "ss": """ss as (select 'Supplier' as entity_type, 's' || l_suppkey as entity_id, l_shipdate as time_index, l_quantity as quantity, l_extendedprice as price,
  l_returnflag as flag, l_orderkey, l_linenumber from lineitem)""",
    "os": """os as (select 'Customer' as entity_type, 'c' || o_custkey as entity_id, '/' || r_name || '/' || n_name as fiware_servicepath, o_orderdate as time_index,
  o_totalprice as total, o_orderstatus as status, o_orderpriority as priority, o_orderkey
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "gs": """gs as (select 'shop' || c_custkey as entity_id, c_custkey, c_custkey % 3 as shape, (c_custkey * 37 % 3500) / 10.0::double - 175 as x, (c_custkey * 53 % 1600) / 10.0::double - 80 as y,
  x + case when c_custkey % 3 = 0 then 0 else 1 end as x1, y + case when c_custkey % 3 = 2 then 1 else 0 end as y1 from customer)""",
}


def iso_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00'"
