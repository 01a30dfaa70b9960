"""Streams with keyed state: the same rows as a batch job, and state that empties."""

import pytest
from pyspark.sql import functions as F

from tracery.operators import query
from tracery.streaming import jobs

SCHEMA = "entity_type string, entity_id string, time_index timestamp, x long, name string"


@pytest.fixture
def keyed(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.needs_keyed_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def arrive(spark, folder, *files):
    """A stream that reads one file a batch, in order."""
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "entity_type string, entity_id string, t string, x long, name string").withColumn("time_index", F.to_timestamp("t")).select("entity_type", "entity_id", "time_index", "x", "name")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/part={k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def state_rows(query_):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query_.recentProgress if p["stateOperators"]]


FILES = [
    [("t", "a", "2020-01-05", 1, None), ("t", "a", "2020-01-31 23:59:59", 5, "b"), ("t", "b", "2020-01-07", None, "c"), ("u", "a", "2020-02-01", 4, None)],
    [("t", "a", "2020-01-06", 7, "late"), ("t", "a", "2020-02-29", 2, None), ("t", "a", "2020-02-29", 2, "z"), ("t", "b", "2020-02-03", 3, None)],
    [("t", "a", "2020-06-01", 9, "x")],
    [("t", "c", "2020-06-02", None, None)],
]


def test_months_close(keyed, tmp_path):
    rows = arrive(keyed, f"{tmp_path}/in", *FILES)
    found = jobs.stream_period_aggregate(rows, "x", "month", "10 days")
    write = lambda b, k: b.withColumn("v", F.lit(k)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
    q = found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    newest = keyed.read.parquet(f"{tmp_path}/out").groupBy("entity_type", "entity_id", "time_index").agg(F.max(F.struct("v", "n", "total", "least", "most")).alias("r"))
    got = sorted((r["entity_type"], r["entity_id"], str(r["time_index"].date()), *r["r"][1:]) for r in newest.collect())
    batch = keyed.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    keys = ["entity_type", "entity_id", F.date_trunc("month", "time_index").alias("m")]
    want = batch.groupBy(*keys).agg(F.count("x"), F.sum("x"), F.min("x"), F.max("x")).collect()
    assert got == sorted((r[0], r[1], str(r[2].date()), *r[3:]) for r in want)
    # January and February are gone once the watermark has passed March
    assert state_rows(q)[-1] == 2


def test_last_values(keyed, tmp_path):
    rows = arrive(keyed, f"{tmp_path}/in", *FILES)
    q = jobs.stream_last_value(rows, ["x", "name"], f"{tmp_path}/last", f"{tmp_path}/log", idle="30 days", late="60 days")
    q.awaitTermination()
    batch = keyed.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    want = sorted(map(repr, query.last_value(batch, ["x", "name"]).collect()))
    assert sorted(map(repr, jobs.read_last_value(keyed, f"{tmp_path}/last").collect())) == want
    jobs.compact_last_value(keyed, f"{tmp_path}/last", f"{tmp_path}/small")
    assert sorted(map(repr, jobs.read_last_value(keyed, f"{tmp_path}/small").collect())) == want
    # b and u's a have been idle since February; a row an entity, not one for each update
    assert max(state_rows(q)) <= 4 and state_rows(q)[-1] == 2
    # each batch wrote only what changed
    assert keyed.read.parquet(f"{tmp_path}/last").groupBy("batch").count().where("batch = 3").first()["count"] == 1
