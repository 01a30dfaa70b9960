"""Operators that share one long series among many tasks, against plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.operators import costs, selection, shape, telemetry


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 15), st.integers(1, 9))
def test_chunks_compose(values, most, size):
    """Chunk by chunk, what a chunk's summary says is what the greedy cut does."""
    total, batch, expected = None, 0, costs.cost_batches(np.array(values, float), most)
    for a in range(0, len(values), size):
        own = np.array(values[a : a + size], float)
        ends, cuts, left, whole = costs.summary(own, most)
        k = 0 if total is None else int(np.searchsorted(ends, most - total, side="right"))
        if k == len(ends):
            total += whole
        else:
            batch, total = batch + int(cuts[k]) + (total is not None), left[k]
        z = a + len(own) - 1
        assert batch == expected[z]
        begin = int(np.flatnonzero(expected == batch)[0])
        assert total == sum(values[begin : z + 1])


def test_one_key_by_many_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(c)) for k, n in (("long", 6000), (None, 40), ("x", 1)) for i, c in enumerate(rng.integers(0, 40, n))]
    rows += [("dear", i, c) for i, c in enumerate([500.0, 0.0, None, -3.0, 100.0, 1.0, 99.0])]
    df = spark.createDataFrame(rows, "k string, i int, c double").withColumn("note", F.array(F.col("i"), F.lit(None)))
    batches = costs.batch_by_cost(df.repartition(7), ["k"], ["i"], "c", 100.0, chunk=64)
    found = batches.collect()
    assert batches.columns == ["k", "i", "c", "note", "batch"] and len(found) == len(rows)
    for k in ("long", None, "x", "dear"):
        own = sorted((r["i"], r["c"], r["batch"]) for r in found if r["k"] == k) if k != "dear" else sorted(((r["i"], r["c"] if r["c"] and r["c"] > 0 else 0.0, r["batch"]) for r in found if r["k"] == k))
        assert [b for *_, b in own] == costs.cost_batches(np.array([c for _, c, _ in own]), 100.0).tolist()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = df.repartitionByRange("k", "i").withColumn("p", F.spark_partition_id()).where("k = 'long'").groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 2
    assert costs.batch_by_cost(df.limit(0), ["k"], ["i"], "c", 100.0).count() == 0


@pytest.mark.parametrize("few", [1, 3, 50])
def test_percentiles_by_selection(spark, few):
    rng = np.random.default_rng(few)
    series = {
        "spread": rng.normal(size=700), "tied": np.repeat([1.0, 2.0, 2.0, 7.0], 100), "same": np.full(300, 4.0), "steep": 10.0 ** rng.integers(-300, 300, 200), "one": np.array([3.0]),
        "edges": np.array([-np.inf] * 20 + [np.inf] * 30 + [0.0] * 5), None: rng.integers(0, 9, 333).astype(float),
    }
    rows = [(k, float(x)) for k, xs in series.items() for x in xs] + [("spread", None), ("none", None)]
    df = spark.createDataFrame(rows, "label string, measurement double").repartition(5)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r["_g"]["label"]: r["_p"] for r in selection.percentiles(df, ("label",), "measurement", at, few).collect()}
    expected = {r["label"]: r["p"] for r in df.where("measurement is not null").groupBy("label").agg(F.percentile("measurement", F.array(*[F.lit(x) for x in at])).alias("p")).collect()}
    assert set(found) == set(expected) == set(series)
    for k in series:
        assert found[k] == pytest.approx(expected[k], rel=1e-12, nan_ok=True), k


def test_summary_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "label string, measurement double")
    found = {r["label"]: r for r in telemetry.series_summary(df).collect()}
    assert found["a"]["p50"] is None and found["a"]["n"] == 0 and found["b"]["p50"] == 2.0
    assert telemetry.series_summary(df.limit(0)).count() == 0
    whole = telemetry.series_summary(df, ()).first()
    assert (whole["n"], whole["p95"]) == (1, 2.0)


def test_chunks_and_pages(spark):
    when = F.timestamp_seconds((F.col("i") / 3).cast("long"))
    df = spark.createDataFrame([(t, e, i, float(i % 7) if i % 5 else None) for t, e, n in (("Room", "long", 1500), ("Room", "r", 3), (None, "r", 70)) for i in range(n)], "entity_type string, entity_id string, i int, v double")
    df = df.withColumn("time_index", F.when(F.col("i") > 1, when)).repartition(5)
    chunks = shape.series_chunks(df, ["v", "i"], ("i",), size=32)
    kept = {(r["entity_type"], r["entity_id"], r["start"]): r for r in chunks.collect()}
    assert chunks.columns == ["entity_type", "entity_id", "start", "index", "v", "i"] and max(len(r["index"]) for r in kept.values()) <= 32 and len(kept) >= 50
    for r in shape.flatten_chunks(chunks).collect():
        assert r["position"] == r["i"] and r["v"] == (float(r["i"] % 7) if r["i"] % 5 else None) and (r["time_index"] is None) == (r["i"] < 2)
    page = shape.series_page(chunks, 60, 20).collect()
    assert sorted((r["entity_id"], r["position"]) for r in page) == [("long", p) for p in range(60, 80)] + [("r", p) for p in range(60, 70)]
    assert shape.flatten_chunks(chunks).count() == df.count()
    assert shape.series_chunks(df.limit(0), ["v"]).count() == 0


def test_seconds_over_long_gaps(spark):
    rows = [("a", 10), ("a", 10), ("a", 9000), ("a", 20000), (None, 5), (None, 8), ("b", 3599), ("b", 3600)]
    df = spark.createDataFrame(rows, "label string, s long").select("label", F.timestamp_seconds("s").alias("time"))
    found = {(r["label"], r["s"]): r["n"] for r in telemetry.measurements_per_second(df).select("label", F.unix_timestamp("second").alias("s"), "n").collect()}
    assert len(found) == (20000 - 10 + 1) + 4 + 2
    assert {k: n for k, n in found.items() if n} == {("a", 10): 2, ("a", 9000): 1, ("a", 20000): 1, (None, 5): 1, (None, 8): 1, ("b", 3599): 1, ("b", 3600): 1}
