import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.operators import filters, ingest, query
from tracery.sources import store, tables
from tracery.streaming import jobs


def bodies(spark, *data):
    return spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in data], "body string")


ROOM = {"id": "Room1", "type": "Room", "temperature": {"type": "Number", "value": 24.2, "metadata": {}}, "pressure": {"type": "Number", "value": 720}}


def test_bodies_without_data_are_dropped(spark):
    rows = ingest.parse_bodies(bodies(spark, {"data": [ROOM, ROOM]}, {"subscriptionId": "x"}, "no json", {"data": []}))
    assert [(r["entity_id"], r["position"]) for r in rows.collect()] == [("Room1", 0), ("Room1", 1)]


def test_validation(spark):
    bad = [{"type": "t"}, {"id": "i"}, {"id": "i", "type": "t", ingest.RESERVED: {"value": 1}}, ROOM]
    found = ingest.validate_entities(ingest.parse_bodies(bodies(spark, {"data": bad})))
    assert [r["error"] for r in found.collect()] == ["missing id", "missing type", "reserved attribute", None]


def test_values(spark):
    attrs = {"text": {"type": "Text", "value": ""}, "blank": {"type": "Number", "value": " "}, "zero": {"type": "Number", "value": 0}, "none": {"type": "Number", "value": None}, "missing": {"type": "Number"}, "no": {"value": False}}
    row = ingest.parse_bodies(bodies(spark, {"data": [{"id": "i", "type": "t", **attrs}]}))
    found = row.select(F.transform_values("attrs", lambda _, a: ingest.has_value(a)).alias("m")).first()["m"]
    assert found == {"text": True, "blank": False, "zero": True, "none": False, "missing": False, "no": True}
    nulled = ingest.null_missing_values(row).select(F.transform_values("attrs", lambda _, a: F.to_json(a)).alias("m")).first()["m"]
    assert json.loads(nulled["blank"]) == {"type": "Number"}


def test_empty_entities_and_untyped_attributes(spark):
    data = [{"id": "a", "type": "t", "x": {"type": "Number", "value": " "}}, {"id": "b", "type": "t", "x": {"value": 0}, "y": {}, "z": 3}]
    rows = ingest.drop_empty_entities(ingest.drop_untyped_attrs(ingest.parse_bodies(bodies(spark, {"data": data}))))
    assert [(r["entity_id"], sorted(r["attrs"])) for r in rows.collect()] == [("b", ["x"])]


def test_service_paths(spark):
    two = {"data": [ROOM, ROOM]}
    rows = bodies(spark, two, two, two).withColumn("n", F.monotonically_increasing_id())
    rows = bodies(spark, two).crossJoin(spark.createDataFrame([("/a",), ("/a, /b",), ("/a,/b,/c",)], "path_header string"))
    found = ingest.assign_service_path(ingest.parse_bodies(rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r["path_header"], []).append((r["fiware_servicepath"], r["path_error"] is None))
    assert by == {"/a": [("/a", True)] * 2, "/a, /b": [("/a", True), ("/b", True)], "/a,/b,/c": [(None, False)] * 2}


def test_catalog_and_wide_rows(spark):
    later = {"id": "Room2", "type": "Room", "Temperature": {"type": "Text", "value": "warm"}, "tags": {"value": ["a", 1]}, "seen": {"type": "DateTime", "value": "2020-01-01T00:00:00Z"}}
    rows = ingest.ingest(bodies(spark, {"data": [ROOM]}))
    catalog = ingest.infer_schema(rows)
    more = ingest.infer_schema(ingest.ingest(bodies(spark, {"data": [later]})))
    merged = ingest.evolve_schema(catalog, more)
    schema = ingest.collect_schema(merged, "Room")
    assert schema == [("pressure", "pressure", "Number"), ("seen", "seen", "DateTime"), ("tags", "tags", "Array"), ("temperature", "temperature", "Number")]
    wide = ingest.pivot_attributes(ingest.ingest(bodies(spark, {"data": [ROOM, later]})), schema).orderBy("entity_id").collect()
    assert (wide[0]["temperature"], wide[0]["tags"]) == (24.2, None)
    assert (wide[1]["temperature"], wide[1]["tags"], wide[1]["seen"].year) == (None, ["a", "1"], 2020)


def test_rejects(spark):
    rows = ingest.validate_entities(ingest.parse_bodies(bodies(spark, {"data": [{"type": "t"}, ROOM]})))
    good, bad = ingest.split_rejected(rows, "b1")
    assert good.count() == 1
    assert [(r["failed_batch_id"], r["error"]) for r in bad.collect()] == [("b1", "missing id")]


def requests(spark):
    """One good and one nameless entity with a path for both, and the same two with three paths."""
    made = bodies(spark, {"data": [ROOM, {"type": "t", "x": {"value": 1}}]}).crossJoin(spark.createDataFrame([("/a",), ("/a,/b,/c",)], "path_header string"))
    return ingest.ingest(made)


def test_entities_of_requests_with_wrong_paths_become_wide_rows(spark):
    rows = requests(spark).where("error is null")
    wide = ingest.pivot_attributes(rows, [("pressure", "pressure", "Number")], ("entity_id", "fiware_servicepath", "path_error")).collect()
    assert sorted((r["pressure"], r["fiware_servicepath"] or "", r["path_error"] is None) for r in wide) == [(720.0, "", False), (720.0, "/a", True)]


def test_dead_letters_hold_no_requests_with_wrong_paths(spark, tmp_path):
    tables.dead_letter_sink(ingest.split_rejected(requests(spark), "b7")[1], str(tmp_path / "dead"))
    assert {(r["error"], r["failed_batch_id"]) for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {("missing id", "b7")}


def test_failed_batches_count_bad_entities_alone(spark):
    bad = ingest.split_rejected(requests(spark), "b7")[1]
    assert [tuple(r) for r in query.count_failed_batches(bad).collect()] == [("b7", 2)]


def test_cost_batches_golden():
    costs = [1, 7, 2, 3, 8, 5, 1, 2, 1]
    assert ingest.cost_batches(np.array(costs), 5).tolist() == [0, 1, 2, 2, 3, 4, 5, 5, 5]


@given(st.lists(st.integers(0, 20), max_size=40), st.integers(1, 30))
def test_cost_batches_hold(costs, most):
    found = ingest.cost_batches(np.array(costs, dtype=float), most)
    for b in set(found.tolist()):
        own = [c for c, k in zip(costs, found, strict=True) if k == b]
        assert sum(own) <= most or len(own) == 1
    assert sorted(found.tolist()) == found.tolist()


def test_batches_by_key(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([1, 7, 2, 3, 8])] + [("b", 0, 9)], "k string, i int, c int")
    found = ingest.batch_by_cost(df, ["k"], ["i"], "c", 5).orderBy("k", "i").collect()
    assert [r["batch"] for r in found] == [0, 1, 2, 2, 3, 0]


def test_store_and_delete(spark, tmp_path):
    rows = spark.createDataFrame([("t", "Room", f"r{i}", float(i)) for i in range(10)], "tenant string, entity_type string, entity_id string, x double")
    rows = rows.withColumn("time_index", F.make_timestamp(F.lit(2020), F.lit(1), (F.col("x") % 3 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    path = str(tmp_path / "series")
    tables.write_series(rows, path)
    assert tables.rewrite_partitions(spark, path, F.col("x").isin(0.0, 1.0, 4.0, 7.0)) == 4
    left = sorted(r["x"] for r in tables.read_series(spark, path, "T", "Room").collect())
    assert left == [2.0, 3.0, 5.0, 6.0, 8.0, 9.0]
    assert tables.read_series(spark, path, "other").count() == 0


def test_delete_reaches_every_partition(spark, tmp_path):
    rows = spark.createDataFrame([(t, k, f"r{i}", float(i)) for t in (None, "a:b") for k in ("ns:room 1", "Car") for i in range(4)], "tenant string, entity_type string, entity_id string, x double")
    rows = rows.withColumn("time_index", F.make_timestamp(F.lit(2020), F.lit(1), (F.col("x") % 2 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    path = str(tmp_path / "series")
    tables.write_series(rows, path)
    assert tables.rewrite_partitions(spark, path, (F.col("entity_type") == "ns:room 1") & (F.col("x") != 3)) == 6
    found = spark.read.parquet(path).collect()
    assert sorted((r["tenant"] or "", r["x"]) for r in found if r["entity_type"] != "Car") == [("", 3.0), ("a:b", 3.0)]
    assert sum(r["entity_type"] == "Car" for r in found) == 8


def test_delete_survives_a_crash(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("t", "Room", f"r{i}", float(i)) for i in range(10)], "tenant string, entity_type string, entity_id string, x double")
    rows = rows.withColumn("time_index", F.make_timestamp(F.lit(2020), F.lit(1), (F.col("x") % 3 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    path = str(tmp_path / "series")
    tables.write_series(rows, path)
    finish = tables.finish_rewrite
    calls = []

    def crash(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return finish(*args, **kwargs)

    monkeypatch.setattr(tables, "finish_rewrite", crash)
    with pytest.raises(RuntimeError):
        tables.rewrite_partitions(spark, path, F.col("x").isin(0.0, 3.0, 6.0, 9.0, 1.0))
    monkeypatch.setattr(tables, "finish_rewrite", finish)
    # the next delete puts the lost one in place first
    assert tables.rewrite_partitions(spark, path, F.col("x") == 2.0) == 1
    schema = "entity_id string, x double, time_index timestamp, tenant string, entity_type string, date date"
    assert sorted(r["x"] for r in tables.read_series(spark, path, "t", "Room", schema).collect()) == [4.0, 5.0, 7.0, 8.0]
    assert not (tmp_path / "series-rewrite").exists()
    dated = filters.filter_time_range(tables.read_series(spark, path), "2020-01-03", "2020-01-03T23:00:00Z")
    assert sorted(r["x"] for r in dated.collect()) == [5.0, 8.0]
    assert "PartitionFilters: [isnotnull(date" in dated._jdf.queryExecution().toString()


def test_csv(spark, tmp_path):
    (tmp_path / "mtt.etdevice.csv").write_text("entity_id,location,x\nd1,'{\"a\": [1,2]}',3.5\n")
    found = tables.load_csv_series(spark, str(tmp_path), "entity_id string, location string, x double").first()
    assert (found["location"], found["x"], found["table_name"]) == ('{"a": [1,2]}', 3.5, "mtt.etdevice")


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        data = [ROOM | {"id": f"r{i}", "TimeInstant": {"value": f"2020-01-0{i + 1}T00:00:00Z"}}, {"type": "t", "x": {"value": 1}}]
        (source / f"{i}.txt").write_text(json.dumps({"data": data}) + "\n")
    jobs.stream_ingest(spark, str(source), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert sorted(r["entity_id"] for r in store.read_table(spark, f"{tmp_path}/t", "Room").collect()) == ["r0", "r1", "r2"]
    assert store.read_dead_letters(spark, f"{tmp_path}/t").count() == 3


def test_late_rows_never_replace(spark):
    make = lambda *rows: spark.createDataFrame(rows, "entity_type string, entity_id string, time_index string, x int").withColumn("time_index", F.to_timestamp("time_index"))
    merged = jobs.merge_last(make(("t", "a", "2020-01-02", 1)), make(("t", "a", "2020-01-01", 9), ("t", "b", "2020-01-01", 5)), ["x"])
    assert {r["entity_id"]: r["x"] for r in merged.collect()} == {"a": 1, "b": 5}
