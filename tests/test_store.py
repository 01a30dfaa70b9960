"""The store of series: commits of several tables at once, the catalog between writers, deletes, snapshots and crashes."""

import json

import pytest
from pyspark.sql import functions as F

from tracery.sources import store
from tracery.streaming import jobs


def body(*entities):
    return json.dumps({"data": list(entities)})


def room(i, **attrs):
    return {"id": f"r{i}", "type": "ns:Room *1", "TimeInstant": {"value": f"2020-01-0{i % 3 + 1}T00:00:00Z"}} | attrs


GOOD = [body(room(0, temperature={"type": "Number", "value": 1.5}, date={"value": "own"})), body(room(1, Temperature={"type": "Number", "value": "2"}), {"id": "c", "type": "Car", "speed": {"value": 3}})]
BAD = ["not json", "", '{"data": []}', '{"nodata": 1}', '{"data": 3}', '{"data": [{"id": "x", "type": "t", "a": {"value": 1}, "a": {"value": 2}}]}', '{"data": [', None]


def frame(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def rows(spark, path, kind="ns:Room *1", **which):
    return sorted((r["entity_id"], r["temperature"]) for r in store.read_table(spark, path, kind, **which).collect())


def test_one_commit_has_everything(spark, tmp_path):
    path = str(tmp_path / "s")
    state = store.ingest_bodies(spark, path, frame(spark, *GOOD, *BAD, body({"type": "t", "x": {"value": 1}})))
    assert state["version"] == 1 and store.entity_types(spark, path) == ["Car", "ns:Room *1"]
    assert rows(spark, path) == [("r0", 1.5), ("r1", 2.0)]
    found = store.read_table(spark, path, "ns:Room *1").orderBy("entity_id").collect()
    assert (found[0]["attr_date"], str(found[0]["date"]), found[0]["tenant"]) == ("own", "2020-01-01", None)
    assert [r["speed"] for r in store.read_table(spark, path, "Car").collect()] == [3]
    refused = {r["refusal"]: r["n"] for r in store.read_refused(spark, path).groupBy("refusal").agg(F.count("*").alias("n")).collect()}
    assert refused == {"not JSON": 4, "no data": 3, "a key twice": 1}
    assert [r["error"] for r in store.read_dead_letters(spark, path).collect()] == ["missing id"]
    assert store.read_table(spark, path, "unknown").count() == 0 and "mergeSchema" not in str(found)


def test_paths_and_tenants(spark, tmp_path):
    path = str(tmp_path / "s")
    two = body(room(0, temperature={"value": 1.0}), room(1, temperature={"value": 2.0}))
    given = spark.createDataFrame([(two, "/a", "ACME"), (two, "/a, /b", None), (two, "/a,/b,/c", "acme")], "body string, path_header string, tenant string")
    store.ingest_bodies(spark, path, given)
    found = store.read_table(spark, path, "ns:Room *1").collect()
    assert sorted((r["tenant"] or "", r["entity_id"], r["fiware_servicepath"]) for r in found) == [("", "r0", "/a"), ("", "r1", "/b"), ("acme", "r0", "/a"), ("acme", "r1", "/a")]
    assert [r["refusal"] for r in store.read_refused(spark, path).collect()] == ["paths and entities differ in number"]
    assert len(rows(spark, path, tenant="Acme")) == 2


def test_a_retried_batch_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    put = store.put_if_absent

    def crash(*args):
        raise RuntimeError("lost")

    # lost after all tables were written, then between two of them
    monkeypatch.setattr(store, "put_if_absent", crash)
    with pytest.raises(RuntimeError):
        store.ingest_bodies(spark, path, frame(spark, *GOOD, *BAD), "s", 0)
    assert store.versions(spark, path) == [] and store.read_refused(spark, path).count() == 0
    monkeypatch.setattr(store, "put_if_absent", put)
    write = store._write
    monkeypatch.setattr(store, "_write", lambda df, base, parts=(): crash() if base.endswith("dead") else write(df, base, parts))
    with pytest.raises(RuntimeError):
        store.ingest_bodies(spark, path, frame(spark, *GOOD, *BAD), "s", 0)
    monkeypatch.setattr(store, "_write", write)
    for _ in range(2):
        store.ingest_bodies(spark, path, frame(spark, *GOOD, *BAD), "s", 0)
    assert store.versions(spark, path) == [1]
    assert rows(spark, path) == [("r0", 1.5), ("r1", 2.0)] and store.read_refused(spark, path).count() == len(BAD)
    assert store.vacuum(spark, path, seconds=0) > 0
    assert rows(spark, path) == [("r0", 1.5), ("r1", 2.0)]


def test_the_first_writer_names_the_type(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    put, calls = store.put_if_absent, []
    text = frame(spark, body(room(5, temperature={"type": "Text", "value": "warm"}, extra={"value": 1})))

    def late(*args):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first
            store.ingest_bodies(spark, path, frame(spark, *GOOD))
        return put(*args)

    monkeypatch.setattr(store, "put_if_absent", late)
    state = store.ingest_bodies(spark, path, text)
    assert state["version"] == 2 and len(calls) == 3
    assert rows(spark, path) == [("r0", 1.5), ("r1", 2.0), ("r5", None)]
    catalog = store.read_catalog(spark, path).where("entity_type <> 'Car'").collect()
    assert {(r["column"], r["ngsi_type"], r["since"]) for r in catalog if r["column"] != "timeinstant"} == {("temperature", "Number", 1), ("date", "Text", 1), ("extra", "Integer", 2)}
    assert len({r["column"] for r in catalog}) == len(catalog)


def test_put_if_absent(spark, tmp_path):
    (tmp_path / "f").mkdir()
    assert store.put_if_absent(spark, f"{tmp_path}/f/1.json", "a") and not store.put_if_absent(spark, f"{tmp_path}/f/1.json", "b")
    assert (tmp_path / "f/1.json").read_text() == "a"
    assert [p.name for p in (tmp_path / "f").iterdir() if "crc" not in p.name] == ["1.json"]


def make(spark, path, n=60):
    df = spark.range(n).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.when(F.col("id") % 2 == 0, "Acme").alias("tenant"),
        F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, cast(id % 4 as int))").alias("time_index"), F.col("id").alias("x"),
    )
    store.append_rows(spark, path, "ns:room", df)


def left(spark, path, **which):
    return sorted(r["x"] for r in store.read_table(spark, path, "ns:room", **which).collect())


def test_deletes_reach_every_partition(spark, tmp_path):
    path = str(tmp_path / "s")
    make(spark, path)
    make(spark, path, 6)
    assert store.delete_rows(spark, path, "ns:room", F.col("tenant").isNull() & (F.col("x") < 10)) == 5 + 3
    assert store.delete_rows(spark, path, "ns:room", F.col("x") % 10 == 0) == 6 + 1
    assert store.delete_rows(spark, path, "ns:room", F.col("x") == 1) == 0
    want = sorted([x for x in range(60) if x % 10 and not (x % 2 and x < 10)] + [2, 4])
    assert left(spark, path) == want and left(spark, path, version=2) == sorted([*range(60), *range(6)])
    assert left(spark, path, tenant="acme") == [x for x in want if x % 2 == 0]
    # an old reader keeps its files through a compaction
    old = store.read_table(spark, path, "ns:room")
    assert store.compact(spark, path, "ns:room") and not store.compact(spark, path, "ns:room")
    assert left(spark, path) == want and sorted(r["x"] for r in old.collect()) == want
    assert store.delete_rows(spark, path, "ns:room", F.col("x") == 59) == 1
    assert left(spark, path) == [x for x in want if x != 59]
    assert store.vacuum(spark, path, seconds=0) >= 3 and left(spark, path) == [x for x in want if x != 59]
    plan = store.read_table(spark, path, "ns:room").where("date = date'2020-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_date" in plan
    assert store.drop_table(spark, path, "ns:room") and not store.drop_table(spark, path, "ns:room")
    assert left(spark, path) == [] and store.delete_rows(spark, path, "ns:room", F.lit(True)) == 0


@pytest.mark.parametrize("other", ["append", "delete", "compact"])
def test_deletes_beside_other_commits(spark, tmp_path, monkeypatch, other):
    path = str(tmp_path / "s")
    make(spark, path, 20)
    make(spark, path, 20)
    put, calls = store.put_if_absent, []

    def late(*args):
        calls.append(1)
        if len(calls) == 1:
            {"append": lambda: make(spark, path, 4), "delete": lambda: store.delete_rows(spark, path, "ns:room", F.col("x") >= 18), "compact": lambda: store.compact(spark, path, "ns:room")}[other]()
        return put(*args)

    monkeypatch.setattr(store, "put_if_absent", late)
    assert store.delete_rows(spark, path, "ns:room", (F.col("x") < 2) | (F.col("x") == 19)) == {"append": 6, "delete": 4, "compact": 6}[other]
    gone = {0, 1, 19} | ({18} if other == "delete" else set())
    assert left(spark, path) == sorted([x for x in range(20) if x not in gone] * 2 + (list(range(4)) if other == "append" else []))


def test_a_lost_delete_leaves_all_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    make(spark, path, 8)
    put = store.put_if_absent
    monkeypatch.setattr(store, "put_if_absent", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.delete_rows(spark, path, "ns:room", F.lit(True))
    monkeypatch.setattr(store, "put_if_absent", put)
    assert left(spark, path) == list(range(8)) and store.delete_rows(spark, path, "ns:room", F.lit(True)) == 8 and left(spark, path) == []


def test_stream_commits_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join([*GOOD, "not json", '{"data": []}']) + "\n")
    for _ in range(2):
        jobs.stream_ingest(spark, str(source), f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    (source / "b.txt").write_text(body(room(7, temperature={"value": 9})) + "\n")
    jobs.stream_ingest(spark, str(source), f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    # the checkpoint is lost, not the store: batches that it has are not added again
    jobs.stream_ingest(spark, str(source), f"{tmp_path}/s", f"{tmp_path}/c2").awaitTermination()
    assert rows(spark, f"{tmp_path}/s") == [("r0", 1.5), ("r1", 2.0), ("r7", 9.0)]
    assert store.read_refused(spark, f"{tmp_path}/s").count() == 2 and store.versions(spark, f"{tmp_path}/s") == [1, 2]
