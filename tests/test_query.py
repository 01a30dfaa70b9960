import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracery.operators import filters, query, shape, telemetry
from tracery.plans import queries, views

BASE = dt.datetime(1970, 1, 1)


@pytest.fixture(scope="module")
def rooms(spark):
    rows = [("Room", f"Room{e}", BASE + dt.timedelta(days=i), float(i), 10.0 * i, "txt", True) for e in range(2) for i in range(30)]
    rows += [("Car", "Car0", BASE + dt.timedelta(days=i), float(i), None, "txt", True) for i in range(5)]
    return spark.createDataFrame(rows, "entity_type string, entity_id string, time_index timestamp, temperature double, pressure double, note string, on boolean").cache()


@pytest.mark.parametrize(("method", "expected"), [("count", 30), ("sum", 435.0), ("avg", 14.5), ("min", 0.0), ("max", 29.0)])
def test_golden_aggregates(rooms, method, expected):
    found = query.aggregate_entities(rooms, ["temperature"], method).where("entity_id = 'Room0'").first()
    assert found["temperature"] == expected


def test_period_sums_add_up(rooms):
    by_month = query.aggregate_by_period(rooms, ["pressure"], "sum", "month").groupBy("entity_id").agg(F.sum("pressure").alias("p"))
    whole = query.aggregate_entities(rooms, ["pressure"], "sum")
    assert sorted(by_month.collect()) == sorted(whole.select("entity_id", "pressure").collect())


def test_per_second_average(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [("t", f"e{i % 2}", start + dt.timedelta(milliseconds=100 * i), float(i)) for i in range(34)]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, time_index timestamp, x double")
    found = query.aggregate_by_period(df, ["x"], "avg", "second").orderBy("entity_id", "time_index").collect()
    assert [r["x"] for r in found] == [4, 14, 24, 31, 5, 15, 25, 32]


def test_measurements_per_second_of_all_events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    seconds = [("click", 0.2), ("click", 0.9), ("view", 3.0), ("click", 5 * 3600 + 0.5), ("view", 3 * 3600 + 7.1), ("view", 3.4), ("buy", 4 * 3600)]
    rows = [(k, start + dt.timedelta(seconds=s), k, e, 1.0, None) for k, (e, s) in enumerate(seconds)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = {(r["label"], r["second"].isoformat()): r["n"] for r in telemetry.measurements_per_second(views.telemetry(spark, str(tmp_path))).collect()}
    wanted = {}
    for label in ("click", "view", "buy"):
        own = [int(s) for e, s in seconds if e == label]
        wanted |= {(label, (start + dt.timedelta(seconds=s)).isoformat()): own.count(s) for s in range(min(own), max(own) + 1)}
    assert found == wanted
    hours = {}
    for (label, second), n in wanted.items():
        own = hours.setdefault((label, second[:13].replace("T", " ")), [])
        own.append(n)
    sums = {(r["label"], r["hour"]): (r["seconds"], r["n"], r["most"]) for r in queries.measurements_per_second(spark, str(tmp_path)).collect()}
    assert sums == {key: (len(own), sum(own), max(own)) for key, own in hours.items()}


def test_pages_lose_nothing(spark):
    rows = [("t", "a", k // 4, k) for k in range(17)] + [("t", "b", 1, 99)]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, time_index int, instance_id int")
    order = ("time_index", "entity_id", "instance_id")
    found, after = [], None
    while page := query.page_after(df, after, 5).collect():
        assert len(page) <= 5
        found += page
        after = {c: page[-1][c] for c in order}
    assert [tuple(r[c] for c in order) for r in found] == sorted(tuple(r[c] for c in order) for r in df.collect())


def test_delta_over_many_periods(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a" if k % 3 else "b", start + dt.timedelta(hours=7 * k + (k % 5 == 0) * 100), float(k * k % 17) if k % 6 else None, k) for k in range(60)] + [("c", None, 1.0, 60), ("c", start, 4.0, 61)]
    df = spark.createDataFrame(rows, "label string, time timestamp, measurement double, k int")
    found = {r["k"]: r["delta"] for r in telemetry.insert_delta(df, tie=("k",)).collect()}
    wanted = {}
    for label in "abc":
        own = sorted((r for r in rows if r[0] == label), key=lambda r: (r[1] or dt.datetime(1, 1, 1), r[3]))
        for before, r in zip([None, *own], own, strict=False):
            wanted[r[3]] = None if before is None or before[2] is None or r[2] is None else r[2] - before[2]
    assert found == wanted


def test_refused_aggregates(rooms):
    for attr in ("note", "on"):
        for method in ("sum", "avg"):
            with pytest.raises(ValueError, match=attr):
                query.aggregate_entities(rooms, [attr], method)
        query.aggregate_entities(rooms, [attr], "count")
    with pytest.raises(ValueError, match="method"):
        query.aggregate_entities(rooms, ["temperature"], "median")


def test_global_scope(rooms):
    found = {r["entity_type"]: r for r in query.aggregate_global(rooms, ["temperature"], "count").collect()}
    assert found["Room"]["temperature"] == 60
    assert found["Room"]["entity_ids"] == ["Room0", "Room1"]


def test_last_n_and_limit(rooms):
    car = rooms.where("entity_type = 'Car'")
    page = query.paginate(car, limit=3, last=5).orderBy("time_index").collect()
    assert [r["temperature"] for r in page] == [2.0, 3.0, 4.0]
    assert query.paginate(car, limit=0).count() == 0
    assert query.last_n(rooms, 3).count() == 6
    assert query.last_n_per_entity(rooms, 3).count() == 9


def test_last_value_forms_agree(rooms):
    columns = ["entity_type", "entity_id", "time_index", "temperature"]
    a = sorted(query.last_value(rooms, ["temperature"], ties=True).select(columns).collect())
    b = sorted(query.last_value_join(rooms, ["temperature"]).select(columns).collect())
    c = sorted(query.last_value(rooms, ["temperature"]).select(columns).collect())
    assert a == b == c


def test_last_value_ties(spark):
    rows = [("t", "e", BASE, 1), ("t", "e", BASE, 2)]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, time_index timestamp, x int")
    assert query.last_value(df, ["x"], ties=True).count() == 2
    assert query.last_value(df, ["x"]).first()["x"] == 2


def test_service_paths(spark):
    rows = [("Rome", "/eu/italy"), ("Berlin", "/eu/germany"), ("Athens", "/eu/greece/athens"), ("Patras", "/eu/greece/patras"), ("None", None)]
    df = spark.createDataFrame(rows, "entity_id string, fiware_servicepath string")
    counts = {p: filters.filter_service_path(df, p).count() for p in ("/eu", "/eu/germany", "/EU/greece", "/eu/g", "/eu/greece/athens", "/", "")}
    assert counts == {"/eu": 4, "/eu/germany": 1, "/EU/greece": 2, "/eu/g": 0, "/eu/greece/athens": 1, "/": 5, "": 1}


def test_filters(rooms, spark):
    assert filters.filter_time_range(rooms, "1970-01-02", "'1970-01-03'").where("entity_id = 'Room0'").count() == 2
    with pytest.raises(ValueError, match="ISO"):
        filters.filter_time_range(rooms, "drop table")
    many = [f"Room{i}" for i in range(500)]
    assert filters.filter_entity_ids(rooms, many).count() == filters.filter_entity_ids(rooms, ["Room0", "Room1"]).count() == 60
    assert filters.filter_id_pattern(rooms, "ROOM[1-9]").count() == 30
    assert filters.filter_entity_type(rooms, "car, bike").count() == 5


def test_ambiguous_type(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "entity_type string, entity_id string")
    with pytest.raises(ValueError, match="several"):
        filters.single_entity_type(df, "x")
    assert filters.single_entity_type(df, "y") == "a"
    assert filters.single_entity_type(df, "z") is None


@pytest.mark.parametrize("bad", [{"options": "keyValues"}, {"method": "sum"}, {"period": "day"}, {"attrs": ["a"], "method": "sum", "period": "week"}, {"attrs": ["a"], "method": "x"}])
def test_bad_params(bad):
    with pytest.raises(ValueError):
        filters.validate_query_params(**bad)


def test_series(rooms):
    found = shape.to_series(rooms, ["temperature", "pressure", "temperature"]).where("entity_id = 'Car0'").first()
    assert found["temperature"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert found["pressure"] == [None] * 5
    assert len(found["index"]) == 5


def test_nested_shapes(rooms):
    few = rooms.where("time_index < '1970-01-03'")
    one = shape.series_by_type_one_attr(few, "temperature", ["Room1"]).where("entity_type = 'Room'").first()
    assert [e["entity_id"] for e in one["entities"]] == ["Room1", "Room0"]
    deep = shape.series_attrs_by_types(few, ["temperature", "pressure"]).first()["attrs"]
    assert [a["attr_name"] for a in deep] == ["pressure", "temperature"]
    assert [t["entity_type"] for t in deep[1]["types"]] == ["Car", "Room"]
    assert deep[1]["types"][1]["entities"][0]["values"] == ["0.0", "1.0"]


def test_deletes(rooms):
    kept, gone = query.delete_entities(rooms, entity_type="room", ids=["Room0"], to="1970-01-10")
    assert (kept.count(), gone.count()) == (55, 10)
    assert query.drop_type(rooms, "ROOM").count() == 5
    with pytest.raises(ValueError, match="root"):
        query.drop_type(rooms, "Room", "/a")


def test_empty_table(rooms):
    none = rooms.limit(0)
    assert query.aggregate_entities(none, ["temperature"], "sum").count() == 0
    assert query.last_value(none, ["temperature"]).count() == 0
    assert shape.to_series(none, ["temperature"]).count() == 0
