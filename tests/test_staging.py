"""Ingest stages its rows in files: no executor holds them between passes, and nothing stays behind."""

import json
import os

import pytest

from tracery.operators import ingest as steps
from tracery.sources import store
from tracery.streaming import jobs


@pytest.fixture
def cached(spark, monkeypatch):
    """Bytes that are cached each time a type's rows are made."""
    seen, pivot = [], steps.pivot_attributes

    def watched(*args):
        seen.append(sum(x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
        return pivot(*args)

    monkeypatch.setattr(steps, "pivot_attributes", watched)
    spark.catalog.clearCache()
    return seen


def bodies():
    value = lambda i, k: {"type": "Text", "value": f"{i * 7919 + k * 104729:032d}"}
    kinds = ["a b/c=d", "é", "__HIVE_DEFAULT_PARTITION__", ""]
    return [json.dumps({"data": [{"id": f"e{i}", "type": kinds[i % 4]} | {f"x{k}": value(i, k) for k in range(20)}]}) for i in range(2000)] + ["{"]


def check(spark, path, cached):
    # the catalog's few rows may be cached
    assert cached and max(cached) < 50_000
    assert not [f for _, _, files in os.walk(f"{path}/staged") for f in files]
    assert {t: store.read_table(spark, path, t).count() for t in store.entity_types(spark, path)} == dict.fromkeys(["a b/c=d", "é", "__HIVE_DEFAULT_PARTITION__"], 500)
    assert store.read_table(spark, path, "é").where("entity_id = 'e5' and x3 = '{:032d}'".format(5 * 7919 + 3 * 104729)).count() == 1


def test_batch_is_not_cached(spark, tmp_path, cached):
    store.ingest_bodies(spark, f"{tmp_path}/s", spark.createDataFrame([(b,) for b in bodies()], "body string"))
    check(spark, f"{tmp_path}/s", cached)
    assert store.read_refused(spark, f"{tmp_path}/s").count() == 1


@pytest.fixture
def streamed(spark, tmp_path, cached):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(bodies()))
    jobs.stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/s", f"{tmp_path}/log").awaitTermination()
    return f"{tmp_path}/s"


def test_dead_letters_of_a_stream_are_whole(spark, streamed, cached):
    found = store.read_dead_letters(spark, streamed).collect()
    assert max(cached) < 50_000 and len(found) == 500 and {r["error"] for r in found} == {"missing type"}
    assert all(json.loads(r["raw_entity"])["id"] == r["entity_id"] and len(json.loads(r["raw_entity"])) == 22 for r in found)


def test_rows_of_a_stream_are_not_cached(spark, streamed, cached):
    check(spark, streamed, cached)


def test_attributes_of_a_stream_are_not_cached(spark, streamed, cached):
    assert max(cached) < 50_000
    rows = store.read_table(spark, streamed, "é").select("entity_id", *[f"x{k}" for k in range(20)]).collect()
    assert {tuple(r) for r in rows} == {(f"e{i}", *[f"{i * 7919 + k * 104729:032d}" for k in range(20)]) for i in range(1, 2000, 4)}
