"""Keyed streams of very many entities: Python is called for a bucket or not at all, not for each entity."""

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_streams import arrive, keyed  # noqa: F401

from tracery.streaming import jobs


def test_months_need_no_python_and_close_at_their_ends(keyed, tmp_path):  # noqa: F811
    files = [
        [("t", "a", "2020-01-05", 1, None), ("t", "b", "2020-03-11", 2, None)],
        # the watermark is the first of March: this batch closes January and February, and the next one takes no rows of theirs
        [("u", "a", "2020-03-02", 1, None)],
        [("t", "a", "2020-02-29 23:59:59", 4, "late"), ("t", "a", "2020-03-01", 8, None), ("t", "a", None, 16, None)],
    ]
    rows = arrive(keyed, f"{tmp_path}/in", *files)
    found = jobs.stream_period_aggregate(rows, "x", "month", "10 days")
    assert "InPandas" not in found._jdf.queryExecution().analyzed().toString()
    write = lambda b, k: b.withColumn("v", F.lit(k)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
    found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["entity_type"] + r["entity_id"], str(r["time_index"].date()), r["n"], r["total"]) for r in keyed.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("ta", "2020-01-01", 1, 1), ("ta", "2020-03-01", 1, 8), ("tb", "2020-03-01", 1, 2), ("ua", "2020-03-01", 1, 1)]


def test_last_values_take_a_bucket_in_one_call():
    kept, timers = {}, set()
    state = SimpleNamespace(exists=lambda: bool(kept), getValue=kept.get, updateValue=kept.__setitem__, iterator=lambda: iter(list(kept.items())), removeKey=kept.pop)
    handle = SimpleNamespace(getMapState=lambda *_: state, registerTimer=timers.add)
    text, day = T.StringType(), 86_400_000
    newest = jobs._Newest(T.StructType([T.StructField("entity_type", text), T.StructField("entity_id", text)]), T.StructType([T.StructField("time_index", T.TimestampType()), T.StructField("x", T.LongType())]), 32 * day)
    newest.init(handle)
    frame = lambda rows: pd.DataFrame([("t", e, pd.Timestamp(t), x) for e, t, x in rows], columns=["entity_type", "entity_id", "time_index", "x"])
    call = lambda *batches: [tuple(r)[1:] for f in newest.handleInputRows((0,), iter(map(frame, batches)), None) for r in f.itertuples(index=False)]
    first = pd.Timestamp("2020-01-01")
    assert call([(f"e{i}", first, i) for i in range(500)] + [("e1", "2020-01-01", 9)], [("e2", "2019-12-31", 99)]) == [(f"e{i}", first, 9 if i == 1 else i) for i in range(500)]
    assert len(timers) == 1 and len(kept) == 500
    # a later row, a late one, an equal one, and a new entity without a value
    assert call([("e3", "2020-02-01", 5), ("e4", "2019-01-01", 5), ("e5", first, 5), ("n", first, None)])[:1] == [("e3", pd.Timestamp("2020-02-01"), 5)]
    assert kept["t", "e4"][1] == 4 and kept["t", "n"][1] is None and len(timers) == 2
    list(newest.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: min(timers))))
    assert list(kept) == [("t", "e3")]
